"""DuckDB SQL that must give the rows of the queries of the same name."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op10_near_duplicates"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END)) AS h FROM w),
n AS (SELECT w.doc_id, count(h) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
r AS (
  SELECT doc_id AS id, doc_id AS root FROM n
  UNION
  SELECT e.y, r.root FROM r JOIN e ON e.x = r.id)
SELECT n.doc_id, n.n AS n_shingles, min(r.root) AS component_id, min(r.root) = n.doc_id AS kept
FROM n JOIN r ON r.id = n.doc_id GROUP BY n.doc_id, n.n
"""

ORACLES["op8_decontamination"] = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
b AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[s:s + n - 1], ' ') AS t FROM (
    SELECT item_id, ws, least(len(ws), 13) AS n, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS s
    FROM i WHERE len(ws) > 0)),
d AS (
  SELECT doc_id, s, n, array_to_string(ws[s:s + n - 1], ' ') AS t FROM (
    SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s
    FROM w, (SELECT DISTINCT n FROM b) WHERE len(ws) >= n)),
o AS (SELECT d.doc_id, d.s, d.n, b.item_id FROM d JOIN b ON d.t = b.t AND d.n = b.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM o) GROUP BY doc_id),
k AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM o) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w.ws) AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id)
"""

ORACLES["op6_line_spread"] = r"""
WITH l AS (
  SELECT doc_id, source, text, pos, trim(lower(regexp_replace(parts[pos], '[\x09-\x0D\x20]+', ' ', 'g'))) AS line
  FROM (SELECT doc_id, source, text, parts, unnest(range(1, len(parts) + 1)) AS pos
        FROM (SELECT doc_id, source, text, string_split(text, chr(10)) AS parts FROM documents))),
n AS (
  SELECT *, 2 * len(string_split(line, ' ')) + len(regexp_extract_all(line, '[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]')) >= 100 AS long
  FROM l WHERE line <> ''),
b AS (
  SELECT line, min({'d': doc_id, 'p': pos}) AS first FROM n GROUP BY line, long
  HAVING count(DISTINCT source) >= CASE WHEN long THEN 3 ELSE 10 END OR (long AND count(DISTINCT (doc_id, text)) >= 4)),
k AS (
  SELECT l.doc_id, count(*) AS n, count(*) FILTER (NOT gone) AS kept,
         string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone) AS left_text
  FROM (SELECT l.*, string_split(l.text, chr(10))[pos] AS raw,
               b.line IS NOT NULL AND NOT (b.first.d = l.doc_id AND b.first.p = l.pos) AS gone
        FROM l LEFT JOIN b ON l.line = b.line) l GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_lines, coalesce(n - kept, 0) AS n_removed,
       length(CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(left_text, '') END) AS n_chars_left,
       sha256(CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(left_text, '') END) AS text_sha256
FROM documents d LEFT JOIN k USING (doc_id)
"""


_TARGET = "t_{0} AS (SELECT {0} AS value, pow(t, {1}) / sum(pow(t, {1})) OVER () AS target FROM (SELECT {0}, sum(tokens)::DOUBLE AS t FROM c0 GROUP BY {0}))"

ORACLES["op7_mixing"] = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
         CASE WHEN regexp_matches(text, '(?i)licensed under|released under|all rights reserved') THEN 'licence'
              WHEN contains(text, ' | ') THEN 'table'
              WHEN regexp_matches(text, '###|\*\*\*|\$\$\$|%%%|&&&') THEN 'symbols'
              WHEN contains(text, '!!') THEN 'shouting' WHEN contains(text, '@') THEN 'contact' ELSE 'prose' END AS topic,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / pow(2, 52) AS draw
  FROM documents),
c0 AS (
  SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens, sum(n_tokens)::DOUBLE AS share
  FROM d GROUP BY 1, 2, 3 HAVING sum(n_tokens) > 0),
{_TARGET.format("source", 0.5)}, {_TARGET.format("lang", 0.3)}, {_TARGET.format("topic", 0.5)},
it AS (
  SELECT 0 AS step, c0.*, a.target AS of_source, b.target AS of_lang, c.target AS of_topic
  FROM c0 JOIN t_source a ON source = a.value JOIN t_lang b ON lang = b.value JOIN t_topic c ON topic = c.value
  UNION ALL SELECT step + 1, source, lang, topic, tokens,
    share * (CASE step % 3 WHEN 0 THEN of_source WHEN 1 THEN of_lang ELSE of_topic END)
      / sum(share) OVER (PARTITION BY CASE step % 3 WHEN 0 THEN source WHEN 1 THEN lang ELSE topic END), of_source, of_lang, of_topic
  FROM it WHERE step < 192),
fitted AS (SELECT * FROM it WHERE step = 192),
r AS (SELECT source, lang, topic, share * (SELECT sum(tokens) FROM c0) * 0.5 / tokens AS ratio FROM fitted),
p AS (
  SELECT d.*, CASE WHEN n_tokens = 0 THEN 1.0 ELSE least(1.0, ratio) END AS chance,
         CASE WHEN n_tokens = 0 THEN 0.0 ELSE greatest(1.0, ratio) END AS w
  FROM d LEFT JOIN r USING (source, lang, topic))
SELECT doc_id, source, lang, topic, n_tokens, round(chance::DOUBLE, 6) AS probability, round(w::DOUBLE, 6) AS weight,
       draw < chance AS kept FROM p
"""

ORACLES["op3_quality_cascade"] = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
t AS (SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
p AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS c FROM t) WHERE c > 1)
  GROUP BY doc_id),
c AS (
  SELECT doc_id, text, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(ls) AS n_lines,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^a-z]', '', 'g')) AS n_lower,
         len(regexp_extract_all(text, '\p{L}[^\x20\x09-\x0D]*')) AS n_letter_words
  FROM w LEFT JOIN p USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines OR n_upper > n_lower
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 5 * n_letter_words < 4 * n_words
            OR contains(lower(text), 'lorem ipsum')) AS kept
FROM f
"""

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op11_collocations"] = rf"""
WITH p AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWERED}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
  FROM p, (SELECT unnest([1, 2, 3, 4]) AS k)),
every AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM every WHERE k = 1 GROUP BY lang),
f AS (SELECT *, string_split(phrase, ' ') AS ws FROM every WHERE a >= 30),
inside AS (
  SELECT lang, phrase, max(longer) AS longer FROM (
    SELECT lang, a AS longer, array_to_string(ws[i:i + m - 1], ' ') AS phrase
    FROM f, (SELECT unnest([2, 3]) AS m), (SELECT unnest([1, 2, 3]) AS i) WHERE m < k AND i + m - 1 <= k)
  GROUP BY lang, phrase),
c AS (SELECT f.* FROM f LEFT JOIN inside USING (lang, phrase) WHERE k > 1 AND (longer IS NULL OR 100 * longer < 80 * a)),
cuts AS (
  SELECT c.lang, c.phrase, c.a, j, x.a AS l, y.a AS r, CAST((2000000::HUGEINT * c.a) // (x.a + y.a) AS BIGINT) AS score
  FROM c JOIN (SELECT unnest([1, 2, 3]) AS j) ON j < k
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:j], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[j + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best JOIN totals USING (lang) QUALIFY rank <= 2000
"""

ORACLES["op12_ranked_search"] = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
t AS (SELECT row, w, count(*) AS tf FROM (SELECT row, unnest(ws) AS w FROM d) GROUP BY ALL),
s AS (SELECT count(*) AS nd, CAST(sum(len(ws)) AS BIGINT) AS nt FROM d WHERE len(ws) > 0),
m AS (SELECT row, doc_id, 50 + (50 * len(ws) * nd) // nt AS m FROM d, s WHERE len(ws) > 0),
df AS (SELECT w, count(*) AS df FROM t GROUP BY w),
wt AS (SELECT w, CAST(floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS weight FROM df, s),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w
  FROM benchmark WHERE item_id IS NOT NULL),
r AS (
  SELECT item_id, row, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM q JOIN wt USING (w) JOIN t USING (w) JOIN m USING (row) GROUP BY item_id, row, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM r WHERE score > 0 QUALIFY rank <= 50
"""

_ESCAPED = "replace(replace(replace({0}, '\\', '\\\\'), '</turn>', '<\\/turn>'), '###', '\\###')"

ORACLES["op13_chat_format"] = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (
  SELECT *, '### ' || replace({_ESCAPED.format("role")}, ':' || chr(10), ':\' || chr(10)) || ':' || chr(10) || {_ESCAPED.format("text")} || '</turn>' || chr(10) AS formatted
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(formatted)) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
