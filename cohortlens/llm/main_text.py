"""Main text of a web page by tag-path ratios.

The page is cut into text blocks, each under its root-to-leaf path of tags. Per path, text length and
punctuation are summed and set against the number of blocks; both ratios are smoothed along the
page, fused, and lifted to every ancestor. The core is the deepest element that keeps most of the
fused weight, or the article around it; paths under it whose fused ratio is not below the threshold are content. So are
blocks beside it whose path passes the threshold by its own ratio, headings before, and what stands between. Where the
core is an article, other articles count by the same threshold and the rest of the page does not. Elements that are
never article text (menus, page headers, asides, scripts) are known by tag; a form is one unless most of the
page's weight lies in it. Words in class, id or role are a prior: they lower the weight of a path, so that it loses against text of
its length without them, and don't decide where all text of a page has them.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The core keeps at least this share of the page's fused weight.
ROOT_SHARE = 0.6
#: A path is content from this share of the core's mean fused ratio on.
PATH_SHARE = 0.1
#: The same inside an article for paths whose names say nothing against them.
ARTICLE_SHARE = 0.005
#: How much more text counts inside an element that the page itself calls its article or main part.
NAMED_FACTOR = 4.0
HEADINGS = frozenset(f"h{k}" for k in range(1, 7))
SMOOTH = np.array([0.25, 0.5, 0.25])
#: Weight of text under a class word of parts beside the article; the second where the word may belong to an article's own part.
PRIOR, WEAK_PRIOR = 0.01, 0.25
#: A form with this share of the page's weight holds the page and is no input form.
FORM_SHARE = 0.5

# Elements by what they hold
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg".split())
NEVER = RAW | frozenset("nav header footer aside button select option datalist dialog menu head object audio video canvas".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup svg time tt u var wbr img math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover "
    "mstyle mpadded mtable mtr mtd mspace semantics".split()
)
SECTIONING = frozenset("article main section".split())
CLOSED_BY_BLOCK = frozenset("p".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# Words in class, id or role that name a part beside the article
BESIDE = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies disqus "
    "footer header masthead menu modal nav navbar navigation newsletter notice notification pagination pager popup promo promoted "
    "recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription toolbar widget".split()
)
# Words that begin names of an article's own parts as well ("related-work"), and elements that hold one passage
AMBIGUOUS = frozenset("banner header masthead modal notice notification recommended related reply respond search share sharing skip social sponsored".split())
PASSAGES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption".split())
LISTS = frozenset("ul ol dl table select".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)|(?P<text>[^<]++|<)",
    re.DOTALL,
)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}
_NAMING = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…、。！，？]")
#: White space of HTML; a no-break space is white space of a text as well.
_SPACE = re.compile(r"\s+")


class Block(NamedTuple):
    element: int
    text: str


class Page(NamedTuple):
    """Blocks in page order, and per element its parent, tag, interned tag path, prior and innermost form (0: none)."""

    blocks: list[Block]
    parent: list[int]
    tag: list[str]
    path: list[int]
    prior: list[float]
    form: list[int]


def _prior(attrs: str, tag: str, in_article: bool) -> float:
    """Prior of an element by its class, id and role words."""
    lowest = 1.0
    for m in _NAMING.finditer(attrs):
        value = m[1] or m[2] or m[3] or ""
        # Each name counts as a whole or by its first or last word: "site-footer", "comment-list".
        for name in value.lower().split():
            parts = _WORD.findall(name)
            if not parts or parts[0] not in BESIDE and parts[-1] not in BESIDE:
                continue
            first_only = parts[-1] not in BESIDE
            weak = in_article and (tag in PASSAGES or first_only and parts[0] in AMBIGUOUS)
            lowest = min(lowest, WEAK_PRIOR if weak else PRIOR)
    return lowest


def read_page(page: str) -> Page:
    """The page's text blocks and elements. Text of elements that are never article text is left out here.

    An inline element does not end a block. Time and memory grow with the length of the page, however deep it nests.
    """
    out = Page([], [-1], [""], [0], [1.0], [0])
    paths: dict[tuple[int, str], int] = {}
    stack: list[tuple[int, str, bool]] = [(0, "", False)]  # id, tag, is it or an ancestor of it left out
    open_tags: dict[str, int] = {}
    # Open paragraphs since the last sectioning element, and open siblings since the last list.
    paragraphs, siblings = [0], [{}]
    holder = [0]  # innermost element of each stack entry that is not inline
    buffer: list[str] = []
    element = pos = 0

    def flush() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(buffer))).strip()
        buffer.clear()
        if text:
            out.blocks.append(Block(element, text))

    def push(e: int, tag: str, left_out: bool) -> None:
        stack.append((e, tag, left_out))
        holder.append(holder[-1] if tag in INLINE else e)
        open_tags[tag] = open_tags.get(tag, 0) + 1
        if tag == "p":
            paragraphs[-1] += 1
        elif tag in SECTIONING:
            paragraphs.append(0)
        if tag in SIBLINGS:
            siblings[-1][tag] = siblings[-1].get(tag, 0) + 1
        elif tag in LISTS:
            siblings.append({})

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            tag = stack.pop()[1]
            holder.pop()
            open_tags[tag] -= 1
            if tag == "p":
                paragraphs[-1] -= 1
            elif tag in SECTIONING:
                paragraphs.pop()
            if tag in SIBLINGS:
                siblings[-1][tag] -= 1
            elif tag in LISTS:
                siblings.pop()

    def depth_of(names: set[str] | frozenset[str]) -> int:
        return next(d for d in range(len(stack) - 1, 0, -1) if stack[d][1] in names)

    while pos < len(page):
        m = _TOKEN.match(page, pos)
        pos = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        closing = bool(m["close"] or m["close2"])
        text = m["text"]
        if text is not None:
            if not stack[-1][2]:
                if not buffer:
                    element = holder[-1]
                buffer.append(text)
            continue
        if not name:
            continue
        if name == "br":
            buffer.append(" ")
            continue
        if name not in INLINE:
            flush()
        if closing:
            if open_tags.get(name):
                pop_to(depth_of({name}))
            continue
        attrs = m["attrs"] if m["name"] else m["attrs2"]
        if name not in INLINE and paragraphs[-1]:
            pop_to(depth_of(CLOSED_BY_BLOCK))
        if name in SIBLINGS and any(siblings[-1].get(x) for x in SIBLINGS[name]):
            pop_to(depth_of(SIBLINGS[name]))
        if name in VOID or attrs.endswith("/") and name in ("svg", "math"):
            continue
        in_article = bool(open_tags.get("article") or open_tags.get("main"))
        # A header inside the article holds its heading; that of the page does not.
        left_out = stack[-1][2] or name in NEVER and not (name == "header" and in_article)
        prior = 1.0 if name in ("html", "body", "article", "main") else _prior(attrs, name, in_article)
        up, e = stack[-1][0], len(out.parent)
        out.parent.append(up)
        out.tag.append(name)
        out.prior.append(min(prior, out.prior[up]))
        out.path.append(out.path[up] if name in INLINE else paths.setdefault((out.path[up], name), len(paths) + 1))
        out.form.append(e if name == "form" else out.form[up])
        push(e, name, left_out)
        if name in RAW:  # no markup counts before its end tag
            end = _RAW_END[name].search(page, pos)
            pos = end.start() if end else len(page)
    flush()
    return out


def _below(page: Page, marked: set[int]) -> np.ndarray:
    """Whether each element is marked or lies in a marked one; parents come before their children."""
    out = [0 in marked] * len(page.parent)
    for e in range(1, len(page.parent)):
        out[e] = e in marked or out[page.parent[e]]
    return np.array(out)


def _lifted(page: Page, element: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Sum of the blocks' values in each element, children before their parents."""
    total = np.bincount(element, value, len(page.parent)).tolist()
    for e in range(len(page.parent) - 1, 0, -1):
        total[page.parent[e]] += total[e]
    return np.array(total)


def _smooth(x: np.ndarray) -> np.ndarray:
    return np.convolve(np.pad(x, 1, mode="edge"), SMOOTH, "valid")


def path_ratios(page: Page, element: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each block its path (equal numbers, equal tags and prior), and its path's text and punctuation per block."""
    keys = list(zip(np.array(page.path)[element].tolist(), np.array(page.prior)[element].tolist()))
    number = {k: i for i, k in enumerate(dict.fromkeys(keys))}
    path = np.array([number[k] for k in keys])
    count = np.bincount(path)
    length = np.bincount(path, [len(t) for t in texts]) / count
    marks = np.bincount(path, [len(_PUNCTUATION.findall(t)) for t in texts]) / count
    return path, length[path], marks[path]


def extract(source: str) -> str:
    """Content blocks of a page, joined by an empty line; empty if there are none."""
    page = read_page(source)
    element = np.array([b.element for b in page.blocks], int)
    texts = [b.text for b in page.blocks]
    forms = np.array(page.form)[element] if texts else element
    if forms.any():
        # Each form by itself: the weight of its text without any other rule.
        path, ratio, punctuation = path_ratios(page, element, texts)
        share = _lifted(page, element, ratio * (1 + punctuation) * np.array(page.prior)[element])
        inputs = {int(f) for f in set(forms.tolist()) - {0} if share[f] < FORM_SHARE * share[0]}
        kept = np.flatnonzero(~_below(page, inputs)[element])
        element, texts = element[kept], [texts[k] for k in kept]
    if not texts:
        return ""
    path, ratio, punctuation = path_ratios(page, element, texts)
    prior = np.array(page.prior)[element]
    named = {e for e, tag in enumerate(page.tag) if tag in ("article", "main")}
    fused = _smooth(ratio) * (1 + _smooth(punctuation)) * prior * np.where(_below(page, named)[element], NAMED_FACTOR, 1.0)
    weight = _lifted(page, element, fused).tolist()
    children: dict[int, list[int]] = {}
    for e in range(1, len(page.parent)):
        if weight[e] > 0:
            children.setdefault(page.parent[e], []).append(e)
    root = 0
    while children.get(root):
        best = max(children[root], key=lambda e: (weight[e], -e))
        # A single paragraph among others is not a container.
        if weight[best] < ROOT_SHARE * weight[0] or not children.get(best) and len(children[root]) > 1:
            break
        root = best
    around, at_root = {root}, root
    while page.parent[at_root] > 0:
        at_root = page.parent[at_root]
        around.add(at_root)
    up = max(around & named, default=0)
    root = up or root
    mine = _below(page, {root})[element]
    sizes = np.array([len(t) for t in texts], float)
    share = np.where(prior == 1, ARTICLE_SHARE, PATH_SHARE) if up else PATH_SHARE
    floor = share * float(np.average(fused[mine], weights=sizes[mine]))
    good = np.zeros(path.max() + 1, bool)
    good[path[mine & (fused >= floor)]] = True
    # Beside the core a path counts by itself, not by the text next to it.
    own = ratio * (1 + punctuation)
    passes = own * prior >= PATH_SHARE * float(np.average(own[mine], weights=sizes[mine]))
    content = mine & good[path]
    if up:
        reach = content
        outer = {e for e in around if e < root}
        others = _lifted(page, element, passes.astype(float))
        holding = {e for e in named - outer - {root} if others[e]}
        beside = _below(page, holding)[element] & ~mine
        content = content | beside & (passes | (prior == 1))
        # A heading outside belongs to the article if both are in the page's main part.
        reach = content | _below(page, named & outer)[element] & ~mine
        at = np.flatnonzero(content).tolist()
    else:
        at = np.flatnonzero(content | passes & ~mine).tolist()
        reach = np.ones(len(texts), bool)
        # What stands between content is content, unless its names or its ratio under the core say otherwise.
        content = ~mine & (prior == 1) | passes & ~mine | content | mine & (prior == 1)
    # A heading belongs to what follows it.
    first = at[0] if at else 0
    while first and reach[first - 1] and page.tag[element[first - 1]] in HEADINGS:
        first -= 1
    return "\n\n".join(texts[k] for k in range(first, at[-1] + 1) if content[k] or k < at[0]) if at else ""


def _extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(t.as_py() or "") for t in batch.column("html")]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(batch.num_columns - 1)), pa.array(texts, pa.string())], [*batch.schema.names[:-1], "text"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text. A NULL or empty page gives the empty text.

    Markup is read tolerantly: tags left open, closed twice or cut off at the end of the page are no error.
    Equal rows give equal results; other columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(_extract_batches, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
