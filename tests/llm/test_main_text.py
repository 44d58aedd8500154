import html
import random
import re
import time

from cohortlens.llm.main_text import extract, main_text


def test_pages_give_exactly_their_article(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in main_text(pages).collect()}
    for row in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", row["html"], re.S)[1].replace("<br>", " ").replace("<b>", "").replace("</b>", "")
        parts = [re.sub(r"\s+", " ", html.unescape(x)).strip() for x in re.split(r"</?(?:p|h1)>", inner)]
        assert got[row["page_id"]] == "\n\n".join(x for x in parts if x)


def test_parts_beside_the_text_are_left_out():
    story = "<h2>Head</h2><p>A long sentence, with marks, of the story. It goes on; and on.</p><ul><li>one</li></ul><p>Short.</p>"
    beside = (
        "<nav>menu, menu</nav><div class='site-header'>top</div><aside>side, text, with. marks.</aside><form>mail? <input></form>"
        "<div id=cookie-notice><p>We use cookies, yes. Agree?</p></div><div class='ad'><p>Buy, buy, buy.</p></div>"
        "<section class='comments'><p>First! A comment, long enough, to look like text. Really.</p></section>"
        "<style>p{}</style><script>if (a<b) x='</p>'</script><footer>end</footer><!-- <p>gone</p> -->"
    )
    want = "Head\n\nA long sentence, with marks, of the story. It goes on; and on.\n\none\n\nShort."
    for shell in ("<article>{}</article>", "<main>{}</main>", "<div id=content>{}</div>", "<div><div class=post>{}</div></div>"):
        assert extract(f"<html><head><title>t</title></head><body>{beside}{shell.format(story)}{beside}</body></html>") == want


def test_tolerance():
    assert extract("") == "" and extract("<p></p> ") == "" and extract("<") == "<"
    assert extract("a <b>b</b>c&#33; &lt;i&gt; &nbsp;d") == "a bc! <i> d"
    assert extract("<p>one<p>two<div>three</p></div></b>four <a href='x") == "one\n\ntwo\n\nthree\n\nfour"
    assert extract("<script>never closed <p>x") == "" and extract("x<!-- never closed <p>y") == "x"
    assert extract("<div>" * 30_000 + "deep, text." + "</div>" * 30_000) == "deep, text."
    assert extract("<p title='a>b'>in quotes</p>") == "in quotes"


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (1, "u", "", "x"), (None, None, "<p>hello", None)], "page_id long, url string, html string, text string")
    assert sorted(map(tuple, main_text(df).collect()), key=str) == sorted([(1, "u", ""), (1, "u", ""), (None, None, "hello")], key=str)
    assert main_text(df.where("false")).collect() == []


def test_text_outside_the_largest_branch():
    long = "<p>A long sentence, with marks, of the story. It goes on; and on, and on.</p>"
    line = "A long sentence, with marks, of the story. It goes on; and on, and on."
    body = "<html><body>{}<div>Imprint</div></body></html>"
    assert extract(body.format(f"<div><h1>Title</h1><div>{long * 5}</div></div>")) == "\n\n".join(["Title"] + [line] * 5)
    # 65 and 35 % in two containers, also with other tags inside the smaller one
    for other in (long * 7, "<section>" + long * 7 + "</section>"):
        for page in (f"<div><div>{long * 13}</div><div>{other}</div></div>", f"<div><div>{other}</div><div>{long * 13}</div></div>"):
            assert extract(body.format(page)).split("\n\n") == [line] * 20
    two = f"<main><h1>Title</h1><article>{long * 13}</article><p>between</p><article><h2>Next</h2>{long * 3}</article></main>"
    assert extract(body.format(two)) == "\n\n".join(["Title"] + [line] * 13 + ["Next"] + [line] * 3)
    assert extract(body.format(two.replace("main", "div"))) == "\n\n".join([line] * 13 + ["Next"] + [line] * 3)


LONG = "<p>A long sentence, with marks, of the story. It goes on; and on, and on.</p>"


def test_form_that_holds_the_page_is_no_input_form():
    assert extract(f"<body><form><input>{LONG * 20}</form></body>").count("A long") == 20
    assert extract(f"<body><form><article>{LONG * 3}</article></form></body>").count("A long") == 3
    assert extract(f"<body><article>{LONG * 3}<form><label>Your mail, please.</label></form></article></body>").count("mail") == 0


def test_formulas_stay_and_drawings_do_not_split():
    page = "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be <svg><text>no</text></svg>. And so.</p></article>"
    assert extract(page) == "Let x=2 be . And so."


def test_names_are_a_prior():
    """They lose against text without them, but neither an article's own parts nor a page of one name."""
    inner = f"<div class='related-work'>{LONG}</div><p class='notice'>Mind this part of the story, please, and that.</p>"
    assert extract(f"<article>{LONG}{inner}{LONG}</article>").count("\n\n") == 3
    assert extract(f"<div id='content' class='content-sidebar'>{LONG * 5}</div><div>Imprint</div>").count("A long") == 5
    assert extract(f"<article>{LONG * 4}<div class='comment-list'>{LONG * 3}</div></article>").count("A long") == 4
    assert extract(f"<article>{LONG}<div style='display:none'>{LONG}</div></article>").count("A long") == 2


def test_deep_and_hostile_pages_take_linear_time():
    shapes = ["<div>x" * 20_000, "<p><article>" + "<div>x" * 20_000, "<li><ol>" + "<div>" * 20_000 + "<li>x</li>" * 20_000, "<form>" * 20_000 + "x", '<a "' * 200_000]
    shapes += ["<b>" * 20_000 + "x" + "</b>" * 20_000, f"<div class='{'comment ' * 100_000}'>x</div>", "<!--" * 200_000, "<p>" + "a, " * 300_000]
    for page in shapes:
        began = time.process_time()
        extract(page)
        assert time.process_time() - began < 2


def brute_ratios(parts):
    """Blocks (path, text) of a flat page: those on paths whose length and punctuation per block, smoothed, reach a tenth of the core's."""
    by = {}
    for path, text in parts:
        by.setdefault(path, []).append(text)
    ratio = [sum(map(len, by[p])) / len(by[p]) for p, _ in parts]
    marks = [sum(len(re.findall(r"[.,;:!?]", t)) for t in by[p]) / len(by[p]) for p, _ in parts]

    def smooth(x):
        x = [x[0], *x, x[-1]]
        return [x[i - 1] / 4 + x[i] / 2 + x[i + 1] / 4 for i in range(1, len(x) - 1)]

    fused = [a * (1 + b) for a, b in zip(smooth(ratio), smooth(marks))]
    sizes = [len(t) for _, t in parts]
    floor = 0.1 * sum(f * n for f, n in zip(fused, sizes)) / sum(sizes)
    good = {p for (p, _), f in zip(parts, fused) if f >= floor}
    return [t for p, t in parts if p in good]


def test_generated_pages_without_article():
    rnd = random.Random(4)
    kept = dropped = 0
    for _ in range(300):
        parts = []
        for _ in range(rnd.randrange(6, 30)):
            tag = rnd.choices(["p", "blockquote", "pre", "dt"], [8, 3, 2, 4])[0]
            n = {"p": rnd.randrange(20, 60), "blockquote": rnd.randrange(5, 40), "pre": rnd.randrange(1, 4), "dt": 1}[tag]
            parts.append((tag, " ".join(rnd.choice(["some", "words,", "here.", "text"]) if tag != "dt" else "tag" for _ in range(n))))
        page = "<html><body><div>" + "".join(f"<{t}>{x}</{t}>" for t, x in parts) + "</div></body></html>"
        want = brute_ratios(parts)
        got = extract(page).split("\n\n")
        # What stands between two blocks of content stays as well.
        first, last = parts.index((next(t for t, x in parts if x == want[0]), want[0])), len(parts) - 1 - [x for _, x in parts][::-1].index(want[-1])
        assert got == [x for _, x in parts[first : last + 1]]
        kept, dropped = kept + len(got), dropped + len(parts) - len(got)
    assert kept and dropped
