import random

import pytest
from pyspark.sql import functions as F

from brindle.llm.boilerplate import bodies, body_text, described, form_of

WORDS = {lang: [f"{lang}{a}{b}" for a in ("mir", "tol", "vak", "zun", "pel") for b in ("ido", "esk", "arn", "umi")] for lang in "abcde"}


def page(rnd, lang, k, markdown):
    """(text, body lines): a page of one of five invented languages; the same notices, menus and sidebar headings on all pages of a language."""
    w = WORDS[lang]

    def sentence():
        return " ".join(rnd.sample(w, 5)).capitalize() + f" {rnd.randrange(99)}."

    def fixed(*i):
        return " ".join(w[x] for x in i).capitalize()

    notice = [f"{fixed(0, 1, 2)} Site{lang.upper()} {rnd.randrange(9)}. {fixed(3, 4)} this.", fixed(5, 6), f"{fixed(7, 8)}: {fixed(9)} | {fixed(10)}"]
    body = [("h", f"Title {k} {lang}")]
    for part in range(3):
        body.append(("h", fixed(11 + part, 12 + part)))
        body += [("p", " ".join(sentence() for _ in range(rnd.choice([1, 1, 2, 3])))) for _ in range(3)]
        body.append(("p", fixed(16, 17) + "."))
        body.append(("p", f"{fixed(16, 17)}. {sentence()}"))
    side = [("h", fixed(18, 19)), ("a", f"/courses/{k}"), ("p", sentence()), ("a", f"/courses/x{k}")]
    rows = [(x, True) for x in body]
    for n in notice[1:]:
        rows.insert(rnd.randrange(2, len(rows)), (("p", n), False))
    before, after = rnd.random() < 0.5, [(("p", notice[0]), False)]
    rows = [(x, False) for x in side] + rows + after if before else rows + [(x, False) for x in side] + after
    rows = [(("a", "/menu"), False)] + rows
    if markdown:
        lines = [{"h": "## " if t[0] != "T" else "# ", "p": "", "a": "- [x y](https://h.example"}[kind] + t + (")" if kind == "a" else "") for (kind, t), _ in rows]
    else:
        lines = [{"h": f"<h{1 if t[0] == 'T' else 2}>{t}</h2>", "p": f"<p>{t}</p>", "a": f'<li><a href="{t}">x y</a></li>'}[kind] for (kind, t), _ in rows]
    return "\n".join(lines), {i for i, (_, is_body) in enumerate(rows) if is_body}


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(7)
    return [(f"{lang}{k}", *page(rnd, lang, k, k % 2 == 0)) for lang in "abcde" for k in range(40)]


def score(df, corpus, **more):
    got = {r.key: set(r.lines) for r in bodies(df, ["key"], **more).collect()}
    both = sum(len(got[k] & t) for k, _, t in corpus)
    return both / sum(len(t) for *_, t in corpus), both / sum(map(len, got.values()))


def test_languages_without_lists(spark, corpus):
    """Five languages nobody made lists of; with the recurrence switched off the notices stay in."""
    df = spark.createDataFrame([(k, t, "clash") for k, t, _ in corpus], "key string, text string, lines string")
    recall, precision = score(df, corpus)
    assert recall >= 0.98 and precision >= 0.98, (recall, precision)
    assert score(df, corpus, recurring=10**9)[1] < 0.95


def test_copies_do_not_recur(spark, corpus):
    """A page fetched many times is one page: its own lines aren't notices."""
    key, text, body = corpus[1]
    df = spark.createDataFrame([(f"c{i}", text) for i in range(60)], "key string, text string")
    assert all(body <= set(r.lines) for r in bodies(df, ["key"]).collect())


PAGE = """<html><head><title>Course on soil | Example Hub</title></head>
<body>
<nav>
<li><a href="/help">Help</a></li>
</nav>
<div class="b2">
<p>Help › News › Course on soil</p>
<h1>Course on soil</h1>
<p>First &amp; best.
Second line of it.</p>
<p hidden>Not shown.</p>
<li><a href="/courses/x">A link of the body</a>
<li>An item of the body.
<table><tr><td>Sand</td><td>12</td></tr>
<tr><td>Loam and clay</td><td>7</td></tr></table>
<button>Accept all</button>
<pre><code>run --in a.csv</code></pre>
</div>
<aside>
<h2>Related materials</h2>
<li><a href="/courses/z">Z</a></li>
<p>Long text of a sidebar. It has two sentences.</p>
</aside>
<div>Example Hub</div>
<footer>© 2020 Example Hub. All rights reserved.</footer>
</body></html>"""


def test_layout(spark):
    want = ["<h1>", "First &amp;", "Second line", "A link of", "An item", "Sand", "Loam", "<pre>"]
    df = spark.createDataFrame([(1, PAGE, 5), (1, PAGE, 5), (2, None, 5), (3, "", 5), (4, "<div>" * 5000 + "x", 5), (5, "word. " * 100_000, 5)], "page_id long, html string, no int")
    found = bodies(df, ["page_id"], "html")
    got = {r.page_id: r.lines for r in found.collect()}
    assert got == {1: [i for i, line in enumerate(PAGE.split("\n")) if any(w in line for w in want)], 2: [], 3: [], 4: [0], 5: [0]}
    text = df.distinct().join(found, "page_id").select("page_id", body_text(F.col("html"), F.col("lines")).alias("t")).where("page_id = 1").first().t
    assert "# Course on soil" in text and "- A link of the body\n- An item of the body." in text and "Sand          | 12\nLoam and clay | 7" in text
    assert bodies(df.limit(0), ["page_id"], "html").count() == 0


def test_forms():
    assert form_of("Found a mistake? Tell the Doflould web team, 12-7.") == "found a mistake * the * web team 0"
    assert form_of("") == form_of("?!") == "" and described(None)[1] == [] and described(" \n ")[1] == []
    assert described("x\n" * 2 + "the longest line")[0] == described("the longest line\ny")[0]
