from pyspark.sql import functions as F

from brindle.functions.markup import clean_html, looks_like_html, markdown, page_content, read_markdown, render

PAGE = """<html><head><title>T</title><script>var x = "<p>no</p>";</script></head><body><h2>Course <b>on</b> soil</h2>
<p>First &amp; best, see <a href="/courses/a">A</a>, <a href="../b?x=1">B</a>,
<a href="#top">Top</a> and <a href="mailto:a@b.example">Mail</a>.</p>
<ul><li>one</li><li>two<ol><li>inner</li></ol></li></ul><img src="pic.png" alt="diagram"><img src="data:x" alt="d">
<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td><a href="/courses/a">again</a></td></tr></table>
<pre>run  --in x</pre></body></html>"""
BASE = "https://h.example/x/y/z.html"


def test_markdown():
    text, links = markdown(PAGE, BASE)
    assert links == [("https://h.example/courses/a", "A"), ("https://h.example/x/b?x=1", "B")]
    for part in (
        "## Course **on** soil", "First & best, see [A](https://h.example/courses/a), [B](https://h.example/x/b?x=1), Top and Mail.", "- one\n- two\n  1. inner",
        "![diagram](https://h.example/x/y/pic.png)![d](data:x)", "| a | b |\n| --- | --- |\n| 1 | [again](https://h.example/courses/a) |", "```\nrun  --in x\n```",
    ):
        assert part in text, part
    assert "var x" not in text and "\n\n\n" not in text
    for odd in ("", "<", "<a href=", "</p></td></ul>", "<td>x<tr>", "<a href='http://[bad'>x</a>", "<ul>" * 500 + "x"):
        assert isinstance(markdown(odd, BASE)[0], str) and isinstance(clean_html(odd, BASE), str)


def test_clean_html():
    text = clean_html(PAGE, BASE)
    for part in ('<a href="https://h.example/courses/a">', '<a href="#top">', 'src="https://h.example/x/y/pic.png"', 'src="data:x"', "<h2>"):
        assert part in text, part
    assert "script" not in text


def test_modes(spark):
    df = spark.createDataFrame([(1, PAGE, BASE, 0), (2, None, BASE, 0), (3, "", None, 0)], "id long, html string, url string, text int")
    shown = {r.id: r.c for r in df.select("id", page_content(F.col("html"), F.col("url")).alias("c")).collect()}
    raw = {r.id: r.c for r in df.select("id", page_content(F.col("html"), F.col("url"), raw=True).alias("c")).collect()}
    assert shown[1].links == raw[1].links and len(raw[1].links) == 2 and raw[1].text == clean_html(PAGE, BASE)
    assert shown[2].text is None and shown[3].text == "" and shown[3].links == []


def test_render():
    lines = render("<div><p>a<p>b</div></div></p>c<")
    assert [line.text for line in lines] == ["abc<"]
    assert len(render("<div>" * 20_000 + "x")) == 1
    assert looks_like_html("<section>" + "words " * 1000 + "</section><p>End.</p>")
    kinds = [(line.kind, line.text) for line in read_markdown("# T\n\ntext\n- item\n| a |\n    code\n**B**")]
    assert kinds == [("h1", "T"), ("text", "text"), ("li", "item"), ("row", "| a |"), ("code", "code"), ("h2", "B")]
