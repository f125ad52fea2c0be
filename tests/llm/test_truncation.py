from brindle.llm.truncation import ending, opening_of, cut_texts

WHOLE = [
    None, "", "  ", "N/A", "...", "```json\n```", "[]", '{"a": "b. c"}', 'Here is it:\n```json\n{"a": ["x"]}\n```', "A sentence. Another one!",
    "It ends with an aside (see below).", "He said “so.”", "**Title only**", "It is well known and so on ...", "```\nI'm sorry.\n```",
    '{"a": "brace } in \\" text"}', "- one item.\n- another item.",
]
CUT = [
    "It stops within a wo", "Two sentences. The second st", '{"a": "b', '```json\n{"a": [1, 2', "The end is nea…", "The end is [truncated]",
    "broken ch�", 'Here:\n{"a": {"b": "c"}, ', "**Title**\n- A short ex", "See https://courses.exa",
]


def test_endings():
    for t in WHOLE:
        assert ending(t, host="courses.example")[0] == "whole", t
    for t in CUT:
        assert ending(t, host="courses.example")[0] == "cut", t


def test_page_endings():
    for t in ("text.\n| a | 1 |", "* [Link](https://x.example/a)", "Text ends here.", "[a](b) (c)"):
        assert ending(t, page=True)[0] == "whole", t
    for t in ("One ends. The other does n", "text\n| a | b", "* [Link tha"):
        assert ending(t, page=True)[0] == "cut", t
    for t in ("Text.\n## Heading", "Back to top", "    run --in x", "at https://x.example/a"):
        assert ending(t, page=True)[0] == "open", t
    assert opening_of("- Questions about the wor") == "Questions about"


def test_frame(spark):
    page = "Questions about one are gathered. " * 3 + "Questions about two are answered.\nBack to top\n"
    rows = [("r", i, "s", "It is a prompt.", '{"a": 1}', page + "Ad") for i in range(9)]
    rows += [("r", 20, "s", "It is a pro", None, ""), ("r", 20, "s", "It is a pro", None, "")]
    rows += [("r", 21, None, None, '{"a": ', page + "Questions about all are gath")]
    # 64 characters end two different prompts of a source: an address there is cut
    for i in (30, 31):
        rows.append(("r", i, "t.example", f"Take {i}. URL: https://t.example/".ljust(80, "x"), None, None))
    rows.append(("r", 32, "t.example", "Take 32. URL: https://t.example/whole", None, None))
    df = spark.createDataFrame([(*r, 1) for r in rows], "run_id string, id int, source string, p string, q string, k string, field int")
    got = {(r.id, r.field) for r in cut_texts(df, ["p", "q", "k"], ["k"]).where("cut").collect()}
    assert got == {(20, "p"), (21, "q"), (21, "k"), (30, "p"), (31, "p")}
    assert cut_texts(df.limit(0), ["p", "q", "k"], ["k"]).count() == 0


def test_every_limit(spark):
    """A source that moved from 80 to 96 characters has two limits; one longer text hides none, equal lengths of whole texts make none."""
    rows = [(i, "m.example", f"Take {i}. URL: https://m.example/".ljust(80, "x")) for i in range(10, 12)] + [(i, "m.example", f"Take {i} of the words".ljust(80, "x")) for i in range(12, 15)]
    rows += [(i, "m.example", f"Take {i}. URL: https://m.example/".ljust(96, "y")) for i in range(20, 22)] + [(i, "m.example", f"Take {i} of the words".ljust(96, "y")) for i in range(22, 25)]
    rows += [(30, "m.example", "It is a longer text. " * 9), (31, "m.example", "Take 31. URL: https://m.example/whole".ljust(88, "z"))]
    rows += [(i, "n.example", f"Take {i}. It is a whole sentence".ljust(79, "w") + ".") for i in range(40, 50)] + [(51, "n.example", "Take 51. URL: https://n.example/".ljust(80, "v")), (52, "n.example", "It is a longer text. " * 9)]
    df = spark.createDataFrame([("r", *r) for r in rows], "run_id string, id int, source string, p string")
    assert {r.id for r in cut_texts(df, ["p"], []).where("cut").collect()} == {*range(10, 15), *range(20, 25)}
