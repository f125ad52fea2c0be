import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators.schema_drift import canonical_names, changes, consistent_table, flatten_one, settled_scores
from brindle.sources.scratch import Scratch

SCHEMA = "id long, url string, structural_summary string, origin string, file_seq int, field string"


def rows_of(files, origin="a"):
    out = []
    for seq, objects in files.items():
        for k, o in enumerate(objects):
            out.append((seq * 100 + k, f"u{k}", o if o is None or isinstance(o, str) else json.dumps(o), origin, seq, "clash"))
    return out


def base(k, **more):
    return {"name": f"n{k}", "count": k, "seen": k % 2 == 0, "parts": [{"title": f"t{k}{j}", "at": {"x": j}} for j in range(2)], **more}


def ren(o, old, new):
    return {new if key == old else key: v for key, v in o.items()}


FILES = {
    1: [base(k) for k in range(6)],
    2: [base(k) for k in range(2)] + [base(k, extra=None) for k in range(2, 6)] + [None, "{broken"],
    4: [ren(base(k, extra=1), "name", "label") for k in range(6)],
    5: [ren({**base(k, extra=1), "count": str(k), "parts": [ren(p, "title", "heading") for p in base(k)["parts"]]}, "name", "label") for k in range(6)],
    6: [None],
    7: [ren({key: v for key, v in base(k, other=f"o{k}").items() if key != "seen"}, "name", "label") for k in range(6)],
}


def got(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    return {(r.origin, r.seq, r.field, r.change, r.new_field) for r in changes(df, **kw).collect()}


def test_changes(spark):
    a = got(spark, rows_of(FILES) + rows_of(FILES, None) + rows_of({1: FILES[1]}, "b"))
    assert a == {
        ("a", 2, "extra", "added", ""),
        ("a", 4, "name", "renamed", "label"),
        ("a", 5, "count", "retyped", ""),
        ("a", 5, "parts[].title", "renamed", "parts[].heading"),
        ("a", 7, "extra", "removed", ""), ("a", 7, "seen", "removed", ""), ("a", 7, "other", "added", ""),
        ("a", 7, "count", "retyped", ""), ("a", 7, "parts[].heading", "renamed", "parts[].title"),
    }
    assert got(spark, rows_of(FILES)[:0]) == set()


def test_flatten():
    fields = flatten_one('{"a": {"b": 1}, "m": {"x": {}}, "l": [], "o": [{"p": null}, {}]}', {"m"})
    assert {f[0]: f[1] for f in fields} == {"": 1, "o[]": 2, "a.b": 1, "m": 1, "l": 1, "o[].p": 1}
    assert flatten_one('{"a": 12}', set())[1][7] == flatten_one('{"a": "12"}', set())[1][7] is not None
    for bad in (None, "", "[1]", "{", "[" * 100_000):
        assert flatten_one(bad, set()) == []


def test_structure_tells_tied_values_apart(spark):
    """Constant flags hold the same values under every new name: only names, types or nesting say which is which. Without flooding it fails."""

    def two(k, a, b, flag_a, flag_b):
        return {a: {"title": f"a{k}", flag_a: True}, b: {"title": f"b{k}", flag_b: True}}

    nested = {1: [two(k, "p", "q", "on", "on") for k in range(4)], 2: [two(k, "w", "u", "set", "set") for k in range(4)]}
    want = {("p.title", "w.title"), ("p.on", "w.set"), ("q.title", "u.title"), ("q.on", "u.set")}
    typed = {1: [{"k": 1, "s": "1", "e": k} for k in range(4)], 2: [{"x": "1", "y": 1, "e": k} for k in range(4)]}
    # The place of the unchanged fields: the two flags go on beside the fields they stood with.
    placed = {1: [{"m": {"t": k, "fm": 7}, "n": {"t": -k, "fn": 7}} for k in range(4)], 2: [{"m": {"t": k, "v": 7}, "n": {"t": -k, "r": 7}} for k in range(4)]}

    def renamed(files, **more):
        return {(f, n) for _, _, f, c, n in got(spark, rows_of(files), **more) if c == "renamed"}

    assert renamed(nested) == want and renamed(nested, flow=0.0) != want
    assert renamed(typed) == {("k", "y"), ("s", "x")} and renamed(typed, flow=0.0) != {("k", "y"), ("s", "x")}
    assert renamed(placed) == {("m.fm", "m.v"), ("n.fn", "n.r")}


def test_deep_nesting_and_settling(spark):
    """Twelve levels of nesting, every name on the way up changed but the first."""

    def deep(k, names, leaf):
        out = {leaf: k, "flag": True}
        for n in reversed(names):
            out = {n: out}
        return {"id": k, **out}

    files = {1: [deep(k, [f"a{i}" for i in range(12)], "x") for k in range(4)], 2: [deep(k, ["a0", *[f"b{i}" for i in range(1, 12)]], "y") for k in range(4)]}
    old, new = ".".join(f"a{i}" for i in range(12)), ".".join(["a0", *[f"b{i}" for i in range(1, 12)]])
    assert got(spark, rows_of(files)) == {("a", 2, f"{old}.x", "renamed", f"{new}.y"), ("a", 2, f"{old}.flag", "renamed", f"{new}.flag")}
    start, inner, outer = np.array([0.4, 0.4, 1.0, 0.0]), np.array([0, 1]), np.array([2, 3])
    scores = settled_scores(start, inner, outer)
    assert scores[0] > scores[1] and np.allclose(scores, settled_scores(start, inner, outer, change=1e-12), atol=1e-4)
    with pytest.raises(RuntimeError):
        settled_scores(start, inner, outer, change=0.0, rounds=1)


def test_long_chains_and_circles(spark):
    """A chain of 300 renames leads to the first name; names in a circle all become the first of them."""
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(300)] + [("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("c2", "t1")]
    found = spark.createDataFrame([(a, b, "renamed") for a, b in edges], "field string, new_field string, change string")
    names = {r.path: r.name for r in canonical_names(found, Scratch(spark, "names")).collect()}
    assert {names[f"n{i:03d}"] for i in range(1, 301)} == {"n000"} and "n000" not in names
    assert names == {**{f"n{i:03d}": "n000" for i in range(1, 301)}, "c2": "c1", "c3": "c1", "t1": "c1"}


def test_table(spark):
    df = spark.createDataFrame(rows_of(FILES), SCHEMA)
    one = consistent_table(df, changes(df), "structural_summary", "origin", "file_seq", "url", "id", ())
    names = {r.field: r.n for r in one.groupBy("field").agg(F.count("*").alias("n")).collect()}
    assert names["name"] == 30 and "label" not in names
    assert "parts[].heading" in names and "parts[].title" not in names
    counts = {r.value for r in one.where("field = 'count'").collect()}
    assert counts == {str(k) for k in range(6)}


def test_renames_of_one_origin(spark):
    """Origin a renames n to m; b, which never had n, follows; c has fields of both names, which stay apart."""
    a = {1: [{"n": f"x{k}", "i": k} for k in range(4)], 2: [{"m": f"x{k}", "i": k} for k in range(4)]}
    b, c = {1: [{"m": f"y{k}"} for k in range(4)]}, {1: [{"m": f"z{k}", "n": k} for k in range(4)]}
    df = spark.createDataFrame(rows_of(a) + rows_of(b, "b") + rows_of(c, "c"), SCHEMA)
    one = consistent_table(df, changes(df), "structural_summary", "origin", "file_seq", "url", "id", ())
    assert {(r.origin, r.field): r.n for r in one.groupBy("origin", "field").agg(F.count("*").alias("n")).collect()} == {("a", "n"): 8, ("a", "i"): 8, ("b", "n"): 4, ("c", "m"): 4, ("c", "n"): 4}


def test_table_casts_lists_and_every_number(spark):
    files = {1: [{"n": k, "l": ["x"], "d": {}, "parts": [{"size": k}, {"size": 1}]} for k in range(4)], 2: [{"n": "1e5", "l": "y", "d": "z", "parts": [{"size": "7"}, {"size": None}, {"size": "big"}]}]}
    df = spark.createDataFrame(rows_of(files), SCHEMA)
    one = consistent_table(df, changes(df), "structural_summary", "origin", "file_seq", "url", "id", ("d",))
    got = {r.field: (r.type, r.value) for r in one.where("seq = 2").collect()}
    assert got == {"n": ("number", "1e5"), "l": ("array", '["y"]'), "d": ("object", "null"), "parts[].size": ("number", "[7, null, null]")}
