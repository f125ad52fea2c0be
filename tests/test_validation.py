import json

from pyspark.sql import functions as F

from brindle.operators.validation import AGENT, RECORD, corpus_checks, load_schema, violations
from brindle.sources import files


def judged(spark, schema, *values):
    df = spark.createDataFrame([(i, None if v is ... else json.dumps(v)) for i, v in enumerate(values)], "i int, t string")
    return [r.e for r in df.select("i", violations(schema, F.parse_json("t")).alias("e")).orderBy("i").collect()]


def test_keywords(spark):
    schema = {
        "type": "object", "required": ["a"], "description": "what it is",
        "properties": {"a": {"type": "string", "pattern": "^x"}, "n": {"type": ["integer", "null"]}, "l": {"type": "array", "items": {"$ref": "#/$defs/small"}}, "c": {"const": "k"}},
        "anyOf": [{"required": ["n"]}, {"required": ["l"]}], "$defs": {"small": {"enum": ["p", "q"]}},
    }
    got = judged(spark, schema, {"a": "xy", "n": 1}, {"a": "y", "l": ["p", "z", 1]}, {"n": None, "c": "k"}, [1], {"a": "x", "n": 1.5, "c": 2}, ...)
    tail = " (expected: what it is)"
    assert got[0] == [] and got[5] is None
    assert got[1] == ["a: does not match ^x", "l → 1: is not one of p, q", "l → 2: is not one of p, q"]
    assert got[2] == [f"(root): a is required{tail}"]
    assert got[3] == [f"(root): is not of type object{tail}"]
    assert got[4] == ["n: is not of type integer or null", "c: is not k"]
    assert judged(spark, schema, {"a": "x"}) == [[f"(root): is valid under none of the alternatives{tail}"]]


def test_exactly_one(spark):
    person, both, named = {"@type": "Person", "name": "A"}, {"name": "A"}, "A"
    assert judged(spark, AGENT, person, named, both, {"@type": "Person"}, 3) == [
        [], [], ["(root): is valid under more than one of the alternatives"], ["(root): is valid under none of the alternatives"], ["(root): is valid under none of the alternatives"],
    ]
    none = ["(root): is valid under none of the alternatives"]
    course = {"@type": "Course", "name": "C"}
    assert judged(spark, RECORD, course, {"@type": "Course"}, {"@type": "Other", "name": "x"}, {"@type": "CreativeWork", "name": "x", "author": [person, named]}, {"@type": "CreativeWork", "name": "x", "author": [both]}) == [[], none, none, [], none]


def test_corpus(spark, tmp_path):
    for name, content in {"good.json": [{"@type": "Course"}, {"@type": "Event"}], "empty.json": [], "odd.json": [{"@type": "Recipe"}, {}], "no.json": {"@type": "Course"}}.items():
        (tmp_path / name).write_text(json.dumps(content))
    (tmp_path / "broken.json").write_text("{")
    got = {r.file: (r["items"], r.unknown, r.valid) for r in corpus_checks(files.json_corpus(spark, str(tmp_path)), ["Course", "Event"]).collect()}
    assert got == {"good.json": (2, 0, True), "empty.json": (0, 0, False), "odd.json": (2, 2, False), "no.json": (0, 0, False), "broken.json": (0, 0, False)}
    (tmp_path / "schema.json").write_text(json.dumps(AGENT))
    assert load_schema(str(tmp_path / "schema.json")) == AGENT
