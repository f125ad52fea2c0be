"""JSON Schemas compiled to Column expressions over VARIANT.

A schema is read once on the driver and becomes one expression that gives the list of
a value's violations; Spark evaluates it where the rows lie. The keywords are type,
enum, const, pattern, required, properties, items, oneOf (exactly one), anyOf, allOf
and $ref; format is an annotation, other keywords are left out.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ARROW = " → "
_TYPES = {"string": "STRING", "boolean": "BOOLEAN", "null": "VOID", "object": "OBJECT<.*", "array": "ARRAY<.*", "integer": "(BIG|SMALL|TINY)?INT", "number": r"(BIG|SMALL|TINY)?INT|DECIMAL\(.*|DOUBLE|FLOAT"}


def load_schema(path: str) -> dict:
    return json.loads(Path(path).read_text())


def _is(value: Column, kind: str) -> Column:
    return F.schema_of_variant(value).rlike(f"^({_TYPES[kind]})$")


def _text(value: Column) -> Column:
    return F.when(_is(value, "string"), F.try_variant_get(value, "$", "string"))


def _member(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f'$["{name}"]', "variant")


def _bound(value: Column, judge: Callable[[Column], Column]) -> Column:
    """An expression over a value that is computed once, however often it stands in the expression."""
    return F.get(F.transform(F.array(value), judge), F.lit(0))


def _judge(schema: dict, path: Column | None, root: dict) -> Callable[[Column], Column]:
    return lambda value: violations(schema, value, path, root)


def _counted(when: Callable[[Column, str], Column], most: int | None) -> Callable[[Column], Column]:
    several = (lambda n: n > most) if most else (lambda n: F.lit(False))
    return lambda n: F.concat(when(n == 0, "is valid under none of the alternatives"), when(several(n), "is valid under more than one of the alternatives"))


def violations(schema: dict, value: Column, path: Column | None = None, root: dict | None = None) -> Column:
    """ARRAY<STRING>: what is wrong with a VARIANT, as `path: message (expected: hint)`; empty for a valid one, null for SQL null.

    The path's steps are joined by an arrow, `(root)` stands for the value itself.
    Properties that are missing are judged by `required` alone. A schema that refers
    to itself can't be compiled.
    """
    if root is None:
        return _bound(value, _judge(schema, path, schema))
    if "$ref" in schema:
        target = reduce(lambda at, step: at[step], schema["$ref"].removeprefix("#/").split("/"), root)
        return violations(target, value, path, root)
    where = F.lit("(root)") if path is None else path
    hint = schema.get("description") or schema.get("$comment")
    tail = f" (expected: {hint[:120]})" if hint else ""

    def below(step: Column) -> Column:
        return step if path is None else F.concat(path, F.lit(ARROW), step)

    def when(broken: Column, message: str) -> Column:
        return F.when(F.coalesce(broken, F.lit(False)), F.array(F.concat(where, F.lit(f": {message}{tail}")))).otherwise(none)

    none = F.array().cast("array<string>")
    parts: list[Column] = []
    if "type" in schema:
        kinds = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        parts.append(when(~reduce(Column.__or__, [_is(value, k) for k in kinds]), f"is not of type {' or '.join(kinds)}"))
    if "enum" in schema:
        parts.append(when(~F.coalesce(_text(value).isin(*schema["enum"]), F.lit(False)), f"is not one of {', '.join(schema['enum'])}"))
    if "const" in schema:
        parts.append(when(~F.coalesce(_text(value) == schema["const"], F.lit(False)), f"is not {schema['const']}"))
    if "pattern" in schema:
        parts.append(when(~_text(value).rlike(schema["pattern"]), f"does not match {schema['pattern']}"))
    for name in schema.get("required", []):
        parts.append(when(_is(value, "object") & _member(value, name).isNull(), f"{name} is required"))
    for name, inner in schema.get("properties", {}).items():
        member = _member(value, name)
        judged = _bound(member, _judge(inner, below(F.lit(name)), root))
        parts.append(F.coalesce(F.when(_is(value, "object"), judged), none))
    if "items" in schema:
        elements = F.coalesce(F.try_variant_get(F.when(_is(value, "array"), value), "$", "array<variant>"), F.array().cast("array<variant>"))
        parts.append(F.flatten(F.transform(elements, lambda e, i: violations(schema["items"], e, below(i.cast("string")), root))))
    for inner in schema.get("allOf", []):
        parts.append(violations(inner, value, path, root))
    for word, few in (("oneOf", 1), ("anyOf", None)):
        if word in schema:
            matches = sum((F.when(F.size(violations(inner, value, path, root)) == 0, 1).otherwise(0) for inner in schema[word]), F.lit(0))
            parts.append(_bound(matches, _counted(when, few)))
    return F.when(value.isNotNull(), F.concat(*parts) if parts else none)


def _named(kind: str, required: tuple[str, ...] = ("name",), **more: dict) -> dict:
    return {"type": "object", "properties": {"@type": {"const": kind}, "name": {"type": "string"}, **more}, "required": list(required)}


def _of_class(kinds: list[str], **more: dict) -> dict:
    base = {"type": "object", "properties": {"@id": {"type": "string"}, "@type": {"type": "string"}, "url": {"type": "string"}}, "required": ["@type"]}
    own = {"type": "object", "properties": {"@type": {"enum": kinds}, "name": {"type": "string"}, **more}, "required": ["name"]}
    return {"allOf": [base, own]}


_STRING = {"type": "string"}
_STRINGS = {"oneOf": [_STRING, {"type": "array", "items": _STRING}]}
#: An agent is exactly one of a person, an organisation and a name.
AGENT = {"oneOf": [_named("Person"), _named("Organization"), _STRING]}
#: A record is of exactly one of three kinds, told by its class.
RECORD = {
    "oneOf": [
        _of_class(["LearningResource", "CreativeWork", "TrainingMaterial"], author={"oneOf": [AGENT, {"type": "array", "items": AGENT}]}, keywords=_STRINGS, inLanguage=_STRINGS, license=_STRING, description=_STRING),
        _of_class(["Course"], description=_STRING),
        _of_class(["CourseInstance", "Event"], startDate=_STRING, endDate=_STRING, duration=_STRING),
    ]
}


def as_record() -> Column:
    """The VARIANT of a row of normalised fields; fields without a value are left out."""
    author = F.transform("author", lambda a: F.struct(a["type"].alias("@type"), a["name"].alias("name"), a["id"].alias("@id")))
    named = {
        "@type": F.col("type"), "@id": F.col("id"), "url": F.col("url"), "name": F.col("name"), "description": F.col("description"), "keywords": F.col("keywords"), "teaches": F.col("teaches"),
        "author": author, "license": F.col("license"), "inLanguage": F.col("in_language"), "startDate": F.col("start_date"), "endDate": F.col("end_date"), "timeRequired": F.col("time_required"),
    }
    return F.parse_json(F.to_json(F.struct(*[c.alias(n) for n, c in named.items()])))


def mended(rows: DataFrame) -> DataFrame:
    """The rows with what can be mended by rule: a missing name becomes the last part of the address, agents without a kind are persons."""
    tail = F.nullif(F.regexp_extract("url", r"([^/]+)/?$", 1), F.lit(""))
    people = F.transform("author", lambda a: F.struct(F.coalesce(a["type"], F.lit("Person")).alias("type"), a["name"].alias("name"), a["id"].alias("id")))
    return rows.withColumns({"name": F.coalesce("name", tail), "author": F.filter(people, lambda a: a["name"].isNotNull())})


def validated_twice(rows: DataFrame, schema: dict = RECORD) -> DataFrame:
    """The rows with `first` and `errors`: the violations before and after mending; only invalid rows are mended, once, and judged again."""
    judged = rows.withColumn("first", violations(schema, as_record()))
    valid, broken = judged.where(F.size("first") == 0), judged.where(F.size("first") > 0)
    again = mended(broken).withColumn("errors", violations(schema, as_record()))
    return valid.withColumn("errors", F.col("first")).unionByName(again)


def corpus_checks(corpus: DataFrame, classes: list[str]) -> DataFrame:
    """(file, items, unknown, valid): of each file of the corpus (file, record) the records, those without a known class, and whether it has any and all are known."""
    known = _text(_member(F.col("record"), "@type")).isin(*classes)
    counted = corpus.groupBy("file").agg(F.count("record").alias("items"), F.count_if(F.col("record").isNotNull() & ~F.coalesce(known, F.lit(False))).alias("unknown"))
    return counted.withColumn("valid", (F.col("items") > 0) & (F.col("unknown") == 0))
