"""Schemas that drift from file to file: every change, and one consistent table.

Each JSON object is flattened into its fields (paths to values), and each file's
schema is what most of its objects hold. The schema of a file is compared with that
of the file before: fields that only one of the two has are added or removed, fields
whose type differs are retyped. Renames are found by similarity flooding. The graph
of a file pair has the pairs of removed and added fields that hold equal values for
the same records, the unchanged fields as anchors, the pairs of objects they are
nested in up to the roots, and the pairs of their types. Scores start from the names'
likeness and the values' agreement and flow between a pair and what it is nested in
and typed as until they settle; the pairs are then chosen by their scores, best first.

The work on rows is joins and aggregations over (source, file, path), with the values'
fingerprints as join keys; candidate pairs come only from equal fingerprints of the
same record, never from all pairs of fields. Sums are pre-aggregated before a
shuffle, so a source that holds a third of all rows is no hot spot. What is flooded is
a graph of fields: a file's schema has less than twice the fields of an average row.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from brindle.sources.scratch import Scratch

_KINDS = {str: "string", int: "number", float: "number", bool: "boolean", dict: "object", list: "array"}
KINDS = ["array", "boolean", "number", "object", "string"]
_PLACE = {t: KINDS.index(k) for t, k in _KINDS.items()}
#: A JSON number, zeros before it left out.
_NUMBER = re.compile(r"(-?)0*([0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)")


def _walk(value: dict, prefix: str, whole: set[str], out: dict[str, list], lists: dict[str, int]) -> None:
    for key, v in value.items():
        path = f"{prefix}.{key}" if prefix else key
        if isinstance(v, dict) and path not in whole:
            _walk(v, path, whole, out, lists)
        elif isinstance(v, list) and v and path not in whole and all(isinstance(e, dict) for e in v):
            lists[path + "[]"] = lists.get(path + "[]", 0) + len(v)
            for e in v:
                _walk(e, path + "[]", whole, out, lists)
        elif path in out:
            out[path].append(v)
        else:
            out[path] = [v]


def _plain(v) -> str:
    """A value's text, the same for a number and its text."""
    kind = type(v)
    return v if kind is str else str(v) if kind is int else json.dumps(v, sort_keys=True, ensure_ascii=False)


def flatten_one(text: str | None, whole: set[str], texts: bool = True) -> list[tuple]:
    """(path, held, counts of the kinds, print, value) of every field of one JSON text; nothing for a text that is no JSON object.

    A field is a path to a value that isn't a plain object or a list of objects;
    inside a list it holds once for each element. `whole` names objects that are
    single fields. A field's print is the same for a number and its text, null for
    nulls only; its value is JSON text, left out without `texts`. The path '' stands
    for the object itself, a path that ends with `[]` for the elements of a list.
    """
    try:
        parsed = json.loads(text) if text else None
    except (ValueError, RecursionError):
        parsed = None
    if not isinstance(parsed, dict):
        return []
    out: dict[str, list] = {}
    lists: dict[str, int] = {}
    _walk(parsed, "", whole, out, lists)
    none = (0, 0, 0, 0, 0)
    fields = [("", 1, *none, None, None), *[(path, n, *none, None, None) for path, n in lists.items()]]
    for path, values in out.items():
        counts = [0, 0, 0, 0, 0]
        for v in values:
            if v is not None:
                counts[_PLACE[type(v)]] += 1
        mark = xxh64_intdigest("\x1f".join(map(_plain, values)).encode("utf-8", "surrogatepass")) - (1 << 63) if any(counts) else None
        told = json.dumps(values if "[]" in path else values[0], sort_keys=True, ensure_ascii=False).encode("utf-8", "replace").decode() if texts else None
        fields.append((path.encode("utf-8", "replace").decode(), len(values), *counts, mark, told))
    return fields


def flattened(rows: DataFrame, text: str, origin: str, seq: str, key: str, order: str, whole: set[str], texts: bool = True) -> DataFrame:
    """(origin, seq, key, order) of the rows whose JSON text is an object, with a row for each path: path, held, a count for each kind, print, value."""
    named = rows.select(F.col(origin).alias("origin"), F.col(seq).alias("seq"), F.col(key).alias("key"), F.col(order).alias("order"), F.col(text).alias("text"))
    kept = ["origin", "seq", "key", "order"]
    types = [pa.string(), *[pa.int64()] * 6, pa.int64(), pa.string()]
    names = ["path", "held", *KINDS, "print", "value"]
    schema = ", ".join([f"{c} {named.schema[c].dataType.simpleString()}" for c in kept] + ["path string, held bigint", *[f"{k} bigint" for k in KINDS], "print bigint, value string"])

    def fields(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [flatten_one(t, whole, texts) for t in batch.column("text").to_pylist()]
            at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            columns = list(zip(*[f for fs in found for f in fs])) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in kept], *[pa.array(c, t) for c, t in zip(columns, types)]], names=[*kept, *names])

    return named.mapInArrow(fields, schema)


def file_schemas(flat: DataFrame) -> DataFrame:
    """(origin, seq, path, type) of the fields that more than half of a file's objects (or of the elements of the list around them) hold.

    The type is the most frequent one of the non-null values, the first by name of
    equally frequent ones, null if all values are null.
    """
    held = flat.groupBy("origin", "seq", "path").agg(*[F.sum(c).alias(c) for c in ("held", *KINDS)])
    objects = held.where("path = '' or path like '%[]'").select("origin", "seq", F.col("path").alias("around"), F.col("held").alias("all"))
    fields = held.where("path <> '' and path not like '%[]'").withColumn("around", F.regexp_extract("path", r"^(.*\[\])", 1))
    kinds = KINDS
    most = F.greatest(*kinds)
    kind = F.coalesce(*[F.when((F.col(k) == most) & (most > 0), F.lit(k)) for k in kinds])
    return fields.join(objects, ["origin", "seq", "around"]).where(F.col("held") * 2 > F.col("all")).select("origin", "seq", "path", kind.alias("type"))


def _parent(path: str) -> str:
    return path.rpartition(".")[0]


def likeness(a: str, b: str) -> float:
    """How like two fields' own names are, without case and separators: 1 less the edits for each character."""
    a, b = (re.sub(r"[\[\]_\- ]", "", p.rpartition(".")[2].lower()) for p in (a, b))
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return 1 - row[-1] / max(len(a), len(b), 1)


def settled_scores(start: np.ndarray, inner: np.ndarray, outer: np.ndarray, flow: float = 1.0, change: float = 1e-6, rounds: int = 10_000) -> np.ndarray:
    """The scores of a graph's nodes after flooding: edges lead from node `inner` to the node `outer` that it is nested in or typed as.

    In each round a node takes in what it had at first, its score, the scores of the
    nodes it stands in and the mean score of the nodes that stand in it; all are then
    scaled to a maximum of 1. It ends when no score changes by more than `change`; a
    graph that doesn't settle within `rounds` is an error.
    """
    members = np.maximum(np.bincount(outer, minlength=len(start)), 1)
    scores = start.copy()
    for _ in range(rounds):
        whole = start + scores
        taken = np.bincount(inner, weights=whole[outer], minlength=len(start)) + np.bincount(outer, weights=whole[inner], minlength=len(start)) / members
        after = whole + flow * taken
        after /= max(after.max(initial=0.0), 1e-12)
        if np.abs(after - scores).max(initial=0.0) <= change:
            return after
        scores = after
    raise RuntimeError(f"similarity flooding of {len(start)} pairs hasn't settled in {rounds} rounds")


def correspondences(pairs: pd.DataFrame, flow: float = 1.0) -> pd.DataFrame:
    """(origin, seq, old, new) of the renames of one file pair: the best pairs by flooded score, each field once.

    `pairs` has the columns old, new, old_type, new_type and agreement: candidate
    pairs, and the unchanged fields (old = new) as anchors. Of equal scores the higher
    agreement, then the first by name goes first.
    """
    start: dict[tuple[str, str], float] = {}
    edges: set[tuple[tuple[str, str], tuple[str, str]]] = set()
    level = []
    for old, new, agreement, old_type, new_type in zip(pairs.old, pairs.new, pairs.agreement, pairs.old_type, pairs.new_type):
        start[old, new] = 1.0 if old == new else 0.5 * likeness(old, new) + 0.5 * agreement
        kinds = (f"\0{old_type}", f"\0{new_type}")
        start[kinds] = float(old_type == new_type)
        edges.add(((old, new), kinds))
        level.append((old, new))
    while level:  # up to the roots
        above = []
        for old, new in level:
            if old or new:
                up = (_parent(old), _parent(new))
                edges.add(((old, new), up))
                if up not in start:
                    start[up] = 1.0 if up[0] == up[1] else 0.5 * likeness(*up)
                    above.append(up)
        level = above
    place = {p: i for i, p in enumerate(start)}
    inner, outer = (np.array([place[e[k]] for e in edges], dtype=np.int64) for k in (0, 1))
    scores = settled_scores(np.array(list(start.values())), inner, outer, flow)
    changed = pairs[pairs.old != pairs.new]
    ranked = sorted(zip(changed.old, changed.new, changed.agreement), key=lambda p: (-round(scores[place[p[0], p[1]]], 6), -p[2], p[0], p[1]))
    gone: set[str] = set()
    come: set[str] = set()
    chosen = []
    for old, new, _ in ranked:
        if old not in gone and new not in come:
            gone.add(old)
            come.add(new)
            chosen.append((old, new))
    out = pd.DataFrame(chosen, columns=["old", "new"])
    return out.assign(origin=pairs.origin.iloc[0], seq=pairs.seq.iloc[0])[["origin", "seq", "old", "new"]]


def changes(
    rows: DataFrame, text: str = "structural_summary", origin: str = "origin", seq: str = "file_seq", key: str = "url",
    order: str = "id", whole: tuple[str, ...] = (), agree: float = 0.5, flow: float = 1.0,
) -> DataFrame:
    """(origin, seq, field, change, new_field): the changes of each file against the file before it of the same origin.

    change is added, removed, renamed or retyped; new_field is '' but for renamed. A
    rename needs the same values in at least the share `agree` of the records that
    both files hold, by `key`; of two rows of one record in a file the one with the
    higher `order` holds. `flow` is how much of the neighbours' scores a pair takes in.
    Rows with a null origin, file or text and texts that are
    no JSON objects are left out; a file without any readable text is passed over.
    An empty table gives an empty result.
    """
    scratch = Scratch(rows.sparkSession, "drift")
    flat = scratch.keep(flattened(rows.where(F.col(origin).isNotNull() & F.col(seq).isNotNull()), text, origin, seq, key, order, set(whole), texts=False))
    schema = scratch.keep(file_schemas(flat))
    files = schema.select("origin", "seq").distinct()
    follows = scratch.keep(files.withColumn("before", F.lag("seq").over(Window.partitionBy("origin").orderBy("seq"))).where("before is not null"))
    now = schema.join(follows.select("origin", "seq"), ["origin", "seq"])
    old = schema.withColumnRenamed("seq", "before").join(follows, ["origin", "before"]).select("origin", "seq", "path", F.col("type").alias("old_type"), F.lit(True).alias("was"))
    both = scratch.keep(now.withColumn("is", F.lit(True)).join(old, ["origin", "seq", "path"], "full_outer"))
    retyped = both.where("was and is and type is not null and old_type is not null and type <> old_type")
    removed = both.where("is is null").select("origin", "seq", "path")
    added = both.where("was is null").select("origin", "seq", "path")

    values = flat.where("key is not null and print is not null").select("origin", "seq", "key", "order", "path", "print")
    held = flat.where("path = '' and key is not null").select("origin", "seq", "key").distinct()
    held_before = held.withColumnRenamed("seq", "before").join(follows, ["origin", "before"]).select("origin", "seq", "key")

    def latest(df: DataFrame) -> DataFrame:
        return df.groupBy("origin", "seq", "key", "path").agg(F.max_by("print", "order").alias("print"))

    gone = latest(values.withColumnRenamed("seq", "before").join(follows, ["origin", "before"]).join(removed, ["origin", "seq", "path"]))
    come = latest(values.join(added, ["origin", "seq", "path"]))
    gone = gone.join(held, ["origin", "seq", "key"], "left_semi").withColumnRenamed("path", "old")
    come = come.join(held_before, ["origin", "seq", "key"], "left_semi").withColumnRenamed("path", "new")
    gone, come = scratch.keep(gone), scratch.keep(come)
    of_old = gone.groupBy("origin", "seq", "old").agg(F.count("*").alias("n_old"))
    of_new = come.groupBy("origin", "seq", "new").agg(F.count("*").alias("n_new"))
    equal = gone.join(come, ["origin", "seq", "key", "print"]).groupBy("origin", "seq", "old", "new").agg(F.count("*").alias("same"))
    candidates = scratch.keep(
        equal.join(of_old, ["origin", "seq", "old"])
        .join(of_new, ["origin", "seq", "new"])
        .withColumn("agreement", F.col("same") / F.least("n_old", "n_new"))
        .where(F.col("agreement") >= agree)
        .select("origin", "seq", "old", "new", "agreement")
    )
    typed = both.select("origin", "seq", "path", F.coalesce("type", "old_type").alias("type"), "old_type", "was", "is")
    with_types = candidates.join(typed.select("origin", "seq", F.col("path").alias("old"), "old_type"), ["origin", "seq", "old"]).join(
        typed.select("origin", "seq", F.col("path").alias("new"), F.col("type").alias("new_type")), ["origin", "seq", "new"]
    )
    anchors = typed.where("was and is").join(candidates.select("origin", "seq").distinct(), ["origin", "seq"], "left_semi")
    graph = with_types.select("origin", "seq", "old", "new", "agreement", "old_type", "new_type").unionByName(
        anchors.select("origin", "seq", F.col("path").alias("old"), F.col("path").alias("new"), F.lit(1.0).alias("agreement"), "old_type", F.col("type").alias("new_type"))
    )
    names = ", ".join(f"{c} {graph.schema[c].dataType.simpleString()}" for c in ("origin", "seq", "old", "new"))
    renamed = scratch.keep(graph.groupBy("origin", "seq").applyInPandas(lambda pairs: correspondences(pairs, flow), names))
    none = F.lit("")
    return (
        renamed.select("origin", "seq", F.col("old").alias("field"), F.lit("renamed").alias("change"), F.col("new").alias("new_field"))
        .unionByName(
            removed.join(renamed.select("origin", "seq", F.col("old").alias("path")), ["origin", "seq", "path"], "left_anti")
            .select("origin", "seq", F.col("path").alias("field"), F.lit("removed").alias("change"), none.alias("new_field"))
        )
        .unionByName(
            added.join(renamed.select("origin", "seq", F.col("new").alias("path")), ["origin", "seq", "path"], "left_anti")
            .select("origin", "seq", F.col("path").alias("field"), F.lit("added").alias("change"), none.alias("new_field"))
        )
        .unionByName(retyped.select("origin", "seq", F.col("path").alias("field"), F.lit("retyped").alias("change"), none.alias("new_field")))
    )


def canonical_names(found: DataFrame, scratch: Scratch, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, path, name): for each field that came by a rename the name it had first, in each group of `by`.

    Of several names before a rename the most frequent one holds (the first by name
    of equally frequent ones); of two names that replace each other the one that more
    often comes first does. Chains are followed to their ends, of names that replace
    one another in a circle the first by name is kept.
    """
    edges = found.where("change = 'renamed'").groupBy(*by, "field", "new_field").agg(F.count("*").alias("n"))
    first = edges.groupBy(*by, F.col("new_field").alias("path")).agg(F.max_by("field", F.struct("n", F.col("field"))).alias("name"))
    back = edges.select(*by, F.col("field").alias("path"), F.col("new_field").alias("name"), F.col("n").alias("back"))
    n_of = edges.select(*by, F.col("new_field").alias("path"), F.col("field").alias("name"), "n")
    links = first.join(n_of, [*by, "path", "name"]).join(back, [*by, "path", "name"], "left")
    # Two names that replace each other: the rarer direction is dropped.
    links = links.where("back is null or n > back or (n = back and name < path)").select(*by, "path", "name")
    links = scratch.keep(links.withColumn("least", F.col("name")))
    # The way up doubles in each round, so that it is at the end of every chain after as many rounds as the number of links has bits.
    for _ in range(links.count().bit_length()):
        up = links.select(*by, F.col("path").alias("name"), F.col("name").alias("higher"), F.col("least").alias("least_up"))
        met = links.join(up, [*by, "name"], "left").select(*by, "path", F.coalesce("higher", "name").alias("name"), F.least("least", F.coalesce("least_up", "least")).alias("least"), (F.col("higher") != F.col("name")).alias("moved"))
        met = scratch.keep(met)
        links = met.drop("moved")
        if not met.where("moved").take(1):
            break
    # A name that still has a way up lies in a circle.
    circles = links.select(*by, F.col("path").alias("name"), F.col("least").alias("first"))
    return links.drop("least").join(circles, [*by, "name"], "left").select(*by, "path", F.coalesce("first", "name").alias("name")).where("path <> name")


def names_of_origins(held: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """(origin, path, name) of the fields (origin, path) that bear another name in the one table.

    An origin's own renames hold for it. Another origin's rename holds too, unless the
    origin has a field of the first name itself: then the two are different fields.
    """
    own = canonical_names(found, scratch, ("origin",))
    of_all = canonical_names(found, scratch).withColumnRenamed("name", "other")
    taken = held.select("origin", F.col("path").alias("other"), F.lit(True).alias("taken"))
    named = held.join(own, ["origin", "path"], "left").join(of_all, "path", "left").join(taken, ["origin", "other"], "left")
    return named.select("origin", "path", F.coalesce("name", F.when(F.col("taken").isNull(), F.col("other"))).alias("name")).where("name is not null")


def cast_text(value: str, kind: str, listed: bool = False) -> str:
    """A JSON text as another one of type `kind`, 'null' where it can't be read so; `listed`: an array, each element of which is cast."""
    if listed:
        return "[" + ", ".join(cast_text(json.dumps(e, sort_keys=True, ensure_ascii=False), kind) for e in json.loads(value)) + "]"
    v = json.loads(value)
    if v is None or _KINDS[type(v)] == kind:
        return value
    if kind == "string":
        return json.dumps(value, ensure_ascii=False)
    text = v.strip() if isinstance(v, str) else ""
    if kind == "number":
        m = _NUMBER.fullmatch(text)
        return m.group(1) + m.group(2) if m else "null"
    if kind == "boolean":
        return text.lower() if text.lower() in ("true", "false") else "null"
    try:
        read = json.loads(text)
        if _KINDS.get(type(read)) == kind:
            return json.dumps(read, sort_keys=True, ensure_ascii=False)
    except (ValueError, RecursionError):
        pass
    return f"[{value}]" if kind == "array" else "null"


def consistent_table(rows: DataFrame, found: DataFrame, text: str, origin: str, seq: str, key: str, order: str, whole: tuple[str, ...]) -> DataFrame:
    """(order, origin, seq, key, field, type, value): all objects of all files under one set of field names and types.

    A field bears its first name; its type is the most frequent one over all files;
    a value is JSON text, cast where its own type is another (each element by itself
    in a list of objects): to a string by quoting, to a number, boolean, object or
    array where the text reads as one, any other value to an array of itself, else null.
    """
    scratch = Scratch(rows.sparkSession, "drift-table")
    flat = flattened(rows, text, origin, seq, key, order, set(whole))
    kinds = KINDS
    values = flat.where("value is not null").select("order", "origin", "seq", "key", "path", *kinds, "value")
    values = scratch.keep(values)
    names = scratch.keep(names_of_origins(values.select("origin", "path").distinct(), found, scratch))
    names = F.broadcast(names) if names.count() < 100_000 else names
    named = values.join(names, ["origin", "path"], "left").withColumn("field", F.coalesce("name", "path")).withColumn("path_listed", F.col("path").contains("[]")).drop("name", "path")
    most = F.greatest(*kinds)
    types = named.groupBy("field").agg(*[F.sum(k).alias(k) for k in kinds]).select("field", F.coalesce(*[F.when((F.col(k) == most) & (most > 0), F.lit(k)) for k in kinds], F.lit("string")).alias("type"))
    types = F.broadcast(types) if types.count() < 100_000 else types
    # Only values with another type than the field's go through the cast.
    own = F.coalesce(*[F.when(F.col("type") == k, F.col(k)) for k in kinds], F.lit(0))
    other = sum(F.col(k) for k in kinds) > own

    @F.pandas_udf("string")
    def cast_to(values: pd.Series, kinds_: pd.Series, listed: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else cast_text(v, k, e) for v, k, e in zip(values, kinds_, listed)], dtype=object)

    cast = F.coalesce(cast_to(F.when(other, F.col("value")), F.col("type"), F.col("path_listed")), F.col("value"))
    return named.join(types, "field").select("order", "origin", "seq", "key", "field", "type", cast.alias("value"))
