import random

from brindle.operators.hierarchy import ancestor_pairs, descendant_counts, hierarchies

SCHEMA = "run string, id int, parent int, depth int, path string, inner boolean"


def brute(edges):
    """(root, depth, path, state) of each node by walking up from it."""
    out = {}
    for g, n in edges:
        seen, at = [n], edges[g, n]
        while at is not None and (g, at) in edges and at not in seen:
            seen.append(at)
            at = edges[g, at]
        if at is None or (g, at) not in edges:
            out[g, n] = (seen[-1], len(seen) - 1, "/".join(map(str, reversed(seen))), "tree")
        else:
            out[g, n] = (-1, -1, "", "cycle" if at == n else "under_cycle")
    return out


def run(spark, edges, extra=()):
    rows = [(g, n, p, 7, "clash", None) for (g, n), p in edges.items()] + list(extra)
    return hierarchies(spark.createDataFrame(rows, SCHEMA), "run", "id", "parent")


def result(df):
    return {(r.g, r.n): (r.root, r.depth, r.path, r.state) for r in df.collect()}


def test_against_walking_up(spark):
    rnd = random.Random(3)
    edges = {}
    for g in "abc":
        for n in range(40):
            edges[g, n] = rnd.choice([None, 99, n, *[rnd.randrange(40)] * 9])
    edges |= {("deep", n): n - 1 for n in range(1, 70)} | {("deep", 0): None}
    got = run(spark, edges)
    assert result(got) == brute(edges)
    tree = brute(edges)
    pairs = {(g, int(a), n) for (g, n), (_, _, path, s) in tree.items() if s == "tree" for a in path.split("/")[:-1]}
    assert {(r.g, r.ancestor, r.descendant) for r in ancestor_pairs(got).collect()} == pairs
    counts = {(r.g, r.n): r.descendants for r in descendant_counts(got).collect()}
    assert counts["deep", 0] == 69 and counts["deep", 69] == 0


def test_repeats_nulls_and_empty(spark):
    edges = {("a", 1): None, ("a", 2): 1}
    extra = [("a", 2, 1, 0, "", None), ("a", 2, None, 0, "", None), (None, 3, 1, 0, "", None), ("a", None, 1, 0, "", None)]
    assert result(run(spark, edges, extra)) == brute(edges)
    assert run(spark, edges).limit(0).count() == 0
    empty = spark.createDataFrame([], SCHEMA)
    assert hierarchies(empty, "run", "id", "parent").count() == 0


def test_only_cycles(spark):
    edges = {("a", 1): 2, ("a", 2): 3, ("a", 3): 1, ("a", 4): 3, ("a", 5): 4, ("b", 1): 1}
    assert result(run(spark, edges)) == brute(edges)
