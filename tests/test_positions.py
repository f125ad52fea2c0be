import random

from pyspark.sql import functions as F

from brindle.operators.positions import carried, numbered


def rows_of(n=400):
    """Half of the rows in one group, some in the null group."""
    rnd = random.Random(2)
    ids = rnd.sample(range(10 * n), n)
    return [(rnd.choice(["hot", "hot", "hot", "a", None, "b"]), i, rnd.choice([None, None, f"v{i}"])) for i in ids]


def test_numbered(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, "g string, id long, v string")
    got = {(r.g, r.id): r.n for r in numbered(df, ["g"], [F.col("id")]).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        for n, i in enumerate(sorted(r[1] for r in rows if r[0] == k), 1):
            want[k, i] = n
    assert got == want
    down = {r.id: r.n for r in numbered(df, [], [F.col("id").desc()]).collect()}
    assert down == {i: n for n, i in enumerate(sorted((r[1] for r in rows), reverse=True), 1)}
    assert numbered(df.limit(0), ["g"], [F.col("id")]).count() == 0


def test_carried(spark):
    rows = rows_of()
    got = {(r.g, r.id): r.c for r in carried(spark.createDataFrame(rows, "g string, id long, v string"), ["g"], ["id"], F.col("v"), "c").collect()}
    for k in {r[0] for r in rows}:
        last = None
        for _, i, v in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            assert got[k, i] == last
            last = v if v is not None else last
