"""Clusters of near-equal short texts by verified shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.sources.scratch import Scratch


def shingles(words: Column, size: int) -> Column:
    """The distinct hashes of the runs of `size` words; a shorter text is one shingle."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(words, i, size), " ")))
    return F.array_distinct(runs)


def _near_pairs(base: DataFrame, similarity: float, block: int, scratch: Scratch) -> DataFrame:
    """(a, b): the ids a < b of all pairs of texts whose shingles (columns id, s) are similar enough.

    Of two such texts, the |s| - ceil(similarity * |s|) + 1 rarest shingles of each
    share one at least, so only texts that share one of those are compared.
    """
    each = base.select("id", F.size("s").alias("n"), F.explode("s").alias("h"))
    often = each.groupBy("h").agg(F.count("*").alias("df"))
    length = F.col("n") - F.ceil(F.col("n") * similarity - 1e-9).cast("int") + 1
    rarest = each.join(often, "h").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("hs"))
    prefix = scratch.keep(rarest.select("id", "n", F.explode(F.slice("hs", 1, length)).alias("r")).where("r.df > 1").select("id", "n", F.col("r.h").alias("h")))
    sharing = prefix.groupBy("h").agg(F.count("*").alias("m")).where("m > 1")
    # A shingle of many texts is dealt out as pairs of blocks, so that no task holds all of its pairs.
    dealt = prefix.join(sharing, "h").withColumn("blocks", F.ceil(F.col("m") / block).cast("int")).withColumn("k", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    left = dealt.select("h", F.col("id").alias("x"), F.col("n").alias("nx"), F.col("k").alias("lo"), F.explode(F.sequence("k", F.col("blocks") - 1)).alias("hi"))
    right = dealt.select("h", F.col("id").alias("y"), F.col("n").alias("ny"), F.explode(F.sequence(F.lit(0), "k")).alias("lo"), F.col("k").alias("hi"))
    met = left.join(right, ["h", "lo", "hi"]).where("lo < hi or x < y").where(F.least("nx", "ny") >= similarity * F.greatest("nx", "ny") - 1e-9)
    pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    pairs = pairs.join(base.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(base.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return pairs.where(shared >= similarity * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def clusters(texts: DataFrame, key: str = "text", size: int = 5, similarity: float = 0.8, block: int = 2000) -> DataFrame:
    """(key, cluster): the cluster of each distinct text, named by its first member.

    Texts whose shingles have a Jaccard similarity of `similarity` or more are
    linked, all of them: candidates share one of their rarest shingles, which is
    exact, and are verified on the shingles themselves. Clusters are the linked
    texts' connected components, by passing on the least name until nothing changes.
    Null texts are left out; an empty text is a cluster of its own.
    """
    scratch = Scratch(texts.sparkSession, "minhash")
    words = F.split(F.col(key), " ")
    base = texts.where(F.col(key).isNotNull()).select(key).distinct().withColumn("s", shingles(words, size))
    base = scratch.keep(base.withColumn("id", F.monotonically_increasing_id()))
    edges = _near_pairs(base, similarity, block, scratch)
    named = base.select("id", key)
    edges = edges.join(named.select(F.col("id").alias("a"), F.col(key).alias("ta")), "a").join(named.select(F.col("id").alias("b"), F.col(key).alias("tb")), "b")
    edges = scratch.keep(edges.select(F.col("ta").alias("a"), F.col("tb").alias("b")))
    both = scratch.keep(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels, kept = base.select(key, F.col(key).alias("cluster")), edges
    while True:
        least = both.join(labels, both["b"] == labels[key]).groupBy(F.col("a").alias(key)).agg(F.min("cluster").alias("other"))
        after = scratch.keep(labels.join(least, key, "left").select(key, F.least("cluster", F.coalesce("other", "cluster")).alias("cluster"), (F.col("other") < F.col("cluster")).alias("moved")))
        moved = after.where("moved").take(1)
        scratch.drop(kept)
        labels, kept = after.select(key, "cluster"), after
        if not moved:
            return labels
