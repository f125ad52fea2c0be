"""Change detection over fetched pages: hashes, snapshots, what to skip."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import text, urls


def fetches(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, status_code, ok, hash, nth, earlier): the newest fetch of each url (nth 1) with the hash of the one before it, and that one (nth 2).

    The hash is null for pages without HTML. The rank is limited, so that every task
    sends at most two rows of a url however many fetches it has.
    """
    w = Window.partitionBy("url").orderBy(F.col("fetched_at").desc(), F.col("page_id").desc())
    hashed = pages.select(
        "page_id", "url", "fetched_at", "status_code", "ok", urls.host(F.col("url")).alias("host"), text.content_hash(text.plain_text(F.col("html"))).alias("hash")
    )
    newest = hashed.withColumn("nth", F.row_number().over(w)).where("nth <= 2")
    return newest.withColumn("earlier", F.lead("hash").over(w))


def changed_pages(pages: DataFrame) -> DataFrame:
    """(url, page_id, hash): the newest fetch of every url whose content is new or other than before."""
    newest = fetches(pages).where("nth = 1 and hash is not null")
    return newest.where("earlier is null or earlier <> hash").select("url", "page_id", "hash")


def snapshot(pages: DataFrame) -> DataFrame:
    """(host, pages, snapshot_hash): one hash over the (url, hash) pairs of each host's newest pages and its root's hash.

    It doesn't depend on the order of the rows. The pairs are hashed in 4,096 blocks,
    told by the first digits of the url's own hash, as sorted canonical JSON; then the
    sorted blocks and the root (null without one) are. So no task holds a whole host.
    """
    newest = fetches(pages).where("nth = 1 and hash is not null")
    root = F.max(F.when(urls.path(F.col("url")).isin("", "/"), F.col("hash"))).alias("root")
    blocks = newest.groupBy("host", F.left(F.sha2("url", 256), F.lit(3)).alias("block")).agg(
        F.count("*").alias("pages"), F.sha2(F.to_json(F.array_sort(F.collect_list(F.array("url", "hash")))), 256).alias("hash"), root
    )
    whole = blocks.groupBy("host").agg(F.sum("pages").alias("pages"), F.array_sort(F.collect_list(F.array("block", "hash"))).alias("p"), F.max("root").alias("root"))
    canonical = F.to_json(F.struct(F.col("p").alias("pages"), F.col("root").alias("root_hash")), {"ignoreNullFields": "false"})
    return whole.select("host", "pages", F.sha2(canonical, 256).alias("snapshot_hash"))


def refresh_plan(pages: DataFrame, probability: float = 0.05) -> DataFrame:
    """(host, pages, failed, changed, mode) of each host: what its next run has to do.

    full_refresh without an earlier fetch or when the draw (a hash of the host, so
    that it can be repeated) is below the probability; incremental when a page
    failed or changed; no_update when all are as before.
    """
    newest = fetches(pages).where("nth = 1")
    per_host = newest.groupBy("host").agg(
        F.count("*").alias("pages"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.count_if(F.col("ok") & F.col("earlier").isNotNull() & (F.col("earlier") != F.col("hash"))).alias("changed"),
        F.count_if(F.col("earlier").isNotNull()).alias("known"),
    )
    digits, name = F.lit("0123456789abcdef"), F.sha2("host", 256)
    draw = ((F.instr(digits, F.substring(name, 1, 1)) - 1) * 16 + F.instr(digits, F.substring(name, 2, 1)) - 1) / 256
    mode = (
        F.when(F.col("known") == 0, "full_refresh")
        .when(F.col("failed") > 0, "incremental")
        .when(draw < probability, "full_refresh")
        .when(F.col("changed") == 0, "no_update")
        .otherwise("incremental")
    )
    return per_host.select("host", "pages", "failed", "changed", mode.alias("mode"))


def unchanged_hosts(pages: DataFrame) -> DataFrame:
    """(host, unchanged): whether every page of a host that had a hash before has it still; true where no page had one."""
    newest = fetches(pages).where("nth = 1")
    same = F.when(F.col("earlier").isNotNull(), F.coalesce(F.col("hash") == F.col("earlier"), F.lit(False)))
    return newest.groupBy("host").agg(F.coalesce(F.bool_and(same), F.lit(True)).alias("unchanged"))


def reusable(items: DataFrame, newest: DataFrame, cached: DataFrame) -> DataFrame:
    """The items (with url and item) whose page has the hash it had before and that the cache (item) holds: they need no new extraction."""
    same = newest.where("hash = earlier").select("url")
    return items.join(same, "url", "left_semi").join(cached.select("item").distinct(), "item", "left_semi")


def known_but_unseen(known: DataFrame, discovered: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """The known items that this run didn't discover, but the cache holds: they are appended to what it found."""
    return known.join(discovered.select(key).distinct(), key, "left_anti").join(cached, key)
