"""Links of pages, the frontier of a crawl and start addresses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import text, urls
from brindle.sources.scratch import Scratch


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, url, pos, href, target, anchor): the navigable links of each page in order, made absolute."""
    shown = text.strip_noise(F.col("html"))
    pattern = r'(?is)<a\b[^>]*?\bhref="([^"]*)"[^>]*>(.*?)</a>'
    # One pass over the page; the link's parts are taken from the link alone.
    each = F.transform(F.regexp_extract_all(shown, F.lit(pattern), F.lit(0)), lambda a: F.struct(F.regexp_extract(a, pattern, 1).alias("href"), F.regexp_extract(a, pattern, 2).alias("anchor")))
    links = pages.where("html is not null").select("page_id", "url", F.posexplode(each).alias("pos", "l"))
    found = links.select("page_id", "url", "pos", F.trim("l.href").alias("href"), F.trim(F.regexp_replace("l.anchor", r"<[^>]*>", "")).alias("anchor"))
    return found.where(urls.is_navigable(F.col("href"))).withColumn("target", urls.absolute(F.col("href"), F.col("url")))


def distinct_links(links: DataFrame) -> DataFrame:
    """(page_id, target, anchor, pos): each target of a page once, with its first anchor."""
    return links.groupBy("page_id", "target").agg(F.min(F.struct("pos", "anchor")).alias("m")).select("page_id", "target", "m.anchor", "m.pos")


def followable(links: DataFrame) -> DataFrame:
    """The links that lead on: pages with content that aren't mere filters of the page they stand on."""
    return links.where(~urls.is_non_content(F.col("target")) & ~urls.is_faceted(F.col("target"), F.col("url")))


def crawl(edges: DataFrame, starts: DataFrame, depth: int = 2) -> DataFrame:
    """(start, url, depth): every page that can be reached from each start in at most `depth` steps, with the fewest steps.

    `edges` has source and target, `starts` url. Breadth first: each level joins the
    frontier with the links and takes out what was met before, so that cycles end.
    """
    scratch = Scratch(edges.sparkSession, "crawl")
    edges = edges.select("source", "target").distinct()
    front = starts.select(F.col("url").alias("start"), "url").distinct().withColumn("depth", F.lit(0))
    levels = [front]
    for d in range(1, depth + 1):
        seen = reduce(DataFrame.unionByName, levels).select("start", "url")
        step = front.join(edges, front["url"] == edges["source"]).select("start", F.col("target").alias("url")).distinct()
        front = scratch.keep(step.join(seen, ["start", "url"], "left_anti").withColumn("depth", F.lit(d)))
        levels.append(front)
    return reduce(DataFrame.unionByName, levels)


def crawl_in_order(edges: DataFrame, starts: DataFrame, depth: int = 2, pages: int = 20) -> DataFrame:
    """(start, url, place): the first `pages` pages of each start in the order of a crawl that follows each link, as deep as `depth`, before the next one.

    `edges` has source, target and pos (unique in a source). Every way of at most
    `depth` links is a list of positions, and the crawl's order is the lists' order. A
    page is visited on the first way that leads to it over visited pages' own ways,
    and only that way goes on from it: the ways are thinned out until none changes.
    A way with at least `pages` visited pages before it is beyond the limit.
    """
    scratch = Scratch(edges.sparkSession, "crawl-order")
    links = edges.groupBy("source", "target").agg(F.min("pos").alias("pos"))
    root = F.array().cast("array<bigint>")
    front = starts.select(F.col("url").alias("start"), "url", root.alias("way"), F.lit(None).cast("array<bigint>").alias("from"))
    ways = front
    for _ in range(depth):
        front = front.join(links, front["url"] == links["source"]).select("start", F.col("target").alias("url"), F.concat("way", F.array(F.col("pos").cast("long"))).alias("way"), F.col("way").alias("from"))
        front = scratch.keep(front)
        ways = ways.unionByName(front)
    ways = scratch.keep(ways)
    first = ways.groupBy("start", "url").agg(F.min("way").alias("way"))
    while True:
        visited = scratch.keep(first)
        open_ = ways.join(visited.select("start", F.col("way").alias("from")), ["start", "from"], "left_semi").unionByName(ways.where("from is null"))
        first = open_.groupBy("start", "url").agg(F.min("way").alias("way"))
        if not first.exceptAll(visited).take(1) and not visited.exceptAll(first).take(1):
            break
    w = Window.partitionBy("start").orderBy("way")
    return visited.withColumn("place", F.row_number().over(w)).where(F.col("place") <= pages).select("start", "url", "place")


def first_addresses(ranked: DataFrame, group: str, limit: int = 200) -> DataFrame:
    """(group, url, priority, pos): each address of a group once, by its best priority and place, the first `limit` of them."""
    best = ranked.groupBy(group, "url").agg(F.min(F.struct("priority", "pos")).alias("m")).select(group, "url", "m.priority", "m.pos")
    w = Window.partitionBy(group).orderBy("priority", "pos", "url")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
