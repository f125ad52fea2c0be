"""Queries of the page, session, event and record operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions import text, urls
from brindle.operators import changes, events, links, positions, records, store
from brindle.sources.tables import spread, table

NOISE_SQL = "html"
for _t in text.NOISE:
    NOISE_SQL = f"regexp_replace({NOISE_SQL}, '(?is)<{_t}\\b[^>]*>.*?</{_t}\\s*>', '', 'g')"
PLAIN_SQL = f"trim(regexp_replace(regexp_replace({NOISE_SQL}, '(?s)<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))"


def _url_part(url: str, group: int) -> str:
    return f"regexp_extract({url}, '{urls.SPLIT}', {group})"


def _path(url: str) -> str:
    return f"regexp_replace({_url_part(url, 3)}, ';[^/]*$', '')"


FETCHES_SQL = f"""SELECT page_id, url, fetched_at, status_code, ok, {_url_part('url', 2)} AS host, sha256({PLAIN_SQL}) AS hash,
  row_number() OVER w AS nth, lead(sha256({PLAIN_SQL})) OVER w AS earlier FROM pages
  WINDOW w AS (PARTITION BY url ORDER BY fetched_at DESC, page_id DESC)"""
ONCE_SQL = "SELECT * FROM event_log QUALIFY row_number() OVER (PARTITION BY run_id, id ORDER BY ingested_at) = 1"
EVENT_COLUMNS = ["run_id", "id", "type", "message", "task", "latency_ms", "url", "status_code", "title", "item_type", "item_name", "errors", "passed", "chunk_preview"]


def _names(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def pages(spark: SparkSession, d: str) -> DataFrame:
    """The fetched pages; their HTML is worked on by expressions that take long, so that every core gets some."""
    return spread(table(spark, d, "pages"), "page_id")


def once(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return events.once(table(spark, d, "event_log"), list(columns) or EVENT_COLUMNS)


def page_content_hash(spark: SparkSession, d: str) -> DataFrame:
    shown = pages(spark, d).where("html is not null")
    return shown.select("page_id", text.content_hash(text.plain_text(F.col("html"))).alias("hash"), F.length(text.plain_text(F.col("html"))).cast("long").alias("chars"))


def site_snapshot_hash(spark: SparkSession, d: str) -> DataFrame:
    return changes.snapshot(pages(spark, d))


def extraction_plan(spark: SparkSession, d: str) -> DataFrame:
    return changes.refresh_plan(pages(spark, d))


def changed_pages(spark: SparkSession, d: str) -> DataFrame:
    return changes.changed_pages(pages(spark, d))


def document_content_hash_dups(spark: SparkSession, d: str) -> DataFrame:
    hashed = table(spark, d, "documents").where("text is not null").select("doc_id", text.content_hash(F.col("text")).alias("hash"))
    return hashed.groupBy("hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


def page_links(spark: SparkSession, d: str) -> DataFrame:
    return links.page_links(pages(spark, d)).select("page_id", F.col("pos").cast("long").alias("pos"), "href", "target", "anchor")


LINKS_SQL = f"""SELECT page_id, url, pos, href, anchor,
  CASE WHEN href ~ '^[A-Za-z][A-Za-z0-9+.-]*:' THEN href
    WHEN href LIKE '//%' THEN {_url_part('url', 1)} || ':' || href
    WHEN href LIKE '/%' THEN {_url_part('url', 1)} || '://' || {_url_part('url', 2)} || href
    WHEN href LIKE '?%' THEN {_url_part('url', 1)} || '://' || {_url_part('url', 2)} || {_url_part('url', 3)} || href
    ELSE {_url_part('url', 1)} || '://' || {_url_part('url', 2)} ||
      coalesce(nullif(regexp_replace({_url_part('url', 3)}, '[^/]*$', ''), ''), '/') || href END AS target
FROM (SELECT page_id, url, pos - 1 AS pos, trim(regexp_extract(l, '(?is)href="([^"]*)"', 1)) AS href,
    trim(regexp_replace(regexp_extract(l, '(?is)<a\\b[^>]*>(.*?)</a>', 1), '<[^>]*>', '', 'g')) AS anchor
  FROM (SELECT page_id, url, unnest(x) AS l, generate_subscripts(x, 1) AS pos
    FROM (SELECT page_id, url, regexp_extract_all({NOISE_SQL}, '(?is)<a\\b[^>]*?\\bhref="[^"]*"[^>]*>.*?</a>') AS x FROM pages WHERE html IS NOT NULL)))
WHERE href <> '' AND href NOT LIKE '#%' AND (NOT href ~ '^[A-Za-z][A-Za-z0-9+.-]*:' OR lower(href) ~ '^https?:')"""


def distinct_links(spark: SparkSession, d: str) -> DataFrame:
    return links.distinct_links(links.page_links(pages(spark, d))).select("page_id", "target", "anchor")


def followable_links(spark: SparkSession, d: str) -> DataFrame:
    return links.followable(links.page_links(pages(spark, d))).groupBy("target").agg(F.count("*").alias("links"), F.countDistinct("page_id").alias("pages"))


def non_content_urls(spark: SparkSession, d: str) -> DataFrame:
    found = links.page_links(pages(spark, d)).select("target").distinct()
    # The data has few such links: each target is also judged with a segment put behind it.
    more = found.select(F.explode(F.array(F.col("target"), F.concat("target", F.lit("/Edit")), F.concat("target", F.lit("/search?new=1")))).alias("url"))
    return more.select("url", urls.is_non_content(F.col("url")).alias("non_content"))


def faceted_urls(spark: SparkSession, d: str) -> DataFrame:
    seen = pages(spark, d).select("url").distinct()
    tails = ["?sort=date", "?Level=beginner&page=2", "?q=", "?page=3", "/?format=online&format=x&lang=de", "?from=a&other=1", "/deeper?sort=date", "?%73ort=1", ""]
    bare = F.regexp_replace("url", r"[?#].*$", "")
    made = seen.select(F.col("url").alias("source"), F.explode(F.array(*[F.concat(bare, F.lit(t)) for t in tails])).alias("url"))
    return made.select("source", "url", urls.is_faceted(F.col("url"), F.col("source")).alias("faceted"))


def url_parts(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return pages(spark, d).select("page_id", urls.scheme(u).alias("scheme"), urls.host(u).alias("host"), urls.path(u).alias("path"), urls.query(u).alias("query"), urls.directory_name(u).alias("directory"))


def host_page_counts(spark: SparkSession, d: str) -> DataFrame:
    status = F.col("status_code")
    kind = F.when(status.isin(401, 403), "denied").when(status >= 400, "error").otherwise("fetched")
    return pages(spark, d).groupBy(urls.host(F.col("url")).alias("host"), kind.alias("outcome")).agg(F.count("*").alias("pages"), F.countDistinct("url").alias("urls"))


def common_path_prefix(spark: SparkSession, d: str) -> DataFrame:
    paths = table(spark, d, "results").where("url is not null").select(urls.host(F.col("url")).alias("host"), urls.path(F.col("url")).alias("path"))
    return records.common_prefix(paths, "host", "path")


def crawl_frontier(spark: SparkSession, d: str) -> DataFrame:
    """Pages within two links of each site's first fetched page, over the addresses that were fetched."""
    seen = pages(spark, d).where("ok").select("page_id", "url", "html")
    edges = links.followable(links.page_links(seen)).select(F.col("url").alias("source"), "target")
    starts = seen.groupBy(urls.host(F.col("url")).alias("host")).agg(F.min("url").alias("url"))
    return links.crawl(edges, starts.select("url"), 2).groupBy("start", "depth").agg(F.count("*").alias("pages"))


def crawl_order(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty pages of a crawl from each site's first fetched page, two links deep, each link followed before the next."""
    seen = pages(spark, d).where("ok").select("page_id", "url", "html")
    edges = links.followable(links.page_links(seen)).select(F.col("url").alias("source"), "target", F.col("pos").cast("long").alias("pos"))
    starts = seen.groupBy(urls.host(F.col("url")).alias("host")).agg(F.min("url").alias("url"))
    return links.crawl_in_order(edges, starts.select("url"))


def start_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Each site's own address, then those of its newest cache rows, the first 200."""
    own = table(spark, d, "sites").select(urls.host(F.col("url")).alias("host"), "url", F.lit(0).alias("priority"), F.lit(0).cast("long").alias("pos"))
    cached = table(spark, d, "metadata_cache").select(urls.host(F.col("url")).alias("host"), "url", F.lit(1).alias("priority"), F.col("id").alias("pos"))
    return links.first_addresses(own.unionByName(cached), "host", 200).select("host", "url", F.col("rank").cast("long").alias("rank"))


def head_tail_excerpt(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", text.head_and_tail(F.col("text"), 1200, 500).alias("excerpt"))


def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id").where("text is not null")
    cut = docs.select("doc_id", text.chunks(F.col("text"), 1000, 100).alias("c"))
    return cut.select("doc_id", F.size("c").alias("of"), F.posexplode("c").alias("chunk_no", "chunk"))


def join_chunks_with_limit(spark: SparkSession, d: str) -> DataFrame:
    return events.joined_texts(once(spark, d, "type", "chunk_preview").where("type = 'llm_call'"), "chunk_preview", 4000)


def event_summary(spark: SparkSession, d: str) -> DataFrame:
    return events.run_summary(once(spark, d, "type", "latency_ms", "errors", "passed"))


def event_summary_by_task(spark: SparkSession, d: str) -> DataFrame:
    return events.task_summary(once(spark, d, "type", "task", "latency_ms"))


def progress_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    return events.checkpoints(once(spark, d, "type")).select("run_id", "id", F.col("n").cast("long").alias("n"))


def console_lines(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, *[c for c in EVENT_COLUMNS if c != "chunk_preview"]).select("run_id", "id", events.display_line().alias("line"))


def json_tolerant_parse(spark: SparkSession, d: str) -> DataFrame:
    """How the answers of each task parse: whole, by the braces in them, or not at all."""
    calls = once(spark, d, "type", "task", "response_preview").where("type = 'llm_call' and response_preview is not null")
    r = F.col("response_preview")
    inner = F.try_parse_json(F.regexp_extract(r, r"(?s)\{.*\}", 0))
    how = F.when(F.try_parse_json(r).isNotNull(), "whole").when(inner.isNotNull(), "salvaged").otherwise("none")
    return calls.groupBy("task", how.alias("parsed")).agg(F.count("*").alias("answers"))


def latest_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The newest session of each user and address, and the newest done and active ones (-1 for none)."""
    s = table(spark, d, "sessions")
    newest = lambda cond: F.coalesce(F.max(F.when(cond, F.col("id"))), F.lit(-1).cast("long"))
    return s.groupBy("user_id", "url").agg(
        F.max("id").alias("latest"), newest(F.col("status") == "done").alias("latest_done"), newest(F.col("status").isin("pending", "running")).alias("latest_active")
    )


def waiting_sessions(spark: SparkSession, d: str) -> DataFrame:
    return store.waiting(table(spark, d, "sessions").select("id", "user_id", "url", "status", "log")).select("id", "user_id", "url", "status", "place")


def cache_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The cache as upserts of all exported rows in the order of their update would leave it."""
    rows = table(spark, d, "metadata_cache")
    merged = store.merge_versions(rows, "url", F.struct("updated_at", "id"), ["content_hash", "structural_summary", "last_crawled_at"])
    return merged.select("url", "content_hash", text.content_hash(F.col("structural_summary")).alias("summary_hash"), F.unix_micros("last_crawled_at").alias("last_crawled_us"))


def session_export(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sessions")
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.unix_micros(F.max("created_at")).alias("newest_us"), F.count_if(F.col("result_json").isNotNull()).alias("with_result"))


def orphan_sessions(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "users").select(F.col("id").alias("user_id"))
    return table(spark, d, "sessions").join(users, "user_id", "left_anti").select("id", "user_id")


def record_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "results").where("trim(name) <> ''").select("name", "url", "record_id", "extracted_at", "type")
    return records.first_of_equals(rows, ["name", "url"], ["extracted_at", "record_id"]).select("name", "url", "record_id", "type")


def record_validation(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "results").select("record_id", records.violations().alias("e")).select("record_id", F.size("e").alias("n_errors"), F.array_join("e", "; ").alias("errors"))


def validation_report(spark: SparkSession, d: str) -> DataFrame:
    label = F.coalesce("name", "url", F.concat(F.lit("item "), F.col("idx").cast("string")))
    return table(spark, d, "results").select("record_id", records.report_line(label, records.violations()).alias("line"))


def record_conventions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "results").select(
        "record_id", records.conforms_to(F.coalesce("type", F.lit(""))).alias("conforms_to"), records.record_id(F.col("id"), F.col("url"), F.concat(F.lit("urn:record:"), F.col("record_id").cast("string"))).alias("full_id")
    )


def record_normal_forms(spark: SparkSession, d: str) -> DataFrame:
    language = F.array_sort(F.array_distinct(F.transform(F.coalesce("in_language", F.array()), records.language_tag)))
    return table(spark, d, "results").select("record_id", records.level(F.col("educational_level")).alias("level"), F.array_join(language, ",").alias("languages"), records.completeness().alias("completeness"))


def best_records(spark: SparkSession, d: str) -> DataFrame:
    """The most complete record of each address."""
    scored = table(spark, d, "results").where("url is not null").select("url", "record_id", records.completeness().alias("completeness"))
    return store.newest(scored, ["url"], F.struct("completeness", "record_id"))


def reused_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of runs whose address an earlier run had extracted under the same name: the earlier record can be used again."""
    rows = table(spark, d, "results").where("url is not null").select("record_id", "run_id", "url", "name", "extracted_at")
    first = rows.groupBy("url", "name").agg(F.min_by("record_id", F.struct("extracted_at", "record_id")).alias("earlier"))
    first = first.withColumnsRenamed({"url": "url_f", "name": "name_f"})
    met = rows.join(first, (F.col("url") == F.col("url_f")) & F.col("name").eqNullSafe(F.col("name_f")))
    return met.where("earlier <> record_id").select("record_id", "earlier")


def relevant_chunks(spark: SparkSession, d: str) -> DataFrame:
    """For each run the number of chunks the model found relevant; runs without any fall back to their first chunk."""
    calls = once(spark, d, "type", "task", "response_preview", "chunk_preview").where("type = 'llm_call' and task = 'content_relevance'")
    judged = calls.withColumn("relevant", F.coalesce(F.try_variant_get(text.tolerant_json(F.col("response_preview")), "$.relevant", "boolean"), F.lit(False)))
    return judged.groupBy("run_id").agg(
        F.count("*").alias("chunks"), F.count_if("relevant").alias("relevant"), F.coalesce(F.min(F.when(F.col("relevant"), F.col("id"))), F.min("id")).alias("first_used")
    )


def carried_context(spark: SparkSession, d: str) -> DataFrame:
    """What each page text inherits from the one before it in its run: that text's first sentence."""
    calls = once(spark, d, "type", "chunk_preview").where("type = 'llm_call' and chunk_preview <> ''")
    first = F.nullif(F.regexp_extract("chunk_preview", r"([A-Z][^.!?\n]{10,200}[.!?])", 1), F.lit(""))
    placed = positions.carried(calls.select("run_id", "id", first.alias("first")), ["run_id"], ["id"], F.struct("first"), "before")
    return placed.select("run_id", "id", F.col("before.first").alias("context"))


def site_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Each host's records: their number, a hash of their first 200 addresses in order, and the addresses' common beginning."""
    items = table(spark, d, "results").select("record_id", F.coalesce(F.nullif("url", F.lit("")), F.nullif("id", F.lit(""))).alias("item")).where("item is not null")
    placed = items.withColumn("host", urls.host(F.col("item")))
    counted = placed.groupBy("host").agg(F.count("*").alias("item_count"))
    first = placed.withColumn("n", F.row_number().over(Window.partitionBy("host").orderBy("record_id"))).where("n <= 200")
    listed = first.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("n", "item"))).alias("l"))
    prefix = records.common_prefix(placed.withColumn("path", urls.path(F.col("item"))), "host", "path")
    hashed = listed.select("host", text.content_hash(F.array_join(F.col("l.item"), "\n")).alias("urls_hash"))
    return counted.join(hashed, "host").join(prefix, "host")


def prompt_log(spark: SparkSession, d: str) -> DataFrame:
    """Each run's prompts in order, joined and cut at 4000 characters; a run needs no more than its first 4000 prompts."""
    calls = once(spark, d, "type", "prompt_preview").where("type = 'llm_call' and prompt_preview is not null")
    first = calls.withColumn("n", F.row_number().over(Window.partitionBy("run_id").orderBy("id"))).where("n <= 4000")
    joined = F.array_sort(F.collect_list(F.struct("n", "prompt_preview")))
    return first.groupBy("run_id").agg(F.left(F.array_join(F.transform(joined, lambda p: p.prompt_preview), "\n"), F.lit(4000)).alias("prompts"))


def fetch_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Fetches by host and by size as people read it."""
    fetched = once(spark, d, "type", "url", "content_length").where("type = 'fetch' and content_length is not null")
    n = F.col("content_length")
    size = F.when(n >= 1024, F.concat(F.ceil(n / 1024).cast("string"), F.lit(" KB"))).otherwise(F.concat(n.cast("string"), F.lit(" B")))
    return fetched.groupBy(urls.host(F.col("url")).alias("host"), size.alias("size")).agg(F.count("*").alias("fetches"))


def logged_sessions(spark: SparkSession, d: str) -> DataFrame:
    """How many events and records each session's JSON columns hold; -1 where they hold no array."""
    s = table(spark, d, "sessions")
    return s.select("id", F.coalesce(F.json_array_length("log"), F.lit(-1)).alias("events"), F.coalesce(F.json_array_length("result_json"), F.lit(-1)).alias("records"))


def structure_pages(spark: SparkSession, d: str) -> DataFrame:
    """The first seven content pages of its own host that each host's first fetched page links to, in the order of their first link."""
    seen = pages(spark, d).where("ok")
    start = seen.groupBy(urls.host(F.col("url")).alias("host")).agg(F.min(F.struct("url", "page_id")).alias("m")).select("host", "m.page_id")
    found = links.page_links(seen).join(start, "page_id")
    own = found.where((urls.host(F.col("target")) == F.col("host")) & ~urls.is_non_content(F.col("target")))
    ranked = own.select("host", F.col("target").alias("url"), F.lit(0).alias("priority"), F.col("pos").cast("long").alias("pos"))
    return links.first_addresses(ranked, "host", 7).select("host", "url", F.col("rank").cast("long").alias("rank"))


def record_pages(spark: SparkSession, d: str) -> DataFrame:
    """What each record would be read from: the newest fetch of its own address, else of the address its run started from, else none (-1)."""
    newest = changes.fetches(pages(spark, d)).where("nth = 1 and ok")
    own = newest.select("url", F.col("page_id").alias("own"))
    source = newest.select(F.col("url").alias("source_url"), F.col("page_id").alias("source"))
    starts = table(spark, d, "sessions").select(F.concat(F.lit("run-"), F.col("id").cast("string")).alias("run_id"), F.col("url").alias("source_url"))
    wanted = table(spark, d, "results").select("record_id", "run_id", "url").join(starts, "run_id", "left")
    return wanted.join(own, "url", "left").join(source, "source_url", "left").select("record_id", F.coalesce("own", "source", F.lit(-1).cast("long")).alias("page_id"))


def users_by_identifier(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "users")
    given = u.select("id", F.explode(F.array(F.col("id").cast("string"), F.col("token_hash"), F.concat(F.lit("tok-"), F.col("id").cast("string")))).alias("identifier"))
    return given.select("id", "identifier", store.identifier_kind(F.col("identifier")).alias("kind"))


QUERIES = {f.__name__: f for f in (
    page_content_hash, site_snapshot_hash, extraction_plan, changed_pages, document_content_hash_dups, page_links, distinct_links, followable_links,
    non_content_urls, faceted_urls, url_parts, host_page_counts, common_path_prefix, crawl_frontier, crawl_order, start_addresses, head_tail_excerpt, chunk_documents,
    join_chunks_with_limit, event_summary, event_summary_by_task, progress_checkpoints, console_lines, json_tolerant_parse, latest_sessions,
    waiting_sessions, cache_upsert, session_export, orphan_sessions, record_dedup, record_validation, validation_report, record_conventions,
    record_normal_forms, best_records, reused_records, relevant_chunks, carried_context, users_by_identifier,
    site_summaries, prompt_log, fetch_sizes, logged_sessions, structure_pages, record_pages,
)}


def _violations_sql() -> str:
    date = r"^\d{4}(-\d{2}(-\d{2}([T ].*)?)?)?$"
    event = "coalesce(type IN ('CourseInstance', 'Event'), false)"
    classes = ", ".join(f"'{c}'" for c in records.CLASSES)
    checks = [
        ("type IS NULL", "@type: is required"), (f"type NOT IN ({classes})", "@type: is no known class"),
        ("coalesce(trim(name) = '', true)", "name: is required"), (r"NOT regexp_matches(url, '^https?://\S+$')", "url: is no address"),
        (f"{event} AND NOT regexp_matches(start_date, '{date}')", "startDate: is no ISO date"), (f"{event} AND NOT regexp_matches(end_date, '{date}')", "endDate: is no ISO date"),
        ("start_date > end_date", "endDate: is before startDate"), (f"NOT {event} AND coalesce(trim(description) = '', true)", "description: is required"),
    ]
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{m}' END" for c, m in checks) + "], lambda x: x IS NOT NULL)"


_TEXTS = ["name", "description", "url", "keywords", "teaches", "license", "educational_level", "time_required"]
_COMPLETE = "round((" + " + ".join([f"coalesce(trim({c}) <> '', false)::INT" for c in _TEXTS] + [f"coalesce(len({c}) > 0, false)::INT" for c in ("author", "in_language")]) + ") / 10, 2)"
_PARAMS = "list_distinct(list_transform(list_filter(string_split({q}, '&'), lambda t: t <> ''), lambda t: lower(url_decode(replace(split_part(t, '=', 1), '+', ' ')))))"
_NON_CONTENT = f"list_has_any(string_split(lower({_path('{u}')}), '/'), {_names(urls.NON_CONTENT_SEGMENTS)})".replace("{u}", "URL_")


def _faceted(u: str, source: str) -> str:
    p = _PARAMS.format(q=_url_part(u, 4))
    return f"(rtrim({_path(u)}, '/') = rtrim({_path(source)}, '/') AND len({p}) > 0 AND NOT list_has_any({p}, {_names(urls.PAGINATION_PARAMS)}) AND list_has_all({_names(urls.FILTER_PARAMS)}, {p}))"


def _non_content(u: str) -> str:
    return _NON_CONTENT.replace("URL_", u)


_FOLLOW = f"SELECT * FROM ({LINKS_SQL}) WHERE NOT {_non_content('target')} AND NOT {_faceted('target', 'url')}"
_TAILS = ["?sort=date", "?Level=beginner&page=2", "?q=", "?page=3", "/?format=online&format=x&lang=de", "?from=a&other=1", "/deeper?sort=date", "?%73ort=1", ""]

def _chunk_end(start: str, size: int) -> str:
    """The end of the chunk from `start`: the last paragraph, else the last of the first kind of sentence end, past the middle of its window, else all of it."""
    window = f"substr(text, {start} + 1, {size})"
    places = [("\\n\\n", 0), ("\\. ", 2), ("\\.\\n", 2), ("\\? ", 2), ("! ", 2)]
    found = [(f"length(regexp_extract({window}, '(?s)^(.*){mark}', 1))", more) for mark, more in places]
    return f"CASE WHEN n - ({start}) <= {size} THEN n " + " ".join(f"WHEN {at} > {size // 2} THEN {start} + {at} + {more}" for at, more in found) + f" ELSE {start} + {size} END"


SQL = {
    "chunk_documents": f"""WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, 0 AS no, 0 AS a, {_chunk_end('0', 1000)} AS b, n <= 1000 AS last FROM d
  UNION ALL SELECT doc_id, no + 1, a, {_chunk_end('a', 1000)}, n - a <= 1000 FROM (SELECT c.doc_id, c.no, greatest(c.a + 1, c.b - 100) AS a, d.text, d.n FROM c JOIN d USING (doc_id) WHERE NOT c.last))
SELECT doc_id, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS of, no AS chunk_no, substr(text, a + 1, b - a) AS chunk FROM c JOIN d USING (doc_id)""",
    "page_content_hash": f"SELECT page_id, sha256({PLAIN_SQL}) AS hash, length({PLAIN_SQL}) AS chars FROM pages WHERE html IS NOT NULL",
    "site_snapshot_hash": f"""WITH b AS (SELECT host, left(sha256(url), 3) AS block, count(*) AS pages, sha256('[' || string_agg('["' || url || '","' || hash || '"]', ',' ORDER BY url, hash) || ']') AS hash,
  max(CASE WHEN {_path('url')} IN ('', '/') THEN hash END) AS root FROM ({FETCHES_SQL}) WHERE nth = 1 AND hash IS NOT NULL GROUP BY 1, 2)
SELECT host, CAST(sum(pages) AS BIGINT) AS pages, sha256('{{"pages":[' || string_agg('["' || block || '","' || hash || '"]', ',' ORDER BY block) || '],"root_hash":' || coalesce('"' || max(root) || '"', 'null') || '}}') AS snapshot_hash FROM b GROUP BY host""",
    "extraction_plan": f"""SELECT host, pages, failed, changed, CASE WHEN known = 0 THEN 'full_refresh' WHEN failed > 0 THEN 'incremental'
  WHEN ((instr('0123456789abcdef', substr(sha256(host), 1, 1)) - 1) * 16 + instr('0123456789abcdef', substr(sha256(host), 2, 1)) - 1) / 256 < 0.05 THEN 'full_refresh'
  WHEN changed = 0 THEN 'no_update' ELSE 'incremental' END AS mode
FROM (SELECT host, count(*) AS pages, count(CASE WHEN NOT ok THEN 1 END) AS failed, count(CASE WHEN ok AND earlier IS NOT NULL AND earlier <> hash THEN 1 END) AS changed, count(CASE WHEN earlier IS NOT NULL THEN 1 END) AS known
  FROM ({FETCHES_SQL}) WHERE nth = 1 GROUP BY host)""",
    "changed_pages": f"SELECT url, page_id, hash FROM ({FETCHES_SQL}) WHERE nth = 1 AND hash IS NOT NULL AND (earlier IS NULL OR earlier <> hash)",
    "document_content_hash_dups": "SELECT sha256(text) AS hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "page_links": f"SELECT page_id, pos, href, target, anchor FROM ({LINKS_SQL})",
    "distinct_links": f"SELECT page_id, target, arg_min(anchor, pos) AS anchor FROM ({LINKS_SQL}) GROUP BY 1, 2",
    "followable_links": f"SELECT target, count(*) AS links, count(DISTINCT page_id) AS pages FROM ({_FOLLOW}) GROUP BY 1",
    "non_content_urls": f"SELECT url, {_non_content('url')} AS non_content FROM (SELECT unnest([target, target || '/Edit', target || '/search?new=1']) AS url FROM (SELECT DISTINCT target FROM ({LINKS_SQL})))",
    "faceted_urls": f"SELECT source, url, {_faceted('url', 'source')} AS faceted FROM (SELECT url AS source, unnest([{', '.join(f'''regexp_replace(url, '[?#].*$', '') || '{t}' ''' for t in _TAILS)}]) AS url FROM (SELECT DISTINCT url FROM pages))",
    "url_parts": f"""SELECT page_id, lower({_url_part('url', 1)}) AS scheme, {_url_part('url', 2)} AS host, {_path('url')} AS path, {_url_part('url', 4)} AS query,
  left(trim(regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '[^a-zA-Z0-9_-]', '_', 'g'), '_+', '_', 'g'), '_'), 80) AS directory FROM pages""",
    "host_page_counts": f"SELECT {_url_part('url', 2)} AS host, CASE WHEN status_code IN (401, 403) THEN 'denied' WHEN status_code >= 400 THEN 'error' ELSE 'fetched' END AS outcome, count(*) AS pages, count(DISTINCT url) AS urls FROM pages GROUP BY 1, 2",
    "common_path_prefix": f"""WITH p AS (SELECT {_url_part('url', 2)} AS host, string_split({_path('url')}, '/') AS s FROM results WHERE url IS NOT NULL),
n AS (SELECT host, k, count(DISTINCT s[1:k]) AS d, count(CASE WHEN len(s) >= k THEN 1 END) AS c, count(*) AS total, any_value(s) AS s FROM p, generate_series(1, 12) g(k) GROUP BY host, k)
SELECT host, coalesce(max_by(array_to_string(s[1:k], '/'), k) FILTER (WHERE d = 1 AND c = total), '') AS prefix FROM n GROUP BY host""",
    "crawl_frontier": f"""WITH RECURSIVE e AS (SELECT DISTINCT url AS source, target FROM ({_FOLLOW.replace('FROM pages WHERE html', 'FROM pages WHERE ok AND html')})),
s AS (SELECT min(url) AS url FROM pages WHERE ok GROUP BY {_url_part('url', 2)}),
r AS (SELECT url AS start, url, 0 AS depth FROM s UNION SELECT r.start, e.target, r.depth + 1 FROM r JOIN e ON e.source = r.url WHERE r.depth < 2)
SELECT start, depth, count(*) AS pages FROM (SELECT start, url, min(depth) AS depth FROM r GROUP BY 1, 2) GROUP BY 1, 2""",
    "start_addresses": f"""WITH a AS (SELECT {_url_part('url', 2)} AS host, url, 0 AS priority, 0 AS pos FROM sites UNION ALL SELECT {_url_part('url', 2)}, url, 1, id FROM metadata_cache),
b AS (SELECT host, url, arg_min(pos, (priority, pos)) AS pos, min(priority) AS priority FROM a GROUP BY 1, 2)
SELECT host, url, rank FROM (SELECT host, url, row_number() OVER (PARTITION BY host ORDER BY priority, pos, url) AS rank FROM b) WHERE rank <= 200""",
    "head_tail_excerpt": "SELECT doc_id, CASE WHEN length(text) > 1200 THEN left(text, 500) || chr(10) || '[...]' || chr(10) || right(text, 500) ELSE text END AS excerpt FROM documents WHERE text IS NOT NULL",
    "join_chunks_with_limit": f"""WITH g AS (SELECT run_id, id, chunk_preview AS t FROM ({ONCE_SQL}) WHERE type = 'llm_call' AND length(chunk_preview) > 0),
o AS (SELECT *, row_number() OVER w AS n, sum(length(t)) OVER w + 7 * (row_number() OVER w - 1) AS used FROM g WINDOW w AS (PARTITION BY run_id ORDER BY id))
SELECT run_id, count(*) AS parts, left(string_agg(t, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n), 4000) AS joined FROM o WHERE used <= 4000 OR n = 1 GROUP BY 1""",
    "event_summary": f"""SELECT run_id, count(CASE WHEN type = 'llm_call' THEN 1 END) AS llm_calls, round(coalesce(sum(CASE WHEN type = 'llm_call' THEN latency_ms END), 0), 1) AS total_llm_ms,
  count(CASE WHEN type = 'fetch' THEN 1 END) AS fetches, count(CASE WHEN type = 'item_found' THEN 1 END) AS items_found, count(CASE WHEN type = 'validation' THEN 1 END) AS validations,
  CAST(coalesce(sum(CASE WHEN type = 'validation' THEN coalesce(len(errors), 0) END), 0) AS BIGINT) AS validation_errors,
  count(CASE WHEN type = 'validation' AND NOT passed THEN 1 END) AS failed_validations, count(CASE WHEN type = 'warn' THEN 1 END) AS warnings FROM ({ONCE_SQL}) GROUP BY 1""",
    "event_summary_by_task": f"SELECT run_id, task, count(*) AS calls, round(sum(latency_ms), 1) AS total_ms FROM ({ONCE_SQL}) WHERE type = 'llm_call' GROUP BY 1, 2",
    "progress_checkpoints": f"SELECT run_id, id, n FROM (SELECT run_id, id, row_number() OVER (PARTITION BY run_id ORDER BY id) AS n FROM ({ONCE_SQL})) WHERE n <= 3 OR n % 10 = 0",
    "console_lines": f"""SELECT run_id, id, CASE type WHEN 'info' THEN message WHEN 'warn' THEN '! ' || message WHEN 'llm_call' THEN '[LLM:' || task || '] ' || CAST(round(latency_ms) AS BIGINT) || ' ms'
  WHEN 'fetch' THEN '< ' || url || ' [' || status_code || ']' WHEN 'item_found' THEN '* ' || title || ' (' || item_type || ')'
  WHEN 'validation' THEN CASE WHEN passed THEN 'ok ' ELSE 'not ok ' END || item_name || CASE WHEN coalesce(len(errors), 0) > 0 THEN ' – ' || len(errors) || ' error(s)' ELSE '' END END AS line FROM ({ONCE_SQL})""",
    "json_tolerant_parse": f"""SELECT task, CASE WHEN json_valid(response_preview) THEN 'whole' WHEN json_valid(nullif(regexp_extract(response_preview, '(?s)\\{{.*\\}}'), '')) THEN 'salvaged' ELSE 'none' END AS parsed,
  count(*) AS answers FROM ({ONCE_SQL}) WHERE type = 'llm_call' AND response_preview IS NOT NULL GROUP BY 1, 2""",
    "latest_sessions": "SELECT user_id, url, max(id) AS latest, coalesce(max(CASE WHEN status = 'done' THEN id END), -1) AS latest_done, coalesce(max(CASE WHEN status IN ('pending', 'running') THEN id END), -1) AS latest_active FROM sessions GROUP BY 1, 2",
    "waiting_sessions": "SELECT id, user_id, url, status, row_number() OVER (ORDER BY id) AS place FROM sessions WHERE status = 'pending' OR (status = 'running' AND (log IS NULL OR trim(log) = '' OR (json_valid(log) AND json_array_length(log) = 0 AND trim(log) LIKE '[%')))",
    "cache_upsert": """SELECT url, arg_max(content_hash, (updated_at, id)) FILTER (WHERE content_hash IS NOT NULL) AS content_hash,
  sha256(arg_max(structural_summary, (updated_at, id)) FILTER (WHERE structural_summary IS NOT NULL)) AS summary_hash,
  epoch_us(arg_max(last_crawled_at, (updated_at, id)) FILTER (WHERE last_crawled_at IS NOT NULL)) AS last_crawled_us FROM metadata_cache GROUP BY 1""",
    "session_export": "SELECT user_id, count(*) AS sessions, epoch_us(max(created_at)) AS newest_us, count(result_json) AS with_result FROM sessions GROUP BY 1",
    "orphan_sessions": "SELECT id, user_id FROM sessions s WHERE NOT EXISTS (SELECT 1 FROM users u WHERE u.id = s.user_id)",
    "record_dedup": "SELECT name, url, arg_min(record_id, (extracted_at, record_id)) AS record_id, first(type ORDER BY extracted_at, record_id) AS type FROM results WHERE trim(name) <> '' GROUP BY 1, 2",
    "record_validation": f"SELECT record_id, CAST(len(e) AS INTEGER) AS n_errors, array_to_string(e, '; ') AS errors FROM (SELECT record_id, {_violations_sql()} AS e FROM results)",
    "validation_report": f"SELECT record_id, CASE WHEN len(e) = 0 THEN label || ': valid' ELSE label || ': ' || array_to_string(e, '; ') END AS line FROM (SELECT record_id, coalesce(name, url, 'item ' || idx) AS label, {_violations_sql()} AS e FROM results)",
    "record_conventions": f"""SELECT record_id, CASE WHEN contains(coalesce(type, ''), 'CourseInstance') THEN '{records.PROFILES['CourseInstance']}' WHEN contains(coalesce(type, ''), 'Course') THEN '{records.PROFILES['Course']}'
  ELSE '{records.DEFAULT_PROFILE}' END AS conforms_to, coalesce(nullif(id, ''), nullif(url, ''), 'urn:record:' || record_id) AS full_id FROM results""",
    "record_normal_forms": f"""SELECT record_id, CASE WHEN regexp_matches(lower(trim(educational_level)), 'begin|basic|intro|novice') THEN 'beginner' WHEN regexp_matches(lower(trim(educational_level)), 'inter|medium') THEN 'intermediate'
  WHEN regexp_matches(lower(trim(educational_level)), 'adv|expert') THEN 'advanced' END AS level,
  array_to_string(list_sort(list_distinct(list_transform(coalesce(in_language, []), lambda t: lower(trim(split_part(t, '-', 1)))))), ',') AS languages, {_COMPLETE} AS completeness FROM results""",
    "best_records": f"SELECT url, arg_max(record_id, ({_COMPLETE}, record_id)) AS record_id, max({_COMPLETE}) AS completeness FROM results WHERE url IS NOT NULL GROUP BY 1",
    "reused_records": "SELECT record_id, earlier FROM (SELECT record_id, first_value(record_id) OVER (PARTITION BY url, name ORDER BY extracted_at, record_id) AS earlier FROM results WHERE url IS NOT NULL) WHERE earlier <> record_id",
    "relevant_chunks": f"""WITH j AS (SELECT run_id, id, coalesce(CASE WHEN json_valid(r) THEN TRY_CAST(json_extract_string(r, '$.relevant') AS BOOLEAN) END, false) AS relevant FROM (
  SELECT run_id, id, CASE WHEN json_valid(response_preview) THEN response_preview ELSE nullif(regexp_extract(response_preview, '(?s)\\{{.*\\}}'), '') END AS r
  FROM ({ONCE_SQL}) WHERE type = 'llm_call' AND task = 'content_relevance'))
SELECT run_id, count(*) AS chunks, count(CASE WHEN relevant THEN 1 END) AS relevant, coalesce(min(CASE WHEN relevant THEN id END), min(id)) AS first_used FROM j GROUP BY 1""",
    "carried_context": f"""SELECT run_id, id, lag(nullif(regexp_extract(chunk_preview, '([A-Z][^.!?\\n]{{10,200}}[.!?])', 1), '')) OVER (PARTITION BY run_id ORDER BY id) AS context
FROM ({ONCE_SQL}) WHERE type = 'llm_call' AND chunk_preview <> ''""",
    "users_by_identifier": "SELECT id, identifier, CASE WHEN regexp_matches(identifier, '^[0-9]+$') THEN 'id' WHEN regexp_matches(identifier, '^[0-9a-f]{64}$') THEN 'hash' ELSE 'token' END AS kind FROM (SELECT id, unnest([CAST(id AS VARCHAR), token_hash, 'tok-' || id]) AS identifier FROM users)",
    "site_summaries": f"""WITH i AS (SELECT record_id, item, {_url_part('item', 2)} AS host, string_split({_path('item')}, '/') AS s
  FROM (SELECT record_id, coalesce(nullif(url, ''), nullif(id, '')) AS item FROM results) WHERE item IS NOT NULL),
n AS (SELECT host, k, count(DISTINCT s[1:k]) AS d, count(CASE WHEN len(s) >= k THEN 1 END) AS c, count(*) AS total, any_value(s) AS s FROM i, generate_series(1, 12) g(k) GROUP BY host, k),
p AS (SELECT host, coalesce(max_by(array_to_string(s[1:k], '/'), k) FILTER (WHERE d = 1 AND c = total), '') AS prefix FROM n GROUP BY host),
f AS (SELECT host, sha256(string_agg(item, chr(10) ORDER BY record_id)) AS urls_hash FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY record_id) AS r FROM i) WHERE r <= 200 GROUP BY host)
SELECT host, item_count, urls_hash, prefix FROM (SELECT host, count(*) AS item_count FROM i GROUP BY host) JOIN f USING (host) JOIN p USING (host)""",
    "prompt_log": f"SELECT run_id, left(string_agg(prompt_preview, chr(10) ORDER BY id), 4000) AS prompts FROM ({ONCE_SQL}) WHERE type = 'llm_call' AND prompt_preview IS NOT NULL GROUP BY 1",
    "fetch_sizes": f"""SELECT {_url_part('url', 2)} AS host, CASE WHEN content_length >= 1024 THEN CAST(ceil(content_length / 1024) AS BIGINT) || ' KB' ELSE content_length || ' B' END AS size,
  count(*) AS fetches FROM ({ONCE_SQL}) WHERE type = 'fetch' AND content_length IS NOT NULL GROUP BY 1, 2""",
    "logged_sessions": """SELECT id, CAST(CASE WHEN json_valid(log) AND json_type(log) = 'ARRAY' THEN json_array_length(log) ELSE -1 END AS INTEGER) AS events,
  CAST(CASE WHEN json_valid(result_json) AND json_type(result_json) = 'ARRAY' THEN json_array_length(result_json) ELSE -1 END AS INTEGER) AS records FROM sessions""",
    "structure_pages": f"""WITH st AS (SELECT {_url_part('url', 2)} AS host, arg_min(page_id, (url, page_id)) AS page_id FROM pages WHERE ok GROUP BY 1),
l AS (SELECT host, target AS url, min(pos) AS pos FROM ({LINKS_SQL}) JOIN st USING (page_id) WHERE {_url_part('target', 2)} = host AND NOT {_non_content('target')} GROUP BY 1, 2)
SELECT host, url, rank FROM (SELECT host, url, row_number() OVER (PARTITION BY host ORDER BY pos, url) AS rank FROM l) WHERE rank <= 7""",
    "record_pages": f"""WITH n AS (SELECT url, page_id FROM ({FETCHES_SQL}) WHERE nth = 1 AND ok)
SELECT r.record_id, coalesce(n.page_id, m.page_id, -1) AS page_id FROM results r LEFT JOIN sessions s ON r.run_id = 'run-' || s.id LEFT JOIN n ON n.url = r.url LEFT JOIN n m ON m.url = s.url""",
}
