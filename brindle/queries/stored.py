"""Queries of the stored tables (users, sessions, cache rows), of what is known from earlier runs, and of schemas, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import markup, text, urls
from brindle.operators import changes, links, positions, records, store, validation
from brindle.queries.core import FETCHES_SQL, LINKS_SQL, ONCE_SQL, SQL as CORE_SQL, _non_content, _url_part, _violations_sql, once, pages
from brindle.sources.tables import spread, table

STATES = ("pending", "running")
#: The kinds of pages that an answer may name, and the tiers of the tasks' models.
PAGE_TYPES = ["home", "listing", "detail", "other"]
SMALL_TASKS, EMBEDDING_TASKS = ["link_decision", "model_selection"], ["ontology_embedding"]


def sessions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sessions")


def _run(id_: str = "id") -> Column:
    return F.concat(F.lit("run-"), F.col(id_).cast("string"))


def sessions_of_runs(spark: SparkSession, d: str) -> DataFrame:
    """The session of every run that has a log, looked up by its key."""
    runs = table(spark, d, "event_log").select("run_id").distinct()
    return store.look_up(sessions(spark, d).select(_run().alias("run_id"), "id", "status", "url"), runs, "run_id")


def sessions_listed(spark: SparkSession, d: str) -> DataFrame:
    """Each user's sessions, the newest first."""
    return positions.numbered(sessions(spark, d).select("user_id", "id"), ["user_id"], [F.col("id").desc()], "place")


def users_listed(spark: SparkSession, d: str) -> DataFrame:
    """All users by their ids."""
    return positions.numbered(table(spark, d, "users").select("id", "is_admin"), [], [F.col("id")], "place")


def export_lines(spark: SparkSession, d: str) -> DataFrame:
    """An export as lines of JSON: a header with the number of sessions, then every session, the newest first."""
    s = sessions(spark, d).select("id", "user_id", "url", "status", F.unix_micros("created_at").alias("created_us"))
    placed = positions.numbered(s, [], [F.col("created_us").desc(), F.col("id").desc()], "pos")
    line = F.to_json(F.struct("id", "user_id", "url", "status", "created_us"), {"ignoreNullFields": "false"})
    header = s.agg(F.to_json(F.struct(F.lit(1).alias("exported_by_user_id"), F.count("*").alias("session_count"))).alias("line")).select(F.lit(0).cast("long").alias("pos"), "line")
    return header.unionByName(placed.select("pos", line.alias("line")))


def _updates(spark: SparkSession, d: str) -> DataFrame:
    """What the logs say of each session: an error where its run warned last of all, the time of its last event."""
    events = once(spark, d, "type", "timestamp")
    last = events.groupBy("run_id").agg(F.max_by("type", "id").alias("type"), F.max("timestamp").alias("at"))
    return last.select(F.regexp_extract("run_id", r"(\d+)$", 1).cast("long").alias("id"), F.when(F.col("type") == "warn", "error").alias("status"), F.timestamp_micros((F.col("at") * 1e6).cast("long")).alias("updated_at"))


def sessions_updated(spark: SparkSession, d: str) -> DataFrame:
    """The sessions with what their runs' logs say put in; what isn't given stays."""
    new = store.coalesced(sessions(spark, d).select("id", "status", "url", "updated_at"), _updates(spark, d), "id", ["status"], "updated_at")
    return new.select("id", "status", "url", F.unix_micros("updated_at").alias("updated_us"))


def logs_appended(spark: SparkSession, d: str) -> DataFrame:
    """Each session's log with one more line: the number of its run's events."""
    counted = table(spark, d, "event_log").groupBy(F.regexp_extract("run_id", r"(\d+)$", 1).cast("long").alias("id")).agg(F.count_distinct("id").alias("n"))
    joined = sessions(spark, d).select("id", "log").join(counted, "id")
    return joined.select("id", store.append_line(F.col("log"), F.concat(F.lit("events: "), F.col("n").cast("string"))).alias("log"))


def cancellations(spark: SparkSession, d: str) -> DataFrame:
    """The users who ask to cancel all sessions of their latest address: the sessions afterwards, and how many of each user are affected."""
    s = sessions(spark, d).select("id", "user_id", "url", "status")
    asked = s.join(s.groupBy("user_id").agg(F.max_by("url", "id").alias("url")), ["user_id", "url"]).select("user_id", "id")
    return store.cancelled(s, asked).groupBy("user_id", "status").agg(F.count("*").alias("sessions"), F.count_if("affected").alias("affected"))


def users_after_revocation(spark: SparkSession, d: str) -> DataFrame:
    """The users left when all without a session are revoked: admins by id, others by the hash of their token."""
    users = table(spark, d, "users")
    idle = users.join(sessions(spark, d).select(F.col("user_id").alias("id")), "id", "left_anti")
    return store.revoked(users, idle.select(F.when(F.col("is_admin"), F.col("id").cast("string")).otherwise(F.col("token_hash")).alias("identifier"))).select("id", "is_admin")


def filtered_sessions(spark: SparkSession, d: str) -> DataFrame:
    """How many sessions optional filters leave: of no condition, of a status, of a status and the first user."""
    s = sessions(spark, d)
    first = s.agg(F.min("user_id")).first()[0]
    asked = [(None, None), ("pending", None), ("done", None), ("done", first)]
    counted = [store.matching(s, status=st, user_id=u).agg(F.count("*").alias("sessions")).select(F.lit(st).alias("status"), F.lit(u).cast("long").alias("user_id"), "sessions") for st, u in asked]
    return counted[0].unionByName(counted[1]).unionByName(counted[2]).unionByName(counted[3])


def orphan_writes(spark: SparkSession, d: str) -> DataFrame:
    """A write of all sessions, each also under a user that isn't there: the rows that the check on users refuses."""
    written = sessions(spark, d).select("id", F.explode(F.array("user_id", -F.col("user_id"))).alias("user_id"))
    return written.join(table(spark, d, "users").select(F.col("id").alias("user_id")), "user_id", "left_anti").select("id", "user_id")


def session_stamps(spark: SparkSession, d: str) -> DataFrame:
    """The job's name of each session, and its times as ISO text and as folder names."""
    at = F.col("created_at")
    return sessions(spark, d).select(
        "id", F.concat(F.lit("session-extraction-"), F.col("id").cast("string")).alias("job_id"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss+00:00").alias("iso"), F.date_format(at, "yyyy-MM-dd'T'HH-mm-ss").alias("folder")
    )


def enqueue_plan(spark: SparkSession, d: str) -> DataFrame:
    """For each host the mode of its next run and its latest session's status; a host without an update whose latest session is done isn't enqueued, the others get new ids."""
    s = sessions(spark, d)
    latest = s.groupBy(urls.host(F.col("url")).alias("host")).agg(F.max_by("status", "id").alias("latest"), F.max_by("url", "id").alias("url"), F.max_by("user_id", "id").alias("user_id"))
    plan = changes.refresh_plan(pages(spark, d)).select("host", "mode").join(latest, "host")
    skipped = F.coalesce((F.col("mode") == "no_update") & (F.col("latest") == "done"), F.lit(False))
    new = store.inserted(s, plan.where(~skipped))
    return plan.join(new.select("user_id", "url", F.col("id").alias("new_id")), ["user_id", "url"], "left").select("host", "mode", "latest", F.coalesce("new_id", F.lit(-1).cast("long")).alias("new_id"))


def _cached(spark: SparkSession, d: str) -> DataFrame:
    """(url, summary): the newest readable summary of each address of the cache as VARIANT."""
    rows = table(spark, d, "metadata_cache").select("id", "url", "updated_at", "structural_summary").where(F.try_parse_json("structural_summary").isNotNull())
    newest = rows.groupBy("url").agg(F.max_by("structural_summary", F.struct("updated_at", "id")).alias("s"))
    return newest.select("url", F.try_parse_json("s").alias("summary"))


def _entries(spark: SparkSession, d: str, name: str) -> DataFrame:
    """(url, key, value): the entries of one object of each cached summary."""
    found = _cached(spark, d).select("url", F.explode(F.try_variant_get("summary", f"$.{name}", "map<string,variant>")).alias("key", "value"))
    return found.where("key <> ''")


def page_hash_maps(spark: SparkSession, d: str) -> DataFrame:
    """The cached hashes of pages, without empty addresses and whatever isn't text or is empty."""
    found = _entries(spark, d, "crawled_page_hashes")
    hash_ = F.when(F.schema_of_variant("value") == "STRING", F.try_variant_get("value", "$", "string"))
    return found.select("url", F.col("key").alias("page"), hash_.alias("hash")).where("hash <> ''")


def cached_item_types(spark: SparkSession, d: str) -> DataFrame:
    """The class of each cached item: the first of a list, else the text, else the default."""
    found = _entries(spark, d, "items_by_url").where(F.schema_of_variant("value").startswith("OBJECT"))
    kind = F.coalesce(F.try_variant_get("value", '$["@type"][0]', "string"), F.try_variant_get("value", '$["@type"]', "string"), F.lit("TrainingMaterial"))
    return found.select("url", F.col("key").alias("item"), kind.alias("type"))


def known_unseen_items(spark: SparkSession, d: str) -> DataFrame:
    """Items that the cache lists for an address and holds, but no record names: they are appended to what was discovered."""
    known = _cached(spark, d).select(F.explode(F.try_variant_get("summary", "$.item_urls", "array<string>")).alias("item")).where("item <> ''").unionByName(_entries(spark, d, "items_by_url").select(F.col("key").alias("item"))).distinct()
    seen = table(spark, d, "results").select(F.coalesce(F.nullif("url", F.lit("")), F.nullif("id", F.lit(""))).alias("item"))
    held = cached_item_types(spark, d).groupBy("item").agg(F.min("type").alias("type"))
    return changes.known_but_unseen(known, seen, held, "item").select("item", "type")


def reused_by_page_hash(spark: SparkSession, d: str) -> DataFrame:
    """The records of runs whose start page has the hash it had before, and which an earlier record holds already: they are used again."""
    newest = changes.fetches(pages(spark, d)).where("nth = 1")
    starts = sessions(spark, d).select(_run().alias("run_id"), F.col("url").alias("page"))
    items = table(spark, d, "results").where("url <> ''").select("run_id", "record_id", F.col("url").alias("item")).join(starts, "run_id").select("record_id", "item", F.col("page").alias("url"))
    held = table(spark, d, "results").where("url <> ''").groupBy("url").agg(F.min("record_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("url").alias("item"))
    return changes.reusable(items, newest, held).select("record_id", "item", "url")


def hosts_unchanged(spark: SparkSession, d: str) -> DataFrame:
    return changes.unchanged_hosts(pages(spark, d))


def merged_page_hashes(spark: SparkSession, d: str) -> DataFrame:
    """The pages' hashes as a new summary has them: those known to the cache, overlaid by those of this run's pages."""
    old = page_hash_maps(spark, d).groupBy("page").agg(F.max("hash").alias("old"))
    new = changes.fetches(pages(spark, d)).where("nth = 1 and hash is not null").select(F.col("url").alias("page"), F.col("hash").alias("new"))
    return old.join(new, "page", "full_outer").select("page", F.coalesce("new", "old").alias("hash"))


def first_summaries(spark: SparkSession, d: str) -> DataFrame:
    """The first form of a host's summary: the number of its records and the first hundred addresses in order."""
    items = table(spark, d, "results").select("record_id", F.coalesce(F.nullif("url", F.lit("")), F.nullif("id", F.lit(""))).alias("url")).where("url is not null").withColumn("host", urls.host(F.col("url")))
    counted = items.groupBy("host").agg(F.count("*").alias("item_count"))
    first = links.first_addresses(items.select("host", "url", F.lit(0).alias("priority"), F.col("record_id").alias("pos")), "host", 100)
    listed = first.groupBy("host").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "url"))), lambda x: x.url), " ").alias("item_urls"))
    return counted.join(listed, "host")


def _answers(spark: SparkSession, d: str) -> DataFrame:
    calls = once(spark, d, "type", "task", "response_preview").where("type = 'llm_call' and task = 'content_summary'")
    return calls.select("run_id", "id", text.tolerant_json(F.col("response_preview")).alias("answer"))


def answer_defaults(spark: SparkSession, d: str) -> DataFrame:
    """The page summaries that models gave, with defaults for what is missing."""
    member = lambda path, kind: F.try_variant_get("answer", path, kind)
    return _answers(spark, d).select(
        "run_id", "id", F.coalesce(member("$.page_type", "string"), F.lit("other")).alias("page_type"), F.coalesce(member("$.description", "string"), F.lit("")).alias("description"),
        F.coalesce(F.size(member("$.training_items", "array<variant>")), F.lit(0)).alias("items"), F.coalesce(F.size(member("$.navigation_links", "array<variant>")), F.lit(0)).alias("links"),
    )


def carried_summaries(spark: SparkSession, d: str) -> DataFrame:
    """What each page summary of a run carries over from the ones before it: the newest line of description and known page type that any of them gave."""
    told = answer_defaults(spark, d)
    kind = F.when(F.col("page_type").isin(*PAGE_TYPES), F.concat(F.lit("page: "), "page_type"))
    line = F.nullif(F.array_join(F.array_compact(F.array(F.nullif("description", F.lit("")), F.when(F.col("description") != "", kind))), " | "), F.lit(""))
    return positions.carried(told.select("run_id", "id", line.alias("line")), ["run_id"], ["id"], F.col("line"), "carried").select("run_id", "id", "carried")


LOGGED = ["id", "parent_id", "type", "message", "task", "model", "url", "status_code", "content_length", "title", "item_type", "item_name", "passed"]


def event_json_lines(spark: SparkSession, d: str) -> DataFrame:
    """Each run's log as JSON lines in the order of its events, as it is written to a run's folder."""
    logged = once(spark, d, *LOGGED[1:])
    return logged.select("run_id", "id", F.to_json(F.struct(*LOGGED), {"ignoreNullFields": "false"}).alias("line"))


def run_results(spark: SparkSession, d: str) -> DataFrame:
    """What a run's folder holds: its address, the number of its events and of its records, and how many of these are valid."""
    judged = table(spark, d, "results").withColumn("e", records.violations())
    results = judged.groupBy("run_id").agg(F.count("*").alias("records"), F.count_if(F.size("e") == 0).alias("valid"))
    logged = once(spark, d, "type").groupBy("run_id").agg(F.count("*").alias("events"))
    runs = sessions(spark, d).select(_run().alias("run_id"), "url")
    zero = F.lit(0).cast("long")
    joined = runs.join(logged, "run_id").join(results, "run_id", "left")
    return joined.select("run_id", "url", "events", F.coalesce("records", zero).alias("records"), F.coalesce("valid", zero).alias("valid"))


def chunk_links(spark: SparkSession, d: str) -> DataFrame:
    """The first ten links that a model named for each page text, taken before any is left out, and of those the ones that lead to pages with content."""
    named = _answers(spark, d).select("run_id", "id", F.posexplode(F.slice(F.try_variant_get("answer", "$.navigation_links", "array<variant>"), 1, 10)).alias("pos", "l"))
    target = F.coalesce(F.try_variant_get("l", "$.url", "string"), F.try_variant_get("l", "$", "string"))
    return named.select("run_id", "id", "pos", target.alias("url")).where(F.col("url").isNotNull() & ~F.coalesce(urls.is_non_content(F.col("url")), F.lit(False)))


def model_tiers(spark: SparkSession, d: str) -> DataFrame:
    """The calls of each task with the tier of the model that the task is meant for."""
    tier = F.when(F.col("task").isin(*SMALL_TASKS), "small").when(F.col("task").isin(*EMBEDDING_TASKS), "embedding").otherwise("large")
    return once(spark, d, "type", "task").where("type = 'llm_call'").groupBy("task", tier.alias("tier")).agg(F.count("*").alias("calls"))


def first_page_links(spark: SparkSession, d: str) -> DataFrame:
    """The first thirty different links of each page, in order."""
    found = links.distinct_links(links.page_links(pages(spark, d)))
    return links.first_addresses(found.select("page_id", F.col("target").alias("url"), F.lit(0).alias("priority"), "pos"), "page_id", 30).select("page_id", "url", F.col("rank").cast("long").alias("rank"))


def page_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Every fetched page as Markdown, with the number of its links and the hash of the text, by which pages are compared."""
    shown = spread(pages(spark, d).where("html is not null").select("page_id", "url", "html"), "page_id")
    content = shown.select("page_id", markup.page_content(F.col("html"), F.col("url")).alias("c"))
    return content.select("page_id", F.col("c.text").alias("markdown"), text.content_hash(F.col("c.text")).alias("hash"), F.size("c.links").alias("links"))


def page_clean_html(spark: SparkSession, d: str) -> DataFrame:
    """Every fetched page as HTML without scripts and the like, its addresses made absolute."""
    shown = spread(pages(spark, d).where("html is not null").select("page_id", "url", "html"), "page_id")
    return shown.select("page_id", markup.page_content(F.col("html"), F.col("url"), raw=True).alias("c")).select("page_id", F.col("c.text").alias("html"), F.size("c.links").alias("links"))


def record_schema_errors(spark: SparkSession, d: str) -> DataFrame:
    """What the schema of records says of each record: it must be of exactly one kind."""
    judged = table(spark, d, "results").select("record_id", validation.violations(validation.RECORD, validation.as_record()).alias("e"))
    return judged.select("record_id", (F.size("e") == 0).alias("valid"), F.array_join("e", "; ").alias("errors"))


def author_schema_errors(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with the agents of each record: each must be exactly one of person, organisation and name."""
    schema = {"type": "object", "properties": {"author": {"type": "array", "items": validation.AGENT}}}
    judged = table(spark, d, "results").select("record_id", F.explode(validation.violations(schema, validation.as_record())).alias("error"))
    return judged


def records_mended(spark: SparkSession, d: str) -> DataFrame:
    """How many records of each class are valid at first, and after one round of mending the invalid ones."""
    twice = validation.validated_twice(table(spark, d, "results"))
    return twice.groupBy("type").agg(F.count("*").alias("records"), F.count_if(F.size("first") == 0).alias("valid_at_first"), F.count_if(F.size("errors") == 0).alias("valid_at_last"))


def record_end_dates(spark: SparkSession, d: str) -> DataFrame:
    """Each record's end: its own, else its start and its duration."""
    return table(spark, d, "results").select("record_id", records.end_date(F.col("start_date"), F.col("end_date"), F.col("time_required")).alias("ends"))


QUERIES = {f.__name__: f for f in (
    sessions_of_runs, sessions_listed, users_listed, export_lines, sessions_updated, logs_appended, cancellations, users_after_revocation, filtered_sessions, orphan_writes,
    session_stamps, enqueue_plan, page_hash_maps, cached_item_types, known_unseen_items, reused_by_page_hash, hosts_unchanged, merged_page_hashes, first_summaries,
    answer_defaults, carried_summaries, event_json_lines, run_results, chunk_links, model_tiers, first_page_links, page_markdown, page_clean_html, record_schema_errors, author_schema_errors, records_mended, record_end_dates,
)}

_CACHED = "(SELECT url, arg_max(structural_summary, (updated_at, id)) AS s FROM metadata_cache WHERE json_valid(structural_summary) GROUP BY 1)"


def _entries_sql(name: str) -> str:
    return f"(SELECT url, e.key AS key, e.value AS value, e.type AS type FROM {_CACHED} c, json_each(c.s, '$.{name}') e WHERE json_type(c.s, '$.{name}') = 'OBJECT' AND e.key <> '')"


_ITEM_TYPES = f"""SELECT url, key AS item, coalesce(CASE WHEN json_type(value, '$."@type"') = 'ARRAY' THEN json_extract_string(value, '$."@type"[0]') ELSE json_extract_string(value, '$."@type"') END, 'TrainingMaterial') AS type
FROM {_entries_sql('items_by_url')} WHERE type = 'OBJECT'"""
_HASHES = f"SELECT url, key AS page, json_extract_string(value, '$') AS hash FROM {_entries_sql('crawled_page_hashes')} WHERE type = 'VARCHAR' AND json_extract_string(value, '$') <> ''"
_ITEM = "coalesce(nullif(url, ''), nullif(id, ''))"
_ANSWERS = f"""(SELECT run_id, id, CASE WHEN json_valid(response_preview) THEN response_preview WHEN json_valid(nullif(regexp_extract(response_preview, '(?s)\\{{.*\\}}'), '')) THEN regexp_extract(response_preview, '(?s)\\{{.*\\}}') ELSE '{{}}' END AS a
  FROM ({ONCE_SQL}) WHERE type = 'llm_call' AND task = 'content_summary')"""
_DEFAULTS = f"""SELECT run_id, id, coalesce(json_extract_string(a, '$.page_type'), 'other') AS page_type, coalesce(json_extract_string(a, '$.description'), '') AS description,
  CAST(coalesce(CASE WHEN json_type(a, '$.training_items') = 'ARRAY' THEN json_array_length(a, '$.training_items') END, 0) AS INTEGER) AS items,
  CAST(coalesce(CASE WHEN json_type(a, '$.navigation_links') = 'ARRAY' THEN json_array_length(a, '$.navigation_links') END, 0) AS INTEGER) AS links FROM {_ANSWERS}"""
_AGENT_OK = "(a.name IS NOT NULL AND coalesce(a.type IN ('Person', 'Organization'), false))"
_RECORD_OK = """(name IS NOT NULL AND (type IN ('Course', 'CourseInstance', 'Event') OR
  (type IN ('LearningResource', 'CreativeWork', 'TrainingMaterial') AND len(list_filter(coalesce({author}, []), lambda a: NOT (a.name IS NOT NULL AND coalesce(a.type IN ('Person', 'Organization'), false)))) = 0)))"""
_VALID = f"coalesce({_RECORD_OK.format(author='author')}, false)"
_MENDED = f"coalesce({_RECORD_OK.format(author='author').replace('name IS NOT NULL AND (type', 'mended IS NOT NULL AND (type', 1)}, false)"
_DURATION = r"regexp_extract(time_required, '^P(\d+)D$', 1)"

SQL = {
    "sessions_of_runs": "SELECT 'run-' || id AS run_id, id, status, url FROM sessions WHERE 'run-' || id IN (SELECT run_id FROM event_log)",
    "sessions_listed": "SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY id DESC) AS place FROM sessions",
    "users_listed": "SELECT id, is_admin, row_number() OVER (ORDER BY id) AS place FROM users",
    "export_lines": """SELECT 0 AS pos, '{"exported_by_user_id":1,"session_count":' || count(*) || '}' AS line FROM sessions UNION ALL
SELECT row_number() OVER (ORDER BY created_at DESC, id DESC), CAST(json_object('id', id, 'user_id', user_id, 'url', url, 'status', status, 'created_us', epoch_us(created_at)) AS VARCHAR) FROM sessions""",
    "sessions_updated": f"""SELECT s.id, coalesce(CASE WHEN u.type = 'warn' THEN 'error' END, s.status) AS status, s.url, coalesce(CAST(trunc(u.at * 1e6) AS BIGINT), epoch_us(s.updated_at)) AS updated_us
FROM sessions s LEFT JOIN (SELECT run_id, arg_max(type, id) AS type, max(timestamp) AS at FROM ({ONCE_SQL}) GROUP BY 1) u ON u.run_id = 'run-' || s.id""",
    "logs_appended": """SELECT s.id, CASE WHEN log IS NULL THEN '' ELSE log || chr(10) END || 'events: ' || n AS log
FROM sessions s JOIN (SELECT run_id, count(DISTINCT id) AS n FROM event_log GROUP BY 1) e ON e.run_id = 'run-' || s.id""",
    "cancellations": """WITH l AS (SELECT user_id, arg_max(url, id) AS url FROM sessions GROUP BY 1),
c AS (SELECT s.user_id, s.status IN ('pending', 'running') AND l.url IS NOT NULL AS affected, s.status FROM sessions s LEFT JOIN l ON l.user_id = s.user_id AND l.url = s.url)
SELECT user_id, CASE WHEN affected THEN 'cancelled' ELSE status END AS status, count(*) AS sessions, count(CASE WHEN affected THEN 1 END) AS affected FROM c GROUP BY 1, 2""",
    "users_after_revocation": "SELECT id, is_admin FROM users WHERE id IN (SELECT user_id FROM sessions)",
    "filtered_sessions": """WITH q(status, user_id) AS (VALUES (NULL, NULL), ('pending', NULL), ('done', NULL), ('done', (SELECT min(user_id) FROM sessions)))
SELECT q.status, CAST(q.user_id AS BIGINT) AS user_id, count(s.id) AS sessions FROM q LEFT JOIN sessions s ON (q.status IS NULL OR s.status = q.status) AND (q.user_id IS NULL OR s.user_id = q.user_id) GROUP BY 1, 2""",
    "orphan_writes": "SELECT id, user_id FROM (SELECT id, unnest([user_id, -user_id]) AS user_id FROM sessions) w WHERE NOT EXISTS (SELECT 1 FROM users u WHERE u.id = w.user_id)",
    "session_stamps": "SELECT id, 'session-extraction-' || id AS job_id, strftime(created_at, '%Y-%m-%dT%H:%M:%S+00:00') AS iso, strftime(created_at, '%Y-%m-%dT%H-%M-%S') AS folder FROM sessions",
    "enqueue_plan": f"""WITH l AS (SELECT {_url_part('url', 2)} AS host, arg_max(status, id) AS latest, arg_max(url, id) AS url, arg_max(user_id, id) AS user_id FROM sessions GROUP BY 1),
p AS (SELECT host, mode, latest, url, user_id FROM ({CORE_SQL['extraction_plan']}) JOIN l USING (host)),
n AS (SELECT user_id, url, (SELECT max(id) FROM sessions) + row_number() OVER (ORDER BY user_id, url) AS new_id FROM (SELECT DISTINCT user_id, url FROM p WHERE NOT (mode = 'no_update' AND latest = 'done')))
SELECT host, mode, latest, coalesce(new_id, -1) AS new_id FROM p LEFT JOIN n USING (user_id, url)""",
    "page_hash_maps": _HASHES,
    "cached_item_types": _ITEM_TYPES,
    "known_unseen_items": f"""WITH k AS (SELECT unnest(CAST(json_extract(s, '$.item_urls') AS VARCHAR[])) AS item FROM {_CACHED} WHERE json_type(s, '$.item_urls') = 'ARRAY' UNION SELECT key FROM {_entries_sql('items_by_url')}),
h AS (SELECT item, min(type) AS type FROM ({_ITEM_TYPES}) GROUP BY 1)
SELECT k.item, h.type FROM k JOIN h USING (item) WHERE k.item <> '' AND NOT EXISTS (SELECT 1 FROM results r WHERE {_ITEM} = k.item)""",
    "reused_by_page_hash": f"""SELECT r.record_id, r.url AS item, s.url FROM results r JOIN sessions s ON r.run_id = 'run-' || s.id
WHERE r.url <> '' AND s.url IN (SELECT url FROM ({FETCHES_SQL}) WHERE nth = 1 AND hash = earlier) AND r.url IN (SELECT url FROM results GROUP BY 1 HAVING count(*) > 1)""",
    "hosts_unchanged": f"SELECT host, coalesce(bool_and(CASE WHEN earlier IS NOT NULL THEN coalesce(hash = earlier, false) END), true) AS unchanged FROM ({FETCHES_SQL}) WHERE nth = 1 GROUP BY 1",
    "merged_page_hashes": f"""SELECT coalesce(n.page, o.page) AS page, coalesce(n.hash, o.hash) AS hash FROM (SELECT page, max(hash) AS hash FROM ({_HASHES}) GROUP BY 1) o
FULL JOIN (SELECT url AS page, hash FROM ({FETCHES_SQL}) WHERE nth = 1 AND hash IS NOT NULL) n ON n.page = o.page""",
    "first_summaries": f"""WITH i AS (SELECT {_url_part(_ITEM, 2)} AS host, {_ITEM} AS url, record_id FROM results WHERE {_ITEM} IS NOT NULL),
f AS (SELECT host, url, row_number() OVER (PARTITION BY host ORDER BY pos, url) AS r FROM (SELECT host, url, min(record_id) AS pos FROM i GROUP BY 1, 2))
SELECT host, item_count, item_urls FROM (SELECT host, count(*) AS item_count FROM i GROUP BY 1) JOIN (SELECT host, string_agg(url, ' ' ORDER BY r) AS item_urls FROM f WHERE r <= 100 GROUP BY 1) USING (host)""",
    "answer_defaults": _DEFAULTS,
    "carried_summaries": f"""SELECT run_id, id, last_value(line IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried
FROM (SELECT run_id, id, CASE WHEN description <> '' THEN description || CASE WHEN page_type IN ('home', 'listing', 'detail', 'other') THEN ' | page: ' || page_type ELSE '' END END AS line FROM ({_DEFAULTS}))""",
    "event_json_lines": f"SELECT run_id, id, CAST(json_object({', '.join(f"'{c}', {c}" for c in LOGGED)}) AS VARCHAR) AS line FROM ({ONCE_SQL})",
    "run_results": f"""SELECT 'run-' || s.id AS run_id, s.url, e.events, coalesce(r.records, 0) AS records, coalesce(r.valid, 0) AS valid
FROM sessions s JOIN (SELECT run_id, count(*) AS events FROM ({ONCE_SQL}) GROUP BY 1) e ON e.run_id = 'run-' || s.id
LEFT JOIN (SELECT run_id, count(*) AS records, count(CASE WHEN len(e) = 0 THEN 1 END) AS valid FROM (SELECT run_id, {_violations_sql()} AS e FROM results) GROUP BY 1) r ON r.run_id = e.run_id""",
    "chunk_links": f"""SELECT run_id, id, CAST(i AS INTEGER) AS pos, url FROM (SELECT run_id, id, i, coalesce(json_extract_string(l, '$.url'), CASE WHEN json_type(l) = 'VARCHAR' THEN json_extract_string(l, '$') END) AS url
  FROM (SELECT run_id, id, unnest(x[1:10]) AS l, generate_subscripts(x[1:10], 1) - 1 AS i FROM (SELECT run_id, id, CAST(json_extract(a, '$.navigation_links') AS JSON[]) AS x FROM {_ANSWERS} WHERE json_type(a, '$.navigation_links') = 'ARRAY')))
WHERE url IS NOT NULL AND NOT coalesce({_non_content('url')}, false)""",
    "model_tiers": f"SELECT task, CASE WHEN task IN ('link_decision', 'model_selection') THEN 'small' WHEN task = 'ontology_embedding' THEN 'embedding' ELSE 'large' END AS tier, count(*) AS calls FROM ({ONCE_SQL}) WHERE type = 'llm_call' GROUP BY 1, 2",
    "first_page_links": f"""SELECT page_id, url, rank FROM (SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY pos, url) AS rank
  FROM (SELECT page_id, target AS url, min(pos) AS pos FROM ({LINKS_SQL}) GROUP BY 1, 2)) WHERE rank <= 30""",
    "record_schema_errors": f"SELECT record_id, {_VALID} AS valid, CASE WHEN {_VALID} THEN '' ELSE '(root): is valid under none of the alternatives' END AS errors FROM results",
    "author_schema_errors": f"""SELECT record_id, 'author → ' || i || ': is valid under ' || CASE WHEN a.name IS NOT NULL AND a.type IS NULL THEN 'more than one' ELSE 'none' END || ' of the alternatives' AS error
FROM (SELECT record_id, unnest(author) AS a, generate_subscripts(author, 1) - 1 AS i FROM results) WHERE NOT {_AGENT_OK}""",
    "records_mended": f"""WITH m AS (SELECT type, {_VALID} AS ok, author, name, coalesce(name, nullif(regexp_extract(url, '([^/]+)/?$', 1), '')) AS mended,
  list_transform(list_filter(author, lambda a: a.name IS NOT NULL), lambda a: {{'type': coalesce(a.type, 'Person'), 'name': a.name}}) AS people FROM results)
SELECT type, count(*) AS records, count(CASE WHEN ok THEN 1 END) AS valid_at_first, count(CASE WHEN ok OR {_MENDED.replace('author', 'people')} THEN 1 END) AS valid_at_last FROM m GROUP BY 1""",
    "record_end_dates": f"""SELECT record_id, coalesce(end_date, CASE WHEN {_DURATION} <> '' AND TRY_CAST(left(start_date, 10) AS DATE) IS NOT NULL THEN strftime(CAST(left(start_date, 10) AS DATE) + CAST({_DURATION} AS INTEGER) - 1, '%Y-%m-%d')
  WHEN regexp_matches(time_required, '^PT\\d+[HM]$') THEN left(start_date, 10) END) AS ends FROM results""",
}
