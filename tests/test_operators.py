import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.functions import text, urls
from brindle.operators import changes, events, links, records, store
from brindle.plans.extraction import extract_records
from brindle.sources import files
from brindle.streaming import events as stream

SOURCE = "https://e.org/courses"
FACETS = [
    ("https://e.org/courses?sort=date", True), ("https://e.org/courses/?Category=a&sort=title", True), ("https://e.org/courses?tag=&q=x", True),
    ("https://e.org/courses?page=2", False), ("https://e.org/courses?category=a&page=2", False), ("https://e.org/courses/python?sort=a", False),
    ("https://e.org/courses", False), ("https://e.org/courses?", False), ("https://e.org/courses?id=7", False), ("https://e.org/courses?sort=a&sort=b#x", True),
    ("https://e.org/courses;v=1?lang=de", True), ("https://e.org/courses?%zz=1", False), ("https://e.org/courses?so%72t=1", True),
]
PAGES = [("https://e.org/a/new", True), ("https://e.org/Admin/x", True), ("https://e.org/news", False), ("https://e.org/search?edit=1", False), ("https://e.org/", False), ("e.org/login", True)]


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_address_filters(spark):
    got = values(spark, [(u, SOURCE) for u, _ in FACETS], "u string, s string", urls.is_faceted(F.col("u"), F.col("s")))
    assert got == [w for _, w in FACETS]
    assert values(spark, PAGES, "u string, w boolean", urls.is_non_content(F.col("u"))) == [w for _, w in PAGES]
    hrefs = [("#x", False), ("mailto:a@b", False), ("javascript:x()", False), ("/a", True), ("HTTP://x", True), (" ", False), ("ftp://x", False)]
    assert values(spark, hrefs, "h string, w boolean", urls.is_navigable(F.col("h"))) == [w for _, w in hrefs]


def test_absolute(spark):
    from urllib.parse import urljoin

    base = "https://e.org/a/b.html?q=1"
    hrefs = ["c", "/c", "//f.org/c", "?x=1", "https://g.org/", "c/d", "", "#f", "../x", "./y?z=../q", "../../../up/.", "a/../b/./c#d", "/d/../e/..", "..", "x/..."]
    assert values(spark, [(h, base) for h in hrefs], "h string, b string", urls.absolute(F.col("h"), F.col("b"))) == [urljoin(base, h) for h in hrefs]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["word ", "x. ", "y?\n", "a.\n", "\n\n", "😀", "long" * 9, "! "]), max_size=120).map("".join), st.sampled_from([(40, 5), (64, 20), (100, 0)]))
def test_chunks_cover_the_text(t, sizes):
    size, overlap = sizes
    found = text.split_text(t, size, overlap)
    assert all(len(c) <= size for c in found) and (len(t) > size or found == [t])
    at = 0
    for c in found:
        at = t.index(c, max(0, at - overlap)) + len(c)
    assert at == len(t)


def test_chunk_arguments(spark):
    with pytest.raises(ValueError):
        text.chunks(F.col("t"), 100, 50)
    assert text.split_text(None, 10, 2) == [] and text.split_text("", 10, 2) == [""]


def test_small_expressions(spark):
    got = values(spark, [("2",), ("-1",), ("x",), (None,), ("0.3",)], "p string", text.probability(F.col("p")))
    assert got == [1.0, 0.0, 0.01, 0.01, 0.3]
    v = values(spark, [('{"a": 1}',), ('so: {"a": 2} it is',), ("{bad",), (None,)], "t string", F.try_variant_get(text.tolerant_json(F.col("t")), "$.a", "int"))
    assert v == [1, 2, None, None]
    assert values(spark, [("https://e.org/a b//c?x=1",)], "u string", urls.directory_name(F.col("u"))) == ["e_org_a_b_c_x_1"]


def test_snapshot_does_not_depend_on_order(spark):
    rows = [(1, "https://e.org/", "a", "2024-01-01"), (2, "https://e.org/x", "<p>é \"q\"</p>", "2024-01-01"), (3, "https://e.org/x", "old", "2023-01-01")]
    schema = "page_id long, url string, html string, fetched_at string"
    a = [changes.snapshot(spark.createDataFrame(r, schema).withColumns({"ok": F.lit(True), "status_code": F.lit(200)})).collect() for r in (rows, rows[::-1])]
    assert a[0] == a[1] and a[0][0].pages == 2
    assert [r.page_id for r in changes.changed_pages(spark.createDataFrame(rows, schema).withColumns({"ok": F.lit(True), "status_code": F.lit(200)})).orderBy("page_id").collect()] == [1, 2]


def test_crawl_ends_in_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("d", "c"), ("c", "e")], "source string, target string")
    got = {(r.url, r.depth) for r in links.crawl(edges, spark.createDataFrame([("a",)], "url string"), 3).collect()}
    assert got == {("a", 0), ("b", 1), ("d", 1), ("c", 2), ("e", 3)}


def test_store(spark):
    old = spark.createDataFrame([("a", "1", "x"), ("b", "2", None)], "k string, h string, s string")
    new = spark.createDataFrame([("b", None, "y"), ("c", "3", None)], "k string, h string, s string")
    assert sorted(map(tuple, store.upsert(old, new, "k").collect())) == [("a", "1", "x"), ("b", "2", "y"), ("c", "3", None)]
    s = spark.createDataFrame([(1, 7, "pending", None), (2, 7, "running", "[]"), (3, 7, "running", "oops"), (4, 8, "running", "[1]"), (5, 7, "done", "")], "id long, user_id long, status string, log string")
    assert {r.id: r.place for r in store.waiting(s).collect()} == {1: 1, 2: 2}
    asked = spark.createDataFrame([(7, i) for i in (1, 2, 3, 4, 5)] + [(7, 1)], "user_id long, id long")
    after = {r.id: (r.status, r.affected) for r in store.cancelled(s, asked).collect()}
    assert after == {1: ("cancelled", True), 2: ("cancelled", True), 3: ("cancelled", True), 4: ("running", False), 5: ("done", False)}
    given = spark.createDataFrame([(1, "done", "2024"), (9, "done", "2024"), (2, None, "2025")], "id long, status string, at string")
    put = store.coalesced(s.withColumn("at", F.lit("2023")), given, "id", ["status"], "at")
    assert {r.id: (r.status, r.at) for r in put.collect()}[1] == ("done", "2024") and {r.id: (r.status, r.at) for r in put.collect()}[2] == ("running", "2025") and put.count() == 5
    assert store.matching(s, status="running", user_id=None).count() == 3 and store.matching(s, status=None, user_id=8).count() == 1 and store.matching(s).count() == 5
    new = store.inserted(s, spark.createDataFrame([(7, "u"), (7, "u"), (3, "v")], "user_id long, url string"))
    assert {(r.id, r.user_id, r.url, r.status) for r in new.collect()} == {(6, 3, "v", "pending"), (7, 7, "u", "pending")}
    assert [r.id for r in store.inserted(s.limit(0), new).orderBy("id").collect()] == [1, 2]
    assert {r.id for r in store.look_up(s, spark.createDataFrame([(2,), (2,), (99,)], "id long"), "id").collect()} == {2}
    assert values(spark, [(None, "b"), ("a", "b")], "l string, m string", store.append_line(F.col("l"), F.col("m"))) == ["b", "a\nb"]


def test_users_are_revoked_by_any_identifier(spark):
    import hashlib

    hashed = {i: hashlib.sha256(f"tok{i}".encode()).hexdigest() for i in range(1, 6)}
    users = spark.createDataFrame(list(hashed.items()), "id long, token_hash string")
    named = spark.createDataFrame([("1",), (hashed[2],), ("tok3",), (None,), ("99",), ("nobody",)], "identifier string")
    assert sorted(r.id for r in store.revoked(users, named).collect()) == [4, 5]


def test_tables_are_created_once(spark, tmp_path):
    spark.sql(f"CREATE DATABASE brindle_test LOCATION '{tmp_path}'")
    try:
        store.create_tables(spark, "brindle_test")
        spark.sql("INSERT INTO brindle_test.users VALUES (1, 'h', NULL, true)")
        store.create_tables(spark, "brindle_test")
        assert spark.table("brindle_test.users").count() == 1 and spark.table("brindle_test.sessions").columns[:3] == ["id", "user_id", "url"]
    finally:
        spark.sql("DROP DATABASE brindle_test CASCADE")


def test_crawl_in_order(spark):
    """Against a crawl that keeps a list of visited pages, on random graphs with cycles and cross links."""
    import random

    def visit(graph, at, depth, limit, seen):
        if at in seen or len(seen) >= limit:
            return
        seen.append(at)
        for target in graph.get(at, []) if depth else []:
            visit(graph, target, depth - 1, limit, seen)

    rnd = random.Random(6)
    for depth, limit in ((2, 20), (3, 7)):
        graph = {f"p{i}": [f"p{rnd.randrange(12)}" for _ in range(rnd.randrange(6))] for i in range(12)}
        edges = spark.createDataFrame([(a, b, n) for a, bs in graph.items() for n, b in enumerate(bs)], "source string, target string, pos long")
        got = links.crawl_in_order(edges, spark.createDataFrame([("p0",), ("p1",)], "url string"), depth, limit).collect()
        for start in ("p0", "p1"):
            seen: list = []
            visit(graph, start, depth, limit, seen)
            assert [r.url for r in sorted((r for r in got if r.start == start), key=lambda r: r.place)] == seen


def test_unchanged_and_reused(spark):
    rows = [(1, "https://a/x", "1", "2024-01-02"), (2, "https://a/x", "1", "2024-01-01"), (3, "https://b/x", "2", "2024-01-02"), (4, "https://b/x", "1", "2024-01-01"), (5, "https://c/x", "1", "2024-01-01")]
    rows += [(10 + i, "https://hot/x", "same", f"2023-01-{i + 1:02d}") for i in range(28)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, fetched_at string").withColumns({"ok": F.lit(True), "status_code": F.lit(200)})
    assert {r.host: r.unchanged for r in changes.unchanged_hosts(df).collect()} == {"a": True, "b": False, "c": True, "hot": True}
    newest = changes.fetches(df)
    assert newest.where("host = 'hot'").count() == 2
    items = spark.createDataFrame([("i1", "https://a/x"), ("i2", "https://a/x"), ("i1", "https://b/x")], "item string, url string")
    held = spark.createDataFrame([("i1",), ("i1",), ("i3",)], "item string")
    assert [(r["item"], r.url) for r in changes.reusable(items, newest.where("nth = 1"), held).collect()] == [("i1", "https://a/x")]
    assert [r["item"] for r in changes.known_but_unseen(held.distinct(), items, held.distinct(), "item").collect()] == ["i3"]


def test_derived_fields(spark):
    rows = [("2024-02-28", None, "P3D"), ("2024-02-28", "2024-12-01", "P3D"), ("2024-02-28T10:00", None, "PT90M"), ("soon", None, "P3D"), (None, None, None)]
    assert values(spark, rows, "s string, e string, d string", records.end_date(F.col("s"), F.col("e"), F.col("d"))) == ["2024-03-01", "2024-12-01", "2024-02-28", None, None]
    assert values(spark, [("see https://doi.org/10.5281/zenodo.12.", ), ("10.5/x",), (None,)], "t string", records.doi(F.col("t"))) == ["10.5281/zenodo.12", None, None]
    place = '{"@type": "Place", "name": " Hall ", "address": {"addressLocality": "X", "addressCountry": ""}, "geo": {"latitude": "1.5", "longitude": "east"}}'
    flat = values(spark, [(place,)], "t string", records.flat_location(F.parse_json("t")))[0]
    assert tuple(flat) == ("Hall", "X", None, 1.5, None)
    modes = [(["Online"], None), (["onsite"], '{"@type": "VirtualLocation"}'), (None, place), (None, None)]
    assert values(spark, modes, "m array<string>, t string", records.is_online(F.col("m"), F.parse_json("t"))) == [True, True, False, False]
    assert values(spark, [(" Yes",), ("0",), (None,)], "t string", text.truth(F.col("t"))) == [True, False, None]


def test_joined_texts(spark):
    rows = [("r", 1, "aaaa"), ("r", 2, "bbbb"), ("r", 3, "c"), ("s", 1, "x" * 50), ("s", 2, "y")]
    got = {r.run_id: r.joined for r in events.joined_texts(spark.createDataFrame(rows, "run_id string, id int, t string"), "t", 12, "--").collect()}
    assert got == {"r": "aaaa--bbbb", "s": "x" * 12}


def test_records(spark):
    rows = [("Course", "n", "https://a", "d", None, None), ("Odd", " ", "x y", None, None, None), ("Event", "n", None, None, "2024-02-01", "2024-01-01"), (None, None, None, None, None, None)]
    errors = values(spark, rows, "type string, name string, url string, description string, start_date string, end_date string", records.violations())
    assert [len(e) for e in errors] == [0, 4, 1, 3]
    assert values(spark, [("Course|CourseInstance",), ("Course",), ("X",)], "t string", records.conforms_to(F.col("t")))[1].endswith("Course/1.0-RELEASE")
    p = spark.createDataFrame([("h", "/a/b/c"), ("h", "/a/b/d"), ("g", "/x"), ("i", "/x"), ("i", "/y")], "h string, p string")
    assert {r.h: r.prefix for r in records.common_prefix(p, "h", "p").collect()} == {"h": "/a/b", "g": "/x", "i": ""}


def test_pipeline_is_repeatable(spark):
    html = '<p>This course is about many things that matter.</p><a href="/courses/x">X course</a><a href="/courses/x">X course</a><a href="/login">In</a><a href="/events/y?sort=1">Y</a>'
    df = spark.createDataFrame([(1, "https://e.org/p", True, html), (2, "https://e.org/q", True, html), (3, "https://e.org/r", False, None)], "page_id long, url string, ok boolean, html string")
    a, b = ({(r.name, r.url, r.type, r.source_page) for r in extract_records(df).collect()} for _ in range(2))
    assert a == b == {("X course", "https://e.org/courses/x", "Course", 1), ("Y", "https://e.org/events/y?sort=1", "CourseInstance", 1)}


def test_files(spark, tmp_path):
    for run, names in {"r1": {"config.json": "{}", "log.txt": "t", "summary.md": "Items      : 12\nError      : none\n"}, "r2": {"config.json": "{bad", "log.json": "[]", "log.txt": "t", "summary.md": "Error : boom"}, "r3": {"log.txt": "x"}}.items():
        (tmp_path / "runs" / run).mkdir(parents=True)
        for n, content in names.items():
            (tmp_path / "runs" / run / n).write_text(content)
    runs = files.run_folders(spark, str(tmp_path / "runs"))
    assert [(r.run, r.log) for r in runs.collect()] == [("r2", "[]"), ("r1", "t")]
    assert {(r.run, r["items"], r.has_error) for r in files.report_figures(runs).collect()} == {("r1", 12, False), ("r2", None, True)}
    (tmp_path / "sites.json").write_text(json.dumps({"sites": [{"url": "https://a", "description": "A"}]}))
    assert files.site_list(spark, str(tmp_path / "sites.json")).count() == 1
    assert files.site_list(spark, str(tmp_path / "sites.json"), "https://b").first().url == "https://b"
    pages = spark.createDataFrame([(1, "https://a/x"), (2, "https://a/private/y"), (3, "https://b/z")], "page_id long, url string")
    rules = spark.createDataFrame([("a", "/", True), ("a", "/private", False)], "host string, prefix string, allow boolean")
    assert sorted(r.page_id for r in files.robots_allowed(pages, rules).collect()) == [1, 3]
    robots = "# all\nUser-agent: one\nUser-agent: *\nDisallow: /private # not this\nAllow: /private/open\n\nUser-agent: two\nDisallow: /\n\nuser-agent: *\ndisallow:\nDisallow: /tmp"
    found = files.robots_rules(spark.createDataFrame([("a", robots), ("b", None), ("c", "nothing here")], "host string, text string"))
    assert {(r.host, r.prefix, r.allow) for r in found.collect()} == {("a", "/private", False), ("a", "/private/open", True), ("a", "/tmp", False)}


def test_exports(spark, tmp_path):
    for name, content in {"2024-01": '{"exported_at": "2024-01-05", "session_count": 3}', "2024-02": '{"exported_at": 7, "session_count": "3"}', "2024-03": "{bad"}.items():
        (tmp_path / "archive" / name).mkdir(parents=True)
        (tmp_path / "archive" / name / "sessions.json").write_text(content)
        (tmp_path / "archive" / name / "other.json").write_text(content)
    assert [tuple(r) for r in files.archive_exports(spark, str(tmp_path / "archive")).collect()] == [("2024-03", "2024-03", None), ("2024-02", "2024-02", None), ("2024-01", "2024-01-05", 3)]
    lines = spark.createDataFrame([(2, "c"), (0, "a"), (1, "b")], "pos long, line string")
    files.write_export(lines, str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["a", "b", "c"]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        files.write_export(lines, str(tmp_path / "out"))
    files.write_run_artifacts(spark.createDataFrame([("r", 2, "two"), ("r", 1, None), ("s", 1, "one")], "run_id string, id int, line string"), str(tmp_path / "runs"))
    assert spark.read.json(str(tmp_path / "runs/log_json")).count() == 3
    assert {(r.run_id, r.value) for r in spark.read.text(str(tmp_path / "runs/log_txt")).collect()} == {("r", "two"), ("r", ""), ("s", "one")}


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("r", 1, "info", 1.0, "2024-01-01 00:10:00"), ("r", 1, "info", 1.0, "2024-01-01 00:10:00"), ("r", 2, "warn", 2.0, "2024-01-01 00:50:00"), ("s", 1, "info", 5.0, "2024-01-01 02:00:00")],
                                 "run_id string, id int, type string, timestamp double, at string").withColumn("ingested_at", F.to_timestamp("at")).drop("at")
    rows.write.parquet(str(tmp_path / "in"))
    source = stream.event_stream(spark, str(tmp_path / "in"), rows.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))
    q = stream.windowed_counts(source).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.type, r.events) for r in spark.table("counts").collect()} == {("info", 1), ("warn", 1)} and spark.table("counts").count() == 3
    q = source.writeStream.foreachBatch(stream.keep_newest(str(tmp_path / "out"), buckets=8)).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()

    def kept():
        return {(r.run_id, r.id) for r in stream.read_newest(spark, str(tmp_path / "out"), rows.schema).collect()}

    assert kept() == {("r", 2), ("s", 1)}
    write = stream.keep_newest(str(tmp_path / "out"), buckets=8)
    late = rows.where("run_id = 's'").withColumns({"id": F.lit(4), "timestamp": F.lit(9.0)})
    for number in (1, 1, 2, 3):  # batch 1 is run twice
        write(late.withColumn("id", F.lit(3 + number)), number)
        assert kept() == {("r", 2), ("s", 3 + number)}
    versions = {p.name for p in (tmp_path / "out").iterdir() if any(p.iterdir()) and any(b.is_dir() for b in p.iterdir())}
    assert versions == {"v=0", "v=2", "v=3"}  # the untouched bucket, the one before, the newest
