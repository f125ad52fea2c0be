"""Every registered core query against its SQL in DuckDB on the smallest data."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from brindle.queries import core, problems, stored

DATA = "/root/testdata/sf0.001"
QUERIES = {**core.QUERIES, **stored.QUERIES, **problems.QUERIES}
SQL = {**core.SQL, **stored.SQL, **problems.SQL}


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return round(value, 6) if isinstance(value, float) else value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    found = duck.execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, found.fetchall())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(SQL) <= set(entry_module.oracle_sql()) and set(QUERIES) <= set(entry_module.queries())
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


#: Columns of the queries without SQL, and those that tell their rows apart.
WITHOUT_SQL = {
    "crawl_order": ("start url place", ["start", "place"]), "p1_found": ("record_id field pos value", ["record_id", "field", "pos"]),
    "p4_found": ("origin file_seq field change new_field", ["origin", "file_seq", "field", "change"]), "p4_table": ("id origin file_seq url field type value", ["id", "field"]),
    "page_markdown": ("page_id markdown hash links", ["page_id"]), "page_clean_html": ("page_id html links", ["page_id"]),
}


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_without_sql(spark, name):
    columns, keys = WITHOUT_SQL[name]
    df = QUERIES[name](spark, DATA)
    assert df.columns == columns.split()
    found = df.select(*keys).collect()
    assert len(found) > 3 and len(set(found)) == len(found)


def test_every_query_is_tested():
    assert set(WITHOUT_SQL) == set(QUERIES) - set(SQL)


def test_pages_as_markdown(spark):
    """Every page's Markdown holds the words that it shows; what both modes link to is the same."""
    shown = {r.page_id: r for r in QUERIES["page_markdown"](spark, DATA).collect()}
    raw = {r.page_id: r for r in QUERIES["page_clean_html"](spark, DATA).collect()}
    assert shown.keys() == raw.keys() and all(shown[k].links == raw[k].links for k in raw)
    assert all("<" not in r.markdown.split("```")[0] or "&lt;" in raw[k].html or "<http" in r.markdown for k, r in shown.items())
