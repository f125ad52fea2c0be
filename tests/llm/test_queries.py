"""The queries on texts through the registry, on the smallest data."""

import pytest

import __spark_entry__ as entry_module
from brindle.llm import queries

DATA = "/root/testdata/sf0.001"
#: Columns of the queries, and those that tell their rows apart.
SHAPES = {
    "p3_found": ("run_id id field", ["run_id", "id", "field"]), "p3_rates": ("source field texts cut_texts rate", ["source", "field"]), "p3_limits": ("source field measure size texts", ["source", "field", "measure", "size"]),
    "p5_found": ("origin record_key line_no", ["origin", "record_key", "line_no"]), "p5_texts": ("page_id body", ["page_id"]),
    "p6_found": ("run_id id defect", ["run_id", "id", "defect"]), "p6_by_task": ("task model defect pairs", ["task", "model", "defect"]),
    "p7_ids": ("doc_id ids", ["doc_id"]), "p8_found": ("doc_id item_id", ["doc_id", "item_id"]), "p8_stretches": ("doc_id item_id item_start n_words altered", ["doc_id", "item_id"]),
    "p9_found": ("doc_id subject", ["doc_id", "subject"]), "p9_composition": ("subject documents chars", ["subject"]),
}


@pytest.mark.parametrize("name", sorted(SHAPES))
def test_shape(spark, name):
    columns, keys = SHAPES[name]
    df = entry_module.queries()[name](spark, DATA)
    assert df.columns == columns.split()
    found = df.select(*keys).collect()
    assert found and len(set(found)) == len(found)


def test_all_are_registered():
    assert set(SHAPES) == set(queries.QUERIES) <= set(entry_module.queries())


def test_every_document_is_encoded_and_every_leak_is_a_document(spark):
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    ids = entry_module.queries()["p7_ids"](spark, DATA)
    assert ids.join(documents, "doc_id", "left_semi").count() == documents.count() == ids.count()
    assert ids.join(documents.where("coalesce(text, '') = ''"), "doc_id", "left_semi").where("size(ids) > 0").count() == 0


def test_limits_explain_cut_texts(spark):
    """Every limit is a length at which texts of its source end; the cut texts of a field are never more than its texts."""
    rates = entry_module.queries()["p3_rates"](spark, DATA).collect()
    assert all(0 <= r.cut_texts <= r.texts and r.rate == round(r.cut_texts / r.texts, 4) for r in rates)
    assert all(r.texts >= 1 and r["size"] > 0 for r in entry_module.queries()["p3_limits"](spark, DATA).collect())
