import pytest

from dateloom.llm.queries import QUERIES, SQL
from oracle import rows_of, sql_rows

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert rows_of(QUERIES[name](spark, FOLDER)) == sql_rows(FOLDER, SQL[name])


def test_every_operator_has_a_query():
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 11)}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"op1_decontaminate"}))
def test_query_covers_its_table(spark, name):
    out = QUERIES[name](spark, FOLDER)
    assert out.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()


def test_near_duplicates_equal_all_pairs(spark):
    from test_near import brute

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op3_lsh_forest"](spark, FOLDER).collect()}
    assert out == brute(rows, 3, 85)


def test_contamination_equals_search(spark):
    from dateloom.llm.decontaminate import normalised

    items = {r.item_id: normalised(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    docs = {r.doc_id: normalised(r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    exact = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    out = {(r.doc_id, r.item_id): r.distance for r in QUERIES["op1_decontaminate"](spark, FOLDER).collect()}
    assert exact <= set(out) and {k for k, d in out.items() if d == 0} == exact
