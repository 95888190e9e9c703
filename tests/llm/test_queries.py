import pytest

from siftmill.llm import queries, sql

BASE = "/root/testdata/sf0.001"
FOUND = {
    "p1_found": "pmcid string, section_no int, cut string",
    "p2_found": "work_id_a string, work_id_b string",
    "p3_found": "review string, work_id string, field string",
    "p4_found": "field string, rec_key string",
    "p5_found": "review string, work_id string",
    "p6_found": "cache_key string, defect string",
    "p7_found": "field string, rec_key string",
    "p10_found": "doc_id bigint",
}


@pytest.mark.parametrize("name", queries.QUERIES)
def test_runs_with_its_columns(spark, name):
    df = queries.QUERIES[name](spark, BASE)
    if name in FOUND:
        assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == FOUND[name]
        assert df.count() == df.distinct().count()
    else:
        assert df.count() > 0


def test_sql_has_queries():
    assert set(sql.SQL) <= set(queries.QUERIES)
