import pytest
from pyspark.sql import functions as F

from siftmill.operators import gaps, pipeline, responses
from siftmill.plans import catalogue

BASE = "/root/testdata/sf0.001"
KEYS = "review string, work_id string"


def test_precision_and_recall(spark):
    stated = spark.createDataFrame([("r", "a", "gap_stated"), ("r", "b", "gap_stated"), ("r", "c", "gap_stated"), ("r", "d", "not_stated"), ("r", "e", None)], f"{KEYS}, value string")
    ratings = spark.createDataFrame([("r", "a", True), ("r", "b", False), ("r", "d", True)], f"{KEYS}, valid boolean")
    r = gaps.gap_precision(stated, ratings)
    one = r.first()
    assert (one["n_records"], one["n_stated"], one["n_valid"], one["n_invalid"], one["n_unrated"], one["gap_rate"], one["precision"]) == (5, 3, 1, 1, 1, 0.6, 0.5)
    none = spark.createDataFrame([], "review string, recall double, recall_low double, recall_high double")
    assert gaps.beside_recall(r, none).first()["recall"] is None
    assert gaps.gap_precision(stated.limit(0), ratings).count() == 0


def test_sample_scores(spark):
    sample = spark.createDataFrame([("r", "a", "pool"), ("r", "b", "pool"), ("r", "c", "pool"), ("r", "d", "control"), ("r", "e", "control")], f"{KEYS}, stratum string")
    ratings = spark.createDataFrame([("r", "a", "x", True, "Motivation only"), ("r", "b", "x", True, None), ("r", "b", "y", True, "MOTIVATION"), ("r", "d", "x", True, None), ("r", "e", "x", False, None), ("r", "e", "y", True, None)], f"{KEYS}, rater_id string, gap boolean, note string")
    r = gaps.sample_scores(sample, ratings, "motivation").first()
    assert (r["n_sampled"], r["n_rated"], r["misses"], r["open_misses"], r["n_controls"], r["control_agreement"]) == (3, 2, 2, 1, 2, 0.5)


def test_guards(spark):
    decisions = spark.createDataFrame([("1", "r", "a", "include"), ("1", "r", "b", "exclude")], f"run_id string, {KEYS}, decision string")
    writes = spark.createDataFrame([("1", "r", "a", "valid"), ("1", "r", "b", "valid"), ("1", "r", "c", "valid"), ("1", "r", "a", "?"), ("1", "r", "a", None)], f"run_id string, {KEYS}, label string")
    assert [r["status"] for r in gaps.guarded(writes, decisions, "label", ["valid", "invalid"], "include").orderBy("work_id", F.desc_nulls_first("label")).collect()] == ["not_a_label", "written", "not_a_label", "not_ratable", "no_decision"]
    known = spark.createDataFrame([("r", "a", 1), ("r", "b", 0), ("r", "b", 0)], f"{KEYS}, label_included int")
    rows = spark.createDataFrame([("r", "a"), ("r", "b"), ("r", "z")], KEYS)
    assert gaps.known_only(rows.filter("work_id = 'a'"), known).first()["label_included"] == 1
    for wrong, what in (("b", "two labels"), ("z", "no label")):
        with pytest.raises(Exception, match=what):
            gaps.known_only(rows.filter(F.col("work_id") == wrong), known).collect()
    assert gaps.scoped(rows.unionByName(spark.createDataFrame([("_discover", "q")], KEYS))).count() == 3 and gaps.scoped(rows, "s").count() == 0


def test_shapes(spark):
    rows = [('{"a": {"value": "v", "evidence_span": "s"}, "more": 1}',), ('```json\n{"a": {"value": "v"}}\n```',), ("",), (None,), ("no json",), ('{"gaps": []}',), ('{"gaps": [{"value": "v"}]}',), ('{"terms": ["x", "y"]}',), ('{"value": "v", "evidence_span": "s"}',)]
    df = spark.createDataFrame(rows, "raw string")
    note = lambda column: [r[0] for r in df.select(column["shape_note"]).collect()]
    bad, empty = "schema_validation_failed", "empty_response"
    assert note(responses.parse_fields(F.col("raw"), ["a"])) == [None, bad, empty, empty, bad, bad, bad, bad, bad]
    assert note(responses.parse_gaps(F.col("raw"))) == [bad, bad, empty, empty, bad, None, bad, bad, bad]
    assert note(responses.parse_terms(F.col("raw"))) == [bad, bad, empty, empty, bad, bad, bad, None, bad]
    assert note(responses.parse_gap(F.col("raw"))) == [bad, bad, empty, empty, bad, bad, bad, bad, None]
    looked = spark.createDataFrame([("k", "hit"), ("m", "miss")], "cache_key string, status string")
    assert responses.require_same_requests(looked).count() == 2
    with pytest.raises(Exception, match="another request"):
        responses.require_same_requests(looked.withColumn("status", F.lit("mismatch"))).collect()


def test_harness_refuses_reviews_without_records(spark):
    works = spark.createDataFrame([("r", "a", "title", "words")], f"{KEYS}, title string, abstract string")
    questions = spark.createDataFrame([("r", "words"), ("s", "words")], "review string, question string")
    decisions = spark.createDataFrame([("r", "a", "exclude", True)], f"{KEYS}, decision string, span_verified boolean")
    truth = spark.createDataFrame([("r", "a", 1)], f"{KEYS}, label_included int")
    with pytest.raises(ValueError):
        pipeline.harness(pipeline.HarnessConfig(), works, questions, decisions, truth)
    r = pipeline.harness(pipeline.HarnessConfig("hybrid"), works, questions.filter("review = 'r'"), decisions, truth).first()
    assert (r["n_head"], r["n_to_human"], r["cutoff"]) == (1, 0, 1)


@pytest.mark.parametrize("name", ["gap_precision", "gap_sample_scores", "override_writes", "session_counts", "harness_bm25", "extract_fields", "find_gaps", "parsed_papers"])
def test_queries_run(spark, name):
    assert catalogue.QUERIES[name](spark, BASE).count() > 0
