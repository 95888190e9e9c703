import pytest
from pyspark.sql import functions as F

from siftmill.operators import ablation, agreement, metrics, responses, sampling, typology
from siftmill.plans import screening

MATRIX = ["11.1", "2232", "3333", "3333", "2222", "1234", "4444", "1121", "2222", ".555", "..11", "..3."]


def ratings(spark):
    rows = [(u, r, None if c == "." else c) for u, row in enumerate(MATRIX) for r, c in enumerate(row)]
    return spark.createDataFrame(rows, "unit int, rater int, category string")


def test_published_example(spark):
    ac1 = agreement.gwet(ratings(spark), ["unit"], "category", list("12345")).first()
    assert (round(ac1["coefficient"], 5), round(ac1["pa"], 5), round(ac1["pe"], 5), ac1["n_units"], ac1["n_paired"]) == (0.77544, 0.81818, 0.19032, 12, 11)
    ac2 = agreement.gwet(ratings(spark), ["unit"], "category", list("12345"), "quadratic").first()
    assert (round(ac2["coefficient"], 3), round(ac2["pa"], 5), round(ac2["pe"], 4)) == (0.914, 0.97538, 0.7137)


def test_binary_and_pabak(spark):
    rows = [("a", "a")] * 45 + [("b", "b")] * 45 + [("a", "b")] * 5 + [("b", "a")] * 5 + [(None, "a")]
    df = spark.createDataFrame(rows, "x string, y string")
    got = agreement.pabak(df, "x", "y", ["a", "b"]).first()
    assert (got["coefficient"], got["n_paired"]) == (0.8, 100)
    with pytest.raises(ValueError):
        agreement.gwet(df, ["x"], "y", ["a"])


def test_wilson_and_recall(spark):
    df = spark.createDataFrame([(0, 10), (0, 0), (10, 10)], "k int, n int")
    low, high = agreement.wilson(F.col("k"), F.col("n"))
    got = [(round(r[0], 4), round(r[1], 4)) for r in df.select(low, high).collect()]
    assert got == [(0.0, 0.2775), (0.0, 1.0), (0.7225, 1.0)]
    one = spark.createDataFrame([(20, 100, 10, 2)], "tp int, pool int, s int, m int")
    r = one.select(*agreement.estimated_recall(F.col("tp"), F.col("pool"), F.col("s"), F.col("m"))).first()
    assert (r["false_negatives"], r["recall"]) == (20.0, 0.5)


def test_arms(spark):
    rows = [("r", w, a, v, "s") for a, said in {"a": "ssnn", "b": "snsn"}.items() for w, v in zip(["W1", "W2", "W3", "W4"], ["gap_stated" if c == "s" else "not_stated" for c in said])]
    rows += [("r", "W5", "a", None, None), ("r", "W5", "b", "gap_stated", None), ("r", "W6", "a", "gap_stated", None)]
    df = spark.createDataFrame(rows, "review string, work_id string, arm string, value string, evidence_span string")
    r = agreement.arms(df, ["a", "b"]).first()
    assert (r["n_records"], r["n_rated_by_every_arm"], r["flagged_a"], r["both"], r["either"], r["n_unanimous"], r["n_disagreed"]) == (5, 4, 2, 1, 3, 2, 2)
    assert {x["work_id"] for x in agreement.disagreements(df).collect()} == {"W2", "W3"}


def test_combined_verdicts(spark):
    rows = [("p1", 1, "exclude", True, False), ("p1", 2, "include", True, True), ("p2", 1, "include", True, False), ("p2", 2, "include", True, False), ("p3", 1, "include", True, False), ("p3", 2, "include", False, False), ("p4", 1, "exclude", False, False)]
    df = spark.createDataFrame(rows, "paper string, arm_no int, decision string, span_verified boolean, gap_stated boolean")
    got = {r["paper"]: (r["decision"], r["agreement"], r["relevant"], r["reading_group"], r["gap_stated"]) for r in agreement.combine_verdicts(df, ["paper"]).collect()}
    assert got == {"p1": ("include", "split", False, 2, True), "p2": ("include", "agreed", True, 0, False), "p3": ("include", "partial", False, 2, False), "p4": ("exclude", "single", False, 1, False)}


DECISIONS = [("W0", "include", True), ("W1", "exclude", True), ("W2", "unverified", False), ("W3", "include", True), ("W4", "exclude", True), ("W5", "exclude", True), ("W6", "error", False)]


def decisions(spark):
    rows = [("run", "r", w, d, 0.5 + i / 20, v, 1000, 100) for i, (w, d, v) in enumerate(DECISIONS)]
    return spark.createDataFrame(rows, "run_id string, review string, work_id string, decision string, confidence double, span_verified boolean, tokens_in long, tokens_out long")


def truth(spark):
    return spark.createDataFrame([("r", f"W{i}", int(i < 3)) for i in range(8)], "review string, work_id string, label_included int")


def test_review_metrics_by_hand(spark):
    r = metrics.review_metrics(decisions(spark), truth(spark)).first()
    assert (r["n_records"], r["n_included_truth"], r["n_screened"]) == (8, 3, 7)
    assert (r["true_positives"], r["false_negatives"], r["false_positives"], r["true_negatives"]) == (1, 1, 1, 2)
    assert (r["recall_verified"], r["verification_rate"], r["n_to_human"]) == (0.5, round(5 / 7, 6), 4)
    assert (r["recall_with_referrals"], r["work_saved"]) == (round(2 / 3, 6), round(3 / 7, 6))
    assert r["cost_usd"] == round(7 * (1000 * 0.15 + 100 * 0.60) / 1e6, 6)


def test_policies(spark):
    proposals = decisions(spark).withColumn("proposed", F.when(F.col("decision").isin("include", "exclude"), F.col("decision")).when(F.col("work_id") == "W2", "include")).withColumn("recovered", F.lit(True))
    got = {r["policy"]: r for r in ablation.verifier_ablation(proposals, truth(spark)).collect()}
    assert set(got) == set(ablation.POLICIES)
    assert (got["with_verifier"]["n_predictions"], got["with_verifier"]["recall"], got["with_verifier"]["comparable"]) == (5, 0.5, False)
    assert (got["no_verifier"]["n_predictions"], got["no_verifier"]["recall"], got["no_verifier"]["n_unverifiable_trusted"], got["no_verifier"]["n_unverifiable_wrong"]) == (6, round(2 / 3, 6), 1, 0)
    assert (got["referrals_to_human"]["n_predictions"], got["referrals_to_human"]["recall"]) == (7, round(2 / 3, 6))


def test_own_percentiles(spark):
    rows = [("run", "r", f"W{i}", v, False) for i, v in enumerate([10, 20])] + [("run", "r", "W9", 0, True)]
    r = metrics.latency_summary(spark.createDataFrame(rows, "run_id string, review string, work_id string, latency_ms int, from_cache boolean")).first()
    assert (r["n"], r["p50"], r["p99"]) == (2, 20.0, 20.0)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(-1.0, True), (0.0, True), (1.0, True), (1.4, True), (0.99, False), (None, True)], "confidence double, span_verified boolean")
    got = {(r["bin"], r["span_verified"]): r["n"] for r in metrics.confidence_histogram(df).collect()}
    assert got == {(0, True): 2, (9, True): 2, (9, False): 1}


def test_budget_stops_at_the_first_crossing(spark):
    rows = [("run", "r", f"W{i}", f"2026-01-01 00:00:{i:02d}", c) for i, c in enumerate([0.4, 0.0, 0.4, 0.4, 0.4])]
    df = spark.createDataFrame(rows, "run_id string, review string, work_id string, t string, cost_usd double").withColumn("created_at", F.to_timestamp("t"))
    got = [(r["work_id"], round(r["spent"], 6), r["aborts"]) for r in metrics.spend_meter(df, 1.0, 3).orderBy("created_at").collect()]
    assert got == [("W0", 0.4, False), ("W2", 0.8, False), ("W3", 1.2, True)]


TITLE = "A randomised trial of an intervention in adults"
ABSTRACT = "First we recruited one hundred adults from four clinics. Then we measured the outcome after six months of follow-up. The intervention reduced the outcome in both arms of the trial."
CRITERIA = "Include trials that report the outcome for adults. Exclude protocols without results of any kind."


def classified(span, title=TITLE, abstract=ABSTRACT, criteria=CRITERIA):
    fold = lambda t: " ".join((t or "").lower().split())
    source = " ".join(x for x in (title, abstract) if x)
    return typology.classify(fold(span), fold(title), fold(abstract), fold(source), fold(criteria))[0]


def test_failure_classes():
    assert classified("Include trials that report the outcome for adults.") == "echoed_criteria"
    assert classified("Include trials that report the outcome for adults.", criteria=None) == "fabricated"
    assert classified("Then we measured the outcome after six months of followup.") == "near_paraphrase"
    assert classified("First we recruited one hundred adults and reduced the outcome in both arms of the trial.") == "stitched"
    assert classified("any quotation of some length", None, None) == "no_source_text"
    assert classified("too short") == "too_short"
    assert classified("word " * 200) == "longer_than_source"
    assert classified(TITLE) == "quote_from_title"
    assert classified(None) == "fabricated"


def test_samples(spark):
    df = spark.createDataFrame([("a" if i < 70 else "b", f"W{i:03d}", int(i % 10 == 0)) for i in range(100)], "review string, work_id string, label_included int")
    s = sampling.stratified(df, ["review"], 5, 1, ["work_id"])
    assert {r["review"]: r["count"] for r in s.groupBy("review").count().collect()} == {"a": 5, "b": 5}
    assert {r["work_id"] for r in s.collect()} == {r["work_id"] for r in sampling.stratified(df.orderBy(F.rand(3)), ["review"], 5, 1, ["work_id"]).collect()}
    p = sampling.proportional(df, "review", 10, 1, ["work_id"])
    assert {r["review"]: r["count"] for r in p.groupBy("review").count().collect()} == {"a": 7, "b": 3}
    k = sampling.keep_included(df, "review", 10, 1, ["work_id"])
    assert k.filter("label_included = 1").count() == 10 and k.groupBy("review").count().filter("count > 10").count() == 0


def test_quotas_add_up(spark):
    counts = spark.createDataFrame([(f"r{i}", n) for i, n in enumerate([1000, 1, 1, 1, 2, 30])], "review string, size bigint")
    for n in (6, 10, 17, 50):
        got = sampling.quotas(counts, "review", n).collect()
        assert sum(r["quota"] for r in got) == n and all(1 <= r["quota"] <= r["size"] for r in got)


def test_responses(spark):
    raw = [
        ('{"decision": "include", "confidence": "0.9", "evidence_span": "we measured the outcome after six months", "extra": 1}', "include", True),
        ('```json\n{"decision": "exclude", "confidence": 0.5, "evidence_span": "nothing like it in the record at all"}\n```', "unverified", False),
        ('{"decision": "maybe", "confidence": 0.5, "evidence_span": "x"}', "error", False),
        ('{"decision": "include", "confidence": 1.4, "evidence_span": "x"}', "error", False),
        ("not json", "error", False),
        (None, "error", False),
    ]
    df = spark.createDataFrame([(i, "r", "W1", r[0]) for i, r in enumerate(raw)], "i int, review string, work_id string, raw_response string")
    works = spark.createDataFrame([("r", "W1", TITLE, ABSTRACT)], "review string, work_id string, title string, abstract string")
    got = responses.screen(df, works, ["i"]).orderBy("i").collect()
    assert [(r["decision"], r["span_verified"]) for r in got] == [(d, v) for _, d, v in raw]
    assert got[4]["verify_note"] == "schema_validation_failed"


def test_cache_states(spark):
    cache = spark.createDataFrame([("k1", "a", "x"), ("k2", "b", "y")], "cache_key string, request_sha256 string, raw_response string")
    asked = spark.createDataFrame([("k1", "a"), ("k2", "other"), ("k3", "c")], "cache_key string, request_sha256 string")
    assert {r["cache_key"]: (r["status"], r["raw_response"]) for r in responses.cache_lookup(asked, cache).collect()} == {"k1": ("hit", "x"), "k2": ("mismatch", None), "k3": ("miss", None)}


def test_field_answers(spark):
    df = spark.createDataFrame([("p", ABSTRACT, ("adults", "we recruited one hundred adults"), ("not_stated", None), ("x", "an invented quotation of some length"))], "id string, src string, a struct<value:string,evidence_span:string>, b struct<value:string,evidence_span:string>, c struct<value:string,evidence_span:string>")
    rows = responses.field_answers(df, ["id"], ["a", "b", "c"], "src", F.lit(True))
    got = {r["field"]: (r["value"], r["note"]) for r in rows.collect()}
    assert got == {"a": ("adults", "exact_after_normalisation"), "b": (None, "not_stated_possibly_truncated"), "c": (None, "not_found")}
    cover = {r["field"]: (r["n"], r["share"]) for r in responses.field_coverage(rows, ["id"], ["a", "b", "c", "d"]).collect()}
    assert cover["d"] == (0, None) and cover["a"] == (1, 1.0)


def test_all_models_are_arms(spark, tmp_path):
    from datetime import datetime

    models = {"r1": "m-a", "r2": "m-b", "r3": "m-c"}
    said = {"W1": "iie", "W2": "iii", "W3": "ie"}  # W3 was not seen by the third model
    spark.createDataFrame(list(models.items()), "run_id string, model string").write.parquet(f"{tmp_path}/screening_run.parquet")
    rows = [(f"r{k + 1}", "rev", w, "include" if c == "i" else "exclude", True, "q", datetime(2026, 1, 1)) for w, cs in said.items() for k, c in enumerate(cs)]
    spark.createDataFrame(rows, "run_id string, review string, work_id string, decision string, span_verified boolean, evidence_span string, created_at timestamp").write.parquet(f"{tmp_path}/screening_decision.parquet")
    r = screening.arm_consensus(spark, str(tmp_path)).first()
    assert (r["n_records"], r["n_rated_by_every_arm"], r["flagged"], r["n_unanimous"], r["n_disagreed"], r["both"], r["either"]) == (2, 2, "m-a:2 m-b:2 m-c:1", 1, 1, 1, 2)
    got = {(r["work_id"], r["n_rated"], r["said"]) for r in screening.arm_disagreements(spark, str(tmp_path)).collect()}
    assert got == {("W1", 3, "m-a:gap_stated m-b:gap_stated m-c:not_stated"), ("W3", 2, "m-a:gap_stated m-b:not_stated")}
