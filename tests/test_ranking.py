import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from siftmill.operators import ranking as R

WORKS = [
    ("r", "W1", "Lichens as gauges of clean air", "Lichens on oaks were mapped; few lichens meant smoke."),
    ("r", "W2", "Ferry timetables", "Boats and tides in two harbours."),
    ("r", "W3", "Smoke and oaks", "Oaks near kilns carried fewer lichens."),
    ("r", "W4", "Bread ovens", "Sourdough in wood-fired ovens."),
]
COLUMNS = "review string, work_id string, title string, abstract string"


def ranked(spark, question, works=WORKS, **more):
    q = spark.createDataFrame([("r", question)], "review string, question string")
    return R.bm25(spark.createDataFrame(works, COLUMNS), q, **more).filter("review = 'r'").orderBy("rank").collect()


@pytest.mark.parametrize("question", ["Lichens on oaks, smoke.", "smoke/air of lichens?", "NOT lichens NEAR oaks", '"open mark (lichens'])
def test_lexical_order(spark, question):
    rows = ranked(spark, question)
    assert {r["work_id"] for r in rows[:2]} == {"W1", "W3"} and rows[0]["score"] is not None
    assert len(rows) == 4


def test_no_usable_term_is_id_order(spark):
    assert [r["work_id"] for r in ranked(spark, "a, b; ?")] == ["W1", "W2", "W3", "W4"]


def test_other_reviews_change_nothing(spark):
    noise = [("other", f"X{i}", "Lichens on small oaks", "Smoke and lichens") for i in range(200)]
    alone = {r["work_id"]: r["score"] for r in ranked(spark, "lichens smoke")}
    assert {r["work_id"]: r["score"] for r in ranked(spark, "lichens smoke", WORKS + noise)} == alone


def test_stemmed_scores_are_those_of_fts5(spark):
    db = sqlite3.connect(":memory:")
    try:
        db.execute("CREATE VIRTUAL TABLE t USING fts5(title, abstract, tokenize='porter unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5")
    db.executemany("INSERT INTO t VALUES (?, ?)", [(w[2], w[3]) for w in WORKS])
    want = {f"W{i}": -s for i, s in db.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH '\"lichen\" OR \"carry\" OR \"ovens\"'")}
    got = {r["work_id"]: r["score"] for r in ranked(spark, "lichen carry ovens", stemmed=True) if r["score"] is not None}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], rel_tol=1e-6, abs_tol=1e-8) for k in want)


def metrics(spark, pattern, total=None):
    rows = [("r", f"W{i:03d}", i + 1, int(c == "P")) for i, c in enumerate(pattern)]
    df = spark.createDataFrame(rows, "review string, work_id string, rank int, label_included int")
    extra = [("r", f"Z{i}", 0) for i in range((total or len(pattern)) - len(pattern))]
    truth = df.select("review", "work_id", "label_included")
    if extra:
        truth = truth.unionByName(spark.createDataFrame(extra, truth.schema))
    return R.ranking_metrics(df, truth).first()


def test_ranking_metrics_by_hand(spark):
    a = metrics(spark, "PNPNNPNNNN")
    assert (a["cutoff"], a["recall_at_cutoff"], a["tnr"], a["wss"]) == (6, 1.0, round(4 / 7, 6), 0.35)
    assert (metrics(spark, "PP" + "N" * 18)["cutoff"], metrics(spark, "PP" + "N" * 18)["tnr"]) == (2, 1.0)
    b = metrics(spark, "N" * 18 + "PP")
    assert (b["cutoff"], b["tnr"]) == (20, 0.0)
    c = metrics(spark, "P" * 19 + "N" * 5 + "P" + "N" * 5)
    assert (c["cutoff"], c["recall_at_cutoff"], c["tnr"]) == (19, 0.95, 1.0)
    d = metrics(spark, "NNNN")
    assert (d["cutoff"], d["tnr"], d["wss"]) == (None, None, None)
    e = metrics(spark, "PNP", 5)
    assert (e["complete"], e["n_ranked"]) == (False, 3)


def test_curve_is_monotone_and_meets_the_cutoff(spark):
    rows = [("r", f"W{i:03d}", i + 1, int(i % 7 == 0)) for i in range(120)]
    df = spark.createDataFrame(rows, "review string, work_id string, rank int, label_included int")
    truth = df.select("review", "work_id", "label_included")
    curve = [(r["position"], r["recall"]) for r in R.recall_curve(df, truth).orderBy("position").collect()]
    assert curve[0] == (0, 0.0) and curve[-1] == (120, 1.0)
    assert all(a[1] <= b[1] for a, b in zip(curve, curve[1:]))
    cutoff = R.ranking_metrics(df, truth).first()["cutoff"]
    assert min(p for p, r in curve if r >= 0.95) == cutoff


def test_fusion_and_reranking(spark):
    make = lambda ids: spark.createDataFrame([("r", w, k + 1) for k, w in enumerate(ids)], "review string, work_id string, rank int")
    fused = R.fuse([make("abc"), make("cab")])
    assert [r["work_id"] for r in fused.orderBy("rank").collect()] == ["a", "c", "b"]
    scores = spark.createDataFrame([("r", "b", 2.0), ("r", "a", 1.0), ("r", "c", 9.0)], "review string, work_id string, score double")
    again = R.rerank(make("abc"), scores, top=2)
    assert [r["work_id"] for r in again.orderBy("rank").collect()] == ["b", "a", "c"]


def test_random_order_ignores_row_order(spark):
    df = spark.createDataFrame([("r", f"W{i}") for i in range(50)], "review string, work_id string")
    a = {r["work_id"]: r["rank"] for r in R.random_rank(df, 7).collect()}
    b = {r["work_id"]: r["rank"] for r in R.random_rank(df.orderBy(F.desc("work_id")), 7).collect()}
    assert a == b != {r["work_id"]: r["rank"] for r in R.random_rank(df, 8).collect()}


def test_dense(spark):
    df = spark.createDataFrame([("r", 1, [0.9, 0.1]), ("r", 2, [0.0, 1.0]), ("r", 3, [0.8, 0.2]), ("r", 4, [-1.0, 0.0]), ("r", 5, [0.0, 0.0])], "review string, vec_id int, embedding array<float>")
    query = spark.createDataFrame([("r", [1.0, 0.0])], "review string, query_vector array<float>")
    assert [r["vec_id"] for r in R.dense_rank(df, query).orderBy("rank").collect()] == [1, 3, 2, 5, 4]


def test_expansion_terms(spark):
    df = spark.createDataFrame([("gut bacteria and sleep", ["sleep", "Gut  bacteria", "gut microbiota", "GUT MICROBIOTA", 'AND "x"', "a b c d e f g", "y" * 61, "", "circadian rhythm"])], "q string, t array<string>")
    assert df.select(R.accept_terms(F.col("q"), F.col("t"))).first()[0] == ["gut microbiota", "circadian rhythm"]


def test_rest_is_appended_and_limits_of_zero_are_none(spark):
    works = spark.createDataFrame(WORKS, COLUMNS)
    part = spark.createDataFrame([("r", "W3", 1)], "review string, work_id string, rank int")
    assert [r["work_id"] for r in R.append_rest(part, works).orderBy("rank").collect()] == ["W3", "W1", "W2", "W4"]
    assert R.random_rank(works, limit=0).count() == 4 and R.random_rank(works, limit=2).count() == 2
    for strategy in ("bm25", "dense", "hybrid", "rerank", "other"):
        with pytest.raises(ValueError):
            R.rank(strategy, works)


def test_strategies(spark):
    works = spark.createDataFrame([*WORKS, ("r", "W5", None, None)], COLUMNS)
    question = spark.createDataFrame([("r", "lichens on oaks")], "review string, question string")
    for strategy in ("random", "bm25", "dense", "hybrid"):
        assert sorted(r["rank"] for r in R.rank(strategy, works, questions=question).collect()) == [1, 2, 3, 4, 5]
    assert {r["work_id"] for r in R.rank("hybrid", works, questions=question, limit=2).collect()} == {"W1", "W3"}
    scores = spark.createDataFrame([("r", "W2", 5.0)], "review string, work_id string, score double")
    assert R.rank("rerank", works, questions=question, scores=scores).orderBy("rank").first()["work_id"] == "W2"
    assert R.one_record(works, ["review"]).first()["work_id"] == "W1" and R.one_record(works, ["review"], 7).count() == 1
    assert [r["title"] for r in R.fetched(R.bm25(works, question, limit=1), works).collect()] in (["Lichens as gauges of clean air"], ["Smoke and oaks"])


def test_vectors_are_remembered_for_their_corpus_only(spark, tmp_path):
    works = spark.createDataFrame(WORKS, COLUMNS)
    make = lambda df: R.remembered_vectors(df, ["work_id"], F.col("abstract"), f"file://{tmp_path}")
    first = {r["work_id"]: r["embedding"] for r in make(works).collect()}
    assert {r["work_id"]: r["embedding"] for r in make(works.orderBy(F.desc("work_id"))).collect()} == first and len(list(tmp_path.iterdir())) == 1
    make(works.withColumn("abstract", F.upper("abstract"))).count()
    assert len(list(tmp_path.iterdir())) == 2
