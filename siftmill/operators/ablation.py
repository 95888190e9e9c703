"""What single mechanisms of a screening run are worth: policies over the same answers, stages against a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.operators.metrics import count_if, ratio
from siftmill.operators.ranking import ranking_metrics, rank_rows

POLICIES = ["with_verifier", "no_verifier", "referrals_to_human"]


def verifier_ablation(proposals: DataFrame, truth: DataFrame) -> DataFrame:
    """Per run, review and policy: confusion, recall, precision, work saved and TNR at 0.95, over the labelled records.

    with_verifier scores verified decisions only and is not comparable; no_verifier trusts every proposal;
    referrals_to_human lets a human read all but verified excludes. One pass scores all three.
    """
    totals = truth.groupBy("review").agg(F.count("*").alias("n_records"), F.sum("label_included").alias("n_included_truth"))
    known = proposals.join(truth, ["review", "work_id"])
    ok, p, d = F.col("span_verified"), F.col("proposed"), F.col("decision")
    sure = F.coalesce("confidence", F.lit(0.0))
    decided = ok & d.isin("include", "exclude")
    closed = ok & (d == "exclude")
    group = F.when(~ok, 1).when(d == "include", 0).otherwise(2)
    raw_group = F.when(p.isNull(), 1).when(p == "include", 0).otherwise(2)
    order = lambda g: F.when(g == 0, -sure).when(g == 2, sure).otherwise(0.0)
    policy = lambda name, predicts, human, g: F.struct(F.lit(name).alias("policy"), predicts.alias("predicts"), human.alias("human"), g.alias("g"), order(g).alias("o"))
    rows = known.select(
        "run_id",
        "review",
        "work_id",
        "label_included",
        "span_verified",
        "proposed",
        F.explode(
            F.array(
                policy(POLICIES[0], F.when(decided, d == "include"), ~closed, group),
                policy(POLICIES[1], p == "include", F.coalesce(p != "exclude", F.lit(True)), raw_group),
                policy(POLICIES[2], ~closed, ~closed, group),
            )
        ).alias("x"),
    ).select("run_id", "review", "work_id", "label_included", "span_verified", "proposed", "x.*")
    by = ["run_id", "review", "policy"]
    yes = F.col("label_included") == 1
    trusted = (F.col("policy") == POLICIES[1]) & F.col("proposed").isNotNull() & ~F.col("span_verified")
    scores = rows.groupBy(*by).agg(
        F.count("predicts").alias("n_predictions"),
        count_if(F.col("human")).alias("n_to_human"),
        count_if(F.col("predicts") & yes).alias("true_positives"),
        count_if(F.col("predicts") & ~yes).alias("false_positives"),
        count_if(~F.col("predicts") & yes).alias("false_negatives"),
        count_if(~F.col("predicts") & ~yes).alias("true_negatives"),
        count_if(trusted).alias("n_unverifiable_trusted"),
        count_if(trusted & (F.col("predicts") != yes)).alias("n_unverifiable_wrong"),
    )
    ranked = rank_rows(rows, by, [F.col("g"), F.col("o")])
    tnr = ranking_metrics(ranked, truth, by=by).select(*by, "tnr")
    c = F.col
    return (
        scores.join(totals, "review")
        .join(tnr, by, "left")
        .select(
            *by,
            "n_records",
            "n_included_truth",
            *(x for x in scores.columns if x not in by),
            ratio(c("true_positives"), c("true_positives") + c("false_negatives")).alias("recall"),
            ratio(c("true_positives"), c("true_positives") + c("false_positives")).alias("precision"),
            ratio(c("n_records") - c("n_to_human"), c("n_records")).alias("work_saved"),
            "tnr",
            (c("policy") != POLICIES[0]).alias("comparable"),
        )
    )


def stage_ablation(stages: DataFrame, baseline: str) -> DataFrame:
    """stages (review, stage, tnr) with each stage's difference from the baseline stage of the same review."""
    base = stages.filter(F.col("stage") == baseline).select("review", F.col("tnr").alias("base"))
    return stages.join(base, "review", "left").select("review", "stage", "tnr", F.round(F.col("tnr") - F.col("base"), 4).alias("delta"))
