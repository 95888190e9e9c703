"""Ratings: gap precision and sampled recall, guarded writes, reports and session counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.operators.metrics import count_if, ratio


def gap_precision(stated: DataFrame, ratings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per review: records, stated gaps, their ratings (valid, invalid, none), rate and precision over the rated.

    stated: (review, work_id, value: gap_stated, not_stated or null); ratings: (review, work_id, valid boolean).
    """
    by = by or ["review"]
    rows = stated.join(ratings, ["review", "work_id"], "left")
    gap = F.col("value") == "gap_stated"
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("n_records"), count_if(gap).alias("n_stated"), count_if(gap & F.col("valid")).alias("n_valid"), count_if(gap & ~F.col("valid")).alias("n_invalid"), count_if(gap & F.col("valid").isNull()).alias("n_unrated")
    )
    return sums.select("*", ratio(F.col("n_stated"), F.col("n_records")).alias("gap_rate"), ratio(F.col("n_valid"), F.col("n_valid") + F.col("n_invalid")).alias("precision"))


def beside_recall(precision: DataFrame, recall: DataFrame) -> DataFrame:
    """Precision per review beside the recall that was measured for it; null where none was."""
    return precision.select("review", "n_stated", "precision").join(recall.select("review", "recall", "recall_low", "recall_high"), "review", "left")


def not_mentioning(note: Column, word: str) -> Column:
    """Notes without the word in any case; no note is one of them."""
    return note.isNull() | ~note.ilike(f"%{word}%")


def sample_scores(sample: DataFrame, ratings: DataFrame, open_word: str) -> DataFrame:
    """Per review what raters said of a blind sample.

    sample: (review, work_id, stratum: pool or control); ratings: (review, work_id, rater_id, gap boolean, note). A record
    counts by the majority of its ratings, ties as no gap. misses are pool records with a gap, open_misses those of them on
    which a note without open_word was left, or none; agreement is the share of rated controls that raters call a gap too.
    """
    votes = F.sum(F.when(F.col("gap"), 1).otherwise(-1)) > 0
    per = ratings.groupBy("review", "work_id").agg(votes.alias("gap"), F.bool_or(not_mentioning(F.col("note"), open_word)).alias("open"))
    rows = sample.join(per, ["review", "work_id"], "left")
    pool, control = F.col("stratum") == "pool", F.col("stratum") == "control"
    return rows.groupBy("review").agg(
        count_if(pool).alias("n_sampled"),
        count_if(pool & F.col("gap").isNotNull()).alias("n_rated"),
        count_if(pool & F.col("gap")).alias("misses"),
        count_if(pool & F.col("gap") & F.col("open")).alias("open_misses"),
        count_if(control & F.col("gap").isNotNull()).alias("n_controls"),
        ratio(count_if(control & F.col("gap")), count_if(control & F.col("gap").isNotNull())).alias("control_agreement"),
    )


def guarded(writes: DataFrame, decisions: DataFrame, label: str, allowed: list[str], only: str | None = None) -> DataFrame:
    """writes (run_id, review, work_id, ...) with ``status``: written, or why not: not_a_label, no_decision, not_ratable.

    only: the one decision that may be rated. Each decision has one row.
    """
    keys = ["run_id", "review", "work_id"]
    joined = writes.join(decisions.select(*keys, F.col("decision").alias("_d")), keys, "left")
    status = F.when(F.col(label).isNull() | ~F.col(label).isin(allowed), "not_a_label").when(F.col("_d").isNull(), "no_decision")
    if only:
        status = status.when(F.col("_d") != only, "not_ratable")
    return joined.withColumn("status", status.otherwise("written")).drop("_d")


def session_counts(combined: DataFrame, decisions: DataFrame) -> DataFrame:
    """Per review: papers included, excluded, referred and split by the combined answers; quotations and gaps.

    combined: the answers of agreement.combine_verdicts with (review, work_id); decisions: all arms' with span_verified.
    """
    c = F.col
    says = combined.groupBy("review").agg(
        F.count("*").alias("n_papers"),
        count_if(c("relevant")).alias("included"),
        count_if(c("lead_verified") & (c("decision") == "exclude")).alias("excluded"),
        count_if(~c("lead_verified")).alias("referred"),
        count_if(c("agreement") == "split").alias("split"),
        count_if(c("gap_stated")).alias("gaps"),
    )
    quotes = decisions.filter("span_verified").groupBy("review").agg(F.count("*").alias("quotes"))
    return says.join(quotes, "review", "left").withColumn("quotes", F.coalesce("quotes", F.lit(0)))


def known_only(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with their label (review, work_id, label_included); an id without a label, or with two, fails the job."""
    once = labels.groupBy("review", "work_id").agg(F.max("label_included").alias("label_included"), F.count("*").alias("_n"))
    joined = rows.join(once, ["review", "work_id"], "left")
    name = F.concat_ws("/", "review", "work_id")
    fail = lambda what: F.raise_error(F.concat(F.lit(what), name)).cast("int")
    label = F.when(F.col("_n").isNull(), fail("no label: ")).when(F.col("_n") > 1, fail("two labels: ")).otherwise(F.col("label_included"))
    return joined.withColumn("label_included", label).drop("_n")


#: What a screening prompt may see of a record.
SCREENING_COLUMNS = ["review", "work_id", "title", "abstract", "year", "doi"]
AD_HOC = "_discover"


def safe(works: DataFrame) -> DataFrame:
    """Records for screening: six columns, never a label."""
    return works.select(*SCREENING_COLUMNS)


def scoped(rows: DataFrame, review: str | None = None, ad_hoc: str = AD_HOC) -> DataFrame:
    """rows of one review if it is given, else of all but the ad-hoc one."""
    return rows.filter(F.col("review") == review) if review else rows.filter(F.col("review") != ad_hoc)
