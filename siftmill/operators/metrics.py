"""What a screening run is worth against human labels, and profiles of runs and collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftmill.operators.ranking import decision_order, positions, ranking_metrics
from siftmill.session import broadcast_if_small


def ratio(a: Column, b: Column) -> Column:
    """a / b rounded to 6 digits; null for b = 0."""
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), 6)


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def to_human() -> Column:
    """Records that a human reads: all but verified excludes."""
    return ~(F.col("span_verified") & (F.col("decision") == "exclude"))


def review_metrics(decisions: DataFrame, truth: DataFrame, usd_in: float = 0.15, usd_out: float = 0.60) -> DataFrame:
    """Per run and review, over the records with a label: counts, confusion over verified decisions, recall with referrals,
    work saved, tokens and their cost."""
    totals = truth.groupBy("review").agg(F.count("*").alias("n_records"), F.sum("label_included").alias("n_included_truth"))
    rows = decisions.join(truth, ["review", "work_id"])
    yes, ok, include = F.col("label_included") == 1, F.col("span_verified"), F.col("decision") == "include"
    agg = rows.groupBy("run_id", "review").agg(
        F.count("*").alias("n_screened"),
        count_if(yes).alias("n_included_screened"),
        count_if(ok).alias("n_verified"),
        count_if(F.col("decision") == "error").alias("n_errors"),
        count_if(~ok & (F.col("decision") != "error")).alias("n_unverified"),
        count_if(ok & include & yes).alias("true_positives"),
        count_if(ok & include & ~yes).alias("false_positives"),
        count_if(ok & ~include & yes).alias("false_negatives"),
        count_if(ok & ~include & ~yes).alias("true_negatives"),
        count_if(to_human()).alias("n_to_human"),
        count_if(to_human() & yes).alias("kept"),
        F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"),
    )
    c = F.col
    return agg.join(totals, "review").select(
        "run_id",
        "review",
        "n_records",
        "n_included_truth",
        F.coalesce(ratio(c("n_included_truth"), c("n_records")), F.lit(0.0)).alias("prevalence"),
        *(x for x in agg.columns if x not in ("run_id", "review", "kept", "tokens_in", "tokens_out")),
        ratio(c("n_verified"), c("n_screened")).alias("verification_rate"),
        ratio(c("true_positives"), c("true_positives") + c("false_negatives")).alias("recall_verified"),
        ratio(c("true_positives"), c("true_positives") + c("false_positives")).alias("precision_verified"),
        ratio(c("kept"), c("n_included_screened")).alias("recall_with_referrals"),
        ratio(c("n_screened") - c("n_to_human"), c("n_screened")).alias("work_saved"),
        "tokens_in",
        "tokens_out",
        F.round(c("tokens_in") * (usd_in / 1e6) + c("tokens_out") * (usd_out / 1e6), 6).alias("cost_usd"),
    )


def run_ranking(decisions: DataFrame, truth: DataFrame, recall: str = "0.95") -> DataFrame:
    """Ranking metrics of every run's decision order over the labelled records."""
    known = decisions.join(truth.select("review", "work_id"), ["review", "work_id"], "left_semi")
    return ranking_metrics(decision_order(known, ["run_id", "review"]), truth, recall, by=["run_id", "review"])


def verification_failures(decisions: DataFrame) -> DataFrame:
    """Notes of unverified decisions per run with their number and share."""
    failed = decisions.filter(~F.col("span_verified")).groupBy("run_id", F.coalesce("verify_note", F.lit("")).alias("note")).agg(F.count("*").alias("n"))
    return failed.withColumn("share", ratio(F.col("n"), F.sum("n").over(W.partitionBy("run_id"))))


def verification_by_review(decisions: DataFrame, truth: DataFrame) -> DataFrame:
    """Per review: screened, verified, rate, and the prevalence of included records."""
    seen = decisions.groupBy("review").agg(F.count("*").alias("n_screened"), count_if(F.col("span_verified")).alias("n_verified"))
    known = truth.groupBy("review").agg(F.round(F.avg("label_included"), 6).alias("prevalence"))
    return seen.join(known, "review").select("review", "prevalence", "n_screened", "n_verified", ratio(F.col("n_verified"), F.col("n_screened")).alias("rate"))


def failure_matrix(decisions: DataFrame) -> DataFrame:
    """review x note: number of failures, share of the review's, and the note's place by its total."""
    counts = decisions.filter(~F.col("span_verified")).groupBy("review", F.coalesce("verify_note", F.lit("")).alias("note")).agg(F.count("*").alias("n"))
    total = counts.groupBy("note").agg(F.sum("n").alias("total"))
    placed = total.withColumn("column_no", F.row_number().over(W.orderBy(F.col("total").desc(), "note")).cast("bigint"))  # a row per note
    return counts.join(broadcast_if_small(placed), "note").select("review", "note", "n", ratio(F.col("n"), F.sum("n").over(W.partitionBy("review"))).alias("share"), "column_no")


def confidence_histogram(decisions: DataFrame, bins: int = 10) -> DataFrame:
    """Confidences clamped to 0..1 in equal bins, the top edge in the last, split by verification."""
    x = F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0))
    at = F.least(F.floor(x * bins), F.lit(bins - 1)).cast("int")
    return (
        decisions.filter("confidence is not null and not isnan(confidence)").groupBy(at.alias("bin"), "span_verified").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean"))
    )


def latest_runs(decisions: DataFrame, runs: DataFrame) -> DataFrame:
    """Per review the last run in the order of run ids that screened it, with its verification rate."""
    per = decisions.groupBy("review", "run_id").agg(F.count("*").alias("n"), count_if(F.col("span_verified")).alias("v"))
    last = per.groupBy("review").agg(F.max_by(F.struct("run_id", "n", "v"), "run_id").alias("r")).select("review", "r.*")
    return last.join(runs.select("run_id", "model", "prompt_version"), "run_id").select("review", "run_id", "model", "prompt_version", "n", ratio(F.col("v"), F.col("n")).alias("verification_rate"))


def latency_summary(decisions: DataFrame) -> DataFrame:
    """Per run, of live calls: mean and the latencies at index min(n - 1, int(p n)) of the sorted values."""
    live = decisions.filter(~F.col("from_cache") & (F.col("latency_ms") > 0))
    named = live.select("run_id", "latency_ms", F.concat_ws("|", "review", "work_id").alias("id"))
    sizes = live.groupBy("run_id").agg(F.count("*").alias("n"))
    ranked = positions(named, ["run_id"], [F.col("latency_ms").asc(), F.col("id").asc()], "k").join(sizes, "run_id")
    at = lambda p: F.max(F.when(F.col("k") == F.least(F.col("n") - 1, F.floor(F.col("n") * p)) + 1, F.col("latency_ms"))).cast("double")
    return ranked.groupBy("run_id").agg(F.max("n").alias("n"), F.round(F.avg("latency_ms"), 6).alias("mean_ms"), at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.99).alias("p99"))


def cache_savings(decisions: DataFrame) -> DataFrame:
    """Per run: cached and live decisions, hit rate, and the hours that the hits saved at the live mean latency."""
    live = ~F.col("from_cache") & (F.col("latency_ms") > 0)
    agg = decisions.groupBy("run_id").agg(F.count("*").alias("n"), count_if(F.col("from_cache")).alias("n_cached"), F.avg(F.when(live, F.col("latency_ms"))).alias("m"), F.sum("cost_usd").alias("c"))
    return agg.select("run_id", "n", "n_cached", ratio(F.col("n_cached"), F.col("n")).alias("hit_rate"), F.round(F.col("m"), 6).alias("live_mean_ms"), F.round(F.col("n_cached") * F.col("m") / 3_600_000, 6).alias("hours_saved"), F.round("c", 4).alias("cost_usd"))


def override_summary(overrides: DataFrame, decisions: DataFrame) -> DataFrame:
    """Per review and model decision: labels given, changed and confirmed, and the share changed.

    overrides: (run_id, review, work_id, human_decision) with plain labels; joined to the decisions they were given on.
    """
    joined = overrides.join(decisions.select("run_id", "review", "work_id", "decision"), ["run_id", "review", "work_id"])
    changed = F.col("human_decision") != F.col("decision")
    return joined.groupBy("review", "decision").agg(F.count("*").alias("n"), count_if(changed).alias("changed"), count_if(~changed).alias("confirmed")).withColumn("rate", ratio(F.col("changed"), F.col("n")))


def override_accuracy(overrides: DataFrame, decisions: DataFrame, truth: DataFrame) -> DataFrame:
    """Per run: labels against the truth, the model's decisions against it, and how often the override was right."""
    keys = ["run_id", "review", "work_id"]
    rows = overrides.join(decisions.select(*keys, "decision"), keys).join(truth, ["review", "work_id"])
    want = F.when(F.col("label_included") == 1, "include").otherwise("exclude")
    return rows.groupBy("run_id").agg(
        F.count("*").alias("n"),
        count_if(F.col("human_decision") == want).alias("human_right"),
        count_if(F.col("decision") == want).alias("model_right"),
        count_if((F.col("human_decision") != F.col("decision")) & (F.col("human_decision") == want)).alias("repaired"),
    )


def prevalence(works: DataFrame, truth: DataFrame) -> DataFrame:
    """Per review: records, labelled, included, prevalence, records without an abstract."""
    joined = works.join(truth, ["review", "work_id"], "left")
    missing = F.col("abstract").isNull() | (F.trim("abstract") == "")
    return joined.groupBy("review").agg(F.count("*").alias("n"), F.count("label_included").alias("n_labelled"), F.coalesce(F.sum("label_included"), F.lit(0)).alias("n_included"), count_if(missing).alias("missing_abstracts")).withColumn(
        "prevalence", ratio(F.col("n_included"), F.col("n_labelled"))
    )


def year_histogram(works: DataFrame, truth: DataFrame) -> DataFrame:
    """Records and included ones by year; rows without a year don't count."""
    return works.filter("year is not null").join(truth, ["review", "work_id"], "left").groupBy(F.col("year").cast("int").alias("year")).agg(F.count("*").alias("n"), F.coalesce(F.sum("label_included"), F.lit(0)).alias("n_included"))


def metadata_coverage(works: DataFrame, columns: list[str]) -> DataFrame:
    """How many records have each column, in one pass."""
    counts = works.agg(F.count("*").alias("n"), *(F.count(c).alias(c) for c in columns))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("n_present")) for c in columns)))
    return counts.select("n", pairs.alias("p")).select("p.field", "p.n_present", "n", ratio(F.col("p.n_present"), F.col("n")).alias("share"))


def spend_meter(decisions: DataFrame, budget: float, block: int = 65_536) -> DataFrame:
    """Per run the paid calls in their order with the running cost, up to and with the first that reaches the budget.

    Calls are numbered in ranges, and blocks of numbers are summed first, so that no run and no burst is one sorted task.
    """
    keys = ["run_id", "created_at", "review", "work_id"]
    paid = decisions.filter("cost_usd > 0").select(*keys, "cost_usd")
    rows = positions(paid, ["run_id"], [F.col(k).asc() for k in keys[1:]], "_k").withColumn("part", F.floor((F.col("_k") - 1) / block))
    sums = rows.groupBy("run_id", "part").agg(F.sum("cost_usd").alias("s"))
    before = sums.select("run_id", "part", (F.sum("s").over(W.partitionBy("run_id").orderBy("part")) - F.col("s")).alias("offset"))
    inside = W.partitionBy("run_id", "part").orderBy("_k").rowsBetween(W.unboundedPreceding, 0)
    running = rows.join(before, ["run_id", "part"]).withColumn("spent", F.round(F.col("offset") + F.sum("cost_usd").over(inside), 8))
    return running.filter(F.round(F.col("spent") - F.col("cost_usd"), 8) < budget).select("run_id", "review", "work_id", "created_at", "spent", (F.col("spent") >= budget).alias("aborts"))


def coverage_with_totals(papers: DataFrame, group: str) -> DataFrame:
    """Per group and over all: papers, fragments, share usable, upper median length of bodies.

    Papers are counted by size first; the median is read off the counts, so no group is collected.
    """
    sizes = papers.select(F.coalesce(F.col(group).cast("string"), F.lit("")).alias(group), F.length("body").alias("size"), "is_fragment")
    counts = sizes.groupBy(group, "size").agg(F.count("*").alias("n"), count_if(F.col("is_fragment")).alias("f"))
    both = counts.unionByName(counts.withColumn(group, F.lit("all")))
    both = both.groupBy(group, "size").agg(F.sum("n").alias("n"), F.sum("f").alias("f"))
    totals = both.groupBy(group).agg(F.sum("n").alias("total"), F.sum("f").alias("n_fragments"), F.sum(F.when(F.col("size").isNotNull(), F.col("n"))).alias("sized"))
    so_far = F.sum("n").over(W.partitionBy(group).orderBy("size").rowsBetween(W.unboundedPreceding, 0))  # a row per length
    middle = both.filter("size is not null").withColumn("c", so_far).join(totals.select(group, "sized"), group).filter(F.col("c") > F.floor(F.col("sized") / 2)).groupBy(group).agg(F.min("size").cast("bigint").alias("upper_median"))
    return totals.join(middle, group, "left").select(group, F.col("total").alias("n"), "n_fragments", ratio(F.col("total") - F.col("n_fragments"), F.col("total")).alias("usable"), "upper_median")
