"""Chance-corrected agreement, intervals and recall estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weight_matrix(df: DataFrame, categories: list[str], kind: str = "identity") -> DataFrame:
    """(k, l, w) for all pairs of categories in their order: identity, linear or quadratic weights."""
    last = len(categories) - 1
    rows = []
    for i, a in enumerate(categories):
        for j, b in enumerate(categories):
            apart = abs(i - j) / last if last else 0.0
            rows.append((a, b, {"identity": float(i == j), "linear": 1 - apart, "quadratic": 1 - apart**2}[kind]))
    return df.sparkSession.createDataFrame(rows, "k string, l string, w double")


def gwet(ratings: DataFrame, unit: list[str], category: str, categories: list[str], weights: str = "identity", by: list[str] | None = None) -> DataFrame:
    """Gwet's AC (AC1 with identity weights) of long ratings: by, coefficient, pa, pe, n_units, n_paired.

    Missing ratings are null and count for nothing; chance comes from all rated units, agreement from those rated twice or
    more. Categories are fixed in advance. All null without a rated unit; the coefficient is null without a paired one.
    """
    by = by or []
    q = len(categories)
    if q < 2:
        raise ValueError("at least two categories are needed")
    valid = F.col(category).isin(categories)
    counts = ratings.filter(valid).groupBy(*by, *unit).agg(*(F.count(F.when(F.col(category) == c, 1)).cast("double").alias(f"c{i}") for i, c in enumerate(categories)), F.count("*").cast("double").alias("r"))
    last = q - 1
    weight = lambda i, j: {"identity": float(i == j), "linear": 1 - abs(i - j) / last, "quadratic": 1 - (abs(i - j) / last) ** 2}[weights]
    paired = sum((F.col(f"c{i}") * (sum((weight(i, j) * F.col(f"c{j}") for j in range(q)), F.lit(0.0)) - 1) for i in range(q)), F.lit(0.0))
    pa = F.avg(F.when(F.col("r") >= 2, paired / (F.col("r") * (F.col("r") - 1))))
    sums = counts.groupBy(*by).agg(
        pa.alias("pa"), *(F.avg(F.col(f"c{i}") / F.col("r")).alias(f"p{i}") for i in range(q)), F.count("*").alias("n_units"), F.count(F.when(F.col("r") >= 2, 1)).alias("n_paired")
    )
    total = sum(weight(i, j) for i in range(q) for j in range(q))
    pe = F.lit(total / (q * (q - 1))) * sum((F.col(f"p{i}") * (1 - F.col(f"p{i}")) for i in range(q)), F.lit(0.0))
    return sums.withColumn("pe", pe).select(
        *by, F.round(F.try_divide(F.col("pa") - F.col("pe"), 1 - F.col("pe")), 6).alias("coefficient"), F.round("pa", 6).alias("pa"), F.round("pe", 6).alias("pe"), "n_units", "n_paired"
    )


def pabak(pairs: DataFrame, a: str, b: str, categories: list[str], by: list[str] | None = None) -> DataFrame:
    """Prevalence- and bias-adjusted kappa of two raters: (q po - 1) / (q - 1) over the pairs with both ratings."""
    by, q = by or [], len(categories)
    both = pairs.filter(F.col(a).isin(categories) & F.col(b).isin(categories))
    po = F.avg((F.col(a) == F.col(b)).cast("double"))
    return both.groupBy(*by).agg(F.count("*").alias("n_paired"), F.round(po, 6).alias("po"), F.round((q * po - 1) / (q - 1), 6).alias("coefficient"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of k of n, within 0..1; (0, 1) for n = 0."""
    p = F.try_divide(k.cast("double"), n.cast("double"))
    spread = z * F.sqrt(F.try_divide(p * (1 - p), n.cast("double")) + z * z / (4 * F.pow(n.cast("double"), 2)))
    base = 1 + F.try_divide(F.lit(z * z), n.cast("double"))
    middle = p + F.try_divide(F.lit(z * z), 2 * n.cast("double"))
    low, high = F.greatest(F.lit(0.0), (middle - spread) / base), F.least(F.lit(1.0), (middle + spread) / base)
    return F.when(n == 0, 0.0).otherwise(low), F.when(n == 0, 1.0).otherwise(high)


def estimated_recall(tp: Column, pool: Column, sampled: Column, misses: Column) -> list[Column]:
    """Recall and its bounds where misses of a sampled part of a pool stand for the pool: tp / (tp + rate * pool)."""
    low, high = wilson(misses, sampled)
    rate = F.try_divide(misses.cast("double"), sampled.cast("double"))
    recall = lambda r: F.round(F.try_divide(tp.cast("double"), tp + r * pool), 6)
    return [
        F.round(rate * pool, 6).alias("false_negatives"),
        recall(rate).alias("recall"),
        recall(high).alias("recall_low"),
        recall(low).alias("recall_high"),
    ]


def arms(statements: DataFrame, names: list[str], stated: str = "gap_stated", by: str = "review", item: str = "work_id") -> DataFrame:
    """Several arms' verdicts on the records that all arms saw, per review.

    statements: (by, item, arm, value) with a null value for a missing rating. unanimous, disagreed, both and either count
    records that every arm rated.
    """
    flag = F.when(F.col("value").isNotNull(), F.col("value") == stated)
    per = (
        statements.filter(F.col("arm").isin(names))
        .groupBy(by, item)
        .agg(F.countDistinct("arm").alias("seen"), F.count("value").alias("rated"), F.bool_and(flag).alias("every"), F.bool_or(flag).alias("any"), *(F.max(F.when(F.col("arm") == a, F.col("value") == stated)).alias(f"f{i}") for i, a in enumerate(names)))
        .filter(F.col("seen") == len(names))
    )
    full = F.col("rated") == len(names)
    count = lambda c: F.count(F.when(c, 1))
    return per.groupBy(by).agg(
        F.count("*").alias("n_records"),
        count(full).alias("n_rated_by_every_arm"),
        *(count(F.col(f"f{i}")).alias(f"flagged_{a}") for i, a in enumerate(names)),
        count(full & (F.col("every") == F.col("any"))).alias("n_unanimous"),
        count(full & (F.col("every") != F.col("any"))).alias("n_disagreed"),
        count(full & F.col("every")).alias("both"),
        count(full & F.col("any")).alias("either"),
    )


def disagreements(statements: DataFrame, by: str = "review", item: str = "work_id") -> DataFrame:
    """Records whose arms differ, with every arm's value and quotation."""
    said = F.map_from_entries(F.array_sort(F.collect_list(F.struct("arm", F.struct("value", "evidence_span")))))
    return statements.groupBy(by, item).agg(F.count_distinct("value").alias("values"), F.count(F.when(F.col("value").isNull(), 1)).alias("missing"), said.alias("said")).filter("values > 1 and missing = 0").select(by, item, "said")


def combine_verdicts(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """One answer per paper from several arms' (by, arm_no, decision, span_verified, gap_stated).

    The lead is the first arm with a verified include, else the first. agreement: single, partial (an arm without a
    verified quotation), agreed or split. A gap stands if any arm states one.
    """
    says = (F.col("decision") == "include") & F.col("span_verified")
    grouped = verdicts.groupBy(*by).agg(
        F.count("*").alias("n_arms"),
        F.count(F.when(F.col("span_verified"), 1)).alias("n_verified"),
        F.count_distinct(F.when(F.col("span_verified"), says)).alias("answers"),
        F.coalesce(F.min_by("decision", F.when(says, F.col("arm_no"))), F.min_by("decision", "arm_no")).alias("decision"),
        F.coalesce(F.min_by("span_verified", F.when(says, F.col("arm_no"))), F.min_by("span_verified", "arm_no")).alias("lead_verified"),
        F.bool_or("gap_stated").alias("gap_stated"),
    )
    agreement = F.when(F.col("n_arms") == 1, "single").when(F.col("n_verified") < F.col("n_arms"), "partial").when(F.col("answers") == 1, "agreed").otherwise("split")
    out = grouped.withColumn("agreement", agreement)
    relevant = (F.col("decision") == "include") & F.col("lead_verified") & ~F.col("agreement").isin("split", "partial")
    group = F.when(relevant, 0).when(~F.col("lead_verified"), 1).otherwise(2)
    return out.select(*by, "n_arms", "decision", "lead_verified", "agreement", "gap_stated", relevant.alias("relevant"), group.alias("reading_group"))
