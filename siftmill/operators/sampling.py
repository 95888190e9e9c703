"""Seeded samples whose membership depends on ids and seed only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftmill.session import broadcast_if_small

PARTS = 32


def hash_order(seed: int, *keys: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *keys))


def stratified(df: DataFrame, strata: list[str], n: int, seed: int, keys: list[str]) -> DataFrame:
    """n rows of every stratum (all where there are fewer) in hash order; first within parts, so no stratum is one task."""
    rows = df.withColumn("_h", hash_order(seed, *keys)).withColumn("_p", F.pmod(F.xxhash64("_h"), F.lit(PARTS)))
    for by in ([*strata, "_p"], strata):
        rows = rows.withColumn("_k", F.row_number().over(W.partitionBy(*by).orderBy("_h", *keys))).filter(F.col("_k") <= n)
    return rows.drop("_h", "_p", "_k")


def quotas(counts: DataFrame, by: str, n: int) -> DataFrame:
    """Proportional quotas of n over the groups of counts(by, size): one at least, trimmed or padded to n, largest first.

    A row per group: the groups are few (reviews).
    """
    total = F.sum("size").over(W.partitionBy())
    first = counts.withColumn("quota", F.least(F.col("size"), F.greatest(F.lit(1), F.round(F.lit(n) * F.col("size") / total).cast("bigint"))))
    order = W.orderBy(F.col("size").desc(), by)
    over = F.sum("quota").over(W.partitionBy()) - n
    # too many: take from the largest while they keep one; too few: give to the largest with rows left
    spare = F.when(over > 0, F.col("quota") - 1).otherwise(F.col("size") - F.col("quota"))
    before = F.coalesce(F.sum("spare").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    moved = first.withColumn("over", over).withColumn("spare", spare)
    step = F.greatest(F.lit(0), F.least(F.col("spare"), F.abs("over") - before))
    return moved.select(by, "size", (F.col("quota") - F.signum("over").cast("bigint") * step).alias("quota"))


def proportional(df: DataFrame, by: str, n: int, seed: int, keys: list[str]) -> DataFrame:
    """n rows of df, spread over the groups in proportion to their sizes."""
    allowed = quotas(df.groupBy(by).agg(F.count("*").alias("size")), by, n)
    few = stratified(df, [by], n, seed, keys)  # no group gets more than n
    order = W.partitionBy(by).orderBy(hash_order(seed, *keys), *keys)
    return few.join(broadcast_if_small(allowed.select(by, "quota")), by).withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= F.col("quota")).drop("_k", "quota")


def keep_included(df: DataFrame, by: str, n: int, seed: int, keys: list[str], label: str = "label_included") -> DataFrame:
    """All included rows, and excluded ones in hash order up to n rows of the group in all."""
    included = df.groupBy(by).agg(F.sum(label).alias("_inc"))
    few = stratified(df.filter(F.col(label) != 1), [by], n, seed, keys).unionByName(df.filter(F.col(label) == 1))
    order = W.partitionBy(by).orderBy(hash_order(seed, *keys), *keys)
    excluded = few.filter(F.col(label) != 1).withColumn("_k", F.row_number().over(order))
    ranked = excluded.unionByName(few.filter(F.col(label) == 1).withColumn("_k", F.lit(0))).join(broadcast_if_small(included), by)
    return ranked.filter((F.col(label) == 1) | (F.col("_k") <= n - F.col("_inc"))).drop("_k", "_inc")
