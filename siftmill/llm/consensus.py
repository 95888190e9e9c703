"""Consensus from several annotators' labels by confidence-aware truth discovery.

Alternates between truths and annotators. A truth is the label at the smallest weighted distance from the record's
labels. An annotator's distance is class-wise: the log-odds that the label carries, from the annotator's error rates on
either class, times the confidence that the number of labels allows: the lower chi-squared quantile over its degrees of
freedom (the factor by which an upper bound exceeds an error variance). Annotators with few labels so count for less,
those who always give one label for nothing, those who are wrong on purpose against what they say.

With one error variance per annotator (the plain form of the method) the class prior and one-sided annotators are out of
reach: on the check tables 1 % of the records come out otherwise than by the likeliest label.

Cases: null, blank and other labels are missing; of a record's labels by one annotator the latest counts, at one time the
larger; a record without any label has no consensus and no row; ties go to exclude; empty tables give empty results.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.session import BROADCAST_ROWS, stage

#: Quantile of the chi-squared bound on an error variance.
QUANTILE = 0.25
#: Rounds after which a result that has not settled is given with a warning; change of the class-wise error rates and the
#: prior below which it has.
ROUNDS, TOLERANCE = 500, 1e-5
#: Sums per annotator; those that give the rates and the prior of all.
SUMS = ("n", "n1", "n0", "s1", "s0", "v_items", "items")


def latest_labels(df: DataFrame, item: list[str], annotator: str, label: str, at: str) -> DataFrame:
    """item, annotator, y (1 include, 0 exclude), m (the item's number of labels)."""
    said = F.lower(F.regexp_replace(F.col(label), r"^\s+|\s+$", ""))
    y = F.when(said == "include", 1.0).when(said == "exclude", 0.0)
    labels = (
        df.select(*item, F.col(annotator).alias("annotator"), y.alias("y"), F.col(at).alias("at"))
        .filter("y is not null and annotator is not null")
        .groupBy(*item, "annotator")
        .agg(F.max_by("y", F.struct("at", "y")).alias("y"))
    )
    return labels.join(labels.groupBy(*item).agg(F.count("*").alias("m")), item)


def _confidence(n: Column) -> Column:
    """Lower chi-squared quantile of n degrees of freedom over n (Wilson-Hilferty)."""
    z = NormalDist().inv_cdf(QUANTILE)
    n = F.greatest(n, F.lit(1.0))
    return F.pow(F.greatest(1 - 2 / (9 * n) + z * F.sqrt(2 / (9 * n)), F.lit(0.05)), 3)


def _statistics(labels: DataFrame, truths: DataFrame, item: list[str]) -> DataFrame:
    """Per annotator: labels, labels' share of each class, errors on each, and the sums that give the prior."""
    v, y = F.col("v"), F.col("y")
    return (
        labels.join(truths, item)
        .groupBy("annotator")
        .agg(
            F.count("*").cast("double").alias("n"),
            F.sum(v).alias("n1"),
            F.sum(1 - v).alias("n0"),
            F.sum(v * (1 - y)).alias("s1"),
            F.sum((1 - v) * y).alias("s0"),
            F.sum(v / F.col("m")).alias("v_items"),
            F.sum(1 / F.col("m")).alias("items"),
        )
    )


def _weights(stats: DataFrame, e1: float, e0: float) -> DataFrame:
    """Per annotator: error rates smoothed by all annotators', confidence, weight of either label."""
    miss = (F.col("s1") + e1) / (F.col("n1") + 1)
    false = (F.col("s0") + e0) / (F.col("n0") + 1)
    clip = lambda x: F.least(F.greatest(x, F.lit(0.002)), F.lit(0.998))
    return stats.select(
        "annotator",
        "n",
        miss.alias("miss"),
        false.alias("false"),
        _confidence(F.col("n")).alias("confidence"),
        F.log(clip(1 - miss) / clip(false)).alias("include"),
        F.log(clip(miss) / clip(1 - false)).alias("exclude"),
    )


def _truths(labels: DataFrame, weights: DataFrame, item: list[str], prior: float) -> DataFrame:
    """Per item the probability of include, by the weighted distances of both labels."""
    odds = F.log(F.lit(prior) / (1 - F.lit(prior)))
    each = F.col("confidence") * F.when(F.col("y") == 1, F.col("include")).otherwise(F.col("exclude"))
    total = labels.join(weights.select("annotator", "confidence", "include", "exclude"), "annotator").groupBy(*item).agg(F.sum(each).alias("s"))
    return total.select(*item, (1 / (1 + F.exp(-F.least(F.greatest(F.col("s") + odds, F.lit(-500.0)), F.lit(500.0))))).alias("v"))


def _totals(sums: dict[str, float]) -> tuple[float, float, float]:
    """Error rates on either class over all annotators, and the share of include."""
    return sums["s1"] / max(sums["n1"], 1e-9), sums["s0"] / max(sums["n0"], 1e-9), min(max(sums["v_items"] / sums["items"], 1e-6), 1 - 1e-6)


def _settle(first, step: Callable, totals: Callable):
    """Alternate until the totals of the statistics no longer change: (statistics, totals), or None where nothing was labelled."""
    stats, before = first, None
    for _ in range(ROUNDS):
        sums = totals(stats)
        if not sums["items"]:
            return None
        now = _totals(sums)
        if before and max(abs(a - b) for a, b in zip(now, before)) < TOLERANCE:
            return stats, now
        before = now
        stats = step(stats, now)
    warnings.warn("truths and annotators had not settled", stacklevel=3)
    return stats, now


def _round(v_of: Callable, size: int):
    """Arrow function: sums per annotator of a part of the items, whose labels (i, y) lie in one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(SUMS), size))
        for batch in batches:
            i, y, begins, m = _flat(batch)
            if len(i):
                v, m = np.repeat(v_of(i, y, begins, m), m), np.repeat(m, m)
                for k, x in enumerate((np.ones(len(i)), v, 1 - v, v * (1 - y), (1 - v) * y, v / m, 1 / m)):
                    sums[k] += np.bincount(i, x, size)
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(x[at]) for x in sums)], names=["i", *SUMS])

    return run


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Annotators and labels of all items in a row, where each item begins, and how many labels it has."""
    i, y = batch.column(batch.schema.get_field_index("i")), batch.column(batch.schema.get_field_index("y"))
    offsets = i.offsets.to_numpy()
    return i.flatten().to_numpy(), y.flatten().to_numpy().astype(np.float64), (offsets - offsets[0])[:-1], np.diff(offsets)


def _weighted(stats: np.ndarray, now: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Weights of both labels per annotator, as in :func:`_weights`."""
    n, n1, n0, s1, s0 = stats[:5]
    miss, false = (s1 + now[0]) / (n1 + 1), (s0 + now[1]) / (n0 + 1)
    clip = lambda x: np.clip(x, 0.002, 0.998)
    m = np.maximum(n, 1.0)
    sure = np.maximum(1 - 2 / (9 * m) + NormalDist().inv_cdf(QUANTILE) * np.sqrt(2 / (9 * m)), 0.05) ** 3
    return sure * np.log(clip(1 - miss) / clip(false)), sure * np.log(clip(miss) / clip(1 - false))


def _likely(weights, prior: float) -> Callable:
    """Probability of include per item from the weights of its labels; weights: a broadcast pair of arrays."""

    def v_of(i: np.ndarray, y: np.ndarray, begins: np.ndarray, m: np.ndarray) -> np.ndarray:
        include, exclude = weights.value
        s = np.add.reduceat(np.where(y == 1, include[i], exclude[i]), begins) + np.log(prior / (1 - prior))
        return 1 / (1 + np.exp(-np.clip(s, -500, 500)))

    return v_of


def _discover_arrays(labels: DataFrame, names: list[str], item: list[str]) -> tuple[DataFrame, DataFrame]:
    """(truths, weights) with an item's labels in one row and the annotators' weights on every executor: a round shuffles
    partial sums of annotators only."""
    spark = labels.sparkSession
    index = spark.createDataFrame([(a, k) for k, a in enumerate(names)], "annotator string, i int")
    numbered = labels.withColumn("annotator", F.col("annotator").cast("string")).join(F.broadcast(index), "annotator")
    pairs = F.array_sort(F.collect_list(F.struct("i", "y")))
    items = stage(numbered.groupBy(*item).agg(pairs.alias("l")).select(*item, F.col("l.i").alias("i"), F.transform("l.y", lambda y: y.cast("tinyint")).alias("y")))

    def sums(v_of: Callable) -> np.ndarray:
        columns = ", ".join(f"{c} double" for c in SUMS)
        rows = items.select("i", "y").mapInArrow(_round(v_of, len(names)), f"i int, {columns}").groupBy("i").agg(*(F.sum(c).alias(c) for c in SUMS)).toArrow()
        out = np.zeros((len(SUMS), len(names)))
        for k, c in enumerate(SUMS):
            out[k, rows.column("i").to_numpy()] = rows.column(c).to_numpy()
        return out

    shared = lambda stats, now: spark.sparkContext.broadcast(_weighted(stats, now))
    first = sums(lambda i, y, begins, m: np.add.reduceat(y, begins) / m)
    stats, now = _settle(first, lambda stats, now: sums(_likely(shared(stats, now), now[2])), lambda stats: dict(zip(SUMS, stats.sum(axis=1))))
    last = _likely(shared(stats, now), now[2])

    def truth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, y, begins, m = _flat(batch)
            v = last(i, y, begins, m) if len(i) else np.empty(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(item))), pa.array(v)], names=[*item, "v"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in labels.select(*item).dtypes)
    truths = items.mapInArrow(truth, f"{kinds}, v double")
    rows = [(a, *map(float, stats[:, k])) for k, a in enumerate(names)]
    return truths, _weights(spark.createDataFrame(rows, "annotator string, " + ", ".join(f"{c} double" for c in SUMS)), now[0], now[1])


def _discover_joined(labels: DataFrame, item: list[str]) -> tuple[DataFrame, DataFrame]:
    """(truths, weights) where the annotators are too many for every executor: by joins; six sums reach the driver a round."""
    first = labels.groupBy(*item).agg(F.avg("y").alias("v"))
    totals = lambda stats: stats.agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in SUMS[1:])).first().asDict()
    truths = lambda stats, now: _truths(labels, _weights(stats, now[0], now[1]), item, now[2])
    settled = _settle(stage(_statistics(labels, first, item)), lambda stats, now: stage(_statistics(labels, truths(stats, now), item)), totals)
    if settled is None:
        return first, _weights(_statistics(labels, first, item), 0.5, 0.5)
    stats, now = settled
    return truths(stats, now), _weights(stats, now[0], now[1])


def discover(df: DataFrame, item: list[str], annotator: str, label: str, at: str, most: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(labels, truths(item, v), weights(annotator, ...)) after the rounds have settled.

    Up to most annotators, who are counted first, their weights are sent to every executor; beyond, they are joined.
    """
    labels = stage(latest_labels(df, item, annotator, label, at))
    names = labels.select(F.col("annotator").cast("string")).distinct().limit(most + 1).collect()
    if 0 < len(names) <= most:
        return labels, *_discover_arrays(labels, sorted(r[0] for r in names), item)
    return labels, *_discover_joined(labels, item)


def consensus(df: DataFrame, item: list[str], annotator: str, label: str, at: str) -> DataFrame:
    """item, consensus, p_include, n_labels, and the share of labels that agree with the consensus."""
    labels, truths, _ = discover(df, item, annotator, label, at)
    counts = labels.groupBy(*item).agg(F.count("*").alias("n_labels"), F.sum("y").alias("yes"))
    include = F.col("v") > 0.5
    return truths.join(counts, item).select(
        *item,
        F.when(include, "include").otherwise("exclude").alias("consensus"),
        F.round("v", 6).alias("p_include"),
        "n_labels",
        F.round(F.when(include, F.col("yes")).otherwise(F.col("n_labels") - F.col("yes")) / F.col("n_labels"), 6).alias("agree"),
    )


def reliability(df: DataFrame, runs: DataFrame, item: list[str], annotator: str, label: str, at: str) -> DataFrame:
    """Per annotator and per run (runs: item, run_id, decision): labels, sensitivity, specificity, confidence, weights."""
    _, truths, weights = discover(df, item, annotator, label, at)
    said = F.when(F.col("decision") == "include", 1.0).when(F.col("decision") == "exclude", 0.0)
    opinions = (
        runs.select(*item, F.col("run_id").alias("annotator"), said.alias("y")).filter("y is not null").groupBy(*item, "annotator").agg(F.max("y").alias("y")).withColumn("m", F.lit(1))
    )
    machine = _weights(_statistics(opinions, truths, item), 0.5, 0.5)
    columns = ["kind", "annotator", F.col("n").cast("bigint").alias("n_labels")] + [
        F.round(c, 6).alias(name)
        for name, c in (("sensitivity", 1 - F.col("miss")), ("specificity", 1 - F.col("false")), ("confidence", F.col("confidence")), ("weight_include", F.col("include")), ("weight_exclude", -F.col("exclude")))
    ]
    both = weights.withColumn("kind", F.lit("rater")).unionByName(machine.withColumn("kind", F.lit("run")))
    return both.select(*columns)


def agreement(df: DataFrame, item: list[str], annotator: str, label: str, at: str) -> DataFrame:
    """One row: items with two labels or more, observed and expected agreement of pairs, Krippendorff's alpha (nominal)."""
    labels = latest_labels(df, item, annotator, label, at)
    per = labels.filter("m > 1").groupBy(*item).agg(F.count("*").alias("m"), F.sum("y").alias("yes"))
    no = F.col("m") - F.col("yes")
    apart = F.sum(2 * F.col("yes") * no / (F.col("m") - 1))
    total, yes = F.sum("m"), F.sum("yes")
    sums = per.agg(F.count("*").alias("n_items"), total.alias("n_labels"), yes.alias("yes"), apart.alias("apart"))
    expected = 2 * F.col("yes") * (F.col("n_labels") - F.col("yes")) / (F.col("n_labels") * (F.col("n_labels") - 1))
    observed = F.try_divide(F.col("apart"), F.col("n_labels"))
    return sums.select(
        "n_items",
        F.coalesce("n_labels", F.lit(0)).alias("n_labels"),
        F.round(1 - observed, 6).alias("observed"),
        F.round(1 - expected, 6).alias("expected"),
        F.round(1 - F.try_divide(observed, expected), 6).alias("alpha"),
    )
