"""Vectors: moments, projections on principal axes, nearest rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def moments(vectors: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, scatter about it): partial sums per partition; what reaches the driver is one matrix per partition."""

    def run(batches):
        n, first, second = 0, None, None
        for batch in batches:
            x = np.stack(batch["v"].to_numpy()).astype(np.float64)
            n += len(x)
            first = x.sum(0) if first is None else first + x.sum(0)
            second = x.T @ x if second is None else second + x.T @ x
        if n:
            yield pd.DataFrame({"i": np.arange(len(first)), "n": n, "first": first, "second": list(second)})

    parts = vectors.select(F.col(vector).alias("v")).filter("v is not null").mapInPandas(run, "i int, n bigint, first double, second array<double>")
    dim = len(vectors.select(vector).first()[0])
    rows = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("first").alias("first"), F.array(*(F.sum(F.col("second")[j]) for j in range(dim))).alias("second")).orderBy("i").collect()
    n = rows[0]["n"]
    mean = np.array([r["first"] for r in rows]) / n
    return n, mean, np.array([r["second"] for r in rows]) - n * np.outer(mean, mean)


def semantic_map(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """key, x, y: centred vectors on their two principal axes, and the share of variance the axes explain.

    Each axis points where its largest loading is positive. Needs three rows or more.
    """
    n, mean, scatter = moments(vectors, vector)
    if n < 3:
        raise ValueError("a map needs three vectors or more")
    values, axes = np.linalg.eigh(scatter)
    top = axes[:, ::-1][:, :2]
    top = top * np.sign(top[np.abs(top).argmax(0), [0, 1]])
    explained = float(values[::-1][:2].sum() / values.sum())

    def project(batches):
        for batch in batches:
            at = (np.stack(batch["v"].to_numpy()).astype(np.float64) - mean) @ top
            yield pd.DataFrame({key: batch[key], "x": at[:, 0].round(6), "y": at[:, 1].round(6), "explained": round(explained, 6)})

    kind = dict(vectors.dtypes)[key]
    return vectors.select(key, F.col(vector).alias("v")).filter("v is not null").mapInPandas(project, f"{key} {kind}, x double, y double, explained double")
