"""Shapes that must hold for hot groups: no window over a whole review, run or key in the ranking queries."""

import random

from pyspark.sql import functions as F

from siftmill.operators import ranking as R


def test_positions_are_row_numbers_of_hot_and_small_groups(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"g{i % 7}", i, rng.choice([None, rng.randint(0, 40)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, id int, x int")
    got = {(r["g"], r["id"]): r["rank"] for r in R.positions(df, ["g"], [F.col("x").desc_nulls_last(), F.col("id").asc()]).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2] is None, -(r[2] or 0), r[1]))
        want |= {(g, r[1]): k for k, r in enumerate(own, 1)}
    assert got == want
    assert R.positions(df.limit(0), ["g"], [F.col("id").asc()]).count() == 0


def test_running_sums_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 7)
    rows = [("r", f"W{i:03d}", i + 1, int(i % 5 == 0)) for i in range(100)]
    df = spark.createDataFrame(rows, "review string, work_id string, rank int, label_included int")
    found = {r["work_id"]: (r["rank"], r["found"]) for r in R._found(df, df.drop("rank"), "work_id", ["review"]).collect()}
    assert found == {f"W{i:03d}": (i + 1, i // 5 + 1) for i in range(100)}
