import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from siftmill.llm import neardup as N


def runs(text, size):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute(rows, t, size):
    sets = [(i, runs(x, size)) for i, x in rows]
    return {tuple(sorted((a, b))) for (a, x), (b, y) in combinations(sets, 2) if a != b and x and y and len(x & y) / len(x | y) >= t}


def corpus(seed, groups=25):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(120)]
    rows = []
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 60))]
        for k in range(rng.randint(1, 4)):
            words = list(base)
            for _ in range(rng.randint(0, 8)):
                at = rng.randrange(len(words))
                words[at : at + rng.randint(0, 2)] = [rng.choice(vocabulary)]
            rows.append((f"D{g:02d}-{k}", " ".join(words)))
    return rows


@pytest.mark.parametrize(("seed", "t", "size"), [(1, "0.45", 3), (2, "0.8", 5), (3, "0.3", 2)])
def test_all_pairs_of_brute_force(spark, seed, t, size):
    rows = corpus(seed) + [("copy", corpus(seed)[0][1]), ("copy2", corpus(seed)[0][1])]
    df = spark.createDataFrame(rows, "id string, text string")
    got = {(r["a"], r["b"]) for r in N.duplicate_pairs(df, "id", F.col("text"), t, size).collect()}
    assert got == brute(rows, float(t), size)


def test_near_duplicate_classes(spark):
    rows = corpus(4)
    members, links = N.near_duplicates(spark.createDataFrame(rows, "id string, text string"), "id", F.col("text"), "0.45", 3)
    assert members.count() == sum(1 for _, x in rows if runs(x, 3))
    assert links.filter("ca >= cb").count() == 0


def test_hot_shingles_and_copies(spark):
    shared = "alpha beta gamma delta epsilon zeta eta theta"
    rows = [(f"A{i}", f"{shared} tail{i} end{i} more{i} last{i}") for i in range(40)] + [(f"B{i}", "one two three four five six") for i in range(30)]
    got = {(r["a"], r["b"]) for r in N.duplicate_pairs(spark.createDataFrame(rows, "id string, text string"), "id", F.col("text"), "0.45", 3).collect()}
    assert got == brute(rows, 0.45, 3)


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [("a", "the same few words stand here", 1), ("a", "the same few words stand here", 1), ("b", "The same, few words stand here!", 2), ("c", None, 3), ("d", "", 4), ("e", "two words", None), ("f", "word " * 100_000, 5)]
    df = spark.createDataFrame(rows, "id string, text string, cid int").withColumn("sh", F.lit(1)).withColumn("doc", F.lit("x"))
    got = {(r["a"], r["b"]) for r in N.duplicate_pairs(df, "id", F.col("text"), "0.45", 3).collect()}
    assert got == {("a", "b")}
    assert N.duplicate_pairs(df.limit(0), "id", F.col("text"), "0.45", 3).count() == 0
