import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftmill.llm import mixing, packing, tokens

SPECS = "spec_id int, capacity_tokens int, separator_tokens int"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=60), st.integers(20, 40))
def test_tree_finds_the_leftmost_container(sizes, capacity):
    room = []
    want = []
    for s in sizes:
        at = next((i for i, r in enumerate(room) if r >= s), len(room))
        if at == len(room):
            room.append(capacity)
        room[at] -= s
        want.append(at)
    assert packing.first_fit(sizes, capacity) == want


def check(placed, items, specs):
    for spec, capacity, gap in specs:
        own = [r for r in placed if r["spec_id"] == spec]
        assert {d: sum(r["tokens"] for r in own if r["doc_id"] == d) for d in {r["doc_id"] for r in own}} == {d: t for d, t in items if t is not None}
        boxes = {}
        for r in own:
            boxes.setdefault((r["grp"], r["container"]), []).append(r)
        for rows in boxes.values():
            assert sum(r["tokens"] for r in rows) + gap * (len(rows) - 1) <= capacity
            assert sorted(r["place"] for r in rows) == list(range(1, len(rows) + 1))
        split = {d for d, t in items if t is not None and t > capacity}
        assert {r["doc_id"] for r in own if r["part"] > 1} == split


def test_packing(spark):
    rng = random.Random(1)
    items = [(i, rng.choice([0, 1, 5, rng.randint(1, 300), 100, 200])) for i in range(3000)] + [(9999, None), (10_000, 100_000)]
    specs = [(1, 100, 0), (2, 257, 3)]
    df = spark.createDataFrame(items, "doc_id long, tokens long").withColumn("grp", F.lit(1)).withColumn("part", F.lit(1))
    placed = packing.pack(df, spark.createDataFrame(specs, SPECS), group_items=1000)
    check(placed.collect(), items, specs)


def test_little_room_is_left(spark):
    rng = random.Random(2)
    items = spark.createDataFrame([(i, rng.randint(1, 120)) for i in range(4000)], "doc_id long, tokens long")
    specs = spark.createDataFrame([(1, 256, 0), (2, 512, 1)], SPECS)
    for r in packing.fill(packing.pack(items, specs, group_items=2000), specs).collect():
        assert r["containers"] <= 1.01 * r["least_containers"] + 2 and r["used"] > 0.98


def test_packing_nothing(spark):
    items = spark.createDataFrame([], "doc_id long, tokens long")
    specs = spark.createDataFrame([(1, 10, 0)], SPECS)
    assert packing.pack(items, specs).count() == 0 and packing.pack(spark.createDataFrame([(1, 5)], items.schema), specs.limit(0)).count() == 0
    one = packing.pack(spark.createDataFrame([(1, 10)], items.schema), specs).collect()
    assert [(r["part"], r["tokens"]) for r in one] == [(1, 10)]


def test_token_counts(spark):
    import tiktoken  # noqa: F401

    with open(tokens.VOCABULARY, "rb") as file:
        encode = tokens.encoder(file.read()).encode_ordinary
    texts = [None, "", "plain words here", "Größe – 第一 <|endoftext|>", "x" * 50_000]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, tokens int")
    got = {r["doc_id"]: r["tokens"] for r in tokens.sized(df, "doc_id", "text", []).collect()}
    assert got == {i: len(encode(t)) for i, t in enumerate(texts) if t is not None}


def test_latest_delivery_counts(spark):
    df = spark.createDataFrame([(1, "one two", "a", 1), (1, "one two three four", "b", 2), (2, "x", None, None)], "doc_id long, text string, source string, fetched_at int")
    got = {r["doc_id"]: r["source"] for r in tokens.sized(df, "doc_id", "text", ["source"], "fetched_at").collect()}
    assert got == {1: "b", 2: None}


def test_rates_are_least_squares():
    size, targets = np.array([100.0, 100.0, 10.0]), np.array([50.0, 80.0, 40.0])
    rates = mixing.fit_rates(size, np.eye(3), np.array([1.0, 3.0, 2.0]), targets, 170.0)
    assert np.allclose(rates * size, [50, 80, 20], atol=1e-4)  # the third is capped
    soft = mixing.fit_rates(np.array([100.0, 100.0]), np.array([[1.0, 0.0], [0.5, 0.5]]), np.array([5.0, 5.0]), np.array([60.0, 30.0]), 90.0)
    assert np.allclose(np.array([[1.0, 0.0], [0.5, 0.5]]).T @ (soft * 100), [60, 30], atol=1e-2)


TARGETS = "mix_id int, source string, target_share double, max_repeats int, budget_frac double"


def documents(spark, n=900):
    rng = random.Random(3)
    kinds = {"alpha": "salt road dust verge winter", "beta": "sleep nurse shift night ward", "gamma": "code churn defect module test"}
    rows = []
    for i in range(n):
        s = rng.choices(list(kinds), [8, 3, 1])[0]
        rows.append((i, " ".join(rng.choice(kinds[s].split()) for _ in range(rng.randint(5, 60))), s))
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), rows


def test_shares_reach_their_targets(spark):
    docs, rows = documents(spark)
    sized = tokens.sized(docs, "doc_id", "text", ["source"])
    targets = spark.createDataFrame([(1, "alpha", 0.5, 1, 0.4), (1, "beta", 0.3, 2, 0.4), (1, "gamma", 0.2, 3, 0.4), (2, "gamma", 1.0, 2, 0.9), (3, "missing", 1.0, 1, 0.5)], TARGETS)
    chosen = mixing.mix(docs, sized, targets)
    got = {(r["mix_id"], r["source"]): r for r in mixing.shares(chosen, sized, targets).collect()}
    for s, want in (("alpha", 0.5), ("beta", 0.3), ("gamma", 0.2)):
        assert abs(got[1, s]["share"] - want) < 0.005
    assert got[2, "gamma"]["most_repeats"] == 2 and got[2, "gamma"]["tokens"] == 2 * sized.filter("source = 'gamma'").agg(F.sum("tokens")).first()[0]
    assert got[3, "missing"]["tokens"] == 0
    caps = {(r["mix_id"], r["source"]): r["max_repeats"] for r in targets.collect()}
    assert all(r["repeats"] <= caps[r["mix_id"], r["domain"]] for r in chosen.collect())


def test_unlabelled_documents_join_by_their_posteriors(spark):
    docs, rows = documents(spark)
    hidden = docs.withColumn("source", F.when(F.col("doc_id") % 5 == 0, F.lit(" ")).otherwise(F.col("source")))
    model = mixing.train(hidden, "source", "text", "doc_id")
    held = [(t, s) for i, t, s in rows if i % 5 == 0]
    assert np.mean([model.domains[model.posteriors(t).argmax()] == s for t, s in held]) > 0.9
    sized = tokens.sized(hidden, "doc_id", "text", ["source"])
    targets = spark.createDataFrame([(1, "alpha", 0.4, 1, 0.3), (1, "beta", 0.4, 2, 0.3), (1, "gamma", 0.2, 4, 0.3)], TARGETS)
    chosen = mixing.mix(hidden, sized, targets)
    true = {i: s for i, _, s in rows}
    got = {}
    for r in chosen.collect():
        got[true[r["doc_id"]]] = got.get(true[r["doc_id"]], 0) + r["tokens"] * r["repeats"]
    total = sum(got.values())
    assert abs(got["alpha"] / total - 0.4) < 0.06 and chosen.filter("domain is null").count() > 0


@pytest.mark.parametrize("part", ["documents", "targets"])
def test_mixing_nothing(spark, part):
    docs, _ = documents(spark, 20)
    targets = spark.createDataFrame([(1, "alpha", 1.0, 1, 0.5)], TARGETS)
    docs, targets = (docs.limit(0), targets) if part == "documents" else (docs, targets.limit(0))
    sized = tokens.sized(docs, "doc_id", "text", ["source"])
    assert mixing.mix(docs, sized, targets).count() == 0
