import datetime as dt
import random

from siftmill.llm import consensus as C

SCHEMA = "review string, work_id string, rater_id string, human_decision string, created_at timestamp"
ARGS = (["review", "work_id"], "rater_id", "human_decision", "created_at")


def frame(spark, rows):
    base = dt.datetime(2026, 1, 1)
    return spark.createDataFrame([("r", w, a, y, base + dt.timedelta(minutes=t)) for w, a, y, t in rows], SCHEMA)


def simulated(seed, items=400):
    """Good raters, one who is always wrong, one who always excludes, guessers, and a long tail with a label or two."""
    rng = random.Random(seed)
    truth = {f"W{i:03d}": rng.random() < 0.3 for i in range(items)}
    skill = {"good1": 0.9, "good2": 0.88, "good3": 0.85, "liar": 0.1, "coin": 0.5, "coin2": 0.55}
    rows = []
    for w, t in truth.items():
        for a in rng.sample(sorted(skill), 4):
            y = t if rng.random() < skill[a] else not t
            rows.append((w, a, "include" if y else "exclude", 0))
        rows.append((w, "never", "exclude", 0))
        if rng.random() < 0.2:
            rows.append((w, f"tail{rng.randrange(60)}", "include" if (t if rng.random() < 0.75 else not t) else "exclude", 0))
    return truth, rows


def brute_force(rows):
    """Likelier labels by expectation maximisation with class-wise error rates."""
    import math

    items = {}
    for w, a, y, _ in rows:
        items.setdefault(w, []).append((a, y == "include"))
    v = {w: sum(y for _, y in said) / len(said) for w, said in items.items()}
    for _ in range(100):
        p = sum(v.values()) / len(v)
        sums = {}
        for w, said in items.items():
            for a, y in said:
                s = sums.setdefault(a, [0.5, 1, 0.5, 1])
                s[0] += v[w] * y
                s[1] += v[w]
                s[2] += (1 - v[w]) * y
                s[3] += 1 - v[w]
        for w, said in items.items():
            odds = math.log(p / (1 - p))
            for a, y in said:
                s = sums[a]
                one, zero = s[0] / s[1], s[2] / s[3]
                odds += math.log(one / zero) if y else math.log((1 - one) / (1 - zero))
            v[w] = 1 / (1 + math.exp(-odds))
    return {w: x > 0.5 for w, x in v.items()}


def test_consensus_is_the_likelier_label(spark):
    truth, rows = simulated(1)
    got = {r["work_id"]: r["consensus"] == "include" for r in C.consensus(frame(spark, rows), *ARGS).collect()}
    likelier = brute_force(rows)
    assert sum(got[w] != likelier[w] for w in got) <= 0.02 * len(got)
    votes = {w: sum(1 if y == "include" else -1 for x, _, y, _ in rows if x == w) > 0 for w in truth}
    assert sum(got[w] == t for w, t in truth.items()) > sum(votes[w] == t for w, t in truth.items())


def test_reliability(spark):
    truth, rows = simulated(2)
    runs = spark.createDataFrame([("r", w, "run", "include" if t else "exclude") for w, t in truth.items()] + [("r", "W000", "run", "error")], "review string, work_id string, run_id string, decision string")
    got = {r["annotator"]: r for r in C.reliability(frame(spark, rows), runs, *ARGS).collect()}
    assert got["good1"]["sensitivity"] > 0.8 and got["liar"]["weight_include"] < 0 and abs(got["never"]["weight_exclude"]) < 0.2
    assert got["run"]["kind"] == "run" and got["run"]["sensitivity"] > 0.8
    assert min(got[a]["confidence"] for a in got if not a.startswith("tail")) > max(got[a]["confidence"] for a in got if a.startswith("tail"))


def test_which_labels_count(spark):
    rows = [("W1", "a", "include", 0), ("W1", "a", " EXCLUDE ", 5), ("W1", "a", "unsure", 9), ("W1", "a", None, 10), ("W1", "a", "", 11), ("W1", "b", "Include", 1), ("W1", "b", "Include", 1), ("W2", None, "include", 0), ("W3", "a", "unsure", 0)]
    got = {(r["work_id"], r["annotator"]): (r["y"], r["m"]) for r in C.latest_labels(frame(spark, rows), *ARGS).collect()}
    assert got == {("W1", "a"): (0.0, 2), ("W1", "b"): (1.0, 2)}


def test_ties_empty_and_clashing_columns(spark):
    tie = frame(spark, [("W1", "a", "include", 3), ("W1", "a", "exclude", 3)])
    assert C.latest_labels(tie, *ARGS).first()["y"] == 1.0
    empty = tie.limit(0)
    assert C.consensus(empty, *ARGS).count() == 0 and C.agreement(empty, *ARGS).first()["n_items"] == 0
    from pyspark.sql import functions as F

    extra = tie.withColumn("y", F.lit(9)).withColumn("m", F.lit(9)).withColumn("annotator", F.lit("z")).withColumn("v", F.lit(0)).withColumn("at", F.lit(0))
    assert C.consensus(extra, *ARGS).count() == 1


def test_agreement_by_hand(spark):
    rows = [("W1", "a", "include", 0), ("W1", "b", "include", 0), ("W2", "a", "exclude", 0), ("W2", "b", "include", 0), ("W3", "a", "exclude", 0)]
    r = C.agreement(frame(spark, rows), *ARGS).first()
    assert (r["n_items"], r["n_labels"], r["observed"], r["expected"], r["alpha"]) == (2, 4, 0.5, 0.5, 0.0)


def test_joins_and_arrays_agree(spark):
    _, rows = simulated(5, 120)
    df = frame(spark, rows)
    few, many = C.discover(df, *ARGS), C.discover(df, *ARGS, most=3)
    for a, b, keys in ((few[1], many[1], ["review", "work_id"]), (few[2], many[2], ["annotator"])):
        one, other = ({tuple(r[k] for k in keys): r for r in x.collect()} for x in (a, b))
        assert one.keys() == other.keys()
        assert all(abs(one[k][c] - other[k][c]) < 1e-6 for k in one for c in a.columns if c not in keys)
