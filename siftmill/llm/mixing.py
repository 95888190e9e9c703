"""Mixing sources to target weights: domain memberships, least-squares rates, whole repeats.

Every document has a membership vector over domains (sources). A labelled document's is its label; for one without a label
a naive Bayes classifier, trained on a bounded sample of the labelled ones, predicts the posteriors. Documents of like
membership form a unit: a source, or one of a bounded number of profiles (first and second domain, posterior in eighths).
Projected gradient steps fit nonnegative rates per unit, at most the repeat caps, whose expected tokens per domain are
nearest to the targets (share times budget) in least squares. A rate becomes whole repeats by taking every
document of the unit floor(rate) times and, in a hash order, so many once more that the unit's tokens are met.

Cases: a null or blank source is no label; domains outside a mix are not used in it; a domain without documents stays at 0;
a source whose cap does not allow its target is taken as often as allowed, and the mix is smaller by what lacks; empty tables give empty mixes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmill.session import stage

#: Labelled documents per source that the classifier learns from; buckets of its features.
SAMPLE, FEATURES = 150, 4096
#: Most gradient steps; weight of the whole budget against the domains' totals (above 0, room that capped sources leave is
#: filled by the others, which moves the shares away from their targets).
STEPS, BUDGET_WEIGHT = 4000, 0.0
#: Parts of a unit in which documents are put in order.
PARTS = 256
_WORD = re.compile(r"[^\W\d_]+|\d+|[{}\[\]*\"#|-]")


def features(text: str) -> np.ndarray:
    """Counts of a text's words and marks in FEATURES buckets, damped."""
    import xxhash

    at = [xxhash.xxh32_intdigest(w) % FEATURES for w in _WORD.findall(text.lower())]
    return np.log1p(np.bincount(at, minlength=FEATURES)).astype(np.float32)


class Classifier:
    """Multinomial naive Bayes over domains."""

    def __init__(self, domains: list[str], counts: np.ndarray, priors: np.ndarray):
        self.domains = domains
        smoothed = counts + 0.1
        self.log = np.log(smoothed / smoothed.sum(axis=1, keepdims=True))
        self.priors = np.log((priors + 1) / (priors + 1).sum())

    def posteriors(self, text: str) -> np.ndarray:
        x = features(text)
        score = self.log @ x / max(1.0, np.sqrt(x.sum())) + self.priors
        score = np.exp(score - score.max())
        return score / score.sum()


def is_label(source: Column) -> Column:
    return source.isNotNull() & (F.trim(source) != "")


def train(df: DataFrame, source: str, text: str, key: str) -> Classifier | None:
    """The classifier of a sample of at most SAMPLE documents per source, taken by hash; priors from all documents."""
    labelled = df.filter(is_label(F.col(source))).select(F.col(source).alias("domain"), text, F.xxhash64(F.lit("sample"), key).alias("h"))
    priors = {r["domain"]: r["count"] for r in labelled.groupBy("domain").count().collect()}
    if not priors:
        return None
    domains = sorted(priors)
    # first within parts of a source, so that a hot one is not one task
    part = W.partitionBy("domain", F.pmod("h", F.lit(64))).orderBy("h")
    whole = W.partitionBy("domain").orderBy("h")
    sample = labelled.withColumn("k", F.row_number().over(part)).filter(F.col("k") <= SAMPLE).withColumn("k", F.row_number().over(whole)).filter(F.col("k") <= SAMPLE)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for domain, value in zip(batch["domain"], batch["text"]):
                if value:
                    totals[domain] = totals.get(domain, 0) + features(value)
        yield pd.DataFrame({"domain": list(totals), "x": [v.tolist() for v in totals.values()]}, columns=["domain", "x"])

    rows = sample.select("domain", F.col(text).alias("text")).mapInPandas(count, "domain string, x array<float>").collect()
    counts = np.zeros((len(domains), FEATURES))
    for r in rows:
        counts[domains.index(r["domain"])] += np.array(r["x"])
    return Classifier(domains, counts, np.array([priors[d] for d in domains], dtype=float))


def profiles(df: DataFrame, key: str, text: str, model: Classifier) -> DataFrame:
    """key, profile and posteriors (array in the order of the model's domains) of unlabelled documents."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.StructType([T.StructField("profile", T.StringType()), T.StructField("p", T.ArrayType(T.FloatType()))]))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            names, ps = [], []
            for t in texts:
                p = m.posteriors(t or "")
                first, second = np.argsort(-p, kind="stable")[:2] if len(p) > 1 else (0, 0)
                names.append(f"?{m.domains[first]}|{m.domains[second]}|{int(p[first] * 8)}")
                ps.append(p.astype(np.float32).tolist())
            yield pd.DataFrame({"profile": names, "p": ps})

    return df.select(key, run(F.col(text)).alias("r")).select(key, "r.profile", "r.p")


def fit_rates(tokens: np.ndarray, membership: np.ndarray, caps: np.ndarray, targets: np.ndarray, budget: float) -> np.ndarray:
    """Rates per unit in 0..caps by projected gradient on sum((x - targets)^2) + BUDGET_WEIGHT (sum(x) - budget)^2.

    x = membership' (rates * tokens) are the expected tokens per domain. Steps are scaled by each unit's share of its
    domains, so that units of one domain move alike.
    """
    size = max(budget, 1.0)
    mass = np.maximum(membership.T @ tokens, 1e-9) / size
    scale = tokens / size
    rates = np.zeros(len(tokens))
    step = 1.0 / (1.0 + BUDGET_WEIGHT * len(targets))
    inverse = membership / mass
    for _ in range(STEPS):
        x = membership.T @ (rates * scale)
        pull = (x - targets / size) + BUDGET_WEIGHT * (x.sum() - budget / size)
        new = np.clip(rates - step * (inverse @ pull), 0.0, caps)
        if np.abs((new - rates) * scale).max(initial=0.0) < 1e-10:
            return new
        rates = new
    return rates


def mix(documents: DataFrame, sized: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """mix_id, key, unit, domain, tokens, repeats of every document chosen.

    sized has key, source and tokens. targets (mix_id, source, target_share, max_repeats, budget_frac) is a given table of
    a row per mix and source; units are as many and a bounded number of profiles, so the rates are fitted on the driver.
    """
    spark = documents.sparkSession
    wanted = [r.asDict() for r in targets.distinct().collect()]
    labelled = sized.filter(is_label(F.col(source))).select(key, F.col(source).alias("unit"), F.col(source).alias("domain"), "tokens")
    open_ones = sized.filter(~is_label(F.col(source)))
    units: list[tuple[str, str, float, np.ndarray | None]] = []
    domains: list[str] = sorted({r["source"] for r in wanted if r["source"] is not None})
    if open_ones.limit(1).count():
        model = train(documents, source, text, key)
        if model is not None:
            found = stage(profiles(documents.filter(~is_label(F.col(source))), key, text, model).dropDuplicates([key]))
            guessed = found.join(open_ones.select(key, "tokens"), key)
            n = len(model.domains)
            sums = guessed.groupBy("profile").agg(F.sum("tokens").alias("tokens"), F.array(*(F.sum(F.col("p")[i] * F.col("tokens")) for i in range(n))).alias("mass"))
            for r in sums.collect():
                share = dict(zip(model.domains, np.array(r["mass"]) / max(r["tokens"], 1)))
                units.append((r["profile"], "?", float(r["tokens"]), np.array([share.get(d, 0.0) for d in domains])))
            labelled = labelled.unionByName(guessed.select(key, F.col("profile").alias("unit"), F.lit(None).cast("string").alias("domain"), "tokens"))
    totals = {r["unit"]: float(r["tokens"]) for r in labelled.filter(F.col("domain").isin(domains)).groupBy("unit").agg(F.sum("tokens").alias("tokens")).collect()}
    everything = float(sized.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()["t"])
    for d in domains:
        if totals.get(d):
            units.append((d, d, totals[d], np.array([1.0 if x == d else 0.0 for x in domains])))
    plan = []
    for mix_id in sorted({r["mix_id"] for r in wanted}):
        own = {r["source"]: r for r in wanted if r["mix_id"] == mix_id}
        names = [d for d in domains if d in own]
        at = [domains.index(d) for d in names]
        budget = everything * next(iter(own.values()))["budget_frac"]
        mine = [(name, kind, tokens, p[at]) for name, kind, tokens, p in units if p[at].sum() > 0.5]
        if not mine:
            continue
        caps = np.array([float(own[k]["max_repeats"]) if k != "?" else float(min(own[names[i]]["max_repeats"] for i in np.flatnonzero(p > 0.05))) for _, k, _, p in mine])
        rates = fit_rates(
            np.array([u[2] for u in mine]), np.array([u[3] for u in mine]), caps, np.array([own[d]["target_share"] * budget for d in names]), budget
        )
        plan += [(int(mix_id), u[0], float(rate), int(cap), float(rate * u[2])) for u, rate, cap in zip(mine, rates, caps) if rate > 0]
    chosen = spark.createDataFrame(plan, "mix_id int, unit string, rate double, cap int, wanted double")
    return _whole_repeats(labelled, chosen, key)


def _whole_repeats(members: DataFrame, plan: DataFrame, key: str) -> DataFrame:
    """floor(rate) repeats of every member, and once more in hash order as long as the unit's tokens are not met."""
    h = F.xxhash64(F.lit("order"), F.col(key), F.col("mix_id"))
    rows = members.join(F.broadcast(plan), "unit").withColumn("h", h).withColumn("part", F.pmod("h", F.lit(PARTS)).cast("int"))
    parts = rows.groupBy("mix_id", "unit", "part").agg(F.sum("tokens").alias("sum"))
    order = W.partitionBy("mix_id", "unit").orderBy("part")
    offsets = parts.select("mix_id", "unit", "part", (F.sum("sum").over(order) - F.col("sum")).alias("offset"), F.sum("sum").over(W.partitionBy("mix_id", "unit")).alias("total"))
    inside = W.partitionBy("mix_id", "unit", "part").orderBy("h", key)
    placed = rows.join(offsets, ["mix_id", "unit", "part"]).withColumn("before", F.col("offset") + F.sum("tokens").over(inside) - F.col("tokens"))
    base = F.floor(F.col("rate") + 1e-9)
    more = F.col("wanted") - base * F.col("total")
    once = F.when((F.col("before") + F.col("tokens") / 2 <= more) & (base < F.col("cap")), 1).otherwise(0)
    return placed.withColumn("repeats", (base + once).cast("int")).filter("repeats > 0").select("mix_id", key, "unit", "domain", "tokens", "repeats")


def shares(chosen: DataFrame, sized: DataFrame, targets: DataFrame, source: str = "source") -> DataFrame:
    """Per mix and source: target and actual tokens and shares, and how often the source was used on average."""
    got = chosen.filter("domain is not null").groupBy("mix_id", F.col("domain").alias(source)).agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    all_tokens = sized.agg(F.sum("tokens").alias("corpus_tokens"))
    total = chosen.groupBy("mix_id").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("mix_tokens"))
    return (
        targets.join(got, ["mix_id", source], "left")
        .join(total, "mix_id", "left")
        .crossJoin(F.broadcast(all_tokens))
        .select(
            "mix_id",
            source,
            "target_share",
            F.round(F.coalesce(F.col("tokens"), F.lit(0)) / F.col("mix_tokens"), 6).alias("share"),
            F.coalesce("tokens", F.lit(0)).alias("tokens"),
            F.round(F.col("target_share") * F.col("budget_frac") * F.col("corpus_tokens"), 1).alias("target_tokens"),
            "max_repeats",
            F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
            "mix_tokens",
            F.round(F.col("budget_frac") * F.col("corpus_tokens"), 1).alias("budget_tokens"),
        )
    )
