"""Ranking of records within their reviews: lexical, random, dense, fused, re-ranked, and what a ranking is worth.

Corpus statistics are those of a review, never of all. Every order ends in the record's id. A limit of None or 0 is none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmill.functions.porter import stems
from siftmill.functions.text import held, query_terms, source_text, words
from siftmill.session import broadcast_if_small, stage

K1, B = 1.2, 0.75
#: Rank constant of reciprocal rank fusion; rows that a re-ranker scores.
RRF_K, RERANKED = 60, 200


def row_no(window) -> Column:
    """Position in a window from 1, as a long."""
    return F.row_number().over(window).cast("bigint")


def positions(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """df with each row's position in its group, however large the group: ranges of the order are numbered apart, then put
    behind each other. The order must be total."""
    ranged = stage(df.repartitionByRange(*(F.col(c) for c in by), *order).withColumn("_p", F.spark_partition_id()))
    counts = ranged.groupBy(*by, "_p").agg(F.count("*").alias("_n"))
    before = counts.select(*by, "_p", (F.sum("_n").over(W.partitionBy(*by).orderBy("_p")) - F.col("_n")).alias("_b"))
    inside = ranged.withColumn(name, row_no(W.partitionBy(*by, "_p").orderBy(*order)))
    return inside.join(before, [*by, "_p"]).withColumn(name, F.col(name) + F.col("_b")).drop("_p", "_b")


def limited(ranked: DataFrame, limit: int | None) -> DataFrame:
    """The first limit ranks of every review."""
    return ranked.filter(F.col("rank") <= limit) if limit else ranked


#: Reviews whose questions and statistics are sent to every executor at most.
REVIEWS = 5_000


def _asked_words(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """review, raw (words of the collection whose stem is a term), of (their stems): only different words go to Python."""
    vocabulary = docs.select(F.explode("words").alias("word")).distinct()
    stemmed = vocabulary.select("word", F.element_at(stems(F.array("word")), 1).alias("term"))
    known = asked.select("review", F.explode(F.array_distinct("terms")).alias("term")).join(stemmed, "term")
    return known.groupBy("review").agg(F.collect_list("word").alias("raw"), F.map_from_entries(F.collect_list(F.struct("word", "term"))).alias("of"))


def bm25(works: DataFrame, questions: DataFrame, stemmed: bool = False, limit: int | None = None) -> DataFrame:
    """review, work_id, score, rank: all records of the reviews with a question, the best first, unmatched last by id.

    questions: (review, question). A record's words are those of title and abstract together; a term in more than half of
    the records has a weight of 1e-6. Texts are read once and not shuffled: each record keeps the counts of its review's
    terms, from which the review's statistics are taken and, sent back, its score.
    """
    asked = questions.select("review", query_terms(F.col("question")).alias("terms"))
    if stemmed:  # terms with one stem count once each
        asked = asked.select("review", stems(F.col("terms")).alias("terms"))
    # what is sent to every executor has a row per review: one count tells for all of it
    sent = F.broadcast if asked.limit(REVIEWS + 1).count() <= REVIEWS else lambda df: df
    asked = sent(asked)
    docs = held(works.join(asked.select("review"), "review", "left_semi").select("review", "work_id", F.concat_ws(" ", "title", "abstract").alias("text")), "words", words(F.col("text")))
    times = lambda known: F.transform(known, lambda w: F.struct(w.alias("term"), (F.size("words") - F.size(F.array_remove("words", w))).alias("tf")))
    if stemmed:
        docs = stage(docs.drop("text"))
        raw = sent(_asked_words(docs, asked))
        found = stage(docs.join(raw, "review", "left").select("review", "work_id", F.size("words").alias("size"), F.transform(times(F.array_intersect("words", "raw")), lambda t: F.struct(F.element_at("of", t["term"]).alias("term"), t["tf"].alias("tf"))).alias("all")))
        one = lambda term: F.struct(term.alias("term"), F.aggregate("all", F.lit(0), lambda s, t: s + F.when(t["term"] == term, t["tf"]).otherwise(0)).alias("tf"))
        rows = found.select("review", "work_id", "size", F.coalesce(F.transform(F.array_distinct("all.term"), one), F.array()).alias("tfs"))
    else:
        rows = stage(docs.join(asked, "review").select("review", "work_id", F.size("words").alias("size"), times(F.array_intersect("words", "terms")).alias("tfs")))
    totals = rows.groupBy("review").agg(F.count("*").alias("n"), F.avg("size").alias("mean"))
    df = rows.select("review", F.explode("tfs.term").alias("term")).groupBy("review", "term").agg(F.count("*").alias("df"))
    wanted = asked.select("review", F.explode("terms").alias("term")).groupBy("review", "term").agg(F.count("*").alias("times"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = df.join(wanted, ["review", "term"]).join(totals, "review").select("review", "term", (F.when(idf <= 0, 1e-6).otherwise(idf) * F.col("times")).alias("w"))
    each = weighed.groupBy("review").agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("weights"))
    stats = sent(totals.join(each, "review", "left").select("review", "mean", "weights"))
    shape = K1 * (1 - B + B * F.col("size") / F.col("mean"))
    score = F.aggregate("tfs", F.lit(0.0), lambda s, t: s + F.element_at("weights", t["term"]) * t["tf"] * (K1 + 1) / (t["tf"] + shape))
    ranked = rows.join(stats, "review").select("review", "work_id", F.when(F.size("tfs") > 0, F.round(score, 9)).alias("score"))
    return limited(positions(ranked, ["review"], [F.col("score").desc_nulls_last(), F.col("work_id").asc()]), limit)


def random_rank(works: DataFrame, seed: int = 42, limit: int | None = None) -> DataFrame:
    """review, work_id, rank in an order that depends on the seed and the ids only."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("work_id")))
    keyed = works.select("review", "work_id", key.alias("key"))
    return limited(positions(keyed, ["review"], [F.col("key").asc(), F.col("work_id").asc()]).drop("key"), limit)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def dense_rank(vectors: DataFrame, query: DataFrame, key: str = "vec_id", vector: str = "embedding", limit: int | None = None) -> DataFrame:
    """review, key, score, rank by cosine with the review's query vector; query: (review, query_vector), a row per review."""
    scored = vectors.join(broadcast_if_small(query, REVIEWS), "review").select("review", key, F.round(cosine(F.col(vector), F.col("query_vector")), 9).alias("score"))
    return limited(positions(scored, ["review"], [F.col("score").desc(), F.col(key).asc()]), limit)


#: Places of the vectors made from words.
PLACES = 64


@lru_cache(maxsize=200_000)
def _place(word: str) -> int:
    return int(hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()[:4], 16) % PLACES


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def hashed_vector(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Counts of words in PLACES hashed places: a vector of a text where no model is at hand."""
    for many in batches:
        yield many.map(lambda ws: None if ws is None else np.bincount(list(map(_place, ws)), minlength=PLACES).astype(float).tolist() if len(ws) else [0.0] * PLACES)


def text_vectors(texts: DataFrame, keys: list[str], text: Column, name: str = "embedding") -> DataFrame:
    """keys and the hashed vector of each text's words."""
    return texts.select(*keys, hashed_vector(words(text)).alias(name))


def remembered_vectors(texts: DataFrame, keys: list[str], text: Column, folder: str) -> DataFrame:
    """Vectors from the table below folder, if it was made of these very texts, else made anew and kept there.

    The table stands under the hash of all ids and texts, so that vectors of another corpus are never taken for these.
    """
    spark = texts.sparkSession
    row = F.xxhash64(*keys, F.coalesce(text, F.lit("None")))
    print_ = texts.select(row.alias("h")).agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.pmod("h", F.lit(1_000_003))).alias("s")).first()
    path = f"{folder.rstrip('/')}/vectors-{hashlib.sha256(repr(tuple(print_)).encode()).hexdigest()[:32]}"
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
        text_vectors(texts, keys, text).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def dense(works: DataFrame, questions: DataFrame, limit: int | None = None) -> DataFrame:
    """All records of the reviews with a question by the cosine of their vectors with the question's."""
    query = text_vectors(questions, ["review"], F.col("question"), "query_vector")
    return dense_rank(text_vectors(works, ["review", "work_id"], source_text(F.col("title"), F.col("abstract"))), query, "work_id", limit=limit)


def hybrid(works: DataFrame, questions: DataFrame, limit: int | None = None) -> DataFrame:
    """The dense and the lexical ranking fused; records without a term count with their place by id."""
    return fuse([dense(works, questions), bm25(works, questions)], limit=limit)


def fuse(rankings: list[DataFrame], key: str = "work_id", k: int = RRF_K, limit: int | None = None) -> DataFrame:
    """review, key, score, rank: the sum of 1 / (k + rank) over the rankings."""
    union = rankings[0].select("review", key, "rank")
    for other in rankings[1:]:
        union = union.unionByName(other.select("review", key, "rank"))
    scores = union.groupBy("review", key).agg(F.round(F.sum(1 / (k + F.col("rank"))), 12).alias("score"))
    return limited(positions(scores, ["review"], [F.col("score").desc(), F.col(key).asc()]), limit)


def rerank(ranked: DataFrame, scores: DataFrame, key: str = "work_id", top: int = RERANKED, limit: int | None = None) -> DataFrame:
    """The first top ranks of every review in the order of an external score, the tail unchanged."""
    joined = ranked.select("review", key, "rank").join(scores.select("review", key, F.col("score").alias("external")), ["review", key], "left")
    # only the head is put in a new order
    head = joined.filter(F.col("rank") <= top)
    order = W.partitionBy("review").orderBy(-F.coalesce("external", F.lit(0.0)), "rank")
    moved = head.select("review", key, F.col("rank").alias("old_rank"), row_no(order).alias("rank"))
    rest = joined.filter(F.col("rank") > top).select("review", key, F.col("rank").alias("old_rank"), "rank")
    return limited(moved.unionByName(rest), limit)


def rank(strategy: str, works: DataFrame, *, seed: int = 42, questions: DataFrame | None = None, scores: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """One ranking by the name of its strategy: random, bm25, dense, hybrid, or rerank (hybrid, its head by external scores)."""
    if strategy == "random":
        return random_rank(works, seed, limit)
    made = {"bm25": bm25, "dense": dense, "hybrid": hybrid}
    if strategy not in (*made, "rerank"):
        raise ValueError(f"unknown strategy: {strategy}")
    if questions is None:
        raise ValueError(f"{strategy} needs questions")
    if strategy == "rerank":
        if scores is None:
            raise ValueError("rerank needs scores")
        return rerank(hybrid(works, questions), scores, limit=limit)
    return made[strategy](works, questions, limit=limit)


def one_record(works: DataFrame, by: list[str], seed: int | None = None, key: str = "work_id") -> DataFrame:
    """One record of each group: the first by id, or with a seed the first in hash order."""
    order = F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key))), F.col(key)) if seed is not None else F.struct(key)
    return works.groupBy(*by).agg(F.min_by(F.struct(*(c for c in works.columns if c not in by)), order).alias("r")).select(*by, "r.*")


def fetched(ranked: DataFrame, rows: DataFrame, key: str = "work_id") -> DataFrame:
    """The rows of a ranking's records, with their ranks."""
    return ranked.select("review", key, "rank").join(rows, ["review", key])


def rank_rows(rows: DataFrame, by: list[str], order: list[Column], key: str = "work_id") -> DataFrame:
    """by, key and rank in an order that the key makes total."""
    named = rows.select(*by, key, *(c.alias(f"_o{i}") for i, c in enumerate(order)))
    return positions(named, by, [*(F.col(f"_o{i}").asc() for i in range(len(order))), F.col(key).asc()]).select(*by, key, "rank")


def append_rest(ranked: DataFrame, works: DataFrame, key: str = "work_id") -> DataFrame:
    """A partial ranking followed by the review's other records in the order of their ids."""
    joined = works.select("review", key).join(ranked.select("review", key, F.col("rank").alias("was")), ["review", key], "left")
    placed = positions(joined, ["review"], [F.col("was").asc_nulls_last(), F.col(key).asc()])
    return placed.select("review", key, "rank", F.col("was").isNotNull().alias("queried"))


#: Ranks that are summed up in one piece.
BLOCK = 65_536


def _found(ranked: DataFrame, truth: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Labelled records with their ranks among themselves and the number of included ones found so far.

    Blocks of ranks are summed first, so that no group is one task.
    """
    labelled = ranked.select(*by, key, "rank").join(truth.select("review", key, "label_included"), ["review", key])
    blocks = labelled.withColumn("_b", F.floor((F.col("rank") - 1) / BLOCK))
    sums = blocks.groupBy(*by, "_b").agg(F.count("*").alias("_n"), F.sum("label_included").alias("_s"))
    so_far = W.partitionBy(*by).orderBy("_b")
    before = sums.select(*by, "_b", (F.sum("_n").over(so_far) - F.col("_n")).alias("_n"), (F.sum("_s").over(so_far) - F.col("_s")).alias("_s"))
    inside = W.partitionBy(*by, "_b").orderBy("rank")
    numbered = blocks.withColumn("_k", row_no(inside)).withColumn("_f", F.sum("label_included").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.join(before, [*by, "_b"]).select(*by, key, (F.col("_k") + F.col("_n")).alias("rank"), "label_included", (F.col("_f") + F.col("_s")).alias("found"))


def ranking_metrics(ranked: DataFrame, truth: DataFrame, recall: str = "0.95", key: str = "work_id", by: list[str] | None = None) -> DataFrame:
    """Per review (and further columns in by): what reading down the ranking to a recall target costs.

    The target is ceil(recall * included) in exact decimals; the cutoff is the first rank that reaches it. tnr: excluded
    records not read over all excluded; wss: records not read over all, less 1 - recall. All null without included records.
    """
    by = by or ["review"]
    found = _found(ranked, truth, key, by)
    totals = found.groupBy(*by).agg(F.count("*").alias("n_ranked"), F.sum("label_included").alias("n_included"))
    complete = truth.groupBy("review").agg(F.count("*").alias("n_truth"))
    target = F.ceil(F.lit(recall).cast("decimal(5,4)") * F.col("n_included"))
    reached = (
        found.join(totals, by).filter((F.col("n_included") > 0) & (F.col("found") >= target)).groupBy(*by).agg(F.min("rank").alias("cutoff"), F.min_by("found", "rank").alias("true_positives"))
    )
    excluded = F.col("n_ranked") - F.col("n_included")
    left = excluded - (F.col("cutoff") - F.col("true_positives"))
    missed = F.col("n_included") - F.col("true_positives")
    return (
        totals.join(reached, by, "left")
        .join(complete, "review", "left")
        .select(
            *by,
            "n_ranked",
            "n_included",
            (F.col("n_ranked") == F.col("n_truth")).alias("complete"),
            "cutoff",
            F.round(F.try_divide(F.col("true_positives"), F.col("n_included")), 6).alias("recall_at_cutoff"),
            F.round(F.try_divide(left, excluded), 6).alias("tnr"),
            F.round(F.try_divide(left + missed, F.col("n_ranked")) - (1 - float(recall)), 6).alias("wss"),
        )
    )


def recall_curve(ranked: DataFrame, truth: DataFrame, points: int = 400, key: str = "work_id", by: list[str] | None = None) -> DataFrame:
    """position, recall and baseline at 0, at every included record, at every stride-th rank and at the end."""
    by = by or ["review"]
    found = _found(ranked, truth, key, by)
    totals = found.groupBy(*by).agg(F.count("*").alias("n"), F.sum("label_included").alias("included")).filter("included > 0")
    stride = F.greatest(F.lit(1), F.floor(F.col("n") / points))
    inner = found.join(totals, by).filter((F.col("label_included") == 1) | (F.col("rank") % stride == 0) | (F.col("rank") == F.col("n")))
    rows = inner.select(*by, F.col("rank").cast("bigint").alias("position"), F.round(F.col("found") / F.col("included"), 6).alias("recall"), F.round(F.col("rank") / F.col("n"), 6).alias("baseline"))
    start = totals.select(*by, F.lit(0).cast("bigint").alias("position"), F.lit(0.0).alias("recall"), F.lit(0.0).alias("baseline"))
    return rows.unionByName(start)


def decision_order(decisions: DataFrame, by: list[str]) -> DataFrame:
    """by, work_id, rank: verified includes by falling confidence, referrals by id, verified excludes by rising confidence."""
    sure = F.coalesce("confidence", F.lit(0.0))
    group = F.when(~F.col("span_verified"), 1).when(F.col("decision") == "include", 0).otherwise(2)
    inner = F.when(group == 0, -sure).when(group == 1, 0.0).otherwise(sure)
    return rank_rows(decisions, by, [group, inner])


def accept_terms(question: Column, terms: Column, most: int = 8) -> Column:
    """Expansion terms worth searching, in their order: no syntax, no phrases, no repeats, nothing the question has."""
    tidy = F.transform(terms, lambda t: F.trim(F.regexp_replace(t, r"\s+", " ")))
    split = lambda t: F.regexp_extract_all(F.lower(t), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    asked = split(question)
    good = F.filter(
        tidy,
        lambda t: (t != "")
        & (F.length(t) <= 60)
        & ~t.rlike(r'["()\[\]{}*?:^~]|\b(?:AND|OR|NOT|NEAR)\b')
        & F.size(split(t)).between(1, 6)
        & (F.size(F.array_except(split(t), asked)) > 0),
    )
    first = F.filter(good, lambda t, i: F.array_position(F.transform(good, F.lower), F.lower(t)) == i + 1)
    return F.slice(first, 1, most)


def expanded(question: Column, terms: Column) -> Column:
    """The question, then its accepted terms."""
    return F.trim(F.concat_ws(" ", F.trim(question), F.array_join(terms, " ")))
