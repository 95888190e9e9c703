"""Near-duplicate records with small edits: an exact set-similarity self-join by grouped prefixes.

Records become sets of word runs (shingles). A global order, rare shingles first, makes two similar sets share one of
their first few elements (prefix filter). Equal sets are collapsed into one class and sets of one size and prefix into
one group; pairs of groups that share a prefix element must then pass length, position and bitmap bounds, all of them
upper bounds that no true pair exceeds; what is left is expanded to classes and verified on the whole sets.

The order needs document frequencies. They are counted over all records in 2**SKETCH_BITS buckets, so what is broadcast
is 4 MB at any size; collisions only make a shingle look more frequent, and any order is exact.

Cases: null or empty text has no shingles and matches nothing; re-delivered rows count once; an id with several texts
stands for each of them; equal texts under several ids are one class. Hot shingles are salted by their frequency.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.session import broadcast_if_small, stage

SKETCH_BITS = 20
#: 64-bit words of a set's bitmap.
BITMAP = 8
#: Documents of a shingle that one task joins with each other; more are divided by salt.
HOT = 4096
_WORD = re.compile(r"[^\W_]+")
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _K[3]
    return x ^ (x >> np.uint64(29))


class Shingler:
    """Sorted distinct hashes of the runs of ``words`` consecutive words of a text, lower case."""

    def __init__(self, words: int):
        self.words = words
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        found = _WORD.findall(text.lower())
        count = len(found) - self.words + 1
        if count < 1:
            return np.empty(0, dtype=np.int64)
        known = self.known
        if len(known) > 500_000:
            known.clear()
        codes = np.empty(len(found), dtype=np.uint64)
        for i, word in enumerate(found):
            code = known.get(word)
            if code is None:
                code = known[word] = xxhash.xxh64_intdigest(word)
            codes[i] = code
        with np.errstate(over="ignore"):
            total = np.zeros(count, dtype=np.uint64)
            for i in range(self.words):
                total = _mixed(total * _K[0] + codes[i : i + count] * _K[1] + _K[2])
        return np.unique(total.view(np.int64))


def shingle_sets(df: DataFrame, ids: str, text: Column, words: int) -> DataFrame:
    """doc, a, b (128-bit fingerprint of the set), sh (its hashes in ascending order); only texts with any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler(words)
        for batch in batches:
            docs, prints, sizes, parts = [], [], [], []
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if value is None or not len(hashes := make(value)):
                    continue
                docs.append(doc)
                digest = xxhash.xxh3_128_intdigest(hashes.tobytes())
                prints.append(((digest >> 64) - (1 << 63), (digest & (1 << 64) - 1) - (1 << 63)))
                sizes.append(len(hashes))
                parts.append(hashes)
            values = pa.array(np.concatenate(parts) if parts else np.empty(0, dtype=np.int64))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(docs, pa.string()),
                    pa.array([p[0] for p in prints], pa.int64()),
                    pa.array([p[1] for p in prints], pa.int64()),
                    pa.ListArray.from_arrays(offsets, values),
                ],
                names=["doc", "a", "b", "sh"],
            )

    return df.select(F.col(ids).cast("string").alias("doc"), text.alias("text")).mapInArrow(
        run, "doc string, a bigint, b bigint, sh array<bigint>"
    )


def frequency_sketch(sets: DataFrame) -> np.ndarray:
    """Documents per bucket of shingles, counted over all sets; its size is fixed."""
    rows = (
        sets.select(F.explode("sh").alias("h"))
        .groupBy(F.col("h").bitwiseAND((1 << SKETCH_BITS) - 1).cast("int").alias("at"))
        .count()
        .toArrow()
    )
    sketch = np.zeros(1 << SKETCH_BITS, dtype=np.int32)
    sketch[rows.column("at").to_numpy()] = np.minimum(rows.column("count").to_numpy(), np.iinfo(np.int32).max)
    return sketch


def _prefixes(classes: DataFrame, sketch, t: Fraction) -> DataFrame:
    """cid, n, ph (fingerprint of the longest prefix), bitmap, the prefix in order and the frequency of each element."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        for batch in batches:
            cid, sets = batch.column(0), batch.column(1)
            n, prints, maps, sizes, pre, freq = [], [], [], [], [], []
            for i in range(len(cid)):
                hashes = sets[i].values.to_numpy()
                size = len(hashes)
                times = counts[hashes & ((1 << SKETCH_BITS) - 1)]
                keep = size - -(-size * t.numerator // t.denominator) + 1
                order = np.lexsort((hashes, times))[:keep]
                bits = np.bincount((hashes.view(np.uint64) >> np.uint64(40)).astype(np.int64) % (64 * BITMAP), minlength=64 * BITMAP) & 1
                maps.append(np.packbits(bits.astype(np.uint8)).view(np.int64))
                n.append(size)
                prints.append(xxhash.xxh3_64_intdigest(hashes[order].tobytes()) - (1 << 63))
                sizes.append(len(order))
                pre.append(hashes[order])
                freq.append(times[order])
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            flat = lambda x, kind: pa.array(np.concatenate(x) if x else np.empty(0, dtype=kind))
            bitmap = np.array(maps, dtype=np.int64).reshape(-1, BITMAP)
            yield pa.RecordBatch.from_arrays(
                [cid, pa.array(n, pa.int32()), pa.array(prints, pa.int64())]
                + [pa.array(bitmap[:, k].copy()) for k in range(BITMAP)]
                + [pa.ListArray.from_arrays(offsets, flat(pre, np.int64)), pa.ListArray.from_arrays(offsets, flat(freq, np.int32))],
                names=["cid", "n", "ph", *(f"m{k}" for k in range(BITMAP)), "pre", "freq"],
            )

    schema = "cid bigint, n int, ph bigint, " + ", ".join(f"m{k} bigint" for k in range(BITMAP)) + ", pre array<bigint>, freq array<int>"
    return classes.select("cid", "sh").mapInArrow(run, schema)


def similar_classes(classes: DataFrame, t: Fraction) -> DataFrame:
    """All pairs of different sets of classes(cid, sh) whose Jaccard similarity is t or more: ca < cb, common, na, nb."""
    spark = classes.sparkSession
    sketch = spark.sparkContext.broadcast(frequency_sketch(classes))
    heads = stage(_prefixes(classes, sketch, t))
    up = lambda x, top, bottom: F.ceil(x * top / bottom - 1e-9)
    p, q = t.numerator, t.denominator
    # Groups: one size, one prefix. A member differs from the group's first in at most ``far`` elements.
    groups = heads.groupBy("n", "ph").agg(F.min("cid").alias("gid"), F.count("*").alias("members")).filter("members > 1")
    several = stage(heads.select("cid", "n", "ph").join(groups, ["n", "ph"]).select("gid", "cid"))
    arrays = classes.select("cid", "sh")
    held = arrays.join(broadcast_if_small(several), "cid")
    radius = stage(
        held.join(held.filter("gid = cid").select("gid", F.col("sh").alias("first")), "gid").groupBy("gid").agg(F.max(F.size(F.array_except("sh", "first"))).alias("far"))
    )
    lead = heads.join(broadcast_if_small(several.filter("gid <> cid").select("cid")), "cid", "left_anti").join(
        broadcast_if_small(radius.withColumnRenamed("gid", "cid")), "cid", "left"
    )
    postings = (
        lead.select(
            F.col("cid").alias("g"), "n", F.coalesce("far", F.lit(0)).alias("far"), *(f"m{k}" for k in range(BITMAP)), F.posexplode(F.arrays_zip("pre", "freq")).alias("pos", "e")
        )
        .filter("e.freq > 1")  # no other set has it
        .select("g", "n", "far", "pos", *(f"m{k}" for k in range(BITMAP)), F.col("e.pre").alias("h"), F.ceil(F.col("e.freq") / HOT).cast("int").alias("parts"))
    )
    short = postings.filter(F.col("pos") <= F.col("n") - up(F.col("n"), 2 * p, p + q)).withColumn("part", F.pmod(F.xxhash64("g"), F.col("parts")).cast("int"))
    long = postings.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    a, b = short.alias("a"), long.alias("b")
    need = up(F.col("a.n") + F.col("b.n"), p, p + q)
    apart = sum((F.bit_count(F.col(f"a.m{k}").bitwiseXOR(F.col(f"b.m{k}"))) for k in range(1, BITMAP)), F.bit_count(F.col("a.m0").bitwiseXOR(F.col("b.m0"))))
    pairs = (
        a.join(
            b,
            (F.col("a.h") == F.col("b.h"))
            & (F.col("a.part") == F.col("b.part"))
            & ((F.col("a.n") < F.col("b.n")) | (F.col("a.n") == F.col("b.n")) & (F.col("a.g") < F.col("b.g")))
            & (F.col("a.n") * q >= F.col("b.n") * p)
            & (F.col("a.n") - F.col("a.pos") >= need)
            & (F.col("b.n") - F.col("b.pos") >= need)
            & ((F.col("a.n") + F.col("b.n") - apart) / 2 + F.col("a.far") + F.col("b.far") >= need),
        )
        .select(F.col("a.g").alias("ga"), F.col("b.g").alias("gb"))
        .distinct()
    )
    # groups of several become all their members; a single one is its own
    one = lambda side: broadcast_if_small(several.select(F.col("gid").alias(f"g{side}"), F.col("cid").alias(f"c{side}")))
    across = pairs.join(one("a"), "ga", "left").join(one("b"), "gb", "left").select(F.coalesce("ca", "ga").alias("ca"), F.coalesce("cb", "gb").alias("cb"))
    inner = several.select("gid", F.col("cid").alias("ca"), F.pmod(F.xxhash64("cid"), F.lit(16)).alias("part"))
    # within a group: one side divided into 16 parts, the other sent to each, so that a hot group is many tasks
    other = several.select("gid", F.col("cid").alias("cb"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(15).cast("bigint"))).alias("part"))
    within = inner.join(other, ["gid", "part"]).filter("ca < cb").select("ca", "cb")
    candidates = stage(across.unionByName(within).select(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")))
    wanted = candidates.select(F.explode(F.array("ca", "cb")).alias("cid")).distinct()
    sets = arrays.join(broadcast_if_small(wanted), "cid", "left_semi")
    side = lambda s: sets.select(F.col("cid").alias(f"c{s}"), F.col("sh").alias(f"s{s}"))
    common = F.size(F.array_intersect("sa", "sb"))
    return (
        candidates.join(side("a"), "ca")
        .join(side("b"), "cb")
        .select("ca", "cb", common.alias("common"), F.size("sa").alias("na"), F.size("sb").alias("nb"))
        .filter(F.col("common") * (p + q) >= (F.col("na") + F.col("nb")) * p)
    )


def near_duplicates(df: DataFrame, ids: str, text: Column, similarity: str = "0.8", words: int = 5) -> tuple[DataFrame, DataFrame]:
    """(members(doc, cid), links(ca, cb, common, na, nb)): the class of every text, and every link between different classes."""
    sets = stage(shingle_sets(df, ids, text, words))
    # one row per different set: only sets that occur again are shuffled
    again = broadcast_if_small(stage(sets.groupBy("a", "b").count().filter("count > 1").select("a", "b")))
    once = sets.join(again, ["a", "b"], "left_anti").select("a", "b", "sh")
    merged = sets.join(again, ["a", "b"], "left_semi").groupBy("a", "b").agg(F.first("sh").alias("sh"))
    classes = stage(once.unionByName(merged).select(F.xxhash64("a", "b").alias("cid"), "sh"))
    members = sets.select("doc", F.xxhash64("a", "b").alias("cid")).distinct()
    return members, similar_classes(classes, Fraction(similarity))


def duplicate_pairs(df: DataFrame, ids: str, text: Column, similarity: str, words: int) -> DataFrame:
    """Every pair of different ids that have similar texts: a < b as strings."""
    members, links = near_duplicates(df, ids, text, similarity, words)
    of = lambda s: members.select(F.col("doc").alias(s), F.col("cid").alias(f"c{s}"))
    linked = links.select("ca", "cb").join(of("a"), "ca").join(of("b"), "cb").select("a", "b")
    parts = F.lit(16)
    left = members.select("cid", F.col("doc").alias("a"), F.pmod(F.xxhash64("doc"), parts).alias("part"))
    right = members.select("cid", F.col("doc").alias("b"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(15).cast("bigint"))).alias("part"))
    shared = members.groupBy("cid").count().filter("count > 1").select("cid")
    copies = left.join(shared, "cid", "left_semi").join(right.join(shared, "cid", "left_semi"), ["cid", "part"]).select("a", "b")
    return (
        linked.unionByName(copies)
        .filter("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
