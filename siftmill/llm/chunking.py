"""Splitting oversized texts at natural boundaries (content-defined chunking).

A rolling hash over the text's characters marks landmarks; each cut is the natural boundary (paragraph, line, sentence,
clause, word) nearest to the first landmark between the minimum and the maximum size. As a landmark depends only on the
characters around it, an edit moves the cuts near it, and the later ones fall where they did before.

Cases: a null text gives null; an empty text and one within the limit give one piece; a stretch without space, tab or
newline longer than the limit is cut inside (kind ``forced``), anything else only at white space (kind ``boundary``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters in a landmark's window.
WINDOW = 32
PIECE = T.StructType(
    [
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("fresh", T.IntegerType()),
        T.StructField("cut", T.StringType()),
    ]
)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BREAK = re.compile(r"[ \t\n]+")
_CLOSERS = "\"')]”’»"
#: Words before a full stop that does not end a sentence.
_ABBREVIATED = frozenset("e.g i.e al fig figs eq eqs vs cf no nos dr prof st approx ca resp vol ed eds ref refs tab sec z.b bzw etc".split())


def landmarks(text: str, spacing: int) -> np.ndarray:
    """Positions after which the rolling hash of the last WINDOW characters is a multiple of spacing (on average)."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    if len(codes) < WINDOW:
        return np.empty(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        total = (codes + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        total ^= total >> np.uint64(32)
        total *= np.uint64(0xD6E8FEB86659FD93)
        factor, width = _BASE, 1
        while width < WINDOW:  # doubling: hash of 2w characters from two hashes of w
            longer = total.copy()
            longer[width:] += factor * total[:-width]
            total, factor, width = longer, factor * factor, width * 2
        total ^= total >> np.uint64(29)
        total *= np.uint64(0xBF58476D1CE4E5B9)
    hits = np.flatnonzero((total >> np.uint64(33)) % np.uint64(spacing) == 0)
    return hits[hits >= WINDOW - 1] + 1


def _strength(text: str, begin: int, end: int) -> int:
    """How natural a cut after text[:end] is, text[begin:end] being the white space there."""
    gap = text[begin:end]
    if "\n" in gap:
        return 5 if gap.count("\n") > 1 else 4
    at = begin - 1
    while at >= 0 and text[at] in _CLOSERS:
        at -= 1
    if at < 0:
        return 1
    last = text[at]
    if last in ".!?…":
        follows = text[end : end + 1]
        word = text[max(0, at - 12) : at].rsplit(None, 1)[-1:] or [""]
        if last == "." and word[0].lower().lstrip("(") in _ABBREVIATED or follows.islower():
            return 1
        return 3
    return 2 if last in ",;:" else 1


def _snap(text: str, low: int, high: int, want: int, reach: int) -> int | None:
    """The natural boundary for a cut in low..high nearest to want; within reach of it stronger ones come first."""
    best: tuple | None = None
    found = None
    for begin_at, end_at in ((max(low, want - reach), min(high, want + reach)), (low, high)):
        for m in _BREAK.finditer(text, max(0, begin_at - 1), min(len(text), end_at + 1)):
            begin, end = m.span()
            while begin > 0 and text[begin - 1] in " \t\n":
                begin -= 1
            cut = min(end, end_at)  # a run of white space that crosses the limit is divided there
            if not begin_at <= cut <= end_at or cut <= low - 1:
                continue
            force = _strength(text, begin, end)
            rank = (min(force, 3), -abs(cut - want), force)
            if best is None or rank > best:
                best, found = rank, cut
        if found is not None and (best[0] >= 2 or begin_at == low and end_at == high):
            return found
    return found


def plan(text: str | None, limit: int, overlap: int, least: int | None = None) -> list[tuple[int, int, int, str]] | None:
    """Pieces of text as (start, end, fresh, cut): text[start:end], of which text[start:fresh] repeats the piece before.

    cut is ``forced`` if the piece's end lies inside a stretch longer than limit, else ``boundary``.
    """
    if text is None:
        return None
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    size = len(text)
    if size <= limit:
        return [(0, size, 0, "boundary")]
    least = least or max(1, limit // 3)
    marks = landmarks(text, max(1, limit // 3))
    pieces, start, fresh = [], 0, 0
    while size - start > limit:
        high = start + limit
        low = min(fresh + max(1, least - (fresh - start)), high)
        k = int(np.searchsorted(marks, low))
        want = int(marks[k]) if k < len(marks) and marks[k] <= high else high
        end, cut = _snap(text, low, high, want, limit // 8), "boundary"
        if end is None and text[high] in " \t\n":
            end = high
        if end is None:  # no white space from the minimum on: the last before it, else inside the stretch
            before = max(text.rfind(c, fresh, low) for c in " \t\n")
            end = before + 1 if before >= fresh else None
        if end is None and start < fresh:  # without the overlap there is more room
            start = fresh
            continue
        if end is None:
            end, cut = high, "forced"
        pieces.append((start, end, fresh, cut))
        fresh, start = end, end
        if overlap and cut == "boundary":
            start = _overlap_start(text, pieces[-1][2], end, limit, overlap)
        elif overlap:
            start = max(end - overlap, pieces[-1][0] + 1)
    pieces.append((start, size, fresh, "boundary"))
    return pieces


def _overlap_start(text: str, earliest: int, end: int, limit: int, overlap: int) -> int:
    """Where the next piece begins: at a sentence, else a word, at most overlap back, with room for the next stretch."""
    nxt = _BREAK.search(text, end)
    room = (nxt.start() if nxt else len(text)) - limit
    low = max(end - overlap, earliest, room)
    if low >= end:
        return end
    begin = 0 if low == 0 else None
    word = None
    for m in _BREAK.finditer(text, max(0, low - 1), end):
        at = m.end()
        if at >= end or at < low:
            continue
        if word is None:
            word = at
        if _strength(text, m.start(), at) >= 3:
            return at
    return word if word is not None else (begin if begin is not None else end)


def chunk_plan(text: Column, limit: int, overlap: int) -> Column:
    """Array of the pieces of text (see :func:`plan`) as offsets; the text itself stays on the JVM's side."""

    @F.pandas_udf(T.ArrayType(PIECE))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if t is None else [dict(zip(PIECE.names, p)) for p in plan(t, limit, overlap)] for t in texts], dtype=object)

    return run(text)


def oversized(df: DataFrame, text: str, limit: int, overlap: int = 150) -> DataFrame:
    """Rows of df whose text is longer than limit, with the array ``pieces``. Null texts are not oversized."""
    return df.filter(F.length(text) > limit).withColumn("pieces", chunk_plan(F.col(text), limit, overlap))


def split(df: DataFrame, keys: list[str], text: str, limit: int, overlap: int = 150) -> DataFrame:
    """Every text as its pieces: keys, piece_no from 1, start, end, fresh, cut, piece. A text within limit is one piece."""
    whole = F.array(
        F.struct(F.lit(0).alias("start"), F.length(text).alias("end"), F.lit(0).alias("fresh"), F.lit("boundary").alias("cut"))
    )
    long = df.filter(F.length(text) > limit).select(*keys, text, chunk_plan(F.col(text), limit, overlap).alias("pieces"))
    short = df.filter(F.length(text) <= limit).select(*keys, text, whole.cast(T.ArrayType(PIECE)).alias("pieces"))
    return long.unionByName(short).select(*keys, text, F.posexplode("pieces").alias("at", "p")).select(
        *keys,
        (F.col("at") + 1).alias("piece_no"),
        "p.start",
        "p.end",
        "p.fresh",
        "p.cut",
        F.substring(F.col(text), F.col("p.start") + 1, F.col("p.end") - F.col("p.start")).alias("piece"),
    )


def cut_kinds(df: DataFrame, keys: list[str], text: str, limit: int, overlap: int = 150) -> DataFrame:
    """One row per distinct key of an oversized text: keys and cut, ``forced`` if any of its cuts had to be."""
    forced = F.exists("pieces", lambda p: p["cut"] == "forced")
    return (
        oversized(df.select(*keys, text), text, limit, overlap)
        .select(*keys, F.when(forced, "forced").otherwise("boundary").alias("cut"))
        .groupBy(*keys)
        .agg(F.max("cut").alias("cut"))
    )
