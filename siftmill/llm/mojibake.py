"""Garbled text from wrong character encodings: find the values concerned and restore them.

A smoothed character trigram model is trained on the clean records of the whole table (values without any sign of a
wrong decoding). Every chain of encode-decode steps is applied to each run of non-ASCII characters; a chain's gain is
the log-likelihood of the runs it changes, in their context, over that of the runs as they stand. The likeliest chain is
accepted if its gain exceeds MARGIN, and the search goes on from its result, so texts garbled twice or more unwind. A
chain need not concern the whole value: of the runs in their order, the stretch with the largest sum of gains counts.

Values with replacement characters, their garbled image, C1 controls or incomplete sequences are garbled without remedy
as far as those go (``restored`` false).

Cases: null and empty values, and ASCII ones, are sound; a table without clean records gives a flat model, so that only
UTF-8 sequences read as something else are found. Model size: fixed tables of twice 2**20 and 2**17 counts (9 MB), at any size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmill.llm.confusables import latin_spelling

#: Each table is kept twice under independent hashes and the smaller count holds (count-min).
TRIGRAM_BITS, BIGRAM_BITS = 20, 17
#: Log-likelihood (nats) by which a chain must win; validated on clean values (tests/llm/test_mojibake.py).
MARGIN = 5.5
#: Share of a valid UTF-8 sequence in the evidence (nats): by chance one character in a hundred forms one.
SEQUENCE = 4.5
#: Against each character that a chain leaves as it was inside a run of which it decodes others.
LEFT = 2.5
#: Least mean log-likelihood of a character that one single-byte page restores.
PLAIN = -4.5
_MIXED = re.compile("[a-zA-Z][\u0370-\u052f]|[\u0370-\u052f][a-zA-Z]")
_LETTERS = re.compile(r"[^\W\d_]+")
_RUN = re.compile(r"[^\x00-\x7f]+")
_CONTROL = re.compile(r"[\x80-\x9f]")
#: Signs of one single-byte page read as another: capitals or signs between small letters, long runs of accented letters,
#: Cyrillic words whose capitals follow a small letter.
_ODD = re.compile(
    "[a-z\u00df-\u00ff][\u00c0-\u00d6\u00d8-\u00de\u0152\u0160\u0178\u017d\u0192]"
    "|[a-z\u00df-\u00ff][\u00a1-\u00a9\u00ab-\u00af\u00b1-\u00b4\u00b6\u00b8\u00b9\u00bb-\u00bf\u2014\u2018\u201a-\u201e\u2020-\u2022\u2030\u2039\u203a][a-z\u00df-\u00ff]"
    "|[\u00c0-\u024f]{4}|[\u0430-\u045f][\u0400-\u042f]{2}| [\u00d0\u00d1] "
)
#: Ranges of characters that restored texts may hold (Latin, Greek, Cyrillic, punctuation, signs).
_PLAUSIBLE = re.compile("[\u0080-\u017f\u02c6\u02dc\u0370-\u03ff\u0400-\u045f\u0490\u0491\u1e00-\u1eff\u2002-\u2026\u2030-\u203a\u2070-\u209f\u20ac\u2100-\u2122\u2190-\u22ff\ufb00-\ufb06\ufeff\ufffd]")
#: Spaces and invisible characters: no evidence of an encoding by themselves.
_BLANK = frozenset("\u00a0\u00ad")
#: Code pages that texts are commonly read in, and the pairs (read as, written in) of single-byte pages.
READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "cp866", "koi8-r", "cp1253", "cp1254", "iso8859-15")
SINGLE = (
    ("cp1252", "mac_roman"),
    ("mac_roman", "cp1252"),
    ("cp1252", "cp1251"),
    ("cp1252", "koi8-r"),
    ("cp1251", "koi8-r"),
    ("koi8-r", "cp1251"),
    ("cp1251", "cp866"),
    ("cp866", "cp1251"),
    ("cp1251", "cp1252"),
    ("cp437", "cp1252"),
    ("cp850", "cp1252"),
    ("cp1252", "cp437"),
    ("cp1252", "cp850"),
    ("cp1250", "cp1252"),
    ("cp1252", "cp1250"),
    ("cp1252", "cp1253"),
    ("cp1253", "cp1252"),
    ("cp1254", "cp1252"),
    ("cp1252", "cp866"),
)


def _page(name: str) -> list[str]:
    """The characters of bytes 128 to 255; an undefined byte stands for the control character of its number."""
    found = []
    for b in range(128, 256):
        try:
            found.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            found.append(chr(b))
    return found


_CHARS = {name: _page(name) for name in {*READ_AS, *(x for pair in SINGLE for x in pair)}}
_BYTES = {name: {c: b + 128 for b, c in reversed(list(enumerate(chars)))} for name, chars in _CHARS.items()}
_UTF8 = tuple((page, "utf-8") for page in READ_AS)
CHAINS: tuple[tuple[str, str], ...] = _UTF8 + SINGLE


def _step(run: str, chain: tuple[str, str]) -> tuple[str, int, int, int] | None:
    """run re-decoded by the chain, with the numbers of complete and broken sequences and of characters left as they were.

    None if the chain doesn't apply.
    """
    source, target = chain
    codes = _BYTES[source]
    try:
        raw = bytes([codes[c] for c in run])
    except KeyError:
        return None
    if target != "utf-8":
        if _BLANK.issuperset(run):
            return None
        page = _CHARS[target]
        return "".join(page[b - 128] for b in raw), 0, 0, 0
    out, good, broken, kept, at = [], 0, 0, 0, 0
    while at < len(raw):
        b = raw[at]
        width = 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 4 if 0xF0 <= b <= 0xF4 else 1
        try:
            if width == 1 or not _PLAUSIBLE.match(char := raw[at : at + width].decode("utf-8")):
                raise ValueError
            out.append(char)
            good += char not in _BLANK
        except ValueError:
            rest = raw[at + 1 : at + width]
            cont = 0
            while cont < len(rest) and 0x80 <= rest[cont] <= 0xBF:
                cont += 1
            # the beginning of a longer sequence; an accented letter before unusual spaces is none
            if width > 2 and cont and at + 1 + cont == len(raw) and not _BLANK.issuperset(run[at + 1 : at + 1 + cont]):
                broken += 1
                width = 1 + cont
            else:
                width = 1
                kept += 1
            out.append(run[at : at + width])
        at += width
    return ("".join(out), good, broken, kept) if len(out) < len(run) or broken else None


def looks_garbled(text: str) -> bool:
    """Signs of a wrong decoding, without a model: what keeps a value out of the training."""
    if "�" in text or _CONTROL.search(text) or _ODD.search(text):
        return True
    return any(_reads_as_utf8(run) for run in _RUN.findall(text) if len(run) > 1)


@lru_cache(maxsize=65_536)
def _reads_as_utf8(run: str) -> bool:
    return any((s := _step(run, (page, "utf-8"))) is not None and s[1] > 0 for page in READ_AS[:6])


def _keys(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two buckets of the trigram and two of the bigram context at every position from the third character on."""
    c = codes.astype(np.uint64)
    with np.errstate(over="ignore"):
        pair = ((c[:-2] << np.uint64(21)) | c[1:-1]) * np.uint64(0x9E3779B97F4A7C15)
        triple = ((c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:]) * np.uint64(0xD6E8FEB86659FD93)
        pair ^= pair >> np.uint64(32)
        triple ^= triple >> np.uint64(32)
        pair *= np.uint64(0xC2B2AE3D27D4EB4F)
        triple *= np.uint64(0xC2B2AE3D27D4EB4F)
    top = lambda x, bits: (x >> np.uint64(64 - bits)).astype(np.int64)
    low = lambda x, bits: ((x >> np.uint64(8)) & np.uint64((1 << bits) - 1)).astype(np.int64)
    return top(triple, TRIGRAM_BITS), low(triple, TRIGRAM_BITS), top(pair, BIGRAM_BITS), low(pair, BIGRAM_BITS)


@dataclass
class Model:
    """Counts of trigrams and of their contexts; log-likelihoods are smoothed by single characters."""

    triples: tuple[np.ndarray, np.ndarray]
    pairs: tuple[np.ndarray, np.ndarray]
    singles: dict[int, int]
    known: dict[str, float] = field(default_factory=dict)
    runs: dict[str, list] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.total = sum(self.singles.values()) + 65536

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "runs": {}}

    def score(self, text: str) -> float:
        """Log-likelihood of the characters of text from the third on."""
        value = self.known.get(text)
        if value is None:
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            one, two, three, four = _keys(codes)
            single = np.array([(self.singles.get(int(c), 0) + 1) / self.total for c in codes[2:]])
            triples = np.minimum(self.triples[0][one], self.triples[1][two])
            times = np.maximum(np.minimum(self.pairs[0][three], self.pairs[1][four]), triples)
            value = float(np.log((triples + 2 * single) / (times + 2)).sum())
            if len(self.known) > 150_000:
                self.known.clear()
            self.known[text] = value
        return value


def train(df: DataFrame, columns: list[str]) -> Model:
    """The model of all clean values of the columns; only its fixed-size tables reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = ["\x02\x02"]
            for column in batch.columns:
                for text in column.to_pylist():
                    if text and (text.isascii() or not looks_garbled(text)):
                        kept.append(text)
            codes = np.frombuffer("\x02\x02".join(kept).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            if len(codes) < 3:
                continue
            for kind, values in enumerate((codes[codes < 65536].astype(np.int64), *_keys(codes))):
                at, count = np.unique(values, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at), pa.array(count)], names=["kind", "at", "n"])

    rows = (
        df.select(*columns)
        .mapInArrow(run, "kind int, at bigint, n bigint")
        .groupBy("kind", "at")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    kind, at, n = (rows.column(c).to_numpy() for c in ("kind", "at", "n"))
    tables = [np.zeros(1 << bits, np.float32) for bits in (TRIGRAM_BITS, TRIGRAM_BITS, BIGRAM_BITS, BIGRAM_BITS)]
    for k, t in enumerate(tables, 1):
        t[at[kind == k]] = n[kind == k]
    return Model((tables[0], tables[1]), (tables[2], tables[3]), dict(zip(at[kind == 0].tolist(), n[kind == 0].tolist())))


@dataclass
class Finding:
    """What was found in a value: whether it is garbled, its text as far as restored, the chains, their gain."""

    garbled: bool
    restored: bool
    text: str
    chains: list[str]
    gain: float


def _changes(model: Model, before: str, run: str, after: str) -> list[tuple[float, str | None, int]]:
    """What every chain makes of a run in its context: gain, the new run or None, broken sequences left."""
    key = f"{before}\x00{run}\x00{after}"
    found = model.runs.get(key)
    if found is None:
        found, as_is = [], model.score(before + run + after)
        for chain in CHAINS:
            step = _step(run, chain)
            if step is None or step[0] == run and not step[2]:
                found.append((0.0, None, 0))
            else:
                new = model.score(before + step[0] + after)
                gain = new - as_is
                if chain[1] != "utf-8" and new < PLAIN * len(step[0] + after):
                    gain = min(gain, 0.0)  # less unlikely isn't likely
                found.append((gain + SEQUENCE * (step[1] + step[2] / 2) - LEFT * step[3], step[0], step[2]))
        if len(model.runs) > 20_000:
            model.runs.clear()
        model.runs[key] = found
    return found


def _best(text: str, model: Model, allowed: tuple[int, ...] = tuple(range(len(CHAINS)))) -> tuple[float, tuple[str, str] | None, str, int]:
    """The best of the chains allowed (by number): gain, chain, result, broken sequences left."""
    runs = list(_RUN.finditer(text))
    padded = f"\x02\x02{text}\x02\x02"
    changes = [_changes(model, padded[m.start() : m.start() + 2], m.group(), padded[m.end() + 2 : m.end() + 4]) for m in runs]
    top, best, low, high = 0.0, -1, 0, 0
    for k in allowed:  # the stretch of runs with the largest sum of gains
        total = begin = 0
        for i, each in enumerate(changes):
            if total <= 0:
                total, begin = 0.0, i
            total += each[k][0]
            if total > top:
                top, best, low, high = total, k, begin, i + 1
    if best < 0:
        return 0.0, None, text, 0
    parts, at, broken = [], 0, 0
    for i, m in enumerate(runs[low:high], low):
        gain, new, left = changes[i][best]
        use = new is not None and (gain > 0 or CHAINS[best][1] != "utf-8")
        parts += [text[at : m.start()], new if use else m.group()]
        broken += left if use else 0
        at = m.end()
    return top, CHAINS[best], "".join([*parts, text[at:]]), broken


def examine(text: str | None, model: Model, margin: float = MARGIN) -> Finding:
    """Unwind the wrong decodings of a value, however many: every step makes it likelier by the margin, so it ends."""
    if not text or text.isascii():
        return Finding(False, True, text or "", [], 0.0)
    # letters of another alphabet put for Latin ones are another fault
    plain = _LETTERS.sub(lambda m: latin_spelling(m.group(), accented=False) or m.group(), text) if _MIXED.search(text) else text
    now, chains, gains, broken, allowed = plain, [], 0.0, 0, tuple(range(len(CHAINS)))
    while True:
        gain, chain, result, left = _best(now, model, allowed)
        if chain is None or gain < margin:
            break
        gains, broken = gains + gain, broken + left
        chains.append(f"{chain[0]}>{chain[1]}")
        # one wrong single-byte page at most, and none below a wrongly read UTF-8
        allowed = tuple(range(len(_UTF8))) + ((CHAINS.index(chain),) if chain[1] != "utf-8" else ())
        if result == now:
            break
        now = result
    lost = "�" in now or broken > 0
    # what still reads as garbled after some steps was not got back
    return Finding(bool(chains) or lost, not lost and not (chains and looks_garbled(now)), now, chains, gains)


FOUND = T.StructType(
    [
        T.StructField("garbled", T.BooleanType()),
        T.StructField("restored", T.BooleanType()),
        T.StructField("text", T.StringType()),
        T.StructField("chain", T.StringType()),
        T.StructField("gain", T.DoubleType()),
    ]
)


def is_garbled(column: Column, spark: SparkSession, model: Model) -> Column:
    """Whether a value is garbled; false for null."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(T.BooleanType())
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([examine(t, shared.value).garbled for t in texts], dtype=bool)

    return look(column)


def restore(df: DataFrame, keys: list[str], columns: list[str], model: Model | None = None) -> DataFrame:
    """keys, field, value, restored text, chain and gain of every garbled value of the columns; re-deliveries once.

    Only values with characters outside ASCII are sent to Python.
    """
    model = model or train(df, columns)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(FOUND)
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [examine(t, shared.value) for t in texts]
            yield pd.DataFrame(
                {
                    "garbled": [f.garbled for f in found],
                    "restored": [f.restored for f in found],
                    "text": [f.text if f.garbled else None for f in found],
                    "chain": [" ".join(f.chains) for f in found],
                    "gain": [f.gain for f in found],
                }
            )

    long = df.select(*keys, F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in columns))).alias("v"))
    return (
        long.select(*keys, "v.field", "v.value")
        .filter(F.col("value").rlike(r"[^\x00-\x7F]"))
        .withColumn("f", look("value"))
        .filter("f.garbled")
        .select(*keys, "field", "value", F.col("f.text").alias("text"), F.col("f.restored").alias("restored"), F.col("f.chain").alias("chain"), F.round("f.gain", 3).alias("gain"))
        .distinct()
    )
