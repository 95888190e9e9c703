"""Text cut off by field limits: structural completeness of answers, abstracts and quotations."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmill.llm.confusables import unify

_FENCE = re.compile(r"^```[a-zA-Z]*[ \t]*\n?")
_FENCE_END = re.compile(r"\n?[ \t]*```[ \t]*$")
_OMISSION = re.compile(r"(?:\s|…|\.\.\.|\[\s*(?:…|\.\.\.)\s*\])+$")
_INTRODUCED = re.compile(r"^[^\n{}\[\]]{0,80}:\s*(?=[{\[])")


def unwrap(answer: str) -> tuple[str, str]:
    """(kind, body) of an answer: ``json`` from its first bracket, ``prose``, or ``nothing``."""
    text = answer.strip()
    text = _FENCE_END.sub("", _FENCE.sub("", text)).strip() if text.startswith("```") else text
    if not text or text in ("null", '""', "``"):
        return "nothing", ""
    if text[0] in '{["':
        return "json", text
    m = _INTRODUCED.match(text)
    if m:
        return "json", _FENCE_END.sub("", text[m.end() :])
    at = text.find("```")
    if at >= 0 and (inner := _FENCE.sub("", text[at:])).lstrip().startswith("{"):
        return "json", _FENCE_END.sub("", inner).strip()
    return "prose", text


def json_is_open(text: str) -> bool:
    """Whether a JSON text stops inside a string, an escape, an object or an array: a stack automaton over its characters."""
    stack: list[str] = []
    inside = escaped = False
    for c in text:
        if inside:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                inside = False
        elif c == '"':
            inside = True
        elif c in "{[":
            stack.append(c)
        elif c in "}]":
            if stack:
                stack.pop()
    return inside or bool(stack)


_PAIRS = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«"}
_OPENERS = frozenset(_PAIRS.values())


def prose_is_open(text: str) -> bool:
    """Whether brackets or quotation marks that were opened stay so."""
    stack: list[str] = []
    for c in text:
        if c in _OPENERS:
            stack.append(c)
        elif c in _PAIRS and stack:
            if _PAIRS[c] in stack:
                while stack.pop() != _PAIRS[c]:
                    pass
    return bool(stack)


def answer_is_cut(answer: str) -> bool:
    """Whether an answer stops before it is complete: open JSON, or prose with open quotation marks or without an end."""
    kind, body = unwrap(_OMISSION.sub("", answer) if answer.strip() else answer)
    if kind == "nothing":
        return False
    if kind == "json":
        return json_is_open(body)
    if prose_is_open(body):
        return True
    if re.search(r"\bis \d\.$", body):  # a number without its decimals
        return True
    last = body.rstrip("\"'”’»)]* ")[-1:]
    return last not in ".!?}" and not body.endswith((")", "]", "”", "»"))


# Abstracts: does the last sentence end?

UNIGRAM_BITS, BIGRAM_BITS = 18, 20
_TOKEN = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*|[.!?]+[\"'”’»)\]]*(?=\s|$)")
_TERMINAL = re.compile(r"[.!?][\"'”’»)\]]*$")
_DIGITS = str.maketrans("0123456789", "##########")
#: What introduces keywords and notices, after which a text is whole without a final stop.
_TAIL = re.compile(
    r"(?i)(?:\bkey ?words|\bindex terms|\bmots[- ]cl[ée]s|\bpalabras clave|\bpalavras[- ]chave|\bschl(?:ü|ue)sselw(?:ö|oe)rter|\bключевые слова)\s*[:—–-][^.!?]*$"
    r"|(?:©|\(c\)|\bcopyright\b)[^.!?]{0,120}$|\bregist(?:ered|ration|ry)\b[^.!?]{0,60}\d[\w/-]*$|\b(?:doi|isrctn|nct|pmid|prospero)\b[^\s]*\s?[\w./:-]*\d$"
)
#: Below this probability of ending a sentence, a text that stops there was cut.
LEAST = 0.15
#: So many different texts that stop with the same two words make them an ending.
NOTICES = 8
#: A word that the corpus has nowhere else is a broken one rather than a new one.
UNSEEN = 0.4
_BITS = {"u": UNIGRAM_BITS, "s": UNIGRAM_BITS, "b": BIGRAM_BITS, "q": BIGRAM_BITS, "k": BIGRAM_BITS, "t": BIGRAM_BITS}


def without_omission(text: str) -> tuple[str, bool]:
    """text without blanks and marks of omission at its end, and whether there were such marks."""
    bare = text.rstrip()
    cut = _OMISSION.sub("", bare)
    return cut, "…" in bare[len(cut) :] or "..." in bare[len(cut) :]


class Endings:
    """How often words, pairs of words and the words after a word end a sentence, in tables of fixed size.

    inner and final count occurrences inside and at the end of terminated sentences; last counts different texts that stop
    with the word and without a terminator.
    """

    NAMES = [*(kind + what for kind in _BITS for what in "if"), "bl"]

    def __init__(self) -> None:
        self.tables = {name: np.zeros(1 << _BITS[name[0]], np.float32) for name in self.NAMES}

    def ends(self, text: str) -> float:
        """Probability that a sentence ends where text stops, not counting this text itself."""
        words = codes_of(text)
        if not len(words) or words[-1] == 0:
            return 1.0
        begins = np.flatnonzero(words == 0)
        if len(words) > 6 and len(words) - 1 - (int(begins[-1]) if len(begins) else -1) < 3:
            return 0.0  # no sentence of one or two words follows others
        words = np.concatenate([np.zeros(2, np.int64), words])[-3:]
        share = 0.1
        if re.search(r"(?:^|\s)[b-df-xz]$", text):
            return 0.0  # no word of these languages
        for kind, weight in (("s", 4.0), ("q", 3.0), ("u", 2.0), ("k", 1.5), ("b", 1.0), ("t", 1.0)):
            at = int(_places(words, kind)[-1])
            inner, done = float(self.tables[kind + "i"][at]), float(self.tables[kind + "f"][at])
            if kind == "u" and not inner + done and share < 0.8:
                share *= UNSEEN
            if kind == "b" and (last := float(self.tables["bl"][at])) >= NOTICES:  # other texts stop there too
                done += last - 1
            share = (done + weight * share) / (inner + done + weight)
        return share


_known: dict[str, int] = {}


def codes_of(text: str) -> np.ndarray:
    """One number for each word of text; 0 for a terminator."""
    out = []
    for token in _TOKEN.findall(text):
        code = _known.get(token)
        if code is None:
            if len(_known) > 500_000:
                _known.clear()
            code = 0 if token[0] in ".!?" else (xxhash.xxh64_intdigest(token.lower().translate(_DIGITS)) >> 1) | 1
            _known[token] = code
        out.append(code)
    return np.array(out, dtype=np.int64)


def _places(words: np.ndarray, kind: str) -> np.ndarray:
    """Bucket of each word from the third on: by itself (u), the word before (s), both (b), the two before (q), it and the one before
    the word before (k), all three (t)."""
    w = words.view(np.uint64)
    a, b, c = w[:-2], w[1:-1], w[2:]
    with np.errstate(over="ignore"):
        turn = lambda x: x ^ (x >> np.uint64(29))
        k = np.uint64(0x9E3779B97F4A7C15)
        x = {
            "u": lambda: c,
            "s": lambda: b + np.uint64(7),
            "b": lambda: c * k + turn(b),
            "k": lambda: turn(c + np.uint64(11)) * k + turn(a),
            "q": lambda: (b + np.uint64(7)) * k + turn(a),
            "t": lambda: turn(c * k + turn(b)) * k + turn(a),
        }[kind]()
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (x >> np.uint64(64 - _BITS[kind])).astype(np.int64)


def train_endings(df: DataFrame, column: str) -> Endings:
    """The model over all values of the column; only its tables of fixed size reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list[np.ndarray]] = {}
            stops: list[tuple[str, int, int]] = []
            for text in batch.column(0).to_pylist():
                text = without_omission(unify(text)[0] or "")[0]
                words = codes_of(text)
                if not len(words):
                    continue
                words = np.concatenate([np.zeros(2, np.int64), words])
                here = words[2:] != 0
                after = np.concatenate([words[3:] == 0, [False]])
                inner = here.copy()
                inner[-1] = False  # the last word without a terminator is neither
                for kind in _BITS:
                    places = _places(words, kind)
                    found.setdefault(kind + "i", []).append(places[inner & ~after])
                    found.setdefault(kind + "f", []).append(places[here & after])
                    if kind == "b" and words[-1] != 0:
                        stops.append((kind + "l", int(places[-1]), xxhash.xxh64_intdigest(text) - (1 << 63)))
            names, ats, ns, texts = [], [], [], []
            for name, parts in found.items():
                at, n = np.unique(np.concatenate(parts), return_counts=True)
                names += [name] * len(at)
                ats.append(at)
                ns.append(n)
                texts.append(np.zeros(len(at), np.int64))
            names += [s[0] for s in stops]
            ats.append(np.array([s[1] for s in stops], np.int64))
            ns.append(np.ones(len(stops), np.int64))
            texts.append(np.array([s[2] for s in stops], np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(np.concatenate(ats)), pa.array(np.concatenate(ns)), pa.array(np.concatenate(texts))], names=["t", "at", "n", "text"]
            )

    rows = (
        df.select(column)
        .filter(F.length(column) > 0)
        .mapInArrow(run, "t string, at bigint, n bigint, text bigint")
        .groupBy("t", "at", "text")
        .agg(F.sum("n").alias("n"))
        .groupBy("t", "at")
        .agg(F.sum(F.when(F.col("t").endswith("l"), F.lit(1)).otherwise(F.col("n"))).alias("n"))
        .select(F.array_position(F.array(*(F.lit(x) for x in Endings.NAMES)), F.col("t")).cast("tinyint").alias("t"), F.col("at").cast("int").alias("at"), F.col("n").cast("float").alias("n"))
        .toArrow()  # nine bytes a bucket
    )
    model = Endings()
    t, at, n = rows.column("t").to_numpy(), rows.column("at").to_numpy(), rows.column("n").to_numpy()
    for k, name in enumerate(Endings.NAMES, 1):
        own = t == k
        model.tables[name][at[own]] = n[own]
    return model


#: What stops inside a tag, a character reference, an escape or a multibyte sequence.
_BROKEN = re.compile(r"<[/!]?[A-Za-z][^<>]{0,200}$|</?$|&(?:#[0-9]*|#x[0-9a-fA-F]*|am|amp|ap|apo|apos|lt|gt|qu|quo|quot|nb|nbs|nbsp)$|\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?$|[�ÂÃ]$")


def abstract_is_cut(text: str | None, model: Endings, at_limit: bool = False) -> bool:
    """Whether an abstract stops inside a word or a sentence; at a field limit of its source, any open end is a cut."""
    if not text or not text.strip():
        return False
    bare, omission = without_omission(unify(text)[0])
    if not bare:
        return False
    tail = re.split(r"(?<=[.!?])\s+", bare[-600:])[-1]
    if _TERMINAL.search(bare) and not (omission and prose_is_open(tail)):
        return False
    if prose_is_open(tail) or _BROKEN.search(bare):
        return True
    if _TAIL.search(bare[-400:]):
        return False
    if at_limit:
        return True
    return bare[-1] not in ")]}”»" and model.ends(bare) < LEAST


# Quotations: does the clause end where they stop?

_EDGE = "\"'“”‘’«»„"
_CLAUSE_END = re.compile(r"[\"'”’»)\]]*[.!?…;:,](?![\d])")
_SPACES = re.compile(r"\s+")


def _flat(text: str) -> str:
    return _SPACES.sub(" ", unify(text)[0]).strip().lower()


def stops_inside(quote: str, source: str) -> bool | None:
    """Whether quote, found in source, stops inside a word or clause there; None if it isn't found. Both are flat."""
    at, verdict = source.find(quote), None
    while at >= 0:
        rest = source[at + len(quote) :]
        if not rest:
            return False
        if quote[-1].isalnum() and (rest[0].isalnum() or rest[0] in "-'’" and rest[1:2].isalnum()):
            inside = True
        elif quote[-1] in ".,;:!?" and not (quote[-1] in ".,:" and rest[0].isdigit()):
            inside = False
        else:
            inside = not _CLAUSE_END.match(rest)
        if not inside:
            return False
        verdict = True
        at = source.find(quote, at + 1)
    return verdict


#: Characters of a quotation's end that must be found again where the whole is not.
SUFFIX = 16


def span_is_cut(span: str | None, title: str | None, abstract: str | None) -> bool:
    """Whether a quotation stops inside a word or clause of the abstract (or title) it quotes, by the text that follows there.

    A quotation that is not found as a whole (altered, partly invented) is placed by the longest end of it that is; one
    whose end isn't found is judged whole, as no text follows.
    """
    if not span or not span.strip():
        return False
    bare, _ = without_omission(span.strip().strip(_EDGE))
    quote = _flat(bare).strip(_EDGE + " ")
    if not quote:
        return False
    sources = [_flat(x) for x in (abstract, title) if x and x.strip()]
    for source in sources:
        found = stops_inside(quote, source)
        if found is not None:
            return found
    words = [m.start() for m in re.finditer(r"(?<=\s)\S", quote)]
    for source in sources[:1]:
        low, high, best = 0, len(words) - 1, None  # a shorter end is found wherever a longer one is
        while low <= high:
            mid = (low + high) // 2
            end = quote[words[mid] :]
            if len(end) >= SUFFIX and end in source:
                best, high = end, mid - 1
            elif len(end) < SUFFIX:
                high = mid - 1
            else:
                low = mid + 1
        if best is not None:
            return bool(stops_inside(best, source))
    return False


def _flag(function, *columns: Column) -> Column:
    @F.pandas_udf(T.BooleanType())
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for parts in batches:
            yield pd.Series([function(*row) for row in zip(*parts)], dtype=bool)

    return run(*columns)


#: A length is a field limit of a source if so many texts without a terminator have it, and so many times as many as usual
#: for the lengths within NEARBY of it.
LIMIT_TEXTS, LIMIT_TIMES, NEARBY = 4, 6.0, 25


def field_limits(works: DataFrame, keys: list[str], column: str, source: str) -> DataFrame:
    """(source, size): the lengths at which a source's texts stop without a terminator unusually often."""
    sizes = (
        works.filter(_open_end(F.col(column)))
        .select(*keys, F.col(source).alias("source"), F.length(column).alias("size"))
        .distinct()
        .groupBy("source", "size")
        .agg(F.count("*").alias("n"))
    )
    near = W.partitionBy("source").orderBy("size").rangeBetween(-NEARBY, NEARBY)
    usual = (F.sum("n").over(near) - F.col("n")) / (2 * NEARBY)
    return sizes.withColumn("usual", usual).filter((F.col("n") >= LIMIT_TEXTS) & (F.col("n") >= LIMIT_TIMES * F.greatest("usual", F.lit(0.2)))).select("source", "size")


def _open_end(text: Column) -> Column:
    """Texts that don't end in a terminator, or in marks of omission."""
    return (F.length(F.trim(text)) > 0) & (~text.rlike(r"[.!?][\"'”’»)\]]*\s*$") | text.rlike(r"\.\.\.\s*$"))


def cut_abstracts(works: DataFrame, keys: list[str], column: str = "abstract", source: str = "publisher") -> DataFrame:
    """keys of the abstracts that were cut. Texts that end in a terminator are settled on the JVM's side."""
    model = works.sparkSession.sparkContext.broadcast(train_endings(works, column))

    @F.pandas_udf(T.BooleanType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, limits in batches:
            yield pd.Series([abstract_is_cut(t, model.value, bool(at)) for t, at in zip(texts, limits)], dtype=bool)

    limits = field_limits(works, keys, column, source)
    texts = works.filter(_open_end(F.col(column))).select(*keys, F.col(column).alias("text"), F.col(source).alias("source"), F.length(column).alias("size")).distinct()
    joined = texts.join(limits.withColumn("at_limit", F.lit(True)), (texts["source"].eqNullSafe(limits["source"])) & (texts["size"] == limits["size"]), "left")
    return joined.filter(run(F.col("text"), F.coalesce("at_limit", F.lit(False)))).select(*keys).distinct()


def cut_spans(decisions: DataFrame, works: DataFrame, keys: list[str], on: list[str]) -> DataFrame:
    """keys of the evidence spans that were cut. Literal quotations of whole sentences are settled on the JVM's side."""
    texts = works.select(*on, "title", "abstract").dropDuplicates(on)
    spans = decisions.select(*keys, F.rtrim("evidence_span").alias("span")).filter("length(span) > 0").dropDuplicates([*keys, "span"])
    joined = spans.join(texts, on, "left")
    at = F.instr("abstract", F.col("span"))
    after = F.expr("substring(abstract, instr(abstract, span) + length(span), 1)")
    whole = F.col("span").rlike("[.!?]$") & (at > 0) & ~after.rlike("[0-9]") & ~F.col("span").rlike(r"\.\.\.$")
    rest = joined.filter(~F.coalesce(whole, F.lit(False)))
    return rest.filter(_flag(span_is_cut, F.col("span"), F.col("title"), F.col("abstract"))).select(*keys).distinct()
