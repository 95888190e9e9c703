"""Text functions as Column expressions; Python only where the JVM has no equivalent (NFKC)."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Typographic characters and the plain ones that quotations are compared in (after NFKC).
TYPOGRAPHIC = "‘’‚‛“”„′″‐‑‒–—―−"
PLAIN = "''''\"\"\"'\"-------"


@F.pandas_udf(T.StringType())
def nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode normalisation form KC, then full case folding's part that lower() does not do."""
    for texts in batches:
        yield texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalise(text: Column) -> Column:
    """Differences of transport folded away: NFKC, typographic characters, white space, case. Null gives ''.

    Only values with characters outside ASCII go to Python.
    """
    wide = text.rlike(r"[^\x00-\x7F]")
    composed = F.when(wide, nfkc(F.when(wide, text))).otherwise(text)
    plain = F.replace(F.translate(composed, TYPOGRAPHIC, PLAIN), F.lit("…"), F.lit("..."))
    spaced = F.trim(F.regexp_replace(plain, r"(?U)[\s\x{1c}-\x{1f}]+", " "))
    folded = F.replace(F.replace(F.lower(spaced), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))
    return F.coalesce(folded, F.lit(""))


def blank_to_null(text: Column) -> Column:
    """Trimmed text; null where nothing is left, and for the word nan that frames make of missing values."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when((bare == "") | (F.lower(bare) == "nan"), None).otherwise(bare)


def whole_year(value: Column) -> Column:
    """Year as int from 2019, '2019' or 2019.0; null where it isn't a whole number."""
    number = value.try_cast("double")
    return F.when(number == F.floor(number), number.cast("int"))


def normalise_doi(doi: Column) -> Column:
    """DOI without resolver prefix, lower case; null where blank."""
    bare = F.lower(F.trim(doi))
    return F.nullif(F.trim(F.regexp_replace(bare, r"^(?:https?://(?:dx\.)?doi\.org/|doi:)\s*", "")), F.lit(""))


def source_text(title: Column, abstract: Column) -> Column:
    """What a quotation may come from: title and abstract, empty ones left out."""
    return F.concat_ws(" ", F.nullif(title, F.lit("")), F.nullif(abstract, F.lit("")))


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with value as a column that is worked out once a row: expressions over it, lambdas above all, don't repeat it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def words(text: Column) -> Column:
    """Maximal runs of letters and digits, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def query_terms(question: Column) -> Column:
    """A question's words of more than two letters, each once."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(question), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), lambda w: F.length(w) > 2))


def question_key(question: Column) -> Column:
    """32 hexadecimal digits that stand for a question, whatever its spacing and case."""
    plain = F.lower(F.trim(F.regexp_replace(question, r"\s+", " ")))
    return F.substring(F.sha2(plain, 256), 1, 32)


def criteria_version(criteria: Column) -> Column:
    """Twelve hexadecimal digits that stand for the wording of criteria; part of a prompt's version."""
    return F.substring(F.sha2(criteria, 256), 1, 12)


def run_name(at: Column, config_hash: Column, kind: str | None = None) -> Column:
    """Name of a run: its time (UTC, to the microsecond), its kind if it has one, and its configuration."""
    return F.concat_ws("-", F.concat(F.date_format(at, "yyyyMMdd'T'HHmmssSSSSSS"), F.lit("Z")), *([F.lit(kind)] if kind else []), config_hash)


def search_text(question: Column) -> Column:
    """A question as a search service takes it: without wildcards, white space collapsed."""
    return F.trim(F.regexp_replace(F.translate(question, "?*", "  "), r"\s+", " "))


def safe_name(text: Column, limit: int = 60) -> Column:
    """A file name: reserved characters out, white space collapsed, cut at limit, no trailing dots or blanks."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r'[<>:"/\\|?*\x00-\x1f]', " "), r"\s+", " ")
    return F.regexp_replace(F.substring(F.trim(plain), 1, limit), r"[. ]+$", "")


def pmcid(text: Column) -> Column:
    """The first PMC identifier in a text, or null."""
    return F.nullif(F.regexp_extract(text, r"(PMC\d+)", 1), F.lit(""))


def sentences(text: Column) -> Column:
    """Sentences and lines of a text, white space collapsed, none empty."""
    parts = F.split(text, r"(?<=[.!?])\s+|\n+")
    return F.filter(F.transform(parts, lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")


def inverted_text(index: Column) -> Column:
    """Text of a map word -> positions, holes skipped; of two words at a position the later in the alphabet stands."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda at: F.struct(at.alias("at"), e["key"].alias("word")))))
    ordered = F.array_sort(pairs)
    following = F.slice(ordered, F.lit(2), F.greatest(F.size(ordered), F.lit(1)))
    last = F.array_compact(F.zip_with(ordered, following, lambda p, q: F.when(q.isNull() | (q["at"] != p["at"]), p["word"])))
    return F.when(F.size(pairs) > 0, F.array_join(last, " "))
