"""Quotations checked word for word against their source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.functions.text import normalise, source_text

#: Shortest quotation that is evidence of anything.
LEAST = 20
#: What may surround a quotation.
STRIPPED = "\"'.,;:()[] "


def verdict(span: Column, source: Column, n_span: Column, n_source: Column) -> Column:
    """Note on a quotation; n_span and n_source are the normalised forms. Only the two exact_ notes are verified."""
    bare = F.btrim(n_span, F.lit(STRIPPED))
    probe = F.substring(n_span, F.lit(1), F.greatest(F.lit(LEAST), F.floor(F.length(n_span) / 2).cast("int")))
    return (
        F.when(span.isNull() | (F.trim(span) == "") | (n_span == ""), "empty_span")
        .when(source.isNull() | (n_source == ""), "no_source_text")
        .when(F.length(n_span) < LEAST, f"span_too_short(<{LEAST}chars)")
        .when(F.length(n_span) > F.length(n_source), "span_longer_than_source")
        .when(F.contains(n_source, n_span), "exact_after_normalisation")
        .when((F.length(bare) >= LEAST) & (bare != n_span) & F.contains(n_source, bare), "exact_after_punctuation_strip")
        .when(F.contains(n_source, probe), "partial_match_only")
        .otherwise("not_found")
    )


def is_verified(note: Column) -> Column:
    return note.startswith("exact_")


def verify(df: DataFrame, span: str = "evidence_span", title: str = "title", abstract: str = "abstract") -> DataFrame:
    """df with n_span, n_source, note and verified."""
    source = source_text(F.col(title), F.col(abstract))
    out = df.withColumn("n_span", normalise(F.col(span))).withColumn("n_source", normalise(source))
    note = verdict(F.col(span), source, F.col("n_span"), F.col("n_source"))
    return out.withColumn("note", note).withColumn("verified", is_verified(F.col("note")))
