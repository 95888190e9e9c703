"""How quotations fail: ordered classes of unverified spans."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmill.functions.text import normalise, source_text
from siftmill.functions.verify import LEAST
from siftmill.operators.metrics import ratio

#: Shares of a span in one run of its source.
PARAPHRASE, PARTIAL, STITCH = 0.85, 0.50, 0.35
CATEGORIES = ["no_source_text", "echoed_criteria", "too_short", "longer_than_source", "quote_from_title", "truncated", "near_paraphrase", "stitched", "partial_overlap", "fabricated"]


class Automaton:
    """Suffix automaton of a text: finds the longest run of any other text that occurs in it, in linear time."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size, self.end = [-1], [0], [0]  # end: where the state's texts end first
        last = 0
        for at, c in enumerate(text, 1):
            now = len(self.size)
            self.next.append({})
            self.link.append(0)
            self.size.append(self.size[last] + 1)
            self.end.append(at)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = now
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                if self.size[p] + 1 == self.size[q]:
                    self.link[now] = q
                else:
                    copy = len(self.size)
                    self.next.append(dict(self.next[q]))
                    self.link.append(self.link[q])
                    self.size.append(self.size[p] + 1)
                    self.end.append(self.end[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = self.link[p]
                    self.link[q] = self.link[now] = copy
            last = now

    def longest_run(self, text: str) -> tuple[int, int]:
        """(length, end in this text) of the longest run here that occurs in text; the first here of equals."""
        state = length = best = 0
        found = 0
        nexts, links, sizes = self.next, self.link, self.size
        for c in text:
            step = nexts[state]
            while state and c not in step:
                state = links[state]
                length = sizes[state]
                step = nexts[state]
            if c in step:
                state = step[c]
                length += 1
                if length > best or length == best and self.end[state] < self.end[found]:
                    best, found = length, state
            else:
                state = length = 0
        return best, self.end[found] if best else 0


def longest_run(span: str, source: str) -> tuple[int, int]:
    """(length, start in span) of the longest run of span that occurs in source; the first of equals. The automaton is that
    of the span, which is short; the source is only read."""
    size, end = Automaton(span).longest_run(source)
    return size, end - size


def classify(span: str, title: str, abstract: str, source: str, criteria: str) -> tuple[str, float]:
    """(class, share of the span in one run) of a failed quotation; all arguments normalised, '' where missing."""
    if not span:
        return "fabricated", 0.0
    if not source:
        return "no_source_text", 0.0
    if criteria and span in criteria:
        return "echoed_criteria", 0.0
    if len(span) < LEAST:
        return "too_short", 0.0
    if len(span) > len(source):
        return "longer_than_source", 0.0
    size, start = longest_run(span, source)
    share = size / len(span)
    if abstract and title and span not in abstract and span in title:
        return "quote_from_title", 1.0
    if share >= PARAPHRASE:
        return ("truncated" if size == len(span) else "near_paraphrase"), share
    if size and share >= STITCH:
        for rest in (span[:start], span[start + size :]):
            if len(rest) >= LEAST and longest_run(rest, source)[0] / len(rest) >= STITCH:
                return "stitched", share
    return ("partial_overlap" if share >= PARTIAL else "fabricated"), share


RESULT = T.StructType([T.StructField("category", T.StringType()), T.StructField("share", T.DoubleType())])


@F.pandas_udf(RESULT)
def _classify(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    for parts in batches:
        found = [classify(*row) for row in zip(*parts)]
        yield pd.DataFrame({"category": [f[0] for f in found], "share": [round(f[1], 6) for f in found]})


def failures(decisions: DataFrame, works: DataFrame, criteria: DataFrame) -> DataFrame:
    """Every unverified decision with its class: the distinct (record, span) are classified once."""
    failed = decisions.filter(~F.col("span_verified")).select("run_id", "review", "work_id", "decision", "evidence_span")
    spans = failed.select("review", "work_id", "evidence_span").distinct()
    joined = spans.join(works.select("review", "work_id", "title", "abstract"), ["review", "work_id"]).join(criteria.select("review", "criteria"), "review", "left")
    source = source_text(F.col("title"), F.col("abstract"))
    forms = [normalise(c) for c in (F.col("evidence_span"), F.col("title"), F.col("abstract"), source, F.col("criteria"))]
    classified = joined.withColumn("c", _classify(*forms)).select("review", "work_id", "evidence_span", "c.category", "c.share")
    a, b = failed.alias("a"), classified.alias("b")
    on = (F.col("a.review") == F.col("b.review")) & (F.col("a.work_id") == F.col("b.work_id")) & F.col("a.evidence_span").eqNullSafe(F.col("b.evidence_span"))
    return a.join(b, on).select("a.run_id", "a.review", "a.work_id", "a.decision", "b.category", "b.share")


def distribution(classified: DataFrame) -> DataFrame:
    """Classes per review and over all reviews (review ``all``) with their numbers and shares."""
    per = classified.groupBy("review", "category").agg(F.count("*").alias("n"))
    every = classified.groupBy("category").agg(F.count("*").alias("n")).select(F.lit("all").alias("review"), "category", "n")
    both = per.unionByName(every)
    totals = both.groupBy("review").agg(F.sum("n").alias("total"))
    return both.join(totals, "review").select("review", "category", "n", F.round(F.col("n") / F.col("total"), 4).alias("share"))


def wrong_by_category(classified: DataFrame, truth: DataFrame) -> DataFrame:
    """Per class: failures on labelled records, and how many of those records are truly included."""
    return classified.join(truth, ["review", "work_id"]).groupBy("category").agg(F.count("*").alias("n"), F.sum("label_included").alias("n_truly_included")).withColumn("share", ratio(F.col("n_truly_included"), F.col("n")))
