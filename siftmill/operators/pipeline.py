"""Operators put together: from candidates to screened, extracted and ordered papers; stated gaps of full texts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftmill.functions.text import normalise
from siftmill.functions.verify import is_verified, verdict
from siftmill.operators.documents import GAP_CUE
from siftmill.operators import ranking
from siftmill.operators.ingest import web_duplicates, without_records
from siftmill.operators.metrics import count_if, to_human
from siftmill.operators.ranking import cosine, positions
from siftmill.operators.responses import field_answers, screen
from siftmill.session import stage

#: Shortest abstract worth screening; most gaps of a paper.
ABSTRACT_CHARS, GAPS = 200, 5


def candidates(found: DataFrame, by: list[str], position: str) -> DataFrame:
    """Search results without later duplicates (by DOI, or title and year) and without short abstracts."""
    return web_duplicates(found, by, position).filter(F.col("kept") & (F.length("abstract") >= ABSTRACT_CHARS)).drop("kept")


def discover(found: DataFrame, answers: DataFrame, extracted: DataFrame, fields: list[str], position: str = "position") -> DataFrame:
    """A row per candidate: its decision, and the verified fields of verified includes; others keep null fields.

    found: (review, work_id, title, abstract, doi, year, position); answers: (review, work_id, raw_response); extracted:
    (review, work_id, a struct of value and evidence_span per field). A candidate without an answer keeps null.
    """
    works = candidates(found, ["review"], position)
    screened = screen(answers, works, []).select("review", "work_id", "decision", "confidence", "span_verified", "verify_note")
    source = F.concat_ws(" ", "title", "abstract")
    wanted = screened.filter("decision = 'include' and span_verified").select("review", "work_id")
    texts = works.join(wanted, ["review", "work_id"], "left_semi").select("review", "work_id", source.alias("source"))
    rows = field_answers(extracted.join(texts, ["review", "work_id"]), ["review", "work_id"], fields, "source")
    wide = rows.groupBy("review", "work_id").agg(*(F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields))
    return works.select("review", "work_id", "title", position).join(screened, ["review", "work_id"], "left").join(wide, ["review", "work_id"], "left")


def accepted_gaps(items: DataFrame, offered: DataFrame, sources: DataFrame, most: int = GAPS) -> tuple[DataFrame, DataFrame]:
    """(kept, counts) of proposed gaps (id, position, value, evidence_span) per paper.

    A gap stands if its quotation verifies against the paper (sources: id, text), is one of the sentences that were offered
    (offered: id, sentence) and points at something undone; each once. Reading stops at the most-th kept one, and counts
    (n_kept, n_unsupported, n_withheld) are of the items read.
    """
    n_span = normalise(F.col("evidence_span"))
    known = offered.select("id", normalise(F.col("sentence")).alias("n")).distinct().withColumn("is_offered", F.lit(True))
    rows = items.withColumn("n", n_span).join(sources.select("id", "text", normalise(F.col("text")).alias("n_text")), "id", "left").join(known, ["id", "n"], "left")
    note = verdict(F.col("evidence_span"), F.col("text"), F.col("n"), F.col("n_text"))
    status = F.when(~is_verified(note), "unsupported").when(F.col("is_offered").isNull() | ~F.col("evidence_span").rlike(GAP_CUE), "withheld").otherwise("good")
    marked = rows.select("id", "position", "value", "evidence_span", "n", status.alias("status"))
    again = F.row_number().over(W.partitionBy("id", "status", "n").orderBy("position")) > 1
    marked = marked.withColumn("status", F.when((F.col("status") == "good") & again, "repeated").otherwise(F.col("status")))
    # a paper has a handful of items
    so_far = W.partitionBy("id").orderBy("position").rowsBetween(W.unboundedPreceding, -1)
    read = marked.withColumn("before", F.coalesce(F.sum(F.when(F.col("status") == "good", 1).otherwise(0)).over(so_far), F.lit(0))).filter(F.col("before") < most)
    counts = read.groupBy("id").agg(*(F.count(F.when(F.col("status") == s, 1)).alias(f"n_{name}") for s, name in (("good", "kept"), ("unsupported", "unsupported"), ("withheld", "withheld"))))
    return read.filter("status = 'good'").select("id", "position", "value", "evidence_span"), counts


def similarity(df: DataFrame, vector: str, query: str, when: str | None = None) -> DataFrame:
    """df with the cosine of two vector columns; null where a vector is missing, or where the condition does not hold."""
    present = F.col(vector).isNotNull() & F.col(query).isNotNull()
    return df.withColumn("similarity", F.when(present & (F.expr(when) if when else F.lit(True)), cosine(F.col(vector), F.col(query))))


def reading_order(combined: DataFrame, by: list[str], position: str = "position") -> DataFrame:
    """combined verdicts (reading_group, similarity) in the order they are read: backed, referred, set aside; within a group
    the nearest to the question first, those without a similarity in their source order."""
    ordered = combined.withColumn("_s", -F.coalesce("similarity", F.lit(0.0)))
    return positions(ordered, by, [F.col("reading_group").asc(), F.col("_s").asc(), F.col(position).asc()]).drop("_s")


@dataclass(frozen=True)
class HarnessConfig:
    """What a run does: how records are ranked, how many of each review are decided, and the recall that is aimed at."""

    strategy: str = "bm25"
    max_records: int | None = None
    recall_target: str = "0.95"
    seed: int = 42


def harness(config: HarnessConfig, works: DataFrame, questions: DataFrame, decisions: DataFrame, truth: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Per review from configuration to metrics: records ranked, the head cut after ranking, its decisions counted, and what
    reading down the head costs. A review without records fails before anything is ranked; one without labels has no costs.

    decisions: one per record (review, work_id, decision, span_verified); records without one are read by a human.
    """
    if without_records(questions, works).limit(1).count():
        raise ValueError("a review has no records")
    ranked = ranking.rank(config.strategy, works, seed=config.seed, questions=questions, scores=scores, limit=config.max_records)
    head = stage(ranked.select("review", "work_id", "rank"))
    joined = head.join(decisions.select("review", "work_id", "decision", "span_verified"), ["review", "work_id"], "left")
    closed = F.coalesce(~to_human(), F.lit(False))
    counts = joined.groupBy("review").agg(F.count("*").alias("n_head"), F.count("decision").alias("n_screened"), count_if(F.col("span_verified")).alias("n_verified"), count_if(~closed).alias("n_to_human"))
    return counts.join(ranking.ranking_metrics(head, truth, config.recall_target), "review", "left")
