"""Tables that the queries share, in Spark and in SQL: re-deliveries once, labels from the raters' majority."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.functions.text import TYPOGRAPHIC, PLAIN
from siftmill.operators.ingest import latest
from siftmill.session import table  # noqa: F401


def works(spark: SparkSession, base: str) -> DataFrame:
    return latest(table(spark, base, "works"), ["review", "work_id"], "loaded_at")


def decisions(spark: SparkSession, base: str) -> DataFrame:
    return latest(table(spark, base, "screening_decision"), ["run_id", "review", "work_id"], "created_at")


def runs(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "screening_run")


def criteria(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "review_criteria")


def questions(spark: SparkSession, base: str) -> DataFrame:
    """Each review's question: the text of its criteria."""
    return criteria(spark, base).select("review", F.col("criteria").alias("question"))


def labels(spark: SparkSession, base: str, item: tuple[str, ...] = ("review", "work_id")) -> DataFrame:
    """item, rater_id, label (include or exclude): the last plain label of each rater."""
    said = F.lower(F.regexp_replace("human_decision", r"^\s+|\s+$", ""))
    rows = table(spark, base, "overrides").select(*item, "rater_id", said.alias("label"), "created_at").filter("label in ('include', 'exclude')")
    return rows.groupBy(*item, "rater_id").agg(F.max_by("label", F.struct("created_at", "label")).alias("label"))


def truth(spark: SparkSession, base: str) -> DataFrame:
    """review, work_id, label_included: 1 where more raters include than exclude."""
    votes = F.sum(F.when(F.col("label") == "include", 1).otherwise(-1))
    return labels(spark, base).groupBy("review", "work_id").agg(F.when(votes > 0, 1).otherwise(0).alias("label_included"))


def sections(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "paper_section").dropDuplicates(["pmcid", "section_no"])


def papers(spark: SparkSession, base: str) -> DataFrame:
    return latest(table(spark, base, "paper_fulltext"), ["pmcid"], "fetched_at")


def cache(spark: SparkSession, base: str) -> DataFrame:
    return latest(table(spark, base, "cached_response"), ["cache_key"], "created_at")


WORKS = "w AS (SELECT * FROM works QUALIFY row_number() OVER (PARTITION BY review, work_id ORDER BY loaded_at DESC) = 1)"
DECISIONS = "d AS (SELECT * FROM screening_decision QUALIFY row_number() OVER (PARTITION BY run_id, review, work_id ORDER BY created_at DESC) = 1)"
CACHE = "c AS (SELECT * FROM cached_response QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY created_at DESC) = 1)"
LABELS = r"""l AS (SELECT review, work_id, rater_id, label FROM (
    SELECT review, work_id, rater_id, created_at, lower(regexp_replace(human_decision, '^\s+|\s+$', '', 'g')) AS label FROM overrides)
    WHERE label IN ('include', 'exclude')
    QUALIFY row_number() OVER (PARTITION BY review, work_id, rater_id ORDER BY created_at DESC, label DESC) = 1)"""
TRUTH = LABELS + """, t AS (SELECT review, work_id, CASE WHEN sum(CASE label WHEN 'include' THEN 1 ELSE -1 END) > 0 THEN 1 ELSE 0 END AS label_included
    FROM l GROUP BY review, work_id)"""
SECTIONS = "s AS (SELECT * FROM paper_section QUALIFY row_number() OVER (PARTITION BY pmcid, section_no ORDER BY pmcid) = 1)"
PAPERS = "f AS (SELECT * FROM paper_fulltext QUALIFY row_number() OVER (PARTITION BY pmcid ORDER BY fetched_at DESC) = 1)"


def ratio(a: str, b: str) -> str:
    return f"round(CASE WHEN ({b}) = 0 THEN NULL ELSE ({a})::DOUBLE / ({b}) END, 6)"


def normalised(text: str) -> str:
    """SQL of functions.text.normalise: NFKC from NFC and its single characters' mappings, made by rule."""
    one_from, one_to, longer = "", "", []
    for low, high in ((0xA0, 0x180), (0x2C6, 0x2E0), (0x2000, 0x2150), (0x2150, 0x2190), (0x3000, 0x3001), (0xFB00, 0xFB07), (0xFF01, 0xFFF0)):
        for c in map(chr, range(low, high)):
            new = unicodedata.normalize("NFKC", c)
            if new != c and unicodedata.normalize("NFC", c) != new:
                if len(new) == 1:
                    one_from, one_to = one_from + c, one_to + new
                else:
                    longer.append((c, new))
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    out = f"translate({text}, {quoted(one_from)}, {quoted(one_to)})"
    for c, new in longer:
        out = f"replace({out}, {quoted(c)}, {quoted(new)})"
    out = f"translate(nfc_normalize({out}), {quoted(TYPOGRAPHIC)}, {quoted(PLAIN)})"
    out = f"trim(regexp_replace(replace({out}, '…', '...'), '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\x{{2028}}\\x{{2029}}]+', ' ', 'g'))"
    return f"coalesce(replace(replace(lower({out}), 'ß', 'ss'), 'ς', 'σ'), '')"
