"""The pN_ queries: each problem's operator over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.llm import chunking, confusables, consensus, mixing, mojibake, neardup, packing, pairs, residue, tokens, truncation
from siftmill.session import broadcast_if_small, stage, table

SECTION_LIMIT, BODY_LIMIT, OVERLAP = 2_000, 24_000, 150


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    """Every oversized section and body (section_no 0) with the kind of cuts that it needed."""
    sections = chunking.cut_kinds(table(spark, base, "paper_section"), ["pmcid", "section_no"], "text", SECTION_LIMIT, OVERLAP)
    bodies = table(spark, base, "paper_fulltext").select("pmcid", F.lit(0).alias("section_no"), "body")
    return sections.unionByName(chunking.cut_kinds(bodies, ["pmcid", "section_no"], "body", BODY_LIMIT, OVERLAP))


def _once(df: DataFrame, keys: list[str]) -> DataFrame:
    """Each key's row once: only rows whose key occurs again are shuffled with their texts."""
    again = broadcast_if_small(stage(df.groupBy(*keys).count().filter("count > 1").select(*keys)))
    return df.join(again, keys, "left_anti").unionByName(df.join(again, keys, "left_semi").dropDuplicates(keys))


def p1_pieces(spark: SparkSession, base: str) -> DataFrame:
    """All pieces of all sections and bodies (section_no 0), re-deliveries once."""
    keys = ["pmcid", "section_no"]
    sections = _once(table(spark, base, "paper_section").select(*keys, "text").filter("text is not null"), keys)
    bodies = _once(table(spark, base, "paper_fulltext").select("pmcid", F.lit(0).alias("section_no"), F.col("body").alias("text")).filter("text is not null"), keys)
    return chunking.split(sections, keys, "text", SECTION_LIMIT, OVERLAP).unionByName(chunking.split(bodies, keys, "text", BODY_LIMIT, OVERLAP))


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    """Pairs of work_ids that are one paper: 0.45 of their runs of three words are common."""
    works = table(spark, base, "works").filter(F.length("abstract") >= 200)
    text = F.concat_ws(" ", "title", "abstract")
    pairs = neardup.duplicate_pairs(works, "work_id", text, "0.45", 3)
    return pairs.select(F.col("a").alias("work_id_a"), F.col("b").alias("work_id_b"))


def p3_restored(spark: SparkSession, base: str) -> DataFrame:
    """Every garbled title and abstract with its text as far as restored, and the chain of wrong decodings."""
    return mojibake.restore(table(spark, base, "works"), ["review", "work_id"], ["title", "abstract"])


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    """Titles and abstracts that were read in a wrong encoding."""
    return p3_restored(spark, base).select("review", "work_id", "field").distinct()


def p4_consistent(spark: SparkSession, base: str) -> DataFrame:
    """Every value of the three fields that is not in its consistent form, with that form; re-deliveries once."""
    parts = (
        ("abstract", "works", "abstract", ["review", "work_id"]),
        ("evidence_span", "screening_decision", "evidence_span", ["run_id", "review", "work_id"]),
        ("section_text", "paper_section", "text", ["pmcid", "section_no"]),
    )
    found = None
    for field, name, column, keys in parts:
        one = confusables.differing(table(spark, base, name), keys, column).select(
            F.lit(field).alias("field"), F.concat_ws("|", *keys).alias("rec_key"), "value", "text"
        )
        found = one if found is None else found.unionByName(one)
    return found.distinct()


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    """Values with look-alike or otherwise differing characters, without the abstracts that are garbled (p3)."""
    model = mojibake.train(table(spark, base, "works"), ["title", "abstract"])
    found = p4_consistent(spark, base)
    sound = (F.col("field") != "abstract") | ~mojibake.is_garbled(F.when(F.col("field") == "abstract", F.col("value")), spark, model)
    return found.filter(sound).select("field", "rec_key").distinct()


_P5 = (["review", "work_id"], "rater_id", "human_decision", "created_at")


def p5_consensus(spark: SparkSession, base: str) -> DataFrame:
    """Consensus per record of overrides, with its probability and the raters' agreement with it."""
    return consensus.consensus(table(spark, base, "overrides"), *_P5)


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    """Records of overrides whose consensus is include."""
    return p5_consensus(spark, base).filter("consensus = 'include'").select("review", "work_id")


def p5_reliability(spark: SparkSession, base: str) -> DataFrame:
    """Reliability of every rater, and of every run's decisions against the raters' consensus."""
    return consensus.reliability(table(spark, base, "overrides"), table(spark, base, "screening_decision"), *_P5)


def p5_agreement(spark: SparkSession, base: str) -> DataFrame:
    """Chance-corrected agreement of all raters over all records."""
    return consensus.agreement(table(spark, base, "overrides"), *_P5)


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    """Responses that do not answer their requests, with the kind of defect."""
    return pairs.defects(table(spark, base, "cached_response"), "cache_key", "request_text", "raw_response")


def _p7_cases(spark: SparkSession, base: str) -> dict[str, tuple[DataFrame, list[str]]]:
    works, decisions, responses = (table(spark, base, t) for t in ("works", "screening_decision", "cached_response"))
    # an answer that ends in a bracket is cut only if its structure is open; for others the request tells copies apart
    closed = F.col("raw_response").rlike(r"[}\]]\s*(```)?\s*$")
    answers = responses.filter("raw_response is not null").withColumn("asked", F.when(~closed, F.col("request_text")))
    cut = pairs.stops_early(F.col("asked"), F.col("raw_response"), closed)
    return {
        "abstract": (truncation.cut_abstracts(works, ["review", "work_id"]), ["review", "work_id"]),
        "evidence_span": (truncation.cut_spans(decisions, works, ["run_id", "review", "work_id"], ["review", "work_id"]), ["run_id", "review", "work_id"]),
        "raw_response": (answers.filter(cut).select("cache_key").distinct(), ["cache_key"]),
    }


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    """Values that stop before their end."""
    parts = [df.select(F.lit(field).alias("field"), F.concat_ws("|", *keys).alias("rec_key")) for field, (df, keys) in _p7_cases(spark, base).items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p7_rates(spark: SparkSession, base: str) -> DataFrame:
    """Share of cut values per publisher (abstracts), run (spans) and model (answers), re-deliveries once."""
    cases = _p7_cases(spark, base)
    sources = {
        "abstract": ("works", "publisher", "abstract"),
        "evidence_span": ("screening_decision", "run_id", "evidence_span"),
        "raw_response": ("cached_response", "model", "raw_response"),
    }
    out = None
    for field, (name, source, column) in sources.items():
        found, keys = cases[field]
        extra = [] if source in keys else [source]
        values = table(spark, base, name).filter(F.length(F.trim(F.col(column))) > 0).select(*keys, *extra).dropDuplicates(keys)
        one = (
            values.join(found.withColumn("cut", F.lit(1)), keys, "left")
            .groupBy(F.col(source).alias("source"))
            .agg(F.count("*").alias("n"), F.count("cut").alias("n_cut"))
            .select(F.lit(field).alias("field"), "source", "n", "n_cut", F.round(F.col("n_cut") / F.col("n"), 6).alias("share"))
        )
        out = one if out is None else out.unionByName(one)
    return out


def p8_packing(spark: SparkSession, base: str) -> DataFrame:
    """All documents in the containers of every spec: a row per document or piece."""
    items = stage(tokens.sized(table(spark, base, "documents"), "doc_id", "text", [], "fetched_at"))
    return packing.pack(items, table(spark, base, "pack_specs"))


def p8_fill(spark: SparkSession, base: str) -> DataFrame:
    """How well the containers of every spec are filled."""
    return packing.fill(p8_packing(spark, base), table(spark, base, "pack_specs"))


def _p9(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    documents, targets = table(spark, base, "documents"), table(spark, base, "mix_targets")
    sized = stage(tokens.sized(documents, "doc_id", "text", ["source"], "fetched_at"))
    return mixing.mix(documents, sized, targets), sized, targets


def p9_mix(spark: SparkSession, base: str) -> DataFrame:
    """The documents of every mix and how often each is repeated."""
    chosen, _, _ = _p9(spark, base)
    return chosen.select("mix_id", "doc_id", F.col("domain").alias("source"), "tokens", "repeats")


def p9_shares(spark: SparkSession, base: str) -> DataFrame:
    """The shares that the sources of every mix really reach."""
    return mixing.shares(*_p9(spark, base))


def p10_residue(spark: SparkSession, base: str) -> DataFrame:
    """Documents with template residue, filler or notices, with the kinds found."""
    return residue.residue(table(spark, base, "documents"), "doc_id", "text", ["source", "kind"])


def p10_found(spark: SparkSession, base: str) -> DataFrame:
    """Documents with template residue, filler or notices, alone or among sound text."""
    return p10_residue(spark, base).select("doc_id")


def p10_clean(spark: SparkSession, base: str) -> DataFrame:
    """The documents that are left: id, source, language and size."""
    return table(spark, base, "documents").join(p10_found(spark, base), "doc_id", "left_anti").select("doc_id", "source", "lang", "n_chars")


QUERIES = {q.__name__: q for q in (p1_found, p1_pieces, p2_found, p3_found, p3_restored, p4_found, p4_consistent, p5_found, p5_consensus, p5_reliability, p5_agreement, p6_found, p7_found, p7_rates, p8_packing, p8_fill, p9_mix, p9_shares, p10_found, p10_residue, p10_clean)}
