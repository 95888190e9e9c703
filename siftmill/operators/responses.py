"""Structured model responses: prompts, cache lookups, parsing, shape checks, verification, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.functions.text import normalise
from siftmill.functions.verify import is_verified, verdict, verify

SHAPE = "decision string, confidence string, evidence_span string, _corrupt string"


def prompt(template: str, **parts: Column) -> Column:
    """A template whose {name} slots are filled with the trimmed parts."""
    out = F.lit(template)
    for name, value in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.trim(F.coalesce(value, F.lit(""))))
    return out


def parse_decision(raw: Column) -> Column:
    """Struct of decision, confidence (double), evidence_span and shape_note; the note is null for a well-shaped answer.

    Fences are taken off; extra fields are ignored, numbers given as text are read; anything else is a schema failure.
    """
    bare = F.trim(F.regexp_replace(F.trim(raw), r"^```[a-z]*\s*|\s*```$", ""))
    r = F.from_json(bare, SHAPE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    confidence = r["confidence"].try_cast("double")
    good = r["decision"].isin("include", "exclude") & confidence.between(0, 1) & r["evidence_span"].isNotNull() & r["_corrupt"].isNull()
    note = F.when(raw.isNull() | (bare == ""), "empty_response").when(~F.coalesce(good, F.lit(False)), "schema_validation_failed")
    return F.struct(r["decision"].alias("decision"), confidence.alias("confidence"), r["evidence_span"].alias("evidence_span"), note.alias("shape_note"))


def _bare(raw: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(raw), r"^```[a-z]*\s*|\s*```$", ""))


def _read(raw: Column, shape: str) -> Column:
    return F.from_json(_bare(raw), f"{shape}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})


def parse_fields(raw: Column, fields: list[str]) -> Column:
    """Struct of a (value, evidence_span) per field and shape_note, which is null where every field is there with both texts."""
    r = _read(raw, ", ".join(f"`{f}` struct<value:string,evidence_span:string>" for f in fields))
    good = r["_corrupt"].isNull()
    for f in fields:
        good = good & r[f]["value"].isNotNull() & r[f]["evidence_span"].isNotNull()
    return F.struct(*(r[f].alias(f) for f in fields), _note(raw, good).alias("shape_note"))


def parse_gap(raw: Column) -> Column:
    """Struct of value, evidence_span and shape_note of one gap answer."""
    r = _read(raw, "value string, evidence_span string")
    return F.struct(r["value"].alias("value"), r["evidence_span"].alias("evidence_span"), _note(raw, r["_corrupt"].isNull() & r["value"].isNotNull() & r["evidence_span"].isNotNull()).alias("shape_note"))


def parse_gaps(raw: Column) -> Column:
    """Struct of gaps (array of value and evidence_span) and shape_note of a list answer; an empty list is well-shaped."""
    r = _read(raw, "gaps array<struct<value:string,evidence_span:string>>")
    good = r["_corrupt"].isNull() & r["gaps"].isNotNull() & F.forall(r["gaps"], lambda g: g["value"].isNotNull() & g["evidence_span"].isNotNull())
    return F.struct(r["gaps"].alias("gaps"), _note(raw, good).alias("shape_note"))


def parse_terms(raw: Column) -> Column:
    """Struct of terms (array of texts) and shape_note of a query expansion."""
    r = _read(raw, "terms array<string>")
    return F.struct(r["terms"].alias("terms"), _note(raw, r["_corrupt"].isNull() & r["terms"].isNotNull()).alias("shape_note"))


def _note(raw: Column, good: Column) -> Column:
    return F.when(raw.isNull() | (_bare(raw) == ""), "empty_response").when(~F.coalesce(good, F.lit(False)), "schema_validation_failed")


def require_same_requests(looked_up: DataFrame) -> DataFrame:
    """The result of cache_lookup; a remembered answer to another request under the same key fails the job."""
    fail = F.raise_error(F.concat(F.lit("another request is remembered under "), F.col("cache_key"))).cast("string")
    return looked_up.withColumn("status", F.when(F.col("status") == "mismatch", fail).otherwise(F.col("status")))


def screen(responses: DataFrame, works: DataFrame, keys: list[str]) -> DataFrame:
    """Decisions from raw responses: parsed, shape-checked and verified against the record.

    A verified answer keeps its decision; an unverified one is a referral (``unverified``); a malformed one is ``error``.
    """
    parsed = responses.select(*keys, "review", "work_id", parse_decision(F.col("raw_response")).alias("p")).select(*keys, "review", "work_id", "p.*")
    joined = verify(parsed.join(works.select("review", "work_id", "title", "abstract"), ["review", "work_id"]))
    note = F.coalesce("shape_note", "note")
    verified = F.col("shape_note").isNull() & F.col("verified")
    decision = F.when(F.col("shape_note").isNotNull(), "error").when(F.col("verified"), F.col("decision")).otherwise("unverified")
    return joined.select(
        *keys, "review", "work_id", decision.alias("decision"), F.when(F.col("shape_note").isNull(), F.col("confidence")).alias("confidence"), F.when(F.col("shape_note").isNull(), F.col("evidence_span")).alias("evidence_span"), verified.alias("span_verified"), note.alias("verify_note")
    )


def cache_lookup(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """requests (cache_key, request_sha256) with the remembered answer: ``hit``, ``miss``, or ``mismatch`` (another request
    under the key, which must stop a run)."""
    held = cache.select("cache_key", F.col("request_sha256").alias("held_sha256"), "raw_response")
    status = F.when(F.col("held_sha256").isNull(), "miss").when(F.col("held_sha256") == F.col("request_sha256"), "hit").otherwise("mismatch")
    return requests.join(held, "cache_key", "left").withColumn("status", status).withColumn("raw_response", F.when(F.col("status") == "hit", F.col("raw_response"))).drop("held_sha256")


def recover_proposals(decisions: DataFrame, cache: DataFrame) -> DataFrame:
    """What the model proposed, before verification: from the remembered answer, else from a verified decision."""
    held = cache.select("cache_key", parse_decision(F.col("raw_response")).alias("p")).select("cache_key", F.when(F.col("p.shape_note").isNull(), F.col("p.decision")).alias("cached")).dropDuplicates(["cache_key"])
    own = F.when(F.col("decision").isin("include", "exclude"), F.col("decision"))
    return (
        decisions.join(held, "cache_key", "left")
        .withColumn("proposed", F.coalesce("cached", own))
        .withColumn("recovered", F.col("proposed").isNotNull())
        .select("run_id", "review", "work_id", "decision", "confidence", "span_verified", "proposed", "recovered")
    )


def mock_response(prompt_text: Column, span: Column) -> Column:
    """A deterministic stand-in for a model: decision and confidence from the prompt's hash; a fifth of the quotations invented."""
    h = F.conv(F.substring(F.sha2(prompt_text, 256), 1, 8), 16, 10).cast("bigint")
    return F.to_json(
        F.struct(
            F.when(h % 3 == 0, "include").otherwise("exclude").alias("decision"),
            F.round(0.5 + (h % 50) / 100, 2).alias("confidence"),
            F.when(h % 5 == 0, F.concat(F.lit("This sentence stands nowhere in the record "), h.cast("string"))).otherwise(span).alias("evidence_span"),
        )
    )


def field_answers(answers: DataFrame, keys: list[str], fields: list[str], source: str, truncated: Column | None = None) -> DataFrame:
    """A row per record and field from structs (value, evidence_span): verified values, ``not_stated`` ones, unbacked ones nulled.

    answers has one struct column per field and the text that quotations come from. A field that is not stated in a source
    that was cut is ``not_stated_possibly_truncated``.
    """
    long = answers.select(*keys, F.col(source).alias("_s"), (truncated if truncated is not None else F.lit(False)).alias("_t"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f)["value"].alias("value"), F.col(f)["evidence_span"].alias("evidence_span")) for f in fields))).alias("f"))
    flat = long.select(*keys, "_s", "_t", "f.*")
    n_span, n_source = normalise(F.col("evidence_span")), normalise(F.col("_s"))
    silent = F.col("value").isNull() | (F.lower(F.trim("value")).isin("not_stated", ""))
    note = F.when(silent, F.when(F.col("_t"), "not_stated_possibly_truncated").otherwise("not_stated")).otherwise(verdict(F.col("evidence_span"), F.col("_s"), n_span, n_source))
    out = flat.withColumn("note", note).withColumn("verified", is_verified(F.col("note")))
    return out.select(*keys, "field", F.when(F.col("verified"), F.col("value")).alias("value"), F.when(F.col("verified"), F.col("evidence_span")).alias("evidence_span"), "verified", "note")


def field_coverage(rows: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """Per group and field of the fixed list, those without rows too: records, verified, not stated, unverified, share."""
    groups = rows.select(*by).distinct()
    grid = groups.withColumn("field", F.explode(F.array(*(F.lit(f) for f in fields))))
    counts = rows.groupBy(*by, "field").agg(F.count("*").alias("n"), F.count(F.when(F.col("verified"), 1)).alias("n_verified"), F.count(F.when(F.col("note").startswith("not_stated"), 1)).alias("n_not_stated"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    joined = grid.join(counts, [*by, "field"], "left").select(*by, "field", zero("n"), zero("n_verified"), zero("n_not_stated"))
    return joined.withColumn("n_unverified", F.col("n") - F.col("n_verified") - F.col("n_not_stated")).withColumn("share", F.round(F.try_divide(F.col("n_verified"), F.col("n")), 6))
