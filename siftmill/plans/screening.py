"""Queries on runs: verification, metrics, agreement, ablations, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftmill.functions.verify import verify
from siftmill.operators import ablation, agreement, ingest, metrics, pipeline, ranking, responses, sampling, typology
from siftmill.plans import base as b

CATEGORIES = ["include", "exclude"]
FIELDS = ["decision", "confidence", "evidence_span"]
BUDGET = 0.05


def verify_span(spark, d):
    """Every decision's quotation checked against its record."""
    rows = verify(b.decisions(spark, d).select("run_id", "review", "work_id", "evidence_span").join(b.works(spark, d).select("review", "work_id", "title", "abstract"), ["review", "work_id"]))
    return rows.select("run_id", "review", "work_id", "note", "verified")


def verification_failures(spark, d):
    return metrics.verification_failures(b.decisions(spark, d))


def verification_by_review(spark, d):
    return metrics.verification_by_review(b.decisions(spark, d), b.truth(spark, d))


def review_metrics(spark, d):
    return metrics.review_metrics(b.decisions(spark, d), b.truth(spark, d))


def run_ranking_metrics(spark, d):
    return metrics.run_ranking(b.decisions(spark, d), b.truth(spark, d))


def failure_matrix(spark, d):
    return metrics.failure_matrix(b.decisions(spark, d))


def confidence_histogram(spark, d):
    return metrics.confidence_histogram(b.decisions(spark, d))


def latest_runs(spark, d):
    return metrics.latest_runs(b.decisions(spark, d), b.runs(spark, d))


def latency_summary(spark, d):
    return metrics.latency_summary(b.decisions(spark, d))


def cache_savings(spark, d):
    return metrics.cache_savings(b.decisions(spark, d))


def _plain_overrides(spark, d):
    return b.labels(spark, d, ("run_id", "review", "work_id")).withColumnRenamed("label", "human_decision")


def override_summary(spark, d):
    return metrics.override_summary(_plain_overrides(spark, d), b.decisions(spark, d))


def override_accuracy(spark, d):
    return metrics.override_accuracy(_plain_overrides(spark, d), b.decisions(spark, d), b.truth(spark, d))


def prevalence(spark, d):
    return metrics.prevalence(b.works(spark, d), b.truth(spark, d))


def year_histogram(spark, d):
    return metrics.year_histogram(b.works(spark, d), b.truth(spark, d))


COVERED = ["doi", "title", "abstract", "year", "venue", "publisher", "country", "language"]


def metadata_coverage(spark, d):
    return metrics.metadata_coverage(b.works(spark, d), COVERED)


def spend_meter(spark, d):
    rows = metrics.spend_meter(b.decisions(spark, d), BUDGET)
    return rows.select("run_id", "review", "work_id", F.unix_micros("created_at").alias("at_us"), "spent", "aborts")


def rater_agreement_ac1(spark, d):
    """AC1 of all raters' labels, per review."""
    return agreement.gwet(b.labels(spark, d), ["work_id"], "label", CATEGORIES, by=["review"])


def inter_run_ac1(spark, d):
    """AC1 of runs with one configuration, per configuration and review; an unverified decision is a missing rating."""
    rows = b.decisions(spark, d).join(b.runs(spark, d).select("run_id", "config_hash"), "run_id")
    said = F.when(F.col("span_verified"), F.col("decision"))
    return agreement.gwet(rows.withColumn("said", said), ["work_id"], "said", CATEGORIES, by=["config_hash", "review"])


def confidence_ac2(spark, d):
    """Quadratic AC2 of runs' confidences in four steps, per review."""
    step = F.when(F.col("confidence").between(0, 1), F.least(F.floor(F.col("confidence") * 4), F.lit(3)).cast("string"))
    return agreement.gwet(b.decisions(spark, d).withColumn("step", step), ["work_id"], "step", ["0", "1", "2", "3"], "quadratic", ["review"])


def model_human_pabak(spark, d):
    """PABAK of verified decisions and the raters' majority, per run."""
    human = F.when(F.col("label_included") == 1, "include").otherwise("exclude")
    rows = b.decisions(spark, d).filter("span_verified").join(b.truth(spark, d), ["review", "work_id"]).withColumn("human", human)
    return agreement.pabak(rows, "decision", "human", CATEGORIES, ["run_id"])


def wilson_recall(spark, d):
    """Recall per review estimated from what raters include among the verified excludes, with the Wilson bounds."""
    rows = b.decisions(spark, d).filter("span_verified").join(b.truth(spark, d), ["review", "work_id"], "left")
    c = metrics.count_if
    inc, exc = F.col("decision") == "include", F.col("decision") == "exclude"
    sums = rows.groupBy("review").agg(c(inc & (F.col("label_included") == 1)).alias("tp"), c(exc).alias("pool"), c(exc & F.col("label_included").isNotNull()).alias("sampled"), c(exc & (F.col("label_included") == 1)).alias("misses"))
    return sums.select("*", *agreement.estimated_recall(F.col("tp"), F.col("pool"), F.col("sampled"), F.col("misses")))


def _arms(spark, d):
    """Models as arms: a record's verified decision by each model (the last run's), as a stated gap or not."""
    rows = b.decisions(spark, d).join(b.runs(spark, d).select("run_id", "model"), "run_id")
    last = rows.groupBy("review", "work_id", "model").agg(F.max_by(F.struct("decision", "span_verified", "evidence_span"), "run_id").alias("r"))
    value = F.when(F.col("r.span_verified"), F.when(F.col("r.decision") == "include", "gap_stated").otherwise("not_stated"))
    return last.select("review", "work_id", F.col("model").alias("arm"), value.alias("value"), "r.evidence_span", "r.decision", "r.span_verified")


def _all_arms(spark, d):
    """The models of all runs, by name: as many as were configured."""
    return [r["model"] for r in b.runs(spark, d).select("model").filter("model is not null").distinct().orderBy("model").collect()]


def arm_consensus(spark, d):
    """Consensus of all models on the records that each of them saw; flagged has every model with its count."""
    names = _all_arms(spark, d)
    rows = agreement.arms(_arms(spark, d), names)
    flagged = F.concat_ws(" ", *(F.concat(F.lit(f"{a}:"), F.col(f"`flagged_{a}`").cast("string")) for a in names))
    return rows.select("review", "n_records", "n_rated_by_every_arm", flagged.alias("flagged"), "n_unanimous", "n_disagreed", "both", "either")


def arm_disagreements(spark, d):
    """Records on which any two models with verified answers differ, with the value of every model that rated them."""
    rows = agreement.disagreements(_arms(spark, d).filter("value is not null and arm is not null"))
    said = F.array_join(F.transform(F.map_entries("said"), lambda e: F.concat(e["key"], F.lit(":"), e["value"]["value"])), " ")
    return rows.select("review", "work_id", F.size("said").cast("bigint").alias("n_rated"), said.alias("said"))


def suggestion_combine(spark, d):
    """One answer per record from all models."""
    order = F.row_number().over(metrics.W.partitionBy("review", "work_id").orderBy("arm"))
    rows = _arms(spark, d).withColumn("arm_no", order).withColumn("gap_stated", F.coalesce(F.col("value") == "gap_stated", F.lit(False)))
    return agreement.combine_verdicts(rows, ["review", "work_id"])


def reading_order(spark, d):
    """All records in the order they are read: backed by the models, referred, set aside; each by its likeness to the question."""
    near = ranking.dense(b.works(spark, d), b.questions(spark, d)).select("review", "work_id", F.col("score").alias("similarity"))
    rows = suggestion_combine(spark, d).join(near, ["review", "work_id"], "left")
    return pipeline.reading_order(rows, ["review"], "work_id").select("review", "work_id", "reading_group", "rank")


def discovered_records(spark, d):
    """Records without duplicates and short abstracts, with the decision of the remembered answer and its quotation."""
    found = b.works(spark, d).select("review", "work_id", "title", "abstract", "doi", "year")
    answers = b.cache(spark, d).groupBy("review", "work_id").agg(F.max_by("raw_response", "cache_key").alias("raw_response"))
    parsed = answers.select("review", "work_id", responses.parse_decision(F.col("raw_response")).alias("p"))
    quoted = parsed.select("review", "work_id", F.struct(F.col("p.evidence_span").alias("value"), F.col("p.evidence_span").alias("evidence_span")).alias("quote"))
    return pipeline.discover(found, answers, quoted, ["quote"], "work_id").select("review", "work_id", "decision", "verify_note", "quote")


def recover_proposals(spark, d):
    return responses.recover_proposals(b.decisions(spark, d), b.cache(spark, d)).select("run_id", "review", "work_id", "proposed", "recovered")


def verifier_ablation(spark, d):
    return ablation.verifier_ablation(responses.recover_proposals(b.decisions(spark, d), b.cache(spark, d)), b.truth(spark, d))


def prompt_stage_ablation(spark, d):
    """Mean TNR by prompt version and review, against the first version."""
    ranked = run_ranking_metrics(spark, d).join(b.runs(spark, d).select("run_id", "prompt_version"), "run_id")
    stages = ranked.groupBy("review", F.col("prompt_version").alias("stage")).agg(F.round(F.avg("tnr"), 6).alias("tnr"))
    return ablation.stage_ablation(stages, "screen_v1")


def typology_failures(spark, d):
    return typology.failures(b.decisions(spark, d), b.works(spark, d), b.criteria(spark, d))


def typology_distribution(spark, d):
    return typology.distribution(typology_failures(spark, d))


def typology_wrong(spark, d):
    return typology.wrong_by_category(typology_failures(spark, d), b.truth(spark, d))


def typology_sample(spark, d):
    """Fifty failures to rate, spread over the reviews in proportion."""
    failed = b.decisions(spark, d).filter("not span_verified").select("run_id", "review", "work_id")
    return sampling.proportional(failed, "review", 50, 42, ["run_id", "review", "work_id"])


def stratified_sample(spark, d):
    """Five verified decisions per review and decision, in hash order."""
    rows = b.decisions(spark, d).filter("span_verified").select("run_id", "review", "work_id", "decision")
    return sampling.stratified(rows, ["review", "decision"], 5, 42, ["run_id", "review", "work_id"])


def label_aware_sample(spark, d):
    """All included records and excluded ones up to thirty a review."""
    return sampling.keep_included(b.truth(spark, d), "review", 30, 42, ["review", "work_id"])


def screen_responses(spark, d):
    """Remembered answers parsed, shape-checked and verified."""
    cache = b.cache(spark, d).select("cache_key", "review", "work_id", "raw_response")
    return responses.screen(cache, b.works(spark, d), ["cache_key"]).select("cache_key", "decision", "confidence", "span_verified", "verify_note")


def cache_lookup(spark, d):
    """Decisions' cache keys against the remembered answers: how many are held."""
    keys = b.decisions(spark, d).filter("cache_key is not null").select("cache_key").distinct()
    held = b.cache(spark, d)
    asked = keys.join(held.select("cache_key", "request_sha256"), "cache_key", "left").withColumn("request_sha256", F.coalesce("request_sha256", F.lit("none")))
    return responses.cache_lookup(asked, held).groupBy("status").agg(F.count("*").alias("n"))


def field_coverage(spark, d):
    """Which parts of an answer remembered responses give, by model."""
    cache = b.cache(spark, d).join(b.works(spark, d).select("review", "work_id", "title", "abstract"), ["review", "work_id"])
    parsed = cache.select("model", "cache_key", F.concat_ws(" ", "title", "abstract").alias("source"), responses.parse_decision(F.col("raw_response")).alias("p"))
    answer = lambda v: F.struct(v.cast("string").alias("value"), F.col("p.evidence_span").alias("evidence_span"))
    answers = parsed.select("model", "cache_key", "source", answer(F.col("p.decision")).alias("decision"), answer(F.col("p.confidence")).alias("confidence"))
    return responses.field_coverage(responses.field_answers(answers, ["model", "cache_key"], ["decision", "confidence"], "source"), ["model"], ["decision", "confidence", "key_finding"])


def corpus_fingerprint(spark, d):
    """Fingerprint of every review's records."""
    return ingest.fingerprint(b.works(spark, d), ["review"], F.col("work_id"), [F.col("work_id"), F.col("title"), F.col("abstract")])


def upsert_decisions(spark, d):
    """The earlier deliveries of all decisions overwritten by the later ones: the last of every key stands."""
    rows = b.table(spark, d, "screening_decision").select("run_id", "review", "work_id", "decision", "confidence", "created_at")
    old = rows.filter("created_at < timestamp '2026-06-01'")
    new = rows.filter("created_at >= timestamp '2026-06-01'")
    kept = ingest.upsert(ingest.upsert(old.limit(0), old, ["run_id", "review", "work_id"], "created_at"), new, ["run_id", "review", "work_id"], "created_at")
    return kept.select("run_id", "review", "work_id", "decision", "confidence", F.unix_micros("created_at").alias("at_us"))


def reviews_without_records(spark, d):
    """Reviews without a record of the last year but one."""
    return ingest.without_records(b.criteria(spark, d), b.works(spark, d).filter("year = 2024"))


def criteria_status(spark, d):
    return ingest.criteria_of(b.works(spark, d), b.criteria(spark, d), "draft").withColumn("criteria", F.length("criteria").cast("bigint"))


def clean_works(spark, d):
    """Records with cleaned texts, years and DOIs."""
    rows = ingest.clean(b.works(spark, d).select("review", "work_id", "doi", "title", "abstract", "year"), ["title", "abstract"])
    return rows.select("review", "work_id", ingest.normalise_doi(F.col("doi")).alias("doi"), F.length("title").cast("bigint").alias("title_chars"), F.length("abstract").cast("bigint").alias("abstract_chars"), "year")


def web_duplicates(spark, d):
    """Records of each review that an earlier one (by id) shares a DOI, or a title and year, with."""
    rows = b.works(spark, d).select("review", "work_id", "doi", "title", "year")
    return ingest.web_duplicates(rows, ["review"], "work_id").select("review", "work_id", "kept")


def cached_prompts(spark, d):
    """Requests as this library would word them, by their fingerprints."""
    template = "CRITERIA:\n{criteria}\n\nTITLE:\n{title}\n\nABSTRACT:\n{abstract}"
    rows = b.works(spark, d).join(b.criteria(spark, d).select("review", "criteria"), "review")
    text = responses.prompt(template, criteria=F.col("criteria"), title=F.col("title"), abstract=F.col("abstract"))
    return rows.select("review", "work_id", F.sha2(text, 256).alias("request_sha256"), ingest.cache_key(F.lit("model"), F.lit("v1"), F.col("review"), F.col("work_id")).alias("cache_key"))


NAMES = [
    verify_span, verification_failures, verification_by_review, review_metrics, run_ranking_metrics, failure_matrix, confidence_histogram, latest_runs, latency_summary, cache_savings, override_summary,
    override_accuracy, prevalence, year_histogram, metadata_coverage, spend_meter, rater_agreement_ac1, inter_run_ac1, confidence_ac2, model_human_pabak, wilson_recall, arm_consensus, arm_disagreements,
    suggestion_combine, reading_order, discovered_records, recover_proposals, verifier_ablation, prompt_stage_ablation, typology_failures, typology_distribution, typology_wrong, typology_sample, stratified_sample, label_aware_sample,
    screen_responses, cache_lookup, field_coverage, corpus_fingerprint, upsert_decisions, reviews_without_records, criteria_status, clean_works, web_duplicates, cached_prompts,
]
QUERIES = {q.__name__: q for q in NAMES}
