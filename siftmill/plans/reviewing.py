"""Queries on ratings, guards, sessions, harnesses and extracted fields, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftmill.operators import gaps, pipeline, ranking, responses, sampling
from siftmill.plans import base as b
from siftmill.plans.screening import suggestion_combine
from siftmill.operators.documents import GAP_CUE
from siftmill.plans.sql import SENTENCES as _sentences
from siftmill.plans.sql import SQL as _SQL
from siftmill.plans.sql import bm25
from siftmill.plans.sql import ranking as ranking_sql


def _stated(spark, d):
    """review, work_id, value: what the last run that saw a record says of a gap; null where nothing was verified."""
    last = b.decisions(spark, d).groupBy("review", "work_id").agg(F.max_by(F.struct("decision", "span_verified"), "run_id").alias("r"))
    return last.select("review", "work_id", F.when(F.col("r.span_verified"), F.when(F.col("r.decision") == "include", "gap_stated").otherwise("not_stated")).alias("value"))


def gap_precision(spark, d):
    """Stated gaps per review, their ratings and precision."""
    return gaps.gap_precision(_stated(spark, d), b.truth(spark, d).select("review", "work_id", (F.col("label_included") == 1).alias("valid")))


def gap_precision_recall(spark, d):
    """Gap precision beside the recall estimated for the same review."""
    from siftmill.plans.screening import wilson_recall

    return gaps.beside_recall(gap_precision(spark, d), wilson_recall(spark, d))


def _notes(spark, d):
    said = F.lower(F.regexp_replace("human_decision", r"^\s+|\s+$", ""))
    rows = b.table(spark, d, "overrides").select("review", "work_id", "rater_id", said.alias("label"), F.coalesce("rationale", F.lit("")).alias("note"), "created_at").filter("label in ('include', 'exclude')")
    last = rows.groupBy("review", "work_id", "rater_id").agg(F.max(F.struct("created_at", "label", "note")).alias("r"))
    return last.select("review", "work_id", "rater_id", (F.col("r.label") == "include").alias("gap"), F.nullif(F.col("r.note"), F.lit("")).alias("note"))


def gap_sample_scores(spark, d):
    """A blind sample of five records without and five with a stated gap per review, scored by the raters."""
    rows = _stated(spark, d).filter("value is not null").withColumn("stratum", F.when(F.col("value") == "gap_stated", "control").otherwise("pool"))
    sample = sampling.stratified(rows.select("review", "work_id", "stratum"), ["review", "stratum"], 5, 42, ["review", "work_id"])
    return gaps.sample_scores(sample, _notes(spark, d), "cohort")


def override_writes(spark, d):
    """Labels given, by whether they may be written: plain labels on verified or failed decisions that exist."""
    said = F.lower(F.regexp_replace("human_decision", r"^\s+|\s+$", ""))
    rows = b.table(spark, d, "overrides").select("run_id", "review", "work_id", "rater_id", said.alias("label"))
    return gaps.guarded(rows, b.decisions(spark, d), "label", ["include", "exclude"]).groupBy("review", "status").agg(F.count("*").alias("n"))


def gap_ratings(spark, d):
    """Ratings of stated gaps only: what may be written, per review."""
    said = F.lower(F.regexp_replace("human_decision", r"^\s+|\s+$", ""))
    rows = b.table(spark, d, "overrides").select("run_id", "review", "work_id", "rater_id", said.alias("label"))
    return gaps.guarded(rows, b.decisions(spark, d), "label", ["include", "exclude"], only="include").groupBy("review", "status").agg(F.count("*").alias("n"))


def session_counts(spark, d):
    return gaps.session_counts(suggestion_combine(spark, d), b.decisions(spark, d))


def labelled_records(spark, d):
    """Labels looked up for the records that have ratings; an unknown id would fail."""
    known = b.truth(spark, d)
    return gaps.known_only(known.select("review", "work_id"), known)


def scoped_records(spark, d):
    """What a screening prompt may see, in all reviews but one that is set apart."""
    rows = gaps.scoped(gaps.safe(b.works(spark, d)), ad_hoc="Harbour_2017")
    return rows.groupBy("review").agg(F.count("*").alias("n"), F.count("abstract").alias("with_abstract"))


def one_paper(spark, d):
    """The first record of each review, and what all runs made of it."""
    first = ranking.one_record(b.works(spark, d).select("review", "work_id", "title"), ["review"])
    rows = first.join(b.decisions(spark, d), ["review", "work_id"], "left")
    return rows.groupBy("review", "work_id").agg(F.count("decision").alias("n_decisions"), F.count(F.when(F.col("span_verified"), 1)).alias("n_verified"), F.count(F.when(F.col("decision") == "include", 1)).alias("n_include"))


def harness_bm25(spark, d):
    """A run from configuration to metrics: twenty records a review by BM25, decided by each review's last run."""
    config = pipeline.HarnessConfig(strategy="bm25", max_records=20)
    last = b.decisions(spark, d).groupBy("review").agg(F.max("run_id").alias("run_id"))
    made = b.decisions(spark, d).join(last, ["review", "run_id"])
    works = b.works(spark, d)
    asked = b.questions(spark, d).join(works.select("review").distinct(), "review", "left_semi")  # the configured reviews: those with records
    return pipeline.harness(config, works, asked, made, b.truth(spark, d))


#: Fields asked of a record.
FIELDS = ["population", "intervention", "outcome", "design"]


def _extracted(spark, d):
    """Answers with four fields as a model gives them: two quotations of the abstract, an invented one, one not stated."""
    works = b.works(spark, d).select("review", "work_id", "title", "abstract")
    text = F.coalesce("abstract", F.lit(""))
    field = lambda value, span: F.struct(F.lit(value).alias("value"), span.alias("evidence_span"))
    raw = F.to_json(
        F.struct(
            field("adults", F.substring(text, 1, 60)).alias("population"), field("walking", F.lit("An invented quotation that stands nowhere")).alias("intervention"), field("not_stated", F.lit("")).alias("outcome"), field("trial", F.substring(text, 31, 50)).alias("design")
        )
    )
    return works.select("review", "work_id", F.concat_ws(" ", F.nullif(F.col("title"), F.lit("")), F.nullif(F.col("abstract"), F.lit(""))).alias("source"), responses.parse_fields(raw, FIELDS).alias("p"))


def extract_fields(spark, d):
    """Four fields parsed, verified and nulled where unbacked: a count per review, field and note."""
    rows = _extracted(spark, d)
    flat = rows.select("review", "work_id", "source", *(F.col("p")[f].alias(f) for f in FIELDS))
    return responses.field_answers(flat, ["review", "work_id"], FIELDS, "source").groupBy("review", "field", "note").agg(F.count("*").alias("n"), F.count("value").alias("n_values"))


def find_gaps(spark, d):
    """Proposed gaps of every paper, its title as a quotation first, then its candidate sentences: how many stand."""
    from siftmill.operators import documents

    papers = b.papers(spark, d).select(F.col("pmcid").alias("id"), "title", F.col("body").alias("text"))
    offered = documents.gap_candidates(papers, ["id"], "text")
    titles = papers.select("id", F.lit(0).cast("bigint").alias("position"), F.lit("gap").alias("value"), F.col("title").alias("evidence_span"))
    items = offered.select("id", F.col("candidate_no").alias("position"), F.lit("gap").alias("value"), F.col("sentence").alias("evidence_span")).unionByName(titles)
    kept, counts = pipeline.accepted_gaps(items, offered.select("id", "sentence"), papers.select("id", "text"))
    return counts.withColumnRenamed("id", "pmcid")


NAMES = [gap_precision, gap_precision_recall, gap_sample_scores, override_writes, gap_ratings, session_counts, labelled_records, scoped_records, one_paper, harness_bm25, extract_fields, find_gaps]
QUERIES = {q.__name__: q for q in NAMES}

_STATED = """st AS (SELECT review, work_id, CASE WHEN span_verified THEN CASE WHEN decision = 'include' THEN 'gap_stated' ELSE 'not_stated' END END AS value
    FROM d QUALIFY row_number() OVER (PARTITION BY review, work_id ORDER BY run_id DESC) = 1)"""
_c = lambda test: f"count(CASE WHEN {test} THEN 1 END)"
SQL = {
    "gap_precision": f"""WITH {b.DECISIONS}, {b.TRUTH}, {_STATED}, e AS (SELECT review, count(*) AS n_records, {_c("value = 'gap_stated'")} AS n_stated, {_c("value = 'gap_stated' AND label_included = 1")} AS n_valid,
        {_c("value = 'gap_stated' AND label_included = 0")} AS n_invalid, {_c("value = 'gap_stated' AND label_included IS NULL")} AS n_unrated FROM st LEFT JOIN t USING (review, work_id) GROUP BY 1)
        SELECT *, {b.ratio('n_stated', 'n_records')} AS gap_rate, {b.ratio('n_valid', 'n_valid + n_invalid')} AS precision FROM e""",
    "gap_sample_scores": rf"""WITH {b.DECISIONS}, {_STATED}, sm AS (SELECT review, work_id, CASE WHEN value = 'gap_stated' THEN 'control' ELSE 'pool' END AS stratum FROM st WHERE value IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY review, value ORDER BY md5(concat_ws(':', '42', review, work_id)), review, work_id) <= 5),
        n0 AS (SELECT review, work_id, rater_id, created_at, lower(regexp_replace(human_decision, '^\s+|\s+$', '', 'g')) AS label, coalesce(rationale, '') AS note FROM overrides),
        n1 AS (SELECT * FROM n0 WHERE label IN ('include', 'exclude') QUALIFY row_number() OVER (PARTITION BY review, work_id, rater_id ORDER BY created_at DESC, label DESC, note DESC) = 1),
        v AS (SELECT review, work_id, sum(CASE WHEN label = 'include' THEN 1 ELSE -1 END) > 0 AS gap, bool_or(note = '' OR NOT note ILIKE '%cohort%') AS op FROM n1 GROUP BY 1, 2)
        SELECT review, {_c("stratum = 'pool'")} AS n_sampled, {_c("stratum = 'pool' AND gap IS NOT NULL")} AS n_rated, {_c("stratum = 'pool' AND gap")} AS misses, {_c("stratum = 'pool' AND gap AND op")} AS open_misses,
            {_c("stratum = 'control' AND gap IS NOT NULL")} AS n_controls, {b.ratio(_c("stratum = 'control' AND gap"), _c("stratum = 'control' AND gap IS NOT NULL"))} AS control_agreement FROM sm LEFT JOIN v USING (review, work_id) GROUP BY 1""",
    "session_counts": f"""WITH {b.DECISIONS}, e AS ({_SQL['suggestion_combine']}), q AS (SELECT review, count(*) AS quotes FROM d WHERE span_verified GROUP BY 1)
        SELECT review, count(*) AS n_papers, {_c('relevant')} AS included, {_c("lead_verified AND decision = 'exclude'")} AS excluded, {_c('NOT lead_verified')} AS referred, {_c("agreement = 'split'")} AS split, {_c('gap_stated')} AS gaps,
            coalesce(any_value(quotes), 0) AS quotes FROM e LEFT JOIN q USING (review) GROUP BY review""",
    "labelled_records": f"WITH {b.TRUTH} SELECT review, work_id, label_included FROM t",
    "scoped_records": f"WITH {b.WORKS} SELECT review, count(*) AS n, count(abstract) AS with_abstract FROM w WHERE review <> 'Harbour_2017' GROUP BY 1",
    "one_paper": f"""WITH {b.WORKS}, {b.DECISIONS}, o AS (SELECT review, min(work_id) AS work_id FROM w GROUP BY 1) SELECT review, work_id, count(decision) AS n_decisions, {_c('span_verified')} AS n_verified,
        {_c("decision = 'include'")} AS n_include FROM o LEFT JOIN d USING (review, work_id) GROUP BY 1, 2""",
    "harness_bm25": f"""WITH {b.WORKS}, {b.DECISIONS}, {b.TRUTH}, {bm25()}, hd AS (SELECT * FROM bm WHERE rank <= 20), la AS (SELECT review, max(run_id) AS run_id FROM d GROUP BY 1),
        sc AS (SELECT review, count(*) AS n_head, count(decision) AS n_screened, {_c('span_verified')} AS n_verified, {_c("NOT coalesce(span_verified AND decision = 'exclude', false)")} AS n_to_human FROM hd LEFT JOIN (SELECT d.* FROM d JOIN la USING (review, run_id)) USING (review, work_id) GROUP BY 1),
        i AS (SELECT review, rank, label_included FROM hd JOIN t USING (review, work_id)), rk AS (WITH {ranking_sql('i', 'review').strip()})
        SELECT review, n_head, n_screened, n_verified, n_to_human, n_ranked, n_included, complete, cutoff, recall_at_cutoff, tnr, wss FROM sc LEFT JOIN rk USING (review)""",
}
SQL["gap_precision_recall"] = f"WITH e AS ({SQL['gap_precision']}), x AS ({_SQL['wilson_recall']}) SELECT review, n_stated, precision, recall, recall_low, recall_high FROM e LEFT JOIN x USING (review)"
_STATUS = r"""WITH {decisions}, o AS (SELECT run_id, review, work_id, lower(regexp_replace(human_decision, '^\s+|\s+$', '', 'g')) AS label FROM overrides)
    SELECT review, CASE WHEN label IS NULL OR label NOT IN ('include', 'exclude') THEN 'not_a_label' WHEN decision IS NULL THEN 'no_decision' {more} ELSE 'written' END AS status, count(*) AS n FROM o LEFT JOIN d USING (run_id, review, work_id) GROUP BY 1, 2"""
SQL["override_writes"] = _STATUS.format(decisions=b.DECISIONS, more="")
SQL["gap_ratings"] = _STATUS.format(decisions=b.DECISIONS, more="WHEN decision <> 'include' THEN 'not_ratable'")
_QUOTED = " UNION ALL ".join(f"SELECT review, work_id, title, abstract, '{f}' AS field, '{value}' AS value, {span} AS evidence_span FROM w" for f, value, span in (("population", "adults", "left(coalesce(abstract, ''), 60)"), ("intervention", "walking", "'An invented quotation that stands nowhere'"), ("outcome", "not_stated", "''"), ("design", "trial", "substring(coalesce(abstract, ''), 31, 50)")))
_N = b.normalised
SQL["extract_fields"] = f"""WITH {b.WORKS}, j AS ({_QUOTED}), v AS (SELECT *, {_N('evidence_span')} AS ns, {_N('src')} AS nt FROM (SELECT *, concat_ws(' ', nullif(title, ''), nullif(abstract, '')) AS src FROM j)),
    n AS (SELECT *, trim(ns, '"''.,;:()[] ') AS bare, left(ns, greatest(20, length(ns) // 2)) AS probe FROM v),
    r AS (SELECT *, CASE WHEN value = 'not_stated' THEN 'not_stated' WHEN trim(evidence_span) = '' OR ns = '' THEN 'empty_span' WHEN nt = '' THEN 'no_source_text' WHEN length(ns) < 20 THEN 'span_too_short(<20chars)'
        WHEN length(ns) > length(nt) THEN 'span_longer_than_source' WHEN contains(nt, ns) THEN 'exact_after_normalisation' WHEN length(bare) >= 20 AND bare <> ns AND contains(nt, bare) THEN 'exact_after_punctuation_strip'
        WHEN contains(nt, probe) THEN 'partial_match_only' ELSE 'not_found' END AS note FROM n)
    SELECT review, field, note, count(*) AS n, count(CASE WHEN note LIKE 'exact%' THEN value END) AS n_values FROM r GROUP BY 1, 2, 3"""
_SENT = _sentences.format(text="body")
SQL["find_gaps"] = f"""WITH {b.PAPERS}, e AS (SELECT pmcid, unnest({_SENT}) AS sentence, generate_subscripts({_SENT}, 1) AS pos FROM f),
    k AS (SELECT *, {_N('sentence')} AS n FROM e WHERE length(sentence) >= 25 AND regexp_matches(sentence, '{GAP_CUE}')),
    o AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY pmcid, n ORDER BY pos) = 1), c AS (SELECT pmcid, count(*) AS n FROM (SELECT pmcid FROM o QUALIFY row_number() OVER (PARTITION BY pmcid ORDER BY pos) <= 12) GROUP BY 1),
    h AS (SELECT pmcid, length({_N('title')}) >= 20 AND (contains({_N('body')}, {_N('title')}) OR length(trim({_N('title')}, '"''.,;:()[] ')) >= 20 AND contains({_N('body')}, trim({_N('title')}, '"''.,;:()[] '))) AS there FROM f)
    SELECT pmcid, least(coalesce(c.n, 0), 5) AS n_kept, CASE WHEN there THEN 0 ELSE 1 END AS n_unsupported, CASE WHEN there THEN 1 ELSE 0 END AS n_withheld FROM h LEFT JOIN c USING (pmcid)"""
