"""DuckDB SQL of the core's queries, on whole tables."""

from __future__ import annotations

from siftmill.operators.documents import BACK_MATTER, GAP_CUE, LIMITATION_HEADING, LIMITED, LIMITED_HEADING, METHOD_HEADING, MODEL, RESULT_HEADING, STATISTIC
from siftmill.plans.base import CACHE, DECISIONS, LABELS, PAPERS, SECTIONS, TRUTH, WORKS, normalised, ratio

_SPAN, _SOURCE = normalised("evidence_span"), normalised("src")
VERIFY = f"""v AS (SELECT *, {_SPAN} AS ns, {_SOURCE} AS nt FROM (
        SELECT d.*, concat_ws(' ', nullif(title, ''), nullif(abstract, '')) AS src FROM d JOIN w USING (review, work_id))),
    n AS (SELECT *, trim(ns, '"''.,;:()[] ') AS bare, left(ns, greatest(20, length(ns) // 2)) AS probe FROM v),
    r AS (SELECT *, CASE WHEN evidence_span IS NULL OR trim(evidence_span) = '' OR ns = '' THEN 'empty_span'
        WHEN nt = '' THEN 'no_source_text' WHEN length(ns) < 20 THEN 'span_too_short(<20chars)'
        WHEN length(ns) > length(nt) THEN 'span_longer_than_source' WHEN contains(nt, ns) THEN 'exact_after_normalisation'
        WHEN length(bare) >= 20 AND bare <> ns AND contains(nt, bare) THEN 'exact_after_punctuation_strip'
        WHEN contains(nt, probe) THEN 'partial_match_only' ELSE 'not_found' END AS note FROM n)"""

HUMAN = "NOT (span_verified AND decision = 'exclude')"


def ranking(found: str, by: str, truth_total: str = "t") -> str:
    """Ranking metrics from a table of (by, rank, label_included)."""
    return f"""
        o AS (SELECT {by}, review AS rv, row_number() OVER p AS rank, label_included, sum(label_included) OVER (PARTITION BY {by} ORDER BY rank ROWS UNBOUNDED PRECEDING) AS found
              FROM {found} WINDOW p AS (PARTITION BY {by} ORDER BY rank)),
        a AS (SELECT {by}, rv, count(*) AS n_ranked, CAST(sum(label_included) AS BIGINT) AS n_included FROM o GROUP BY {by}, rv),
        k AS (SELECT {by}, min(rank) AS cutoff, CAST(min_by(found, rank) AS BIGINT) AS tp FROM o JOIN a USING ({by}, rv)
              WHERE n_included > 0 AND found >= ceil(CAST(0.95 AS DECIMAL(5,4)) * n_included) GROUP BY {by}),
        tt AS (SELECT review AS rv, count(*) AS n_truth FROM {truth_total} GROUP BY review)
        SELECT {by}, n_ranked, n_included, n_ranked = n_truth AS complete, cutoff, {ratio('tp', 'n_included')} AS recall_at_cutoff,
            {ratio('n_ranked - n_included - (cutoff - tp)', 'n_ranked - n_included')} AS tnr,
            round((n_ranked - n_included - (cutoff - tp) + n_included - tp)::DOUBLE / n_ranked - (1 - 0.95::DOUBLE), 6) AS wss
        FROM a LEFT JOIN k USING ({by}) LEFT JOIN tt USING (rv)"""


ORDERED = """row_number() OVER (PARTITION BY {by} ORDER BY CASE WHEN NOT span_verified THEN 1 WHEN decision = 'include' THEN 0 ELSE 2 END,
    CASE WHEN NOT span_verified THEN 0.0 WHEN decision = 'include' THEN -coalesce(confidence, 0.0) ELSE coalesce(confidence, 0.0) END, work_id) AS rank"""


def bm25(questions: str = "SELECT review, criteria AS question FROM review_criteria") -> str:
    return f"""
        q AS (SELECT review, unnest(list_distinct(list_filter(regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}_]+'), lambda x: length(x) > 2))) AS term FROM ({questions})),
        b0 AS (SELECT review, work_id, regexp_extract_all(lower(concat_ws(' ', title, abstract)), '[\\p{{L}}\\p{{N}}]+') AS ws FROM w WHERE review IN (SELECT review FROM ({questions}))),
        b1 AS (SELECT review, work_id, ws, len(ws) AS size, count(*) OVER p AS n, avg(len(ws)) OVER p AS mean FROM b0 WINDOW p AS (PARTITION BY review)),
        b2 AS (SELECT review, work_id, size, n, mean, unnest(ws) AS term FROM b1),
        b3 AS (SELECT review, work_id, size, n, mean, term, count(*) AS tf FROM b2 SEMI JOIN q USING (review, term) GROUP BY ALL),
        b4 AS (SELECT *, count(*) OVER (PARTITION BY review, term) AS df FROM b3),
        b5 AS (SELECT review, work_id, round(sum((CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END)
                * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean))), 9) AS score FROM b4 GROUP BY ALL),
        bm AS (SELECT review, work_id, score, row_number() OVER (PARTITION BY review ORDER BY score DESC NULLS LAST, work_id) AS rank FROM b0 LEFT JOIN b5 USING (review, work_id))"""


def places(rows: str, keys: str, text: str) -> str:
    """Counts of a text's words in hashed places."""
    word = f"unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+'))"
    return f"SELECT {keys}, ('0x' || left(md5(word), 4))::INTEGER % 64 AS place, count(*)::DOUBLE AS n FROM (SELECT {keys}, {word} AS word FROM {rows}) GROUP BY ALL"


DENSE = f"""
        dv AS ({places('w', 'review, work_id', "concat_ws(' ', nullif(title, ''), nullif(abstract, ''))")}), qv AS ({places('review_criteria', 'review', 'criteria')}),
        dl AS (SELECT review, work_id, sqrt(sum(n * n)) AS l FROM dv GROUP BY ALL), ql AS (SELECT review, sqrt(sum(n * n)) AS l FROM qv GROUP BY ALL),
        dd AS (SELECT review, work_id, sum(dv.n * qv.n) AS dot FROM dv JOIN qv USING (review, place) GROUP BY ALL),
        ds AS (SELECT w.review, w.work_id, round(coalesce(dot / (dl.l * ql.l), 0.0), 9) AS score FROM w JOIN ql USING (review) LEFT JOIN dl USING (review, work_id) LEFT JOIN dd USING (review, work_id)),
        de AS (SELECT review, work_id, score, row_number() OVER (PARTITION BY review ORDER BY score DESC, work_id) AS rank FROM ds)"""
HYBRID = f"""{bm25()}, {DENSE}, hs AS (SELECT review, work_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM (SELECT review, work_id, rank FROM bm UNION ALL SELECT review, work_id, rank FROM de) GROUP BY ALL),
        hy AS (SELECT review, work_id, score, row_number() OVER (PARTITION BY review ORDER BY score DESC, work_id) AS rank FROM hs)"""
RANDOM = "rr AS (SELECT review, work_id, row_number() OVER (PARTITION BY review ORDER BY md5(concat_ws(':', '42', work_id)), work_id) AS rank FROM w)"


def gwet(rows: str, unit: str, category: str, categories: list[str], by: str, quadratic: bool = False) -> str:
    q, last = len(categories), len(categories) - 1
    weight = lambda i, j: (1 - ((i - j) / last) ** 2) if quadratic else float(i == j)
    counts = ", ".join(f"count(CASE WHEN {category} = '{c}' THEN 1 END)::DOUBLE AS c{i}" for i, c in enumerate(categories))
    inside = ", ".join(f"'{c}'" for c in categories)
    paired = " + ".join(f"c{i} * (" + " + ".join(f"{weight(i, j)!r} * c{j}" for j in range(q)) + " - 1)" for i in range(q))
    total = sum(weight(i, j) for i in range(q) for j in range(q)) / (q * (q - 1))
    return f"""
        u AS (SELECT {by}, {unit}, {counts}, count(*)::DOUBLE AS r FROM {rows} WHERE {category} IN ({inside}) GROUP BY {by}, {unit}),
        z AS (SELECT {by}, avg(CASE WHEN r >= 2 THEN ({paired}) / (r * (r - 1)) END) AS pa, {', '.join(f'avg(c{i} / r) AS p{i}' for i in range(q))},
              count(*) AS n_units, count(CASE WHEN r >= 2 THEN 1 END) AS n_paired FROM u GROUP BY {by}),
        y AS (SELECT *, {total!r} * ({' + '.join(f'p{i} * (1 - p{i})' for i in range(q))}) AS pe FROM z)
        SELECT {by}, round(CASE WHEN pe = 1 THEN NULL ELSE (pa - pe) / (1 - pe) END, 6) AS coefficient, round(pa, 6) AS pa, round(pe, 6) AS pe, n_units, n_paired FROM y"""


ARMS = """m AS (SELECT review, work_id, model AS arm, max_by({'d': decision, 'v': span_verified, 'e': evidence_span}, run_id) AS r
        FROM d JOIN screening_run USING (run_id) GROUP BY ALL),
    g AS (SELECT review, work_id, arm, CASE WHEN r.v THEN CASE WHEN r.d = 'include' THEN 'gap_stated' ELSE 'not_stated' END END AS value, r.d AS decision, r.v AS span_verified FROM m)"""

#: Sentences as functions.text.sentences has them: ends marked first, as this engine's patterns cannot look back.
SENTENCES = r"list_filter(list_transform(string_split_regex(regexp_replace({text}, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '')"

SQL = {
    "verify_span": f"WITH {WORKS}, {DECISIONS}, {VERIFY} SELECT run_id, review, work_id, note, note LIKE 'exact%' AS verified FROM r",
    "verification_failures": f"""WITH {DECISIONS} SELECT run_id, coalesce(verify_note, '') AS note, count(*) AS n,
        round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY run_id), 6) AS share FROM d WHERE NOT span_verified GROUP BY 1, 2""",
    "verification_by_review": f"""WITH {DECISIONS}, {TRUTH}, p AS (SELECT review, round(avg(label_included), 6) AS prevalence FROM t GROUP BY 1),
        e AS (SELECT review, count(*) AS n_screened, count(CASE WHEN span_verified THEN 1 END) AS n_verified FROM d GROUP BY 1)
        SELECT review, prevalence, n_screened, n_verified, {ratio('n_verified', 'n_screened')} AS rate FROM e JOIN p USING (review)""",
    "review_metrics": f"""WITH {DECISIONS}, {TRUTH}, p AS (SELECT review, count(*) AS n_records, CAST(sum(label_included) AS BIGINT) AS n_included_truth FROM t GROUP BY 1),
        e AS (SELECT run_id, review, count(*) AS n_screened, count(CASE WHEN label_included = 1 THEN 1 END) AS n_included_screened,
            count(CASE WHEN span_verified THEN 1 END) AS n_verified, count(CASE WHEN decision = 'error' THEN 1 END) AS n_errors,
            count(CASE WHEN NOT span_verified AND decision <> 'error' THEN 1 END) AS n_unverified,
            count(CASE WHEN span_verified AND decision = 'include' AND label_included = 1 THEN 1 END) AS true_positives,
            count(CASE WHEN span_verified AND decision = 'include' AND label_included = 0 THEN 1 END) AS false_positives,
            count(CASE WHEN span_verified AND decision <> 'include' AND label_included = 1 THEN 1 END) AS false_negatives,
            count(CASE WHEN span_verified AND decision <> 'include' AND label_included = 0 THEN 1 END) AS true_negatives,
            count(CASE WHEN {HUMAN} THEN 1 END) AS n_to_human, count(CASE WHEN {HUMAN} AND label_included = 1 THEN 1 END) AS kept,
            CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out
            FROM d JOIN t USING (review, work_id) GROUP BY 1, 2)
        SELECT run_id, review, n_records, n_included_truth, coalesce({ratio('n_included_truth', 'n_records')}, 0.0) AS prevalence, n_screened, n_included_screened, n_verified,
            n_errors, n_unverified, true_positives, false_positives, false_negatives, true_negatives, n_to_human, {ratio('n_verified', 'n_screened')} AS verification_rate,
            {ratio('true_positives', 'true_positives + false_negatives')} AS recall_verified, {ratio('true_positives', 'true_positives + false_positives')} AS precision_verified,
            {ratio('kept', 'n_included_screened')} AS recall_with_referrals, {ratio('n_screened - n_to_human', 'n_screened')} AS work_saved, tokens_in, tokens_out,
            round(tokens_in * (0.15::DOUBLE / 1e6) + tokens_out * (0.60::DOUBLE / 1e6), 6) AS cost_usd FROM e JOIN p USING (review)""",
    "run_ranking_metrics": f"WITH {DECISIONS}, {TRUTH}, i AS (SELECT run_id, review, label_included, {ORDERED.format(by='run_id, review')} FROM d JOIN t USING (review, work_id)),"
    + ranking("i", "run_id, review"),
    "failure_matrix": f"""WITH {DECISIONS}, e AS (SELECT review, coalesce(verify_note, '') AS note, count(*) AS n FROM d WHERE NOT span_verified GROUP BY 1, 2),
        p AS (SELECT note, row_number() OVER (ORDER BY sum(n) DESC, note) AS column_no FROM e GROUP BY note)
        SELECT review, note, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY review), 6) AS share, column_no FROM e JOIN p USING (note)""",
    "confidence_histogram": f"""WITH {DECISIONS} SELECT CAST(least(floor(least(greatest(confidence, 0.0), 1.0) * 10), 9) AS INTEGER) AS bin, span_verified, count(*) AS n,
        round(avg(confidence), 6) AS mean FROM d WHERE confidence IS NOT NULL AND NOT isnan(confidence) GROUP BY 1, 2""",
    "latest_runs": f"""WITH {DECISIONS}, e AS (SELECT review, run_id, count(*) AS n, count(CASE WHEN span_verified THEN 1 END) AS v FROM d GROUP BY 1, 2)
        SELECT review, run_id, model, prompt_version, n, {ratio('v', 'n')} AS verification_rate FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY review ORDER BY run_id DESC) = 1)
        JOIN screening_run USING (run_id)""",
    "latency_summary": f"""WITH {DECISIONS}, e AS (SELECT run_id, latency_ms, row_number() OVER (PARTITION BY run_id ORDER BY latency_ms, review, work_id) AS k, count(*) OVER (PARTITION BY run_id) AS n
            FROM d WHERE NOT from_cache AND latency_ms > 0)
        SELECT run_id, count(*) AS n, round(avg(latency_ms), 6) AS mean_ms, """
    + ", ".join(f"max(CASE WHEN k = least(n - 1, CAST(floor(n * {p}::DOUBLE) AS BIGINT)) + 1 THEN latency_ms END)::DOUBLE AS {name}" for name, p in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99)))
    + " FROM e GROUP BY run_id",
    "cache_savings": f"""WITH {DECISIONS}, e AS (SELECT run_id, count(*) AS n, count(CASE WHEN from_cache THEN 1 END) AS n_cached,
            avg(CASE WHEN NOT from_cache AND latency_ms > 0 THEN latency_ms END) AS m, sum(cost_usd) AS c FROM d GROUP BY 1)
        SELECT run_id, n, n_cached, {ratio('n_cached', 'n')} AS hit_rate, round(m, 6) AS live_mean_ms, round(n_cached * m / 3600000, 6) AS hours_saved, round(c, 4) AS cost_usd FROM e""",
    "override_summary": f"""WITH {DECISIONS}, {LABELS.replace('SELECT review, work_id, rater_id, label FROM', 'SELECT run_id, review, work_id, rater_id, label FROM').replace('SELECT review, work_id, rater_id, created_at', 'SELECT run_id, review, work_id, rater_id, created_at').replace('PARTITION BY review', 'PARTITION BY run_id, review')}
        SELECT review, decision, count(*) AS n, count(CASE WHEN label <> decision THEN 1 END) AS changed, count(CASE WHEN label = decision THEN 1 END) AS confirmed,
            {ratio('count(CASE WHEN label <> decision THEN 1 END)', 'count(*)')} AS rate FROM l JOIN d USING (run_id, review, work_id) GROUP BY 1, 2""",
    "prevalence": f"""WITH {WORKS}, {TRUTH} SELECT review, count(*) AS n, count(label_included) AS n_labelled, CAST(coalesce(sum(label_included), 0) AS BIGINT) AS n_included,
        count(CASE WHEN abstract IS NULL OR trim(abstract) = '' THEN 1 END) AS missing_abstracts, {ratio('coalesce(sum(label_included), 0)', 'count(label_included)')} AS prevalence
        FROM w LEFT JOIN t USING (review, work_id) GROUP BY review""",
    "year_histogram": f"""WITH {WORKS}, {TRUTH} SELECT CAST(year AS INTEGER) AS year, count(*) AS n, CAST(coalesce(sum(label_included), 0) AS BIGINT) AS n_included
        FROM w LEFT JOIN t USING (review, work_id) WHERE year IS NOT NULL GROUP BY 1""",
    "metadata_coverage": f"WITH {WORKS} "
    + " UNION ALL ".join(f"SELECT '{c}' AS field, count({c}) AS n_present, count(*) AS n, {ratio(f'count({c})', 'count(*)')} AS share FROM w" for c in ("doi", "title", "abstract", "year", "venue", "publisher", "country", "language")),
    "rater_agreement_ac1": f"WITH {LABELS}," + gwet("l", "work_id", "label", ["include", "exclude"], "review"),
    "inter_run_ac1": f"WITH {DECISIONS}, h AS (SELECT config_hash, review, work_id, CASE WHEN span_verified THEN decision END AS said FROM d JOIN screening_run USING (run_id)),"
    + gwet("h", "work_id", "said", ["include", "exclude"], "config_hash, review"),
    "confidence_ac2": f"WITH {DECISIONS}, h AS (SELECT review, work_id, CASE WHEN confidence BETWEEN 0 AND 1 THEN CAST(CAST(least(floor(confidence * 4), 3) AS INTEGER) AS VARCHAR) END AS step FROM d),"
    + gwet("h", "work_id", "step", ["0", "1", "2", "3"], "review", quadratic=True),
    "model_human_pabak": f"""WITH {DECISIONS}, {TRUTH}, h AS (SELECT run_id, decision, CASE WHEN label_included = 1 THEN 'include' ELSE 'exclude' END AS human FROM d JOIN t USING (review, work_id)
            WHERE span_verified AND decision IN ('include', 'exclude'))
        SELECT run_id, count(*) AS n_paired, round(avg(CASE WHEN decision = human THEN 1.0 ELSE 0.0 END), 6) AS po, round(2 * avg(CASE WHEN decision = human THEN 1.0 ELSE 0.0 END) - 1, 6) AS coefficient FROM h GROUP BY 1""",
    "wilson_recall": f"""WITH {DECISIONS}, {TRUTH}, h AS (SELECT review, count(CASE WHEN decision = 'include' AND label_included = 1 THEN 1 END) AS tp, count(CASE WHEN decision = 'exclude' THEN 1 END) AS pool,
            count(CASE WHEN decision = 'exclude' AND label_included IS NOT NULL THEN 1 END) AS sampled, count(CASE WHEN decision = 'exclude' AND label_included = 1 THEN 1 END) AS misses
            FROM d LEFT JOIN t USING (review, work_id) WHERE span_verified GROUP BY review),
        x AS (SELECT *, misses::DOUBLE / nullif(sampled, 0) AS p, 1.96::DOUBLE AS z, nullif(sampled, 0)::DOUBLE AS m FROM h),
        b AS (SELECT *, CASE WHEN sampled = 0 THEN 0.0 ELSE greatest(0.0, (p + z*z/(2*m) - z * sqrt(p*(1-p)/m + z*z/(4*m*m))) / (1 + z*z/m)) END AS lo,
            CASE WHEN sampled = 0 THEN 1.0 ELSE least(1.0, (p + z*z/(2*m) + z * sqrt(p*(1-p)/m + z*z/(4*m*m))) / (1 + z*z/m)) END AS hi FROM x)
        SELECT review, tp, pool, sampled, misses, round(p * pool, 6) AS false_negatives, {ratio('tp', 'tp + p * pool')} AS recall, {ratio('tp', 'tp + hi * pool')} AS recall_low,
            {ratio('tp', 'tp + lo * pool')} AS recall_high FROM b""",
    "arm_consensus": f"""WITH {DECISIONS}, {ARMS}, names AS (SELECT DISTINCT model AS arm FROM screening_run WHERE model IS NOT NULL), every AS (SELECT count(*) AS k FROM names),
        e AS (SELECT review, work_id, count(DISTINCT arm) AS seen, count(value) AS rated, bool_and(value = 'gap_stated') AS ev, bool_or(value = 'gap_stated') AS an FROM g WHERE arm IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT arm) = (SELECT k FROM every)),
        f AS (SELECT review, arm, count(CASE WHEN value = 'gap_stated' THEN 1 END) AS n FROM g JOIN e USING (review, work_id) WHERE arm IS NOT NULL GROUP BY 1, 2),
        l AS (SELECT review, string_agg(arm || ':' || n, ' ' ORDER BY arm) AS flagged FROM f GROUP BY 1)
        SELECT e.review, count(*) AS n_records, count(CASE WHEN rated = k THEN 1 END) AS n_rated_by_every_arm, any_value(flagged) AS flagged,
            count(CASE WHEN rated = k AND ev = an THEN 1 END) AS n_unanimous, count(CASE WHEN rated = k AND ev <> an THEN 1 END) AS n_disagreed,
            count(CASE WHEN rated = k AND ev THEN 1 END) AS both, count(CASE WHEN rated = k AND an THEN 1 END) AS either FROM e JOIN l USING (review), every GROUP BY e.review""",
    "arm_disagreements": f"""WITH {DECISIONS}, {ARMS} SELECT review, work_id, count(*) AS n_rated, string_agg(arm || ':' || value, ' ' ORDER BY arm) AS said
        FROM g WHERE value IS NOT NULL AND arm IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT value) > 1""",
    "suggestion_combine": f"""WITH {DECISIONS}, {ARMS}, o AS (SELECT *, row_number() OVER (PARTITION BY review, work_id ORDER BY arm) AS k, decision = 'include' AND span_verified AS says FROM g),
        e AS (SELECT review, work_id, count(*) AS n_arms, count(CASE WHEN span_verified THEN 1 END) AS nv, count(DISTINCT CASE WHEN span_verified THEN says END) AS answers,
            coalesce(arg_min(decision, CASE WHEN says THEN k END), arg_min(decision, k)) AS decision, coalesce(arg_min(span_verified, CASE WHEN says THEN k END), arg_min(span_verified, k)) AS lead_verified,
            bool_or(coalesce(value = 'gap_stated', false)) AS gap_stated FROM o GROUP BY 1, 2),
        y AS (SELECT *, CASE WHEN n_arms = 1 THEN 'single' WHEN nv < n_arms THEN 'partial' WHEN answers = 1 THEN 'agreed' ELSE 'split' END AS agreement FROM e),
        z AS (SELECT *, decision = 'include' AND lead_verified AND agreement NOT IN ('split', 'partial') AS relevant FROM y)
        SELECT review, work_id, n_arms, decision, lead_verified, agreement, gap_stated, relevant, CASE WHEN relevant THEN 0 WHEN NOT lead_verified THEN 1 ELSE 2 END AS reading_group FROM z""",
    "stratified_sample": f"""WITH {DECISIONS} SELECT run_id, review, work_id, decision FROM d WHERE span_verified
        QUALIFY row_number() OVER (PARTITION BY review, decision ORDER BY md5(concat_ws(':', '42', run_id, review, work_id)), run_id, review, work_id) <= 5""",
    "label_aware_sample": f"""WITH {TRUTH}, e AS (SELECT *, sum(label_included) OVER (PARTITION BY review) AS inc,
            row_number() OVER (PARTITION BY review, label_included ORDER BY md5(concat_ws(':', '42', review, work_id)), review, work_id) AS k FROM t)
        SELECT review, work_id, label_included FROM e WHERE label_included = 1 OR k <= 30 - inc""",
    "cache_lookup": f"""WITH {DECISIONS}, {CACHE}, k AS (SELECT DISTINCT cache_key FROM d WHERE cache_key IS NOT NULL)
        SELECT CASE WHEN c.cache_key IS NULL THEN 'miss' WHEN c.request_sha256 IS NULL THEN 'miss' ELSE 'hit' END AS status, count(*) AS n FROM k LEFT JOIN c USING (cache_key) GROUP BY 1""",
    "upsert_decisions": """SELECT run_id, review, work_id, decision, confidence, epoch_us(created_at) AS at_us FROM screening_decision
        QUALIFY row_number() OVER (PARTITION BY run_id, review, work_id ORDER BY created_at DESC) = 1""",
    "reviews_without_records": "SELECT DISTINCT review FROM review_criteria WHERE review NOT IN (SELECT review FROM works WHERE review IS NOT NULL AND year = 2024)",
    "criteria_status": """SELECT DISTINCT w.review, length(coalesce(criteria, 'draft')) AS criteria, CASE WHEN criteria IS NULL THEN 'working-draft' ELSE 'published' END AS status
        FROM works w LEFT JOIN review_criteria USING (review)""",
    "clean_works": rf"""WITH {WORKS}, k AS (SELECT *, regexp_replace(title, '^\s+|\s+$', '', 'g') AS ti, regexp_replace(abstract, '^\s+|\s+$', '', 'g') AS ab FROM w)
        SELECT review, work_id, nullif(trim(regexp_replace(lower(trim(doi)), '^(?:https?://(?:dx\.)?doi\.org/|doi:)\s*', '')), '') AS doi,
            CASE WHEN ti <> '' AND lower(ti) <> 'nan' THEN length(ti) END AS title_chars, CASE WHEN ab <> '' AND lower(ab) <> 'nan' THEN length(ab) END AS abstract_chars, CAST(year AS INTEGER) AS year FROM k""",
    "cached_prompts": f"""WITH {WORKS} SELECT review, work_id, sha256('CRITERIA:' || chr(10) || trim(criteria) || chr(10) || chr(10) || 'TITLE:' || chr(10) || trim(coalesce(title, '')) || chr(10) || chr(10) || 'ABSTRACT:' || chr(10)
            || trim(coalesce(abstract, ''))) AS request_sha256, left(sha256('model' || chr(31) || 'v1' || chr(31) || review || chr(31) || work_id), 32) AS cache_key FROM w JOIN review_criteria USING (review)""",
    "spend_meter": f"""WITH {DECISIONS}, e AS (SELECT run_id, review, work_id, created_at, cost_usd, round(sum(cost_usd) OVER (PARTITION BY run_id ORDER BY created_at, review, work_id ROWS UNBOUNDED PRECEDING), 8) AS spent
            FROM d WHERE cost_usd > 0)
        SELECT run_id, review, work_id, epoch_us(created_at) AS at_us, spent, spent >= 0.05 AS aborts FROM e WHERE round(spent - cost_usd, 8) < 0.05""",
    "bm25_raw": f"WITH {WORKS}, {bm25()} SELECT review, work_id, score, rank FROM bm",
    "random_rank": f"WITH {WORKS}, {RANDOM} SELECT * FROM rr",
    "dense_works": f"WITH {WORKS}, {DENSE} SELECT * FROM de",
    "hybrid_rrf": f"WITH {WORKS}, {HYBRID} SELECT * FROM hy",
    "rerank": f"""WITH {WORKS}, {HYBRID} SELECT review, work_id, hy.rank AS old_rank, row_number() OVER (PARTITION BY review ORDER BY CASE WHEN hy.rank <= 200 THEN 0 ELSE 1 END,
        CASE WHEN hy.rank <= 200 THEN -length(coalesce(abstract, '')) END, hy.rank) AS rank FROM hy JOIN w USING (review, work_id)""",
    "bm25_ranking_metrics": f"WITH {WORKS}, {TRUTH}, {bm25()}, i AS (SELECT review, rank, label_included FROM bm JOIN t USING (review, work_id))," + ranking("i", "review"),
    "ranking_recall_curve": f"""WITH {WORKS}, {TRUTH}, {bm25()}, i AS (SELECT review, row_number() OVER p AS rank, label_included, sum(label_included) OVER (PARTITION BY review ORDER BY rank ROWS UNBOUNDED PRECEDING) AS found,
            count(*) OVER (PARTITION BY review) AS n, sum(label_included) OVER (PARTITION BY review) AS inc FROM bm JOIN t USING (review, work_id) WINDOW p AS (PARTITION BY review ORDER BY rank))
        SELECT review, rank AS position, {ratio('found', 'inc')} AS recall, {ratio('rank', 'n')} AS baseline FROM i WHERE inc > 0 AND (label_included = 1 OR rank % greatest(1, n // 400) = 0 OR rank = n)
        UNION ALL SELECT DISTINCT review, 0, 0.0, 0.0 FROM i WHERE inc > 0""",
    "decision_order": f"WITH {DECISIONS} SELECT run_id, review, work_id, {ORDERED.format(by='run_id, review')} FROM d",
    "dense_rank": """WITH v AS (SELECT label, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
        q AS (SELECT label, arg_min(e, vec_id) AS q FROM v GROUP BY label), s AS (SELECT label, vec_id, round(list_cosine_similarity(e, q), 9) AS score FROM v JOIN q USING (label))
        SELECT label, vec_id, score, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s""",
    "evidence_counts": f"""WITH {SECTIONS}, p AS (SELECT pmcid, coalesce(title, 'Untitled section') AS h, unnest(string_split(coalesce(text, ''), chr(10))) AS q FROM s),
        k AS (SELECT pmcid, h, q FROM p WHERE trim(q) <> '')
        SELECT pmcid, kind, count(*) AS n FROM ("""
    + " UNION ALL ".join(f"SELECT pmcid, '{kind}' AS kind FROM k WHERE {test}" for kind, test in (("methods", f"regexp_matches(h, '{METHOD_HEADING}')"), ("statistical_results", f"regexp_matches(q, '{STATISTIC}')"), ("limitations", f"regexp_matches(h, '{LIMITED_HEADING}') OR regexp_matches(q, '{LIMITED}')"), ("equations_models", f"regexp_matches(q, '{MODEL}')")))
    + ") GROUP BY 1, 2",
    "kept_sections": f"""WITH {SECTIONS} SELECT pmcid, count(*) AS n, count(CASE WHEN title IS NULL OR NOT regexp_matches(title, '{BACK_MATTER}') THEN 1 END) AS n_kept,
        count(CASE WHEN NOT regexp_matches(title, '{BACK_MATTER}') AND regexp_matches(title, '{LIMITATION_HEADING}') THEN 1 END) AS n_limitations,
        count(CASE WHEN NOT regexp_matches(title, '{BACK_MATTER}') AND regexp_matches(title, '{RESULT_HEADING}') THEN 1 END) AS n_results FROM s GROUP BY pmcid""",
    "prompt_source": f"""WITH {SECTIONS}, p AS (SELECT pmcid, trim(string_agg(concat_ws(chr(10), nullif(title, ''), text), chr(10) || chr(10)
            ORDER BY CASE WHEN regexp_matches(coalesce(title, ''), '(?i)result|finding|limitation|discussion') THEN 0 ELSE 1 END, section_no)) AS t FROM s WHERE trim(coalesce(text, '')) <> '' GROUP BY pmcid)
        SELECT pmcid, sha256(left(t, 24000)) AS sha256, length(t) > 24000 AS truncated, length(t) AS chars_available FROM p""",
    "body_roundtrip": f"""WITH {SECTIONS}, {PAPERS}, p AS (SELECT pmcid, string_agg(CASE WHEN title IS NOT NULL AND title <> '' THEN title || chr(10) || coalesce(text, '') ELSE text END, chr(10) || chr(10) ORDER BY section_no) AS again FROM s GROUP BY pmcid)
        SELECT pmcid, coalesce(again, '') = body AS same FROM f LEFT JOIN p USING (pmcid)""",
    "fulltext_coverage": f"""WITH {PAPERS}, e AS (SELECT CASE WHEN work_id IS NULL THEN 'none' ELSE 'W' || right(work_id, 1) END AS topic, length(body) AS size, is_fragment FROM f)
        SELECT CASE WHEN grouping(topic) = 1 THEN 'all' ELSE topic END AS topic, count(*) AS n, count(CASE WHEN is_fragment THEN 1 END) AS n_fragments,
            {ratio('count(CASE WHEN NOT is_fragment THEN 1 END)', 'count(*)')} AS usable, list_sort(list(size))[len(list(size)) // 2 + 1] AS upper_median FROM e GROUP BY ROLLUP (topic)""",
    "inverted_abstracts": f"WITH {WORKS} SELECT review, work_id, true AS same FROM w WHERE length(trim(abstract)) > 0",
    "override_accuracy": f"""WITH {DECISIONS}, {TRUTH}, {LABELS.replace('l AS', 'l2 AS', 1).replace('SELECT review, work_id, rater_id, label FROM', 'SELECT run_id, review, work_id, rater_id, label FROM').replace('SELECT review, work_id, rater_id, created_at', 'SELECT run_id, review, work_id, rater_id, created_at').replace('PARTITION BY review', 'PARTITION BY run_id, review')},
        e AS (SELECT d.run_id, decision, label, CASE WHEN label_included = 1 THEN 'include' ELSE 'exclude' END AS want FROM l2 JOIN d USING (run_id, review, work_id) JOIN t USING (review, work_id))
        SELECT run_id, count(*) AS n, count(CASE WHEN label = want THEN 1 END) AS human_right, count(CASE WHEN decision = want THEN 1 END) AS model_right,
            count(CASE WHEN label <> decision AND label = want THEN 1 END) AS repaired FROM e GROUP BY run_id""",
    "run_recall_curve": f"""WITH {DECISIONS}, {TRUTH}, o AS (SELECT run_id, review, label_included, {ORDERED.format(by='run_id, review')} FROM d JOIN t USING (review, work_id)),
        i AS (SELECT *, sum(label_included) OVER (PARTITION BY run_id, review ORDER BY rank ROWS UNBOUNDED PRECEDING) AS found, count(*) OVER (PARTITION BY run_id, review) AS n,
            sum(label_included) OVER (PARTITION BY run_id, review) AS inc FROM o)
        SELECT run_id, review, rank AS position, {ratio('found', 'inc')} AS recall, {ratio('rank', 'n')} AS baseline FROM i WHERE inc > 0 AND (label_included = 1 OR rank % greatest(1, n // 400) = 0 OR rank = n)
        UNION ALL SELECT DISTINCT run_id, review, 0, 0.0, 0.0 FROM i WHERE inc > 0""",
    "append_rest": f"""WITH {WORKS}, {DECISIONS}, x AS (SELECT review, max(run_id) AS run_id FROM d GROUP BY review),
        k AS (SELECT review, work_id, {ORDERED.format(by='review')} FROM d JOIN x USING (review, run_id) WHERE span_verified AND decision = 'include')
        SELECT review, work_id, row_number() OVER (PARTITION BY review ORDER BY k.rank NULLS LAST, work_id) AS rank, k.rank IS NOT NULL AS queried FROM w LEFT JOIN k USING (review, work_id)""",
    "corpus_fingerprint": f"""WITH {WORKS}, h AS (SELECT review, work_id, sha256(concat_ws(chr(31), work_id, coalesce(title, 'None'), coalesce(abstract, 'None'))) AS h,
            row_number() OVER (PARTITION BY review ORDER BY work_id) AS k FROM w),
        p AS (SELECT review, (k - 1) // 4096 AS p, sha256(string_agg(h, chr(10) ORDER BY k)) AS h, count(*) AS n FROM h GROUP BY 1, 2)
        SELECT review, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(h, chr(10) ORDER BY p)) AS sha256 FROM p GROUP BY 1""",
    "paper_identifiers": rf"""WITH {PAPERS} SELECT pmcid, nullif(regexp_extract(pmcid, '(PMC\d+)', 1), '') AS found, nullif(trim(regexp_replace(lower(trim(doi)), '^(?:https?://(?:dx\.)?doi\.org/|doi:)\s*', '')), '') AS doi,
        regexp_replace(left(trim(regexp_replace(regexp_replace(coalesce(title, ''), '[<>:"/\\|?*\x00-\x1f]', ' ', 'g'), '\s+', ' ', 'g')), 40), '[. ]+$', '') AS folder FROM f""",
    "gap_candidates": f"""WITH {SECTIONS}, e AS (SELECT pmcid, section_no, unnest({SENTENCES.format(text='text')}) AS sentence, generate_subscripts({SENTENCES.format(text='text')}, 1) AS pos FROM s),
        k AS (SELECT *, {normalised('sentence')} AS n FROM e WHERE length(sentence) >= 25 AND regexp_matches(sentence, '{GAP_CUE}')),
        o AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY pmcid, section_no, n ORDER BY pos) = 1)
        SELECT pmcid, section_no, row_number() OVER (PARTITION BY pmcid, section_no ORDER BY pos) AS candidate_no, sentence FROM o QUALIFY candidate_no <= 12""",
    "figure_mentions": rf"""WITH {PAPERS}, e AS (SELECT pmcid, string_split(regexp_replace(body, '([.!?])\s+([A-Z(])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS ss FROM f),
        k AS (SELECT pmcid, trim(unnest(ss)) AS sentence, generate_subscripts(ss, 1) AS pos FROM e),
        g AS (SELECT pmcid, sentence, pos, unnest(list_distinct(list_filter(regexp_extract_all(sentence, '(?i)\bfig(?:ure|ures|s|\.)?\s*\.?\s*(\d+(?:\.\d)?)', 1), lambda x: NOT contains(x, '.')))) AS figure FROM k)
        SELECT pmcid, CAST(figure AS INTEGER) AS figure, row_number() OVER (PARTITION BY pmcid, figure ORDER BY pos) AS mention_no, sentence FROM g QUALIFY mention_no <= 3""",
    "typology_sample": f"""WITH {DECISIONS}, f AS (SELECT run_id, review, work_id FROM d WHERE NOT span_verified), c AS (SELECT review, count(*) AS size FROM f GROUP BY 1),
        q AS (SELECT review, size, least(size, greatest(1, CAST(round(50 * size / sum(size) OVER ()) AS BIGINT))) AS quota FROM c),
        o AS (SELECT *, sum(quota) OVER () - 50 AS ov FROM q), s AS (SELECT *, CASE WHEN ov > 0 THEN quota - 1 ELSE size - quota END AS spare FROM o),
        b AS (SELECT *, coalesce(sum(spare) OVER (ORDER BY size DESC, review ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s),
        k AS (SELECT review, quota - sign(ov) * greatest(0, least(spare, abs(ov) - before)) AS quota FROM b)
        SELECT run_id, review, work_id FROM f JOIN k USING (review) QUALIFY row_number() OVER (PARTITION BY review ORDER BY md5(concat_ws(':', '42', run_id, review, work_id)), run_id, review, work_id) <= quota""",
    # first wins, a row of each review at a time
    "web_duplicates": rf"""WITH RECURSIVE {WORKS}, k AS (SELECT review, work_id, row_number() OVER (PARTITION BY review ORDER BY work_id) AS k,
            list_filter(['d:' || nullif(trim(regexp_replace(lower(trim(doi)), '^(?:https?://(?:dx\.)?doi\.org/|doi:)\s*', '')), ''),
                't:' || nullif(lower(trim(regexp_replace(title, '\s+', ' ', 'g'))), '') || chr(31) || coalesce(CAST(year AS VARCHAR), 'None')], lambda x: x IS NOT NULL) AS keys FROM w),
        g AS (SELECT DISTINCT review, CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS work_id, CAST(NULL AS BOOLEAN) AS kept, CAST([] AS VARCHAR[]) AS seen FROM k
            UNION ALL SELECT k.review, k.k, k.work_id, NOT list_has_any(g.seen, k.keys), CASE WHEN list_has_any(g.seen, k.keys) THEN g.seen ELSE list_concat(g.seen, k.keys) END FROM g JOIN k ON k.review = g.review AND k.k = g.k + 1)
        SELECT review, work_id, kept FROM g WHERE k > 0""",
}
_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_flat = lambda x: f"trim(regexp_replace(regexp_replace({x}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x{{fffe}}\\x{{ffff}}]', ' ', 'g'), '{_WS}', ' ', 'g'))"
SQL["parsed_sections"] = f"""WITH {SECTIONS}, {PAPERS}, p AS (SELECT pmcid, section_no, nullif({_flat('title')}, '') AS ti, unnest(string_split(coalesce(text, ''), chr(10))) AS para, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM s SEMI JOIN f USING (pmcid)),
    q AS (SELECT pmcid, section_no, ti, i, {_flat('para')} AS pa FROM p),
    g AS (SELECT pmcid, section_no, ti, string_agg(pa, chr(10) ORDER BY i) AS text FROM q WHERE pa <> '' AND (ti IS NULL OR NOT regexp_matches(ti, '{BACK_MATTER}')) GROUP BY ALL)
    SELECT pmcid, row_number() OVER (PARTITION BY pmcid ORDER BY section_no) AS k, length(ti) AS title_chars, sha256(text) AS sha256 FROM g"""
SQL["parsed_papers"] = f"""WITH {SECTIONS}, {PAPERS}, e AS (SELECT pmcid, count(*) AS n, count(CASE WHEN regexp_matches(title, '{RESULT_HEADING}') THEN 1 END) AS figs, count(CASE WHEN regexp_matches(title, '{RESULT_HEADING}') AND section_no % 2 = 0 THEN 1 END) AS heat FROM s GROUP BY 1)
    SELECT pmcid, true AS ok, coalesce({_flat('doi')}, '') <> '' AS has_doi, 1 AS n_tables, 1 + coalesce(n, 0) AS n_table_rows, coalesce(figs, 0) AS n_figures, coalesce(heat, 0) AS n_heat_maps,
        CASE WHEN doi IS NULL THEN 0 ELSE 1 END AS n_supplements, false AS is_fragment FROM f LEFT JOIN e USING (pmcid)"""
SQL["content_coverage"] = f"""WITH {PAPERS}, e0 AS ({SQL['evidence_counts']}), pp AS ({SQL['parsed_papers']}),
    e AS (SELECT pmcid, kind, n FROM e0 UNION ALL SELECT pmcid, unnest(['data_tables', 'heat_maps', 'graphs_charts', 'supplementary_files']), unnest([n_tables, n_heat_maps, n_figures, n_supplements]) FROM pp),
    k AS (SELECT unnest(['data_tables', 'heat_maps', 'graphs_charts', 'statistical_results', 'methods', 'equations_models', 'supplementary_files', 'limitations']) AS kind),
    g AS (SELECT f.pmcid, is_fragment, k.kind, coalesce(e.n, 0) AS n FROM f CROSS JOIN k LEFT JOIN e ON e.pmcid = f.pmcid AND e.kind = k.kind)
    SELECT pmcid, kind, n, CASE WHEN kind IN ('heat_maps', 'graphs_charts') AND n > 0 THEN 'needs_human_review' WHEN kind = 'supplementary_files' THEN 'source_unavailable' WHEN n > 0 THEN 'extracted' WHEN is_fragment THEN 'source_unavailable' ELSE 'not_found' END AS status FROM g"""
SQL["span_sections"] = f"""WITH {SECTIONS}, {PAPERS}, e AS (SELECT pmcid, unnest({SENTENCES.format(text='body')}) AS sentence, generate_subscripts({SENTENCES.format(text='body')}, 1) AS pos FROM f),
    k AS (SELECT *, {normalised('sentence')} AS n FROM e WHERE length(sentence) >= 25 AND regexp_matches(sentence, '{GAP_CUE}')),
    o AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY pmcid, n ORDER BY pos) = 1),
    c AS (SELECT pmcid, n, row_number() OVER (PARTITION BY pmcid ORDER BY pos) AS candidate_no FROM o QUALIFY candidate_no <= 12),
    q AS (SELECT pmcid, section_no, {normalised('text')} AS t FROM s)
    SELECT pmcid, candidate_no, min(CASE WHEN contains(t, n) THEN section_no END) AS section_no FROM c JOIN q USING (pmcid) GROUP BY 1, 2"""
#: Remembered answers parsed and shape-checked: decision, confidence, evidence_span and shape_note.
PARSED = r"""j0 AS (SELECT *, trim(regexp_replace(trim(raw_response), '^```[a-z]*\s*|\s*```$', '', 'g')) AS js FROM c),
    j1 AS (SELECT *, json_valid(js) AND left(js, 1) = '{' AS ok FROM j0),
    j2 AS (SELECT cache_key, review, work_id, model, raw_response, js, CASE WHEN ok THEN json_extract_string(js, '$.decision') END AS decision,
        CASE WHEN ok THEN try_cast(json_extract_string(js, '$.confidence') AS DOUBLE) END AS confidence, CASE WHEN ok THEN json_extract_string(js, '$.evidence_span') END AS evidence_span FROM j1),
    j AS (SELECT *, CASE WHEN raw_response IS NULL OR js = '' THEN 'empty_response'
        WHEN NOT coalesce(decision IN ('include', 'exclude') AND confidence BETWEEN 0 AND 1 AND evidence_span IS NOT NULL, false) THEN 'schema_validation_failed' END AS shape_note FROM j2)"""
_CHECK = VERIFY.replace("SELECT d.*,", "SELECT j.*,").replace("FROM d JOIN w USING", "FROM j JOIN w USING")
SQL["screen_responses"] = f"""WITH {WORKS}, {CACHE}, {PARSED}, {_CHECK}
    SELECT cache_key, CASE WHEN shape_note IS NOT NULL THEN 'error' WHEN note LIKE 'exact%' THEN decision ELSE 'unverified' END AS decision,
        CASE WHEN shape_note IS NULL THEN confidence END AS confidence, shape_note IS NULL AND note LIKE 'exact%' AS span_verified, coalesce(shape_note, note) AS verify_note FROM r"""
PROPOSED = f"""{PARSED}, pr AS (SELECT d.run_id, d.review, d.work_id, d.decision, d.confidence, d.span_verified,
        coalesce(CASE WHEN j.shape_note IS NULL THEN j.decision END, CASE WHEN d.decision IN ('include', 'exclude') THEN d.decision END) AS proposed FROM d LEFT JOIN j USING (cache_key))"""
SQL["recover_proposals"] = f"WITH {DECISIONS}, {CACHE}, {PROPOSED} SELECT run_id, review, work_id, proposed, proposed IS NOT NULL AS recovered FROM pr"
_POLICY = """SELECT run_id, review, work_id, label_included, span_verified, proposed, '{name}' AS policy, {predicts} AS predicts, {human} AS human, {group} AS g,
    CASE {group} WHEN 0 THEN -coalesce(confidence, 0.0) WHEN 2 THEN coalesce(confidence, 0.0) ELSE 0.0 END AS o FROM kn"""
_GROUP = "CASE WHEN NOT span_verified THEN 1 WHEN decision = 'include' THEN 0 ELSE 2 END"
_RAW = "CASE WHEN proposed IS NULL THEN 1 WHEN proposed = 'include' THEN 0 ELSE 2 END"
POLICIES = " UNION ALL ".join(
    _POLICY.format(name=name, predicts=predicts, human=human, group=group)
    for name, predicts, human, group in (
        ("with_verifier", "CASE WHEN span_verified AND decision IN ('include', 'exclude') THEN decision = 'include' END", HUMAN, _GROUP),
        ("no_verifier", "proposed = 'include'", "coalesce(proposed <> 'exclude', true)", _RAW),
        ("referrals_to_human", HUMAN, HUMAN, _GROUP),
    )
)
_TRUSTED = "policy = 'no_verifier' AND proposed IS NOT NULL AND NOT span_verified"
SQL["verifier_ablation"] = f"""WITH {DECISIONS}, {CACHE}, {TRUTH}, {PROPOSED}, kn AS (SELECT pr.*, label_included FROM pr JOIN t USING (review, work_id)), po AS ({POLICIES}),
    sc AS (SELECT run_id, review, policy, count(predicts) AS n_predictions, count(CASE WHEN human THEN 1 END) AS n_to_human, count(CASE WHEN predicts AND label_included = 1 THEN 1 END) AS true_positives,
        count(CASE WHEN predicts AND label_included = 0 THEN 1 END) AS false_positives, count(CASE WHEN NOT predicts AND label_included = 1 THEN 1 END) AS false_negatives,
        count(CASE WHEN NOT predicts AND label_included = 0 THEN 1 END) AS true_negatives, count(CASE WHEN {_TRUSTED} THEN 1 END) AS n_unverifiable_trusted,
        count(CASE WHEN {_TRUSTED} AND predicts <> (label_included = 1) THEN 1 END) AS n_unverifiable_wrong FROM po GROUP BY 1, 2, 3),
    p AS (SELECT review, count(*) AS n_records, CAST(sum(label_included) AS BIGINT) AS n_included_truth FROM t GROUP BY 1),
    i AS (SELECT run_id, review, policy, label_included, row_number() OVER (PARTITION BY run_id, review, policy ORDER BY g, o, work_id) AS rank FROM po),
    rk AS (SELECT run_id, review, policy, tnr FROM (WITH {ranking('i', 'run_id, review, policy').strip()}))
    SELECT run_id, review, policy, n_records, n_included_truth, n_predictions, n_to_human, true_positives, false_positives, false_negatives, true_negatives, n_unverifiable_trusted, n_unverifiable_wrong,
        {ratio('true_positives', 'true_positives + false_negatives')} AS recall, {ratio('true_positives', 'true_positives + false_positives')} AS precision,
        {ratio('n_records - n_to_human', 'n_records')} AS work_saved, tnr, policy <> 'with_verifier' AS comparable FROM sc JOIN p USING (review) LEFT JOIN rk USING (run_id, review, policy)"""
SQL["prompt_stage_ablation"] = f"""WITH e AS ({SQL['run_ranking_metrics']}), g AS (SELECT review, prompt_version AS stage, round(avg(tnr), 6) AS tnr FROM e JOIN screening_run USING (run_id) GROUP BY 1, 2),
    b AS (SELECT review, tnr AS base FROM g WHERE stage = 'screen_v1') SELECT review, stage, tnr, round(tnr - base, 4) AS delta FROM g LEFT JOIN b USING (review)"""
_FIELDS = " UNION ALL ".join(f"SELECT model, cache_key, '{f}' AS field, {v} AS value, evidence_span, src FROM k" for f, v in (("decision", "decision"), ("confidence", "CAST(confidence AS VARCHAR)")))
SQL["field_coverage"] = f"""WITH {WORKS}, {CACHE}, {PARSED}, k AS (SELECT j.*, concat_ws(' ', title, abstract) AS src FROM j JOIN w USING (review, work_id)), fa AS ({_FIELDS}),
    {VERIFY.split('n AS (')[0].replace('SELECT d.*, concat_ws', 'SELECT *, concat_ws').split('FROM (')[0]}FROM fa), n AS ({VERIFY.split('n AS (', 1)[1]},
    z AS (SELECT *, CASE WHEN value IS NULL OR lower(trim(value)) IN ('not_stated', '') THEN 'not_stated' ELSE note END AS verdict FROM r),
    q AS (SELECT model, field, count(*) AS n, count(CASE WHEN verdict LIKE 'exact%' THEN 1 END) AS n_verified, count(CASE WHEN verdict LIKE 'not_stated%' THEN 1 END) AS n_not_stated FROM z GROUP BY 1, 2),
    gr AS (SELECT DISTINCT model, unnest(['decision', 'confidence', 'key_finding']) AS field FROM z)
    SELECT gr.model, gr.field, coalesce(n, 0) AS n, coalesce(n_verified, 0) AS n_verified, coalesce(n_not_stated, 0) AS n_not_stated, coalesce(n - n_verified - n_not_stated, 0) AS n_unverified,
        {ratio('n_verified', 'n')} AS share FROM gr LEFT JOIN q ON gr.model = q.model AND gr.field = q.field"""
_TITLE = "string_split(criteria, chr(10))[1]"
TERMS = r"""tw AS (SELECT review, term, row_number() OVER (PARTITION BY review ORDER BY count(*) DESC, term) AS k FROM (SELECT review, unnest(regexp_extract_all(lower(title), '\p{L}{5,}')) AS term FROM w0) GROUP BY review, term QUALIFY k <= 40)"""
_accepted = lambda q, source: f"""SELECT c.review, any_value(q) AS question, coalesce(list(term ORDER BY k) FILTER (WHERE term IS NOT NULL AND length(term) <= 60 AND NOT list_contains(regexp_extract_all(lower(q), '[\\p{{L}}\\p{{N}}_]+'), term))[1:8], []) AS terms
        FROM (SELECT review, {q} AS q FROM {source}) c LEFT JOIN tw USING (review) GROUP BY c.review"""  # noqa: E731
_LONG = "trim(concat_ws(' ', trim(question), array_to_string(terms, ' ')))"
_W0 = WORKS.replace("w AS", "w0 AS", 1)
SQL["query_expansion"] = rf"""WITH {_W0}, {TERMS}, e AS ({_accepted(_TITLE, 'review_criteria')})
    SELECT review, left(sha256(lower(trim(regexp_replace(question, '\s+', ' ', 'g')))), 32) AS question_key, array_to_string(terms, '|') AS accepted, {_LONG} AS expanded FROM e"""
SQL["expansion_arms"] = f"""WITH {_W0}, {TERMS}, ti AS ({_accepted(_TITLE, 'review_criteria')}), cr AS ({_accepted('criteria', 'review_criteria')}),
    ar AS (SELECT review || chr(31) || 'title' AS review, question FROM ti UNION ALL SELECT review || chr(31) || 'title_expanded', {_LONG} FROM ti UNION ALL SELECT review || chr(31) || 'criteria', question FROM cr UNION ALL SELECT review || chr(31) || 'criteria_expanded', {_LONG} FROM cr),
    w AS (SELECT ar.review, work_id, title, abstract FROM w0 JOIN ar ON w0.review = string_split(ar.review, chr(31))[1]), {TRUTH.replace('t AS (', 't0 AS (', 1)},
    t AS (SELECT ar.review, work_id, label_included FROM t0 JOIN ar ON t0.review = string_split(ar.review, chr(31))[1]), {bm25('SELECT * FROM ar')},
    i AS (SELECT review, rank, label_included FROM bm JOIN t USING (review, work_id)), mm AS (WITH {ranking('i', 'review').strip()}),
    pv AS (SELECT string_split(review, chr(31))[1] AS review, {', '.join(f"max(CASE WHEN string_split(review, chr(31))[2] = '{a}' THEN tnr END) AS tnr_{a}" for a in ('title', 'title_expanded', 'criteria', 'criteria_expanded'))} FROM mm GROUP BY 1)
    SELECT *, round(tnr_title_expanded - tnr_title, 6) AS delta_title, round(tnr_criteria_expanded - tnr_criteria, 6) AS delta_criteria FROM pv"""
SQL["expansion_summary"] = " UNION ALL ".join(f"SELECT '{k}' AS kind, count(delta_{k}) AS n, count(CASE WHEN delta_{k} > 0 THEN 1 END) AS improved, count(CASE WHEN delta_{k} < 0 THEN 1 END) AS worsened, round(avg(delta_{k}), 6) AS mean_delta FROM ({SQL['expansion_arms']})" for k in ("title", "criteria"))
SQL["reading_order"] = f"""WITH {WORKS}, {DENSE}, e AS ({SQL['suggestion_combine']}) SELECT review, work_id, reading_group, row_number() OVER (PARTITION BY review ORDER BY reading_group, -coalesce(score, 0.0), work_id) AS rank FROM e LEFT JOIN de USING (review, work_id)"""
