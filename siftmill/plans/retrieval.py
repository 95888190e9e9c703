"""Queries on records, papers, documents and vectors: rankings, passages, maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftmill.functions import text as ft
from siftmill.operators import documents, linalg, metrics, ranking
from siftmill.plans import base as b


def bm25_raw(spark, d):
    """BM25 of every record against its review's criteria, on words as they stand."""
    return ranking.bm25(b.works(spark, d), b.questions(spark, d)).select("review", "work_id", "score", "rank")


def bm25_porter(spark, d):
    """BM25 on word stems."""
    return ranking.bm25(b.works(spark, d), b.questions(spark, d), stemmed=True).select("review", "work_id", "score", "rank")


def random_rank(spark, d):
    return ranking.random_rank(b.works(spark, d))


def dense_works(spark, d):
    """Records by the likeness of their words to their review's criteria (hashed vectors stand in for a model's)."""
    return ranking.dense(b.works(spark, d), b.questions(spark, d))


def hybrid_rrf(spark, d):
    """Reciprocal rank fusion of the dense and the lexical ranking."""
    return ranking.rank("hybrid", b.works(spark, d), questions=b.questions(spark, d))


def rerank(spark, d):
    """The hybrid ranking's first two hundred by an external score, here the length of the abstract."""
    works = b.works(spark, d)
    scores = works.select("review", "work_id", F.length(F.coalesce("abstract", F.lit(""))).cast("double").alias("score"))
    return ranking.rank("rerank", works, questions=b.questions(spark, d), scores=scores)


def bm25_ranking_metrics(spark, d):
    """What reading each review in lexical order costs, against the raters' majority."""
    known = b.truth(spark, d)
    ranked = ranking.bm25(b.works(spark, d), b.questions(spark, d))
    return ranking.ranking_metrics(ranked, known)


def ranking_recall_curve(spark, d):
    return ranking.recall_curve(ranking.bm25(b.works(spark, d), b.questions(spark, d)), b.truth(spark, d))


def run_recall_curve(spark, d):
    """Recall curves of every run's decision order."""
    known = b.truth(spark, d)
    rows = b.decisions(spark, d).join(known.select("review", "work_id"), ["review", "work_id"], "left_semi")
    return ranking.recall_curve(ranking.decision_order(rows, ["run_id", "review"]), known, by=["run_id", "review"])


def decision_order(spark, d):
    return ranking.decision_order(b.decisions(spark, d), ["run_id", "review"])


def append_rest(spark, d):
    """Verified includes of each review's last run in their order, then all other records."""
    last = metrics.latest_runs(b.decisions(spark, d), b.runs(spark, d)).select("review", "run_id")
    rows = b.decisions(spark, d).filter("span_verified and decision = 'include'").join(last, ["review", "run_id"])
    return ranking.append_rest(ranking.decision_order(rows, ["review"]), b.works(spark, d))


def dense_rank(spark, d):
    """Vectors by cosine with the vector of the smallest id, within their labels."""
    vectors = b.table(spark, d, "embeddings").withColumn("review", F.col("label"))
    query = vectors.groupBy("review").agg(F.min_by("embedding", "vec_id").alias("query_vector"))
    return ranking.dense_rank(vectors, query).withColumnRenamed("review", "label")


def _suggested(spark, d):
    """Terms that may expand a review's question: its titles' words, the most frequent first."""
    said = b.works(spark, d).select("review", F.explode(F.regexp_extract_all(F.lower("title"), F.lit(r"(\p{L}{5,})"), F.lit(1))).alias("term")).groupBy("review", "term").agg(F.count("*").alias("n"))
    first = said.withColumn("k", F.row_number().over(ranking.W.partitionBy("review").orderBy(F.col("n").desc(), "term"))).filter("k <= 40")  # a row per different word
    return first.groupBy("review").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "term"))), lambda s: s["term"]).alias("terms"))


def _arms(spark, d):
    """review, arm, question: the title-like first line and the whole criteria, each without and with accepted terms."""
    base = b.criteria(spark, d).join(_suggested(spark, d), "review", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))
    kinds = {"title": F.element_at(F.split("criteria", "\n"), 1), "criteria": F.col("criteria")}
    arms = [F.struct(F.lit(f"{kind}{more}").alias("arm"), (ranking.expanded(q, ranking.accept_terms(q, F.col("terms"))) if more else q).alias("question")) for kind, q in kinds.items() for more in ("", "_expanded")]
    return base.select("review", F.explode(F.array(*arms)).alias("a")).select("review", "a.*")


def query_expansion(spark, d):
    """What is searched for each review: the first line of its criteria, and the title words accepted for it."""
    rows = b.criteria(spark, d).join(_suggested(spark, d), "review", "left").select("review", F.element_at(F.split("criteria", "\n"), 1).alias("question"), F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))
    terms = ranking.accept_terms(F.col("question"), F.col("terms"))
    return rows.select("review", ft.question_key(F.col("question")).alias("question_key"), F.array_join(terms, "|").alias("accepted"), ranking.expanded(F.col("question"), terms).alias("expanded"))


def expansion_arms(spark, d):
    """Ranking metrics of four arms per review: title and criteria, without and with accepted terms, and both differences."""
    arms, works, known = _arms(spark, d), b.works(spark, d), b.truth(spark, d)
    # one job for all arms: an arm is part of the review's name
    key = F.concat_ws("\x1f", "review", "arm")
    part = lambda k: F.element_at(F.split("review", "\x1f"), k)
    names = arms.select("review", "arm")
    wide = works.select("review", "work_id", "title", "abstract").join(names, "review").withColumn("review", key)
    ranked = ranking.bm25(wide, arms.select(key.alias("review"), "question"))
    labelled = known.join(names, "review").withColumn("review", key)
    m = ranking.ranking_metrics(ranked, labelled).withColumn("arm", part(2)).withColumn("review", part(1))
    one = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("tnr"))).alias(f"tnr_{arm}")
    pivot = m.groupBy("review").agg(*(one(a) for a in ("title", "title_expanded", "criteria", "criteria_expanded")))
    delta = lambda kind: F.round(F.col(f"tnr_{kind}_expanded") - F.col(f"tnr_{kind}"), 6).alias(f"delta_{kind}")
    return pivot.select("*", delta("title"), delta("criteria"))


def expansion_summary(spark, d):
    """Per kind of question: reviews measured, improved and worsened by expansion, and the mean difference."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"delta_{k}").alias("delta")) for k in ("title", "criteria")))).alias("p")
    rows = expansion_arms(spark, d).select(pairs).select("p.*")
    return rows.groupBy("kind").agg(F.count("delta").alias("n"), metrics.count_if(F.col("delta") > 0).alias("improved"), metrics.count_if(F.col("delta") < 0).alias("worsened"), F.round(F.avg("delta"), 6).alias("mean_delta"))


def gap_candidates(spark, d):
    """Sentences of sections that point at something undone."""
    return documents.gap_candidates(b.sections(spark, d), ["pmcid", "section_no"], "text")


def figure_mentions(spark, d):
    """Sentences that refer to a figure, by paper and number."""
    return documents.figure_mentions(b.papers(spark, d), ["pmcid"], "body")


def evidence_counts(spark, d):
    """Passages by paper and kind of evidence."""
    return documents.evidence_passages(b.sections(spark, d)).groupBy("pmcid", "kind").agg(F.count("*").alias("n"))


def _marked_up(spark, d):
    """Every paper as a JATS document made of its record and sections: a table of its sections, a figure per section on results
    (a heat map where its number is even), a supplement where the paper has a DOI."""
    plain = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", " ")
    safe = lambda c: F.replace(F.replace(F.replace(plain(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    tag = lambda name, *inner: F.concat(F.lit(f"<{name}>"), *inner, F.lit(f"</{name.split()[0]}>"))
    no = F.col("section_no").cast("string")
    head = F.when(F.trim(F.coalesce("title", F.lit(""))) != "", tag("title", safe(F.col("title")))).otherwise("")
    prose = F.array_join(F.transform(F.split(safe(F.col("text")), "\n"), lambda p: tag("p", p)), "")
    figure = tag("fig", tag("label", F.lit("Figure "), no), tag("caption", tag("p", F.when(F.col("section_no") % 2 == 0, "Heat map of ").otherwise("Plot of "), safe(F.col("title")))), F.concat(F.lit('<graphic l:href="'), no, F.lit('.png"/>')))
    parts = b.sections(spark, d).select("pmcid", "section_no", tag("sec", head, prose).alias("sec"), tag("tr", tag("td", no), tag("td", safe(F.col("title")))).alias("row"), F.when(F.col("title").rlike(documents.RESULT_HEADING), figure).otherwise("").alias("fig"))
    ordered = parts.groupBy("pmcid").agg(F.array_sort(F.collect_list(F.struct("section_no", "sec", "row", "fig"))).alias("l"))
    joined = lambda name: F.coalesce(F.array_join(F.transform("l", lambda s: s[name]), ""), F.lit(""))
    ids = F.concat(F.lit('<article-id pub-id-type="pmcid">'), "pmcid", F.lit("</article-id>"), F.when(F.col("doi").isNotNull(), F.concat(F.lit('<article-id pub-id-type="doi">'), safe(F.col("doi")), F.lit("</article-id>"))).otherwise(""))
    front = tag("front", ids, tag("article-title", safe(F.col("title"))), tag("abstract", tag("p", safe(F.col("abstract")))))
    table = tag("table-wrap", tag("label", F.lit("Table 1")), tag("caption", tag("p", F.lit("Sections"))), tag("table", F.lit("<tr><th>no</th><th>title</th></tr>"), joined("row")))
    supplement = F.when(F.col("doi").isNotNull(), '<supplementary-material l:href="data.csv"><label>S1</label></supplementary-material>').otherwise("")
    papers = b.papers(spark, d).select("pmcid", "doi", "title", "abstract").join(ordered, "pmcid", "left")
    xml = F.concat(F.lit('<article xmlns:l="http://www.w3.org/1999/xlink">'), front, tag("body", joined("sec"), table, joined("fig")), supplement, F.lit("</article>"))
    return documents.parse_papers(papers.select("pmcid", xml.alias("xml")), "pmcid", "xml")


def parsed_sections(spark, d):
    """Sections read back from the marked-up papers."""
    rows = _marked_up(spark, d).select("pmcid", F.posexplode("sections").alias("k", "s"))
    return rows.select("pmcid", (F.col("k") + 1).cast("bigint").alias("k"), F.length("s.title").cast("bigint").alias("title_chars"), F.sha2("s.text", 256).alias("sha256"))


def parsed_papers(spark, d):
    """What the marked-up papers hold: identifiers, tables with their rows, figures, heat maps, supplements, fragments."""
    rows = _marked_up(spark, d)
    heat = F.size(F.filter("figures", lambda f: f["kind"] == "heat_map"))
    c = lambda x: x.cast("bigint")
    return rows.select("pmcid", "ok", F.col("doi").isNotNull().alias("has_doi"), c(F.size("tables")).alias("n_tables"), c(F.size(F.flatten("tables.rows"))).alias("n_table_rows"), c(F.size("figures")).alias("n_figures"), c(heat).alias("n_heat_maps"), c(F.size("supplements")).alias("n_supplements"), documents.is_fragment(rows).alias("is_fragment"))


def content_coverage(spark, d):
    """Status of the eight kinds of content per paper: what its passages and its parsed parts hold."""
    counts = documents.evidence_passages(b.sections(spark, d)).groupBy("pmcid").agg(*(metrics.count_if(F.col("kind") == k).alias(k) for k in documents.EVIDENCE))
    parts = parsed_papers(spark, d).select("pmcid", F.col("n_tables").alias("data_tables"), F.col("n_heat_maps").alias("heat_maps"), F.col("n_figures").alias("graphs_charts"), F.col("n_supplements").alias("supplementary_files"))
    rows = b.papers(spark, d).select("pmcid", "is_fragment").join(counts, "pmcid", "left").join(parts, "pmcid", "left")
    return documents.coverage(rows, F.col("is_fragment"))


def kept_sections(spark, d):
    """Sections per paper with and without back matter."""
    all_of = b.sections(spark, d).groupBy("pmcid").agg(F.count("*").alias("n"))
    kept = documents.sections_kept(b.sections(spark, d)).groupBy("pmcid").agg(F.count("*").alias("n_kept"), metrics.count_if(F.col("title").rlike(documents.LIMITATION_HEADING)).alias("n_limitations"), metrics.count_if(F.col("title").rlike(documents.RESULT_HEADING)).alias("n_results"))
    return all_of.join(kept, "pmcid", "left").select("pmcid", "n", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_kept", "n_limitations", "n_results")))


def prompt_source(spark, d):
    """What a prompt can hold of each paper, results and limitations first."""
    return documents.prompt_source(b.sections(spark, d)).select("pmcid", F.sha2("text", 256).alias("sha256"), "truncated", "chars_available")


def body_roundtrip(spark, d):
    """Papers whose sections, joined again, give another body than the stored one."""
    title = F.when(F.col("title").isNotNull() & (F.col("title") != ""), F.concat_ws("\n", "title", "text")).otherwise(F.col("text"))
    joined = b.sections(spark, d).groupBy("pmcid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_no", title.alias("p")))), lambda s: s["p"]), "\n\n").alias("again"))
    return b.papers(spark, d).join(joined, "pmcid", "left").select("pmcid", (F.coalesce("again", F.lit("")) == F.col("body")).alias("same"))


def fulltext_coverage(spark, d):
    """Papers by the source of their record, with a row for all."""
    source = F.when(F.col("work_id").isNull(), "none").otherwise(F.concat(F.lit("W"), F.substring("work_id", -1, 1)))
    return metrics.coverage_with_totals(b.papers(spark, d).withColumn("topic", source), "topic")


def paper_identifiers(spark, d):
    """Identifiers, file names and DOIs of papers in their plain forms."""
    return b.papers(spark, d).select("pmcid", ft.pmcid(F.col("pmcid")).alias("found"), ft.normalise_doi(F.col("doi")).alias("doi"), ft.safe_name(F.col("title"), 40).alias("folder"))


def inverted_abstracts(spark, d):
    """Abstracts rebuilt from their inverted indexes: whether they come out as they were. Each within its row."""
    rows = b.works(spark, d).filter(F.length(F.trim("abstract")) > 0).select("review", "work_id", "abstract")
    rows = ft.held(rows, "words", F.split("abstract", " "))
    at = F.transform("words", lambda w, i: F.struct(i.alias("i"), w.alias("w")))
    rows = ft.held(rows, "at", at)
    rows = ft.held(rows, "index", F.map_from_entries(F.transform(F.array_distinct("words"), lambda w: F.struct(w, F.filter("at", lambda x: x["w"] == w)["i"]))))
    index = F.col("index")
    return rows.select("review", "work_id", (ft.inverted_text(index) == F.col("abstract")).alias("same"))


def span_sections(spark, d):
    """The section of its paper that each candidate sentence stands in."""
    spans = documents.gap_candidates(b.papers(spark, d), ["pmcid"], "body").select("pmcid", "candidate_no", F.col("sentence").alias("span"))
    return documents.section_of(spans, b.sections(spark, d)).select("pmcid", "candidate_no", "section_no")


def semantic_map(spark, d):
    """Vectors on their two principal axes."""
    return linalg.semantic_map(b.table(spark, d, "embeddings"), "vec_id", "embedding")


NAMES = [
    bm25_raw, bm25_porter, random_rank, dense_works, hybrid_rrf, rerank, bm25_ranking_metrics, ranking_recall_curve, run_recall_curve, decision_order, append_rest, dense_rank, query_expansion, expansion_arms, expansion_summary, parsed_sections, parsed_papers,
    gap_candidates, figure_mentions, evidence_counts, content_coverage, kept_sections, prompt_source, body_roundtrip, fulltext_coverage, paper_identifiers, inverted_abstracts, span_sections, semantic_map,
]
QUERIES = {q.__name__: q for q in NAMES}
