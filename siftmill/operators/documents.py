"""Papers: marked-up text to sections, tables, figures and equations; passages that carry evidence; prompt sources."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.functions.text import normalise, sentences

#: Headings and cues, as patterns.
BACK_MATTER = (
    r"(?i)^\s*(?:acknowledge?ments?|authors?.{0,3} (?:contributions?|information)|funding|competing interests?|conflicts? of interest|declarations?"
    r"|(?:availability|accessibility) of data|data availability(?: statement)?|ethics? (?:approval|statement)|consent (?:for publication|to participate)"
    r"|abbreviations?|supplementary (?:information|material)|additional file|publisher.{0,3}s note|about this (?:article|supplement)|peer review|received|copyright|licen[cs]e)\b"
)
LIMITATION_HEADING = r"(?i)\b(?:limitation|weakness|caveat|future (?:work|research|direction)|strengths? and limitations)\b"
RESULT_HEADING = r"(?i)\b(?:result|finding|outcome)s?\b"
GAP_CUE = (
    r"(?i)\b(?:further (?:research|work|stud\w+|investigation)|future (?:research|work|stud\w+|trial\w*)|more (?:research|work|stud\w+|data|evidence)"
    r"|additional (?:research|work|stud\w+)|research is needed|studies are needed|remains? (?:to be|unclear|unknown|unanswered)"
    r"|not (?:yet )?(?:been )?(?:examined|investigated|studied|established|explored|known|clear)|we did not (?:examine|investigate|study|assess|measure|address)"
    r"|no (?:stud\w+|trial\w*|research) (?:has|have)|little is known|warrants? further|should be (?:examined|investigated|explored|studied|addressed)"
    r"|needs? (?:to be|further)|unanswered|open question)\b"
)
METHOD_HEADING = r"(?i)method|procedure|design|participant|recruit|intervention|measurement|analysis"
LIMITED_HEADING = r"(?i)limitation|weakness|caveat|future"
STATISTIC = r"(?i)confidence interval|\bCI\b|\bp\s*[<=>]|\bP value|odds ratio|risk ratio|hazard ratio|mean difference|test statistic|standard deviation|regression coefficient"
LIMITED = r"(?i)\blimitations?\b|\blimited by\b|\bwe (?:did not|could not|cannot)\b|\bfuture (?:studies|research|work)\b"
MODEL = r"(?i)\bmodel\b|\bequation\b|\bparameter\b"
EVIDENCE = ["methods", "statistical_results", "limitations", "equations_models"]
#: Shortest body of a whole paper; characters of a prompt's source; candidate sentences of a paper.
WHOLE_BODY, PROMPT_CHARS, CANDIDATES = 5_000, 24_000, 12

PAPER = (
    "id string, ok boolean, pmcid string, doi string, title string, abstract string, sections array<struct<title:string,text:string>>, "
    "tables array<struct<label:string,caption:string,rows:array<array<string>>,spans:array<array<struct<rowspan:int,colspan:int>>>,footnotes:array<string>>>, "
    "figures array<struct<label:string,caption:string,kind:string,refs:array<string>>>, equations array<string>, supplements array<struct<label:string,caption:string,ref:string>>"
)


def _text(node) -> str | None:
    """All text below a node, white space collapsed; None where there is none."""
    found = "" if node is None else " ".join("".join(node.itertext()).split())
    return found or None


def _local(node) -> str:
    """A node's tag without its namespace."""
    return node.tag.rsplit("}", 1)[-1] if isinstance(node.tag, str) else ""


def _links(node) -> Iterator[str]:
    """Addresses that a node and all below it refer to."""
    return (value for n in node.iter() for name, value in n.attrib.items() if name.endswith("href") and value)


class _Reader:
    """One walk over a marked-up paper; a method per tag takes what it is there for, and tells whether to go below it."""

    def __init__(self) -> None:
        self.front: dict[str, str | None] = {}
        self.sections, self.loose, self.tables, self.figures = [], [], [], []
        self.formulas: list[tuple[bool, str]] = []
        self.supplements: dict[str, dict] = {}

    def walk(self, node, part: str = "") -> None:
        tag = _local(node)
        if tag in ("front", "body"):
            part = part or tag
        take = getattr(self, "on_" + tag.replace("-", "_"), None)
        if take:
            take(node, part)
        for child in node:
            self.walk(child, part)

    def first(self, name: str | None, value: str | None) -> None:
        if name and value:
            self.front.setdefault(name, value)

    def on_article_id(self, node, part: str) -> None:
        if part == "front":
            self.front[node.get("pub-id-type")] = _text(node)  # the last one stands

    def on_article_title(self, node, part: str) -> None:
        if part == "front":
            self.first("title", _text(node))

    def on_abstract(self, node, part: str) -> None:
        if part == "front":
            self.first("abstract", _text(node))

    def on_sec(self, node, part: str) -> None:
        """Paragraphs of the section itself; sections within it are rows of their own."""
        if part != "body":
            return
        title = _text(node.find("title"))
        prose = [t for p in node.findall("p") if (t := _text(p))]
        if prose and not re.search(BACK_MATTER, title or ""):
            self.sections.append({"title": title, "text": "\n".join(prose)})

    def on_p(self, node, part: str) -> None:
        if part == "body" and (text := _text(node)):
            self.loose.append(text)

    def on_table_wrap(self, node, part: str) -> None:
        cells = [row for tr in node.iter("tr") if (row := [c for c in tr if _local(c) in ("td", "th")])]
        span = lambda c, name: int(v) if (v := c.get(name) or "").isdigit() else 1
        self.tables.append(
            {
                "label": _text(node.find("label")),
                "caption": _text(node.find("caption")),
                "rows": [[_text(c) or "" for c in row] for row in cells],
                "spans": [[{k: span(c, k) for k in ("rowspan", "colspan")} for c in row] for row in cells],
                "footnotes": [t for foot in node.findall("table-wrap-foot") if (t := _text(foot))],
            }
        )

    def on_fig(self, node, part: str) -> None:
        caption = _text(node.find("caption"))
        kind = "heat_map" if re.search("(?i)heat[ -]?map", caption or "") else "figure"
        self.figures.append({"label": _text(node.find("label")), "caption": caption, "kind": kind, "refs": [next(found) for g in node.iter("graphic") if (found := _peek(_links(g)))]})

    def on_disp_formula(self, node, part: str) -> None:
        self._formula(node, False)

    def on_inline_formula(self, node, part: str) -> None:
        self._formula(node, True)

    def _formula(self, node, inline: bool) -> None:
        named = {name: next((n for n in node.iter() if _local(n) == name), None) for name in ("tex-math", "math")}
        text = (named["tex-math"].text if named["tex-math"] is not None else None) or _text(named["math"] if named["math"] is not None else node)
        if text:
            self.formulas.append((inline, text))

    def on_supplementary_material(self, node, part: str) -> None:
        for ref in _links(node):
            self.supplements.setdefault(ref, {"label": _text(node.find("label")) or ref, "caption": _text(node.find("caption")) or "", "ref": ref})

    on_supplement = on_media = on_supplementary_material

    def row(self) -> dict:
        if not self.sections and self.loose:
            self.sections = [{"title": None, "text": "\n".join(self.loose)}]
        return {
            "pmcid": self.front.get("pmcid") or self.front.get("pmc"),
            **{name: self.front.get(name) for name in ("doi", "title", "abstract")},
            "sections": self.sections,
            "tables": self.tables,
            "figures": self.figures,
            "equations": [text for _, text in sorted(self.formulas, key=lambda f: f[0])],  # displayed ones first
            "supplements": list(self.supplements.values()),
        }


def _peek(found: Iterator[str]) -> Iterator[str] | None:
    """found with at least one item, or None."""
    for one in found:
        return iter([one])
    return None


def parse_paper(key: str, xml: str | None) -> dict:
    """One JATS document as a row of PAPER; ok is false, and all else null, where it isn't XML."""
    reader = _Reader()
    try:
        reader.walk(ET.fromstring(xml or ""))
    except ET.ParseError:
        return {**dict.fromkeys(p.split()[0] for p in _columns()), "id": key, "ok": False}
    return {"id": key, "ok": True, **reader.row()}


def parse_papers(df: DataFrame, key: str, xml: str) -> DataFrame:
    """Every document of df parsed; see PAPER."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([parse_paper(k, x) for k, x in zip(batch["id"], batch["xml"])], columns=[p.split()[0] for p in _columns()])

    return df.select(F.col(key).cast("string").alias("id"), F.col(xml).alias("xml")).mapInPandas(run, PAPER)


def _columns() -> list[str]:
    depth, names, part = 0, [], ""
    for c in PAPER + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            names.append(part.strip())
            part = ""
        else:
            part += c
    return names


def body_of(sections: Column) -> Column:
    """All sections in their order, titles on lines of their own, joined by empty lines."""
    return F.array_join(F.transform(sections, lambda s: F.concat_ws("\n", F.nullif(s["title"], F.lit("")), s["text"])), "\n\n")


def is_fragment(papers: DataFrame) -> Column:
    """A stub: a short body without headings, tables and figures."""
    bare = (F.size("tables") == 0) & (F.size("figures") == 0) & ~F.exists("sections", lambda s: s["title"].isNotNull())
    return (F.length(body_of(F.col("sections"))) < WHOLE_BODY) & bare


def table_grid(rows: list[list[str]], spans: list[list[dict]], widest: int = 100) -> list[list[str]]:
    """A table as a rectangle: each cell's text stands in the first place that it spans, the others are blank.

    Every row is kept; a single span counts for widest places at most.
    """
    taken: dict[int, set[int]] = {}
    grid: list[dict[int, str]] = []
    for r, (cells, sizes) in enumerate(zip(rows, spans)):
        line: dict[int, str] = {}
        at = 0
        for cell, size in zip(cells, sizes):
            held = taken.setdefault(r, set())
            while at in held:
                at += 1
            line[at] = cell
            high, wide = (min(max(1, int(size[k])), widest) for k in ("rowspan", "colspan"))
            for below in range(r, r + high):
                taken.setdefault(below, set()).update(range(at, at + wide))
            at += wide
        grid.append(line)
    width = max((max(places) + 1 for r, places in taken.items() if r < len(grid) and places), default=0)
    return [[line.get(c, "") for c in range(width)] for line in grid]


def sections_kept(sections: DataFrame) -> DataFrame:
    """Sections (pmcid, section_no, title, text) without back matter, by their headings."""
    return sections.filter(F.col("title").isNull() | ~F.col("title").rlike(BACK_MATTER))


def evidence_passages(sections: DataFrame) -> DataFrame:
    """Paragraphs of sections with the kinds of evidence they carry: a row per paragraph and kind."""
    para = sections.select("pmcid", "section_no", "title", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("para_no", "quote")).filter(F.trim("quote") != "")
    heading, quote = F.coalesce("title", F.lit("Untitled section")), F.col("quote")
    kinds = {
        "methods": heading.rlike(METHOD_HEADING),
        "statistical_results": quote.rlike(STATISTIC),
        "limitations": heading.rlike(LIMITED_HEADING) | quote.rlike(LIMITED),
        "equations_models": quote.rlike(MODEL),
    }
    found = F.array_compact(F.array(*(F.when(test, kind) for kind, test in kinds.items())))
    return para.select("pmcid", "section_no", "para_no", heading.alias("heading"), "quote", F.explode(found).alias("kind"))


def gap_candidates(df: DataFrame, key: list[str], text: str, most: int = CANDIDATES) -> DataFrame:
    """The first sentences of every text that point at something undone: 25 characters or more, each once."""
    parts = df.select(*key, F.posexplode(sentences(F.col(text))).alias("at", "sentence")).filter((F.length("sentence") >= 25) & F.col("sentence").rlike(GAP_CUE))
    first = parts.groupBy(*key, normalise(F.col("sentence")).alias("n")).agg(F.min(F.struct("at", "sentence")).alias("f"))
    ordered = first.groupBy(*key).agg(F.slice(F.array_sort(F.collect_list("f")), 1, most).alias("fs"))
    return ordered.select(*key, F.posexplode("fs").alias("k", "f")).select(*key, (F.col("k") + 1).cast("bigint").alias("candidate_no"), "f.sentence")


def figure_mentions(df: DataFrame, key: list[str], text: str, number: Column | None = None, most: int = 3) -> DataFrame:
    """The first sentences of every text that refer to each figure number (or to the one given)."""
    split = F.split(F.col(text), r"(?<=[.!?])\s+(?=[A-Z(])")
    parts = df.select(*key, F.posexplode(F.transform(split, F.trim)).alias("at", "sentence"))
    found = F.regexp_extract_all("sentence", F.lit(r"(?i)\bfig(?:ure|ures|s|\.)?\s*\.?\s*(\d+)(?!\d)(?!\.\d)"), F.lit(1))
    rows = parts.withColumn("figure", F.explode(F.array_distinct(found)))
    if number is not None:
        rows = rows.filter(F.col("figure") == number)
    ordered = rows.groupBy(*key, "figure").agg(F.slice(F.array_sort(F.collect_list(F.struct("at", "sentence"))), 1, most).alias("m"))
    return ordered.select(*key, F.col("figure").cast("int").alias("figure"), F.posexplode("m").alias("k", "m1")).select(*key, "figure", (F.col("k") + 1).cast("bigint").alias("mention_no"), "m1.sentence")


def prompt_source(sections: DataFrame, first: str = "(?i)result|finding|limitation|discussion", most: int = PROMPT_CHARS) -> DataFrame:
    """Per paper its sections, those of the first headings in front, joined and cut at most; what was available is told."""
    front = F.when(F.coalesce("title", F.lit("")).rlike(first), 0).otherwise(1)
    part = F.concat_ws("\n", F.nullif(F.col("title"), F.lit("")), "text")
    joined = sections.filter(F.trim(F.coalesce("text", F.lit(""))) != "").groupBy("pmcid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(front.alias("f"), "section_no", part.alias("p")))), lambda s: s["p"]), "\n\n").alias("t"))
    text = F.trim("t")
    return joined.select("pmcid", F.substring(text, 1, most).alias("text"), (F.length(text) > most).alias("truncated"), F.length(text).cast("bigint").alias("chars_available"))


def section_of(spans: DataFrame, sections: DataFrame, by: str = "pmcid") -> DataFrame:
    """The first section of its paper that each span stands in, word for word after normalisation."""
    joined = spans.join(sections.select(by, "section_no", "title", normalise(F.col("text")).alias("_n")), by)
    hit = F.contains("_n", normalise(F.col("span"))) & (F.length(F.trim("span")) > 0)
    return joined.groupBy(*spans.columns).agg(F.min(F.when(hit, F.struct("section_no", "title"))).alias("s")).select(*spans.columns, "s.section_no", F.col("s.title").alias("section"))


def coverage(counts: DataFrame, fragment: Column) -> DataFrame:
    """Status of the eight kinds of content per paper from a struct of counts: a row per paper and kind."""
    labels = ["data_tables", "heat_maps", "graphs_charts", "statistical_results", "methods", "equations_models", "supplementary_files", "limitations"]
    rows = counts.select("pmcid", fragment.alias("fragment"), F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.coalesce(F.col(k), F.lit(0)).cast("bigint").alias("n")) for k in labels))).alias("c")).select("pmcid", "fragment", "c.*")
    status = (
        F.when(F.col("kind").isin("heat_maps", "graphs_charts") & (F.col("n") > 0), "needs_human_review")
        .when((F.col("kind") == "supplementary_files"), "source_unavailable")
        .when(F.col("n") > 0, "extracted")
        .when(F.col("fragment"), "source_unavailable")
        .otherwise("not_found")
    )
    return rows.withColumn("status", status).drop("fragment")


def readability() -> Column:
    """Whether a paper can be read, from its class of availability and an open copy's address (elsewhere)."""
    status = F.col("availability")
    return F.when(status == "full", "held").when(F.col("elsewhere").isNotNull(), "elsewhere").when(status.isin("lookup_failed", "error"), "unknown").otherwise("none")


def availability(df: DataFrame) -> Column:
    """Class of a lookup from (error, doi, found, pmcid, has_text, is_fragment) columns."""
    c = F.col
    return (
        F.when(c("error").isNotNull(), "lookup_failed")
        .when(c("doi").isNull() & c("pmcid").isNull(), "no_doi")
        .when(~c("found"), "not_indexed")
        .when(c("pmcid").isNull(), "no_pmc")
        .when(~c("has_text"), "paywalled")
        .when(c("is_fragment"), "fragment")
        .otherwise("full")
    )


def match_assets(refs: DataFrame, assets: DataFrame, by: str = "pmcid") -> DataFrame:
    """Each reference with the asset of its exact name if that is unique, else of its stem if that is unique, else null."""
    name = lambda c: F.regexp_extract(c, r"([^/\\]+)$", 1)
    stem = lambda c: F.regexp_replace(name(c), r"\.[^.]*$", "")
    held = assets.select(by, F.col("name").alias("asset"), name(F.col("name")).alias("n"), stem(F.col("name")).alias("s"))
    once = lambda k: held.groupBy(by, k).agg(F.count("*").alias("c"), F.min("asset").alias(f"by_{k}")).filter("c = 1").drop("c")
    keyed = refs.withColumn("n", name(F.col("ref"))).withColumn("s", stem(F.col("ref")))
    return keyed.join(once("n"), [by, "n"], "left").join(once("s"), [by, "s"], "left").select(*refs.columns, F.coalesce("by_n", "by_s").alias("asset"))
