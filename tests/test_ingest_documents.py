import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from siftmill.functions import text
from siftmill.operators import documents, ingest, linalg
from siftmill.sources import files

PAPER = """<article xmlns:l="http://www.w3.org/1999/xlink">
<front><journal-meta/><article-meta><article-id pub-id-type="pmcid">PMC77</article-id><article-id pub-id-type="doi">10.5/moss</article-id>
<title-group><article-title>Moss on <sub>old</sub> walls</article-title></title-group><abstract><p>Moss  was
counted.</p></abstract></article-meta></front>
<body><sec><title>Sites</title><p>Nine walls.</p><sec><title>Climate</title><p>Wet; see <xref>map</xref>.</p><p>Cold.</p></sec></sec>
<sec><title>Counts</title><table-wrap><label>T1</label><caption><p>Walls</p></caption><table><tr><th>Wall</th><th>Moss</th></tr><tr><td>North</td><td>31</td></tr><tr/></table><table-wrap-foot><p>By eye.</p></table-wrap-foot></table-wrap>
<p>More moss in the north, <inline-formula>m</inline-formula>.</p><disp-formula><tex-math>m = 2n</tex-math></disp-formula></sec>
<fig><label>F1</label><caption><p>Heat-map of moss</p></caption><graphic l:href="walls.png"/></fig><fig><graphic/></fig>
<sec><title>Acknowledgements</title><p>To the wall keepers.</p></sec></body>
<back><supplementary-material l:href="raw.xlsx"><caption><p>Raw</p></caption><media l:href="raw.xlsx"/></supplementary-material></back></article>"""


def test_marked_up_papers(spark):
    df = spark.createDataFrame([("moss", PAPER), ("open", "<article><body>"), ("none", None), ("bare", "<article><body><p>One.</p><p/><p>Two.</p></body></article>")], "key string, xml string")
    rows = {r["id"]: r for r in documents.parse_papers(df, "key", "xml").collect()}
    moss = rows["moss"]
    assert (moss["ok"], moss["pmcid"], moss["doi"], moss["title"], moss["abstract"]) == (True, "PMC77", "10.5/moss", "Moss on old walls", "Moss was counted.")
    assert [tuple(s) for s in moss["sections"]] == [("Sites", "Nine walls."), ("Climate", "Wet; see map.\nCold."), ("Counts", "More moss in the north, m.")]
    table = moss["tables"][0]
    assert (table["label"], table["caption"], table["rows"], table["footnotes"]) == ("T1", "Walls", [["Wall", "Moss"], ["North", "31"]], ["By eye."])
    assert [(f["label"], f["kind"], f["refs"]) for f in moss["figures"]] == [("F1", "heat_map", ["walls.png"]), (None, "figure", [])]
    assert moss["equations"] == ["m = 2n", "m"] and [tuple(s) for s in moss["supplements"]] == [("raw.xlsx", "Raw", "raw.xlsx")]
    assert [tuple(s) for s in rows["bare"]["sections"]] == [(None, "One.\nTwo.")]
    assert not rows["open"]["ok"] and not rows["none"]["ok"] and rows["none"]["tables"] is None


def test_grid_of_spans():
    one = {"rowspan": 1, "colspan": 1}
    rows = [["a", "b"], ["c"], ["d", "e", "f"]]
    spans = [[{"rowspan": 2, "colspan": 1}, {"rowspan": 1, "colspan": 2}], [one], [one, one, one]]
    assert documents.table_grid(rows, spans) == [["a", "b", ""], ["", "c", ""], ["d", "e", "f"]]
    long = documents.table_grid([[str(i)] for i in range(150)], [[{"rowspan": 1, "colspan": 900}]] + [[one]] * 149)
    assert len(long) == 150 and len(long[0]) == 100 and documents.table_grid([], []) == []


def test_figure_numbers(spark):
    text = "See Figure 1. As in Fig. 12 it rose. Figs 1 and 3 agree (Figure 2.1). Figure 1 again. Once more figure 1!"
    df = spark.createDataFrame([("p", text), ("q", None)], "id string, t string")
    got = [(r["figure"], r["mention_no"], r["sentence"]) for r in documents.figure_mentions(df, ["id"], "t").orderBy("figure", "mention_no").collect()]
    assert [g[0] for g in got].count(1) == 3 and [g[0] for g in got].count(12) == 1 and all(g[0] != 2 for g in got)


def test_gap_sentences(spark):
    text = "Discussion\nFurther research is needed on dose and timing. Further research  is needed on dose and timing. It rose. It remains unclear whether the effect lasts."
    df = spark.createDataFrame([("p", text), ("q", ""), ("r", None)], "id string, t string")
    got = [r["sentence"] for r in documents.gap_candidates(df, ["id"], "t").orderBy("candidate_no").collect()]
    assert got == ["Further research is needed on dose and timing.", "It remains unclear whether the effect lasts."]


def test_prompt_source_order_and_cut(spark):
    df = spark.createDataFrame([("p", 1, "Introduction", "i" * 30), ("p", 2, None, "u" * 10), ("p", 3, "Results", "r" * 10)], "pmcid string, section_no int, title string, text string")
    r = documents.prompt_source(df, most=25).first()
    assert (r["text"], r["truncated"]) == ("Results\n" + "r" * 10 + "\n\nIntro", True)


def test_assets_match_by_name_then_stem(spark):
    refs = spark.createDataFrame([("p", "f1.jpg"), ("p", "f2"), ("p", "dup"), ("p", "none"), ("p", "F1.JPG")], "pmcid string, ref string")
    assets = spark.createDataFrame([("p", "x/f1.jpg"), ("p", "f2.png"), ("p", "dup.png"), ("p", "dup.gif")], "pmcid string, name string")
    assert {r["ref"]: r["asset"] for r in documents.match_assets(refs, assets).collect()} == {"f1.jpg": "x/f1.jpg", "f2": "f2.png", "dup": None, "none": None, "F1.JPG": None}


def test_availability_classes(spark):
    rows = [("x", None, None, None, None, None), (None, None, None, None, None, None), (None, "d", False, None, None, None), (None, "d", True, None, None, None), (None, "d", True, "P", False, None), (None, "d", True, "P", True, True), (None, "d", True, "P", True, False)]
    df = spark.createDataFrame(rows, "error string, doi string, found boolean, pmcid string, has_text boolean, is_fragment boolean")
    assert [r[0] for r in df.select(documents.availability(df)).collect()] == ["lookup_failed", "no_doi", "not_indexed", "no_pmc", "paywalled", "fragment", "full"]


def greedy(rows):
    kept, seen = {}, set()
    for pos, doi, title, year in sorted(rows):
        keys = [k for k in (("d", (doi or "").strip().lower().removeprefix("doi:")) if (doi or "").strip() else None, ("t", " ".join(title.split()).lower(), year) if title and title.strip() else None) if k]
        kept[pos] = not any(k in seen for k in keys)
        if kept[pos]:
            seen.update(keys)
    return kept


def test_web_duplicates_are_greedy(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, " ", *(f"10.1/{k}" for k in range(25))]), rng.choice([None, "", *(f"Title  {k}" for k in range(25))]), rng.choice([2019, 2020, None])) for i in range(120)]
    df = spark.createDataFrame([("g", *r) for r in rows], "g string, pos int, doi string, title string, year int")
    assert {r["pos"]: r["kept"] for r in ingest.web_duplicates(df, ["g"], "pos").collect()} == greedy(rows)


def test_web_duplicates_settle_long_chains(spark):
    # every row shares its DOI or its title and year with the next, so that a round settles one row
    rows = [(i, f"10.1/{(i + 1) // 2}", f"Title {i // 2}", 2020) for i in range(58)]
    df = spark.createDataFrame([("g", *r) for r in rows], "g string, pos int, doi string, title string, year int").coalesce(1)
    assert {r["pos"]: r["kept"] for r in ingest.web_duplicates(df, ["g"], "pos").collect()} == greedy(rows)


def test_upsert_replaces_whole_rows(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, at int, v string")
    new = spark.createDataFrame([("b", 2, None), ("b", 3, "z"), ("c", 1, "n")], old.schema)
    assert {tuple(r) for r in ingest.upsert(old, new, ["k"], "at").collect()} == {("a", 1, "x"), ("b", 3, "z"), ("c", 1, "n")}
    assert {tuple(r) for r in ingest.upsert(old.limit(0), new, ["k"], "at").collect()} == {("b", 3, "z"), ("c", 1, "n")}


def test_labels_must_be_labels(spark):
    good = spark.createDataFrame([("1",), ("0",)], "label_included string")
    assert [r[0] for r in ingest.require_labels(good).collect()] == [1, 0]
    with pytest.raises(Exception, match="not a label"):
        ingest.require_labels(spark.createDataFrame([("2",)], "label_included string")).collect()
    clash = spark.createDataFrame([("r", "W", 1), ("r", "W", 0), ("r", "V", 1)], "review string, work_id string, label int")
    assert [r["work_id"] for r in ingest.conflicting_labels(clash, ["review", "work_id"], "label").collect()] == ["W"]


def test_first_wins_and_fingerprint(spark):
    df = spark.createDataFrame([("r", "W", i, str(i)) for i in range(5)], "review string, work_id string, pos int, t string")
    assert [r["t"] for r in ingest.first_wins(df, ["review", "work_id"], ["pos"]).collect()] == ["0"]
    mark = lambda d: ingest.fingerprint(d, ["review"], F.col("pos"), [F.col("work_id"), F.col("t")]).first()["sha256"]
    assert mark(df) == mark(df.orderBy(F.desc("pos"))) != mark(df.filter("pos > 0"))


def test_criteria_source():
    content = b'[A]\ncriteria = " include x "\n[B]\ncriteria = ""\n'
    assert files.parse_criteria(content) == {"A": "include x"}
    with pytest.raises(ValueError):
        files.parse_criteria(content, "0" * 64)


def test_config():
    c = files.load_config('name = "n"\nmode = "screen"\nreviews = ["A"]\n', {"A"})
    assert (c.reviews, len(c.config_hash)) == (("A",), 10)
    for bad in ('name = "n"\nmode = "m"\nx = 1', 'name = "n"\nmode = "m"\nreviews = ["Z"]', 'name = "n"\nmode = "m"\nrecall_target = 0'):
        with pytest.raises(ValueError):
            files.load_config(bad, {"A"})


def test_run_index_and_report(spark, tmp_path):
    review = {"review": "A", "n_records": 10, "n_included": 2, "prevalence": 0.2, "ranking": {"tnr_at_recall": 0.5, "wss_at_recall": 0.4}}
    files.write_run(str(tmp_path / "20260101-gapconsensus-x"), {"metrics.json": {"schema": 2, "per_review": [review]}})
    files.write_run(str(tmp_path / "20260102-gap-x"), {"metrics.json": {"schema": 1, "per_review": [review]}})
    (tmp_path / "20260103-abc").mkdir()
    index = files.run_index(spark, str(tmp_path))
    assert {r["run"][9:]: (r["kind"], r["schema"]) for r in index.collect()} == {"gapconsensus-x": ("gap consensus", 2), "gap-x": ("gap", 1), "abc": ("screening", None)}
    with pytest.warns(UserWarning, match="20260102-gap-x"):
        rows = files.report_rows(index).collect()
    assert [(r["review"], r["tnr"]) for r in rows] == [("A", 0.5)]
    assert "| A | 0.500 |" in files.markdown([{"review": "A", "tnr": 0.5}], ["review", "tnr"])


def test_archives_are_bounded(spark, tmp_path):
    def archive(name, entries):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            for n, data in entries:
                z.writestr(n, data)
        (tmp_path / name).write_bytes(buffer.getvalue())

    archive("a.zip", [("t.csv", "x,y\n1,2\n"), ("n.txt", "text"), ("j.json", json.dumps({"a": 1})), ("b.bin", b"\0")])
    archive("many.zip", [(f"{i}.txt", "x") for i in range(151)])
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    got = {(r["path"].rsplit("/", 1)[1], r["name"]): r for r in files.archive_assets(spark, str(tmp_path)).collect()}
    assert got["a.zip", "t.csv"]["rows"] == [["x", "y"], ["1", "2"]] and got["a.zip", "n.txt"]["text"] == "text"
    assert got["a.zip", "b.bin"]["status"] == "unsupported" and got["many.zip", None]["status"] == "refused" and got["bad.zip", None]["status"] == "unreadable"


def test_files_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([("a", 'x, "y"\nz', 1), ("b", None, None)], "k string, t string, n int")
    files.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "c"), df.schema).collect())) == [("a", 'x, "y"\nz', 1), ("b", None, None)]
    files.write_jsonl(df, str(tmp_path / "j"))
    assert sorted(map(tuple, files.read_jsonl(spark, str(tmp_path / "j"), df.schema).collect())) == [("a", 'x, "y"\nz', 1), ("b", None, None)]
    with pytest.raises(TypeError):
        files.require_schema(df.drop("n"), df.schema)
    files.export_project([{"work_id": "W1", "title": "T", "relevance": "relevant", "evidence_span": None}], str(tmp_path / "p.zip"))
    with zipfile.ZipFile(tmp_path / "p.zip") as z:
        assert z.namelist() == ["001 W1/paper.md", "summary.csv"]


def test_verified_includes_and_names(spark, tmp_path):
    rows = [("W1", "include", True), ("W2", "include", False), ("W3", "exclude", True), ("W4", None, None)]
    files.write_jsonl(spark.createDataFrame(rows, "work_id string, decision string, span_verified boolean"), str(tmp_path / "r"))
    assert [r["work_id"] for r in files.verified_includes(spark, str(tmp_path / "r"), "work_id string, decision string, span_verified boolean").collect()] == ["W1"]
    df = spark.createDataFrame([("What  of *moss*?",)], "q string").withColumn("at", F.timestamp_micros(F.lit(1_767_225_600_000_001)))
    r = df.select(text.search_text(F.col("q")).alias("s"), text.criteria_version(F.col("q")).alias("c"), text.run_name(F.col("at"), F.lit("ab12"), "gap").alias("n")).first()
    assert (r["s"], len(r["c"]), r["n"]) == ("What of moss", 12, "20260101T000000000001Z-gap-ab12")


def test_map_explains_variance(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5)) * [5, 3, 1, 0.5, 0.1]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id int, e array<double>")
    got = linalg.semantic_map(df, "vec_id", "e").first()
    s = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2
    assert abs(got["explained"] - s[:2].sum() / s.sum()) < 1e-5
    with pytest.raises(ValueError):
        linalg.semantic_map(df.limit(2), "vec_id", "e")
