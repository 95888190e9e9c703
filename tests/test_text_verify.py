import sqlite3
import unicodedata

import pytest
from pyspark.sql import functions as F

from siftmill.functions import text as ft
from siftmill.functions.porter import stem
from siftmill.functions.verify import verify

ABSTRACT = "We evaluated eleven object-oriented metrics on industrial code. Coupling measures outperform size measures. The “best” model – a forest – reached 0.91…"


def notes(spark, spans, source=ABSTRACT, title=None):
    rows = [(i, s, title, source) for i, s in enumerate(spans)]
    df = spark.createDataFrame(rows, "i int, evidence_span string, title string, abstract string")
    return [r["note"] for r in verify(df).orderBy("i").collect()]


def test_notes_in_their_order(spark):
    got = notes(
        spark,
        [
            "COUPLING MEASURES OUTPERFORM SIZE MEASURES",
            "the \"best\"\tmodel\n- a forest - reached 0.91...",
            '"Coupling measures outperform size measures" ()',
            "We evaluated eleven object-oriented metrics using a novel Bayesian framework",
            "An invented sentence that nobody wrote",
            None,
            "",
            "  \t ",
            "the results",
            ABSTRACT + " and a lot more besides",
            "(((((((reached))))))))))))",
        ],
    )
    assert got == [
        "exact_after_normalisation",
        "exact_after_normalisation",
        "exact_after_punctuation_strip",
        "partial_match_only",
        "not_found",
        "empty_span",
        "empty_span",
        "empty_span",
        "span_too_short(<20chars)",
        "span_longer_than_source",
        "not_found",
    ]


def test_no_source(spark):
    assert notes(spark, ["a quotation of more than twenty letters"], source=None) == ["no_source_text"]
    assert notes(spark, ["a quotation of more than twenty letters"], source="  ") == ["no_source_text"]


def test_normalise_agrees_with_python_and_is_idempotent(spark):
    texts = [None, "", "Straße ﬁn ½ Å", "Ｆｕｌｌ　ｗｉｄｔｈ", "tab\tand\nline", "a b c d", "x̄ ŭ é", "″quoted″ ‑ − …", "ΣΊΣΥΦΟΣ", "plain ascii"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    once = [r[0] for r in df.orderBy("i").select(ft.normalise(F.col("t"))).collect()]
    twice = [r[0] for r in df.orderBy("i").select(ft.normalise(ft.normalise(F.col("t")))).collect()]
    folds = str.maketrans(ft.TYPOGRAPHIC + "…", ft.PLAIN + "\x00")
    want = [" ".join(unicodedata.normalize("NFKC", t or "").translate(folds).replace("\x00", "...").split()).casefold() for t in texts]
    assert once == want and twice == once


def test_cleaning(spark):
    df = spark.createDataFrame([(" a ", "2019", "https://doi.org/10.1/X"), ("nan", "2019.0", "doi:10.1/x "), ("", "2019.5", " "), (None, None, None)], "t string, y string, d string")
    got = [tuple(r) for r in df.select(ft.blank_to_null(F.col("t")), ft.whole_year(F.col("y")), ft.normalise_doi(F.col("d"))).collect()]
    assert got == [("a", 2019, "10.1/x"), (None, 2019, "10.1/x"), (None, None, None), (None, None, None)]


def test_inverted_index(spark):
    df = spark.createDataFrame([({"the": [0, 3], "cat": [1], "and": [2], "dog": [4]},), ({"a": [0], "b": [7]},), ({},), (None,)], "m map<string,array<int>>")
    assert [r[0] for r in df.select(ft.inverted_text(F.col("m"))).collect()] == ["the cat and the dog", "a b", None, None]


def test_names_and_keys(spark):
    df = spark.createDataFrame([('A/B: "c"  d...',), ("",)], "t string")
    assert [r[0] for r in df.select(ft.safe_name(F.col("t"), 7)).collect()] == ["A B c d", ""]
    keys = [r[0] for r in spark.createDataFrame([("What  works?",), (" what works? ",)], "q string").select(ft.question_key(F.col("q"))).collect()]
    assert keys[0] == keys[1] and len(keys[0]) == 32


def test_stemmer_agrees_with_fts5():
    words = "relational conditional valenci digitizer vietnamization feudalism decisiveness formaliti sensibiliti triplicate electrical hopeful goodness revival adjustable replacement adoption homologous bowdlerize probate controll rolling hopping tanned filing conflated troubled sized agreed plastered motoring sky happy by a is generalizations oscillators".split()
    db = sqlite3.connect(":memory:")
    try:
        db.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    db.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", enumerate(words))
    assert {w: stem(w) for w in words} == {words[d]: term for term, d in db.execute("SELECT term, doc FROM v")}
