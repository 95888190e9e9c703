import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftmill.llm import confusables as C


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("ｗｉｄｅ　ｔｅｘｔ １２％", "wide text 12%"),
        ("näive café", "näive café"),
        ("in​vis­ible﻿", "invisible"),
        ("a b c d", "a b c d"),
        ("wіth Сyrillіc lеttеrѕ", "with Cyrillic letters"),
        ("mοdels Αnd Νames", "models And Names"),
        ("сор saw the рееr group", "cop saw the peer group"),
    ],
)
def test_cases(text, want):
    assert C.unify(text) == (want, True)


@pytest.mark.parametrize(
    "text",
    [None, "", "plain", "naïve façade – “quoted” ½ x² 5 µg ±2 …", "IFN-γ and β-carotene at 25 μm, χ² = 3", "The word σύνοψη heads the summary", "Данные о выборке и с учётом возраста", "x̄ and p̂ were reported", "K–S test, 10 Å"],
)
def test_no_cases(text):
    assert C.unify(text) == (text, False)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abс еоА­​　ｗ１é́Ωдн мβγ.\n"), max_size=40))
def test_idempotent(text):
    once, _ = C.unify(text)
    assert C.unify(once) == (once, False)
    assert not C.INVISIBLE.search(once) and unicodedata.normalize("NFC", once) is not None


def test_java_trigger_sees_every_case(spark):
    samples = ["ｗ", "á", "​", "­", " ", " ", "　", "wіth", "ο", "﻿", "⁠", " ", "️", "\u0085", " "]
    df = spark.createDataFrame([(s,) for s in samples] + [("plain – ½ é",)], "t string")
    assert [r["t"] for r in df.filter(~F.col("t").rlike(C.TRIGGER)).collect()] == ["plain – ½ é"]


def test_frames(spark):
    rows = [("a", "wіth", 1), ("a", "wіth", 1), ("b", None, 2), ("c", "", 3), (None, "x​", None), ("d", "é " * 100_000, 4)]
    df = spark.createDataFrame(rows, "k string, t string, value int").withColumn("text", F.lit("other")).withColumn("f", F.lit(0)).drop("value")
    got = {(r["k"], r["text"][:5]) for r in C.differing(df, ["k"], "t").distinct().collect()}
    assert got == {("a", "with"), (None, "x"), ("d", "é é é")}
    assert [r["t"] for r in C.with_consistent(df.filter("k in ('b', 'c')"), ["t"]).orderBy("k").collect()] == [None, ""]
    assert C.differing(df.limit(0), ["k"], "t").count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("tаble ᎪᏙᎪ and ⲥⲟre with ꓮꓠꓳ", "table AVA and core with ANO"),
        ("𝐛𝐨𝐥𝐝 and 𝒮𝒸ℴ𝓅ℯ, p𝐚tient", "bold and Scope, patient"),
        ("Տtudу of զuality, cafё", "Study of quality, cafë"),
        ("ᖴull ⵝ-ray and ПА", "Full X-ray and ПА"),
        ("а trial of а сору", "a trial of a copy"),
        ("page\x0bbreak\x0cand\x00 nul", "page break and nul"),
        ("か\u3099 in text", "が in text"),
    ],
)
def test_look_alikes_of_all_alphabets(text, want):
    assert C.unify(text) == (want, True)
    assert C.unify(want) == (want, False)


@pytest.mark.parametrize("text", ["at 9 В°C, ВїInfluye", "𝑥 and ℝ", "וWindows של מערכת", "group Α with χ", "тест а с", "line\r\nend\tof", "αhelix, TNFα, ΔT"])
def test_no_look_alikes(text):
    assert C.unify(text) == (text, False)


def test_every_character_that_is_changed_reaches_python(spark):
    changed = []
    for c in map(chr, (*range(0xD800), *range(0xE000, 0x20000), *range(0xE0000, 0xE1010))):
        changed += [t for t in (f"some te{c}t", f"some {c}{c} {c} here") if C.unify(t)[1]]
    df = spark.createDataFrame([(t,) for t in changed], "t string")
    assert len(changed) > 4_000 and [r["t"] for r in df.filter(~F.col("t").rlike(C.TRIGGER)).head(5)] == []
    assert {r["text"] for r in C.differing(df.filter("t like '%te𝐚t%' or t like '%teᎪt%' or t like '%teꓮt%'"), ["t"], "t").collect()} == {"some teat", "some teAt"}
