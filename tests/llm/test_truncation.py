import pytest

from siftmill.llm import truncation as X

SENTENCES = [
    "The association was partial among tidal marshes and vanished after adjustment for age",
    "These data do not support written disclosure as a remedy for alcohol use",
    "Further work should separate road salt from dust in urban verges",
    "Samples were incubated at 20 °C for 4 h before analysis",
    "Les résultats suggèrent que la télésurveillance mérite une évaluation",
    "We searched 14 databases for reports on stepped care",
]


@pytest.fixture(scope="module")
def model(spark):
    texts = [". ".join(SENTENCES[i % 6 :] + SENTENCES[: i % 6]) + "." for i in range(60)]
    texts += [f"{SENTENCES[i % 6]}. Registered as TRK-{i:06d}" for i in range(20)]
    return X.train_endings(spark.createDataFrame([(t,) for t in [*texts, None, "", " "]], "abstract string"), "abstract")


@pytest.mark.parametrize("tail", ["The association was par", "These data do not support written disclosure as a", "Les résultats suggèrent que la télésur…", "We searched 14 databases (in", "Samples were incubated at 20 °C for 4 h bef ", "T"])
def test_cut(model, tail):
    assert X.abstract_is_cut(". ".join(SENTENCES) + ". " + tail, model)


@pytest.mark.parametrize(
    "tail",
    ["", SENTENCES[0], SENTENCES[2], "Registered as TRK-123456", "© 2020 the contributors", "Keywords: salt; dust; verges", "(see the companion protocol)", "Editors asked: “Why salt?”", SENTENCES[1] + " \n"],
)
def test_whole(model, tail):
    assert not X.abstract_is_cut(". ".join(SENTENCES) + ". " + tail, model)


def test_no_text(model):
    assert not any(X.abstract_is_cut(t, model) for t in (None, "", "  \n"))


ABSTRACT = "We set out to test it, but records were few. Values rose by 0.46 (95% CI 0.35 to 1.04); later they fell. A before-after design was used."


@pytest.mark.parametrize("span", ["We set out to te", "We set out to test it, but records", "We set out to tes…", "Values rose by 0.", "A before", "later they fell. A before-after des ", "Vаlues rosе by 0.46 (95% CI"])
def test_spans_that_stop_inside(span):
    assert X.span_is_cut(span, "Title", ABSTRACT)


@pytest.mark.parametrize("span", [None, "", " ", "We set out to test it", "We set out to test it,", "but records were few", "“but records were few.”", "later they fell", "A before-after design was used", "nothing of the kind in th", "Title"])
def test_spans_that_are_whole(span):
    assert not X.span_is_cut(span, "Title", ABSTRACT)


def test_altered_spans_are_placed_by_their_end():
    assert X.span_is_cut("We did test something else, but records were few. Values rose by", "T", ABSTRACT)
    assert not X.span_is_cut("We did test something else, but records were few", "T", ABSTRACT)


def test_field_limits(spark):
    rows = [("A", f"{i}", ("x" * 10 + " ") * 20 + "y" * (i % 3) if i > 25 else "z" * 150) for i in range(60)]
    df = spark.createDataFrame(rows, "publisher string, id string, abstract string")
    assert {(r["source"], r["size"]) for r in X.field_limits(df, ["id"], "abstract", "publisher").collect()} >= {("A", 150)}


def test_frames(spark):
    rows = [("r", "1", "P", "T", ABSTRACT + " It was found by a", 1), ("r", "1", "P", "T", ABSTRACT + " It was found by a", 1), ("r", "2", None, None, None, 2), ("r", "3", "P", "T", "", 3), (None, "4", "P", "T", "word " * 60_000 + "end.", None)]
    works = spark.createDataFrame(rows, "review string, work_id string, publisher string, title string, abstract string, size int")
    assert [tuple(r) for r in X.cut_abstracts(works, ["review", "work_id"]).collect()] == [("r", "1")]
    assert X.cut_abstracts(works.limit(0), ["review", "work_id"]).count() == 0
    spans = spark.createDataFrame([("u", "r", "1", "later they fe"), ("u", "r", "1", "later they fe"), ("u", "r", "2", "later they fe"), ("v", "r", "1", None), ("w", "r", "1", "  "), ("x", None, "4", "word wo"), ("y", "r", "1", "x" * 300_000)], "run_id string, review string, work_id string, evidence_span string")
    got = [tuple(r) for r in X.cut_spans(spans, works, ["run_id", "review", "work_id"], ["review", "work_id"]).collect()]
    assert got == [("u", "r", "1")]
    assert X.cut_spans(spans.limit(0), works, ["run_id", "review", "work_id"], ["review", "work_id"]).count() == 0


@pytest.mark.parametrize("end", ["soil <i", "soil </", "soil &am", "soil &#82", "soil \\u00e", "soil \\", "soil \ufffd", "soil \u00c3"])
def test_broken_ends(end):
    model = X.Endings()
    assert X.abstract_is_cut(f"Grass was counted. The {end}", model)


@pytest.mark.parametrize("end", ["paid for R&D.", "was 2 < 3 m.", "of <i>soil</i>.", "saw A&B Ltd."])
def test_sound_ends(end):
    assert not X.abstract_is_cut(f"Grass was counted. The {end}", X.Endings())
