import json

from siftmill.operators import pipeline as P

LONG = "We measured the outcome in one hundred adults over six months. " * 5


def test_discovery_keeps_what_was_screened_out(spark):
    found = spark.createDataFrame(
        [("r", "W1", "A", LONG, "10.1/a", 2020, 1), ("r", "W2", "A again", LONG, "doi:10.1/A", 2021, 2), ("r", "W3", "B", "short", None, 2020, 3), ("r", "W4", "C", LONG, None, 2020, 4), ("r", "W5", "D", LONG, None, 2020, 5)],
        "review string, work_id string, title string, abstract string, doi string, year int, position int",
    )
    say = lambda d, s: json.dumps({"decision": d, "confidence": 0.9, "evidence_span": s})
    answers = spark.createDataFrame([("r", "W1", say("include", "measured the outcome in one hundred adults")), ("r", "W4", say("include", "an invented passage of some length"))], "review string, work_id string, raw_response string")
    fields = spark.createDataFrame([("r", w, ("100", "in one hundred adults over six months")) for w in ("W1", "W4")], "review string, work_id string, size struct<value:string,evidence_span:string>")
    got = {r["work_id"]: (r["decision"], r["size"]) for r in P.discover(found, answers, fields, ["size"]).collect()}
    assert got == {"W1": ("include", "100"), "W4": ("unverified", None), "W5": (None, None)}


def test_gaps_are_offered_verified_and_counted_until_the_cap(spark):
    good = [f"Further research is needed on topic number {i} in adults." for i in range(4)]
    text = "It rose over the months of the study. " + " ".join(good)
    rows = [("p", 1, "a", good[0]), ("p", 2, "b", "An invented sentence that further research needs."), ("p", 3, "c", "It rose over the months of the study."), ("p", 4, "d", good[0]), ("p", 5, "e", good[1]), ("p", 6, "f", good[2]), ("p", 7, "g", "Another invented sentence of the model here.")]
    items = spark.createDataFrame(rows, "id string, position int, value string, evidence_span string")
    offered = spark.createDataFrame([("p", s) for s in good], "id string, sentence string")
    sources = spark.createDataFrame([("p", text)], "id string, text string")
    kept, counts = P.accepted_gaps(items, offered, sources, most=2)
    assert [r["value"] for r in kept.orderBy("position").collect()] == ["a", "e"]
    c = counts.first()
    assert (c["n_kept"], c["n_unsupported"], c["n_withheld"]) == (2, 1, 1)
    assert P.accepted_gaps(items.limit(0), offered, sources)[0].count() == 0


def test_reading_order(spark):
    df = spark.createDataFrame([("r", "a", 2, 0.9, 1), ("r", "b", 0, 0.1, 2), ("r", "c", 0, 0.5, 3), ("r", "d", 1, None, 4), ("r", "e", 1, None, 5)], "review string, work_id string, reading_group int, similarity double, position int")
    assert [r["work_id"] for r in P.reading_order(df, ["review"]).orderBy("rank").collect()] == ["c", "b", "d", "e", "a"]
    v = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0], True), ([1.0, 0.0], None, True), ([1.0, 0.0], [1.0, 0.0], False)], "v array<double>, q array<double>, stated boolean")
    assert [r["similarity"] for r in P.similarity(v, "v", "q", "stated").collect()] == [1.0, None, None]
