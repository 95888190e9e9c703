import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftmill.llm import pairs as P
from siftmill.llm.truncation import answer_is_cut, json_is_open

ABSTRACT = "We examined whether early screening tracked treatment dropout among flood-affected villagers. Help seeking was highest in the capital area (30.7%). Nurses declined to answer when the setting was a single site. We are unable to recommend the index for patients."
RULES = "- Exclude editorials, letters and protocols without results on sleep disturbance.\n- Include papers that use proportional hazards models or an equivalent design.\n- Follow-up of six weeks or longer is required for cognitive decline."
HEAD = 'You are screening records for a review. Decide whether the record below meets the criteria. Return JSON with three fields: decision (include or exclude), confidence (a number from 0 to 1) and evidence_span (one sentence copied word for word from the title or abstract). Do not explain.'
REQUEST = f"{HEAD}\n\nCRITERIA:\n{RULES}\n\nTITLE:\nEarly screening and dropout\n\nABSTRACT:\n{ABSTRACT}"


def answer(span, decision="include", confidence=0.8, **more):
    return json.dumps({"decision": decision, "confidence": confidence, "evidence_span": span, **more}, ensure_ascii=False)


@pytest.mark.parametrize("text", [None, "", " \n\t", "{}", "[]", "null", '""', "```json\n```", answer(None, None, None), answer("", ""), answer("", None, 0.0)])
def test_empty(text):
    assert P.defect(REQUEST, text) == "empty"


@pytest.mark.parametrize(
    "text",
    [
        answer("Help seeking was highest in the capital area (30.7%)."),
        answer("HELP SEEKING WAS HIGHEST IN THE CAPITAL AREA (30.7%)."),
        answer("", "exclude"),
        answer(None, "exclude"),
        answer("An invented sentence that is in English but nowhere in the record."),
        answer("Nurses declined to answer when the setting was a single site."),
        answer("We are unable to recommend the index for patients."),
        answer("We are unable to recommend the other index for adults."),
        answer("Help ​seeking was highеst in the capital area (30.7%)."),
        answer("Early screening and dropout", confidence="high", note="one rule is borderline"),
        answer("Early screening and dropout", confidence=1.4),
        "```json\n" + answer("Early screening and dropout") + "\n```",
        "Here is the decision:\n" + answer("Early screening and dropout"),
        "Exclude. The record says: “Early screening and dropout” Confidence is 0.72.",
        "Exclude. The record says: “” Confidence is 1.0.",
    ],
)
def test_sound(text):
    assert P.defect(REQUEST, text) is None


@pytest.mark.parametrize("text", [answer("x")[:20], '{"decision": "include", "confidence": 0.9, "evidence_span": "Help see', "```json\n" + answer("Help seeking")[:-1], answer("Help seeking")[:-3] + "…", "Exclude. The record says: “Help see", "Include. The record says: “Help.” Confidence is 0."])
def test_truncated(text):
    assert P.defect(REQUEST, text) == "truncated"


@pytest.mark.parametrize(
    "text",
    [
        "I'm sorry, but I cannot decide on this record.",
        '{"error": "Unfortunately, I won\'t assess papers that describe harm."}',
        answer("The system declined to respond to this topic.", None, 0.0),
        answer("As an AI language model, I cannot provide medical judgements.", "exclude"),
        "It would not be appropriate for me to screen this topic. Please consult a specialist.",
        "I am afraid I can't help with that.",
    ],
)
def test_refusal(text):
    assert P.defect(REQUEST, text) == "refusal"


@pytest.mark.parametrize(
    "text",
    [
        HEAD,
        REQUEST,
        f"CRITERIA:\n{RULES}\n\nTITLE:\nEarly screening and dropout",
        answer("Exclude editorials, letters and protocols without results on sleep disturbance.", "exclude"),
        answer("INCLUDE PAPERS THAT USE PROPORTIONAL HAZARDS MODELS OR AN EQUIVALENT DESIGN."),
        answer("one sentence copied word for word from the title or abstract", "include or exclude", "a number from 0 to 1"),
        "The request is as follows: i am screening records for a review. decide whether the record below meets the criteria. The rules are: " + RULES.replace("\n- ", "; "),
    ],
)
def test_copies(text):
    assert P.defect(REQUEST, text) == "copies_request"


GERMAN = "Die Daten wurden über zwölf Monate in mehreren Küstenregionen erhoben, und der Index lag an drei Orten über zehn."


@pytest.mark.parametrize("text", [answer(GERMAN), json.dumps({"Entscheidung": "einschließen", "Sicherheit": 0.7, "Beleg": GERMAN}, ensure_ascii=False), f"Die Arbeit ist auszuschließen: {GERMAN}"])
def test_other_language(text):
    assert P.defect(REQUEST, text) == "other_language"
    german = REQUEST.replace(ABSTRACT, GERMAN + " " + GERMAN)
    assert P.defect(german, text) is None


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=8), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=4), x, max_size=3), max_leaves=8), st.data())
def test_a_prefix_of_an_object_is_open(value, data):
    text = json.dumps({"a": value}, ensure_ascii=False)
    assert not json_is_open(text)
    assert json_is_open(text[: data.draw(st.integers(1, len(text) - 1))])


def test_subsequence_against_brute_force():
    import random

    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    rng = random.Random(0)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in "ab")
        assert P.common_subsequence(a, b) == slow(a, b)


def test_frames(spark):
    rows = [("k1", REQUEST, HEAD, "x"), ("k1", REQUEST, HEAD, "x"), ("k2", None, None, None), ("k3", None, answer("x" * 300_000), "x"), ("k4", "", "", "x"), (None, REQUEST, "{", None)]
    df = spark.createDataFrame(rows, "cache_key string, q string, r string, defect string").drop("defect")
    got = {(r["cache_key"], r["defect"]) for r in P.defects(df, "cache_key", "q", "r").collect()}
    assert got == {("k1", "copies_request"), ("k2", "empty"), ("k4", "empty"), (None, "truncated")}
    assert P.defects(df.limit(0), "cache_key", "q", "r").count() == 0
    assert not answer_is_cut("")


def test_refusals_of_any_length():
    request = "Judge the record. If you cannot judge it, say exclude.\n\nCRITERIA:\nTrials of walking.\n\nTITLE:\nWalking\n\nABSTRACT:\nWe cannot assess the effect of walking on sleep. I decline to say more."
    filler = "The record speaks of walking and sleep, of several groups and their results, and of what they were asked. " * 12
    assert P.defect(request, f"{filler} I must decline to judge this record. {filler}") == "refusal"
    assert P.defect(request, '{"decision": "exclude", "confidence": 0.5, "evidence_span": "' + filler + 'I am unable to judge."}') == "refusal"
    assert P.defect(request, f"Exclude. {filler} We cannot assess the effect of walking on sleep. I decline to say more.") is None
