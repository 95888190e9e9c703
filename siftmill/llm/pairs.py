"""Broken prompt and response pairs: which responses do not answer their requests, and how.

A response is unwrapped (fence, introduction, JSON), then judged in this order: ``empty``, ``truncated`` (its structure
stays open), ``refusal``, ``copies_request``, ``other_language``, and for prose ``truncated`` again. Quotations are first
looked up in the record; what stands there is sound. Copies are found by aligning response and request tokens: shingle
containment in the instructions and rules against containment in the record, then the longest common subsequence.
Refusals are found by aligning the response with refusal templates, and by the three parts of any refusal: the speaker,
the inability, the act that is declined.

Cases: a null or blank response is ``empty``; a null request has no rules and no record, so only its own language and
shape are judged; wrong types, extra fields, unusual layout and absent quotes beside a decision are sound.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmill.llm.confusables import unify
from siftmill.llm.language import language, votes
from siftmill.llm.truncation import answer_is_cut, unwrap

_WORD = re.compile(r"[^\W_]+")
_OFFER = re.compile(r"(?i)\binclude\b\W*(?:or|and|/|\||,)?\W*\bexclude\b")
_SECTION = re.compile(r"(?m)^(CRITERIA|TITLE|ABSTRACT):[ \t]*\n?")
#: Decisions, and words for the lack of one, in the languages answers come in.
DECISIONS = frozenset("include exclude included excluded".split())
FOREIGN_DECISIONS = frozenset("inclure exclure incluir excluir einschließen ausschließen aufnehmen includere escludere".split())
NOTHING = frozenset(["", "none", "null", "n/a", "na", "nan", "-", "undefined", "unknown", "..."])
FIELDS = frozenset("decision confidence evidence_span note reason rationale error explanation comment".split())
#: How refusals are worded; {act} stands for the act declined.
REFUSALS = [
    tuple(x.split())
    for x in (
        "i am unable to",
        "i m unable to",
        "i am not able to",
        "i m not able to",
        "i am not going to",
        "i m not comfortable",
        "i do not feel comfortable",
        "i cannot decide",
        "i can t decide",
        "i cannot judge",
        "i cannot assess",
        "i cannot provide a",
        "i can t provide a",
        "i cannot help with",
        "i can t help with",
        "i cannot assist",
        "i can t assist",
        "i can t answer",
        "i cannot answer",
        "i cannot comply",
        "i can t comply",
        "i cannot make a",
        "i won t assess",
        "i will not assess",
        "i won t answer",
        "i must decline",
        "i have to decline",
        "i decline to",
        "i refuse to",
        "i have to pass on",
        "i would rather not",
        "i d rather not",
        "i prefer not to",
        "not be appropriate for me to",
        "not appropriate for me to",
        "would go beyond what i may",
        "beyond what i may do",
        "outside what i may do",
        "that is not something i do",
        "not something i can do",
        "something i leave to",
        "i am not permitted",
        "i m not permitted",
        "i am not allowed",
        "i m not allowed",
        "my guidelines do not",
        "my guidelines say",
        "my policy does not",
        "the content policy stops me",
        "against my policy",
        "no decision the content policy",
        "no verdict will be given",
        "there is no answer",
        "the system declined to",
        "request was declined by",
        "as an ai language model",
        "as an automated assistant",
        "as a language model",
        "this request cannot be processed",
    )
]
_SPEAKER = re.compile(r"(?i)\b(?:i|i['’]m|i['’]d|i['’]ll|me|my|myself|assistant|this system|the system|content policy)\b")
_INABILITY = re.compile(
    r"(?i)\b(?:cannot|can['’]?t|can not|unable|not able|won['’]?t|will not|would not|wouldn['’]?t|rather not|decline[ds]?|refuse[ds]?|pass on|not something|not appropriate|"
    r"not permitted|not allowed|not comfortable|prohibit\w*|prevent\w*|stops? me|beyond what|leave (?:it |that |this )?to|no (?:decision|verdict|answer))\b"
)
_ACT = re.compile(r"(?i)\b(?:judg\w*|decid\w*|decision|assess\w*|screen\w*|evaluat\w*|verdict|answer\w*|help|assist\w*|respond\w*|provide|comment\w*|review\w*|say|do|give[ns]?)\b")


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def shingles(words: list[str], size: int = 3) -> set[tuple[str, ...]]:
    size = min(size, len(words)) or 1
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def containment(words: list[str], other: list[str]) -> float:
    """Share of the runs of three words of words that are runs of other; short ones as a whole."""
    mine = shingles(words)
    return len(mine & shingles(other, min(3, len(words)))) / len(mine) if mine and words else 0.0


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence (Hunt-Szymanski: over the matching positions only)."""
    from bisect import bisect_left

    at: dict[str, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        at.setdefault(b[j], []).append(j)
    ends: list[int] = []
    for word in a:
        for j in at.get(word, ()):
            k = bisect_left(ends, j)
            if k == len(ends):
                ends.append(j)
            else:
                ends[k] = j
    return len(ends)


def request_parts(request: str | None) -> tuple[str, str, str]:
    """(instructions and rules, title, abstract) of a request; the last two are the record."""
    if not request:
        return "", "", ""
    marks = list(_SECTION.finditer(request))
    parts = {"CRITERIA": "", "TITLE": "", "ABSTRACT": ""}
    head = request[: marks[0].start()] if marks else request
    for k, m in enumerate(marks):
        if not parts[m.group(1)]:
            parts[m.group(1)] = request[m.end() : marks[k + 1].start() if k + 1 < len(marks) else len(request)]
    return head + "\n" + parts["CRITERIA"], parts["TITLE"], parts["ABSTRACT"]


def _leaves(value) -> Iterator[str]:
    if isinstance(value, str):
        yield value
    elif isinstance(value, dict):
        for v in value.values():
            yield from _leaves(v)
    elif isinstance(value, list):
        for v in value:
            yield from _leaves(v)


_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
#: First words of the templates, so that sentences without any are passed over.
_FIRST = {t[0] for t in REFUSALS}


def is_refusal(text: str, known: str = "") -> bool:
    """Whether a text of any length declines to judge: one of its sentences aligns with a refusal template, or has speaker,
    inability and act. Sentences that stand in known (folded: rules and record) are no one's own words."""
    for sentence in _SENTENCE.split(text):
        words = tokens(sentence)
        if not words or len(words) > 3 and f" {' '.join(words)} " in known:
            continue
        for i, word in enumerate(words) if not _FIRST.isdisjoint(words) else ():
            if word in _FIRST and any(t[0] == word and common_subsequence(list(t), words[i : i + len(t) + 1]) == len(t) for t in REFUSALS):
                return True
        inability = _INABILITY.search(sentence)
        if inability and _SPEAKER.search(sentence) and _ACT.search(sentence[: inability.start()] + " " + sentence[inability.end() :]):
            return True
    return False


def _folded(text: str) -> str:
    return " ".join(tokens(text))


def is_copy(text: str, rules: str, record: str) -> bool:
    """Whether a text hands the rules or instructions back: it aligns with them, and better than with the record.

    A text longer than the record's share of it is a copy too if it holds most of the rules, whatever else it holds.
    """
    words, other = tokens(text), tokens(rules)
    if len(words) < 4:
        return False
    if len(words) >= 20 and (containment(other, words) >= 0.5 or containment(other[:25], words) >= 0.8):
        return True
    share, known = containment(words, other), containment(words, tokens(record))
    if share < 0.45 or known >= share and share < 1 or known > 0.8:
        return False
    return share >= 0.8 or common_subsequence(words, other) >= 0.8 * len(words)


def defect(request: str | None, response: str | None) -> str | None:
    """The defect of a pair, or None."""
    if response is None or not response.strip():
        return "empty"
    kind, body = unwrap(response)
    if kind == "nothing":
        return "empty"
    rules, title, abstract = request_parts(request)
    if kind == "json":
        try:
            value = json.loads(body, strict=False)
        except ValueError:
            if answer_is_cut(response):
                return "truncated"
            value = body
    else:
        value = body
    fields = value if isinstance(value, dict) else {}
    decision = fields.get("decision")
    decided = isinstance(decision, str) and decision.strip().lower() in DECISIONS
    texts = [t for k, v in fields.items() if k not in ("decision", "confidence") for t in _leaves(v)] if fields else list(_leaves(value))
    texts = [t for t in texts if t.strip().lower() not in NOTHING]
    if not decided and not texts and (not isinstance(decision, str) or decision.strip().lower() in NOTHING):
        return "empty"
    texts = [unify(t)[0] for t in texts]
    record = unify(f"{title}\n{abstract}")[0]
    if isinstance(decision, str) and not decided and _OFFER.search(decision):  # the choice itself, handed back
        return "copies_request"
    folded = None
    loose = []
    for text in texts:
        words = _folded(text)
        if not words:
            continue
        if folded is None:
            folded = f" {_folded(record)} "
        if f" {words} " not in folded:
            loose.append(text)
    if loose:
        heard = f" {_folded(rules)} {folded} "
        for text in loose:
            if is_refusal(text, heard) and containment(tokens(text), tokens(record)) < 0.5:
                return "refusal"
        for text in loose:
            if is_copy(text, rules, record):
                return "copies_request"
    known = language(abstract if len(abstract.strip()) >= 80 else record)
    foreign = [k for k in fields if isinstance(k, str) and k.lower() not in FIELDS]
    if isinstance(decision, str) and decision.strip().lower() in FOREIGN_DECISIONS:
        foreign.append(decision)
    foreign += [v for k, v in fields.items() if isinstance(v, str) and v.strip().lower() in FOREIGN_DECISIONS]
    for text in [*loose, " ".join([*foreign, *loose])] if loose or len(foreign) > 1 else ():
        other = language(text)
        if other not in (None, "en", known) and votes(text).get("en", 0.0) < 2.0 and containment(tokens(text), tokens(record)) < 0.25:
            return "other_language"  # unless it is the record's own text with a word changed
    if kind == "prose" and answer_is_cut(response):
        return "truncated"
    return None


def defect_kind(request: Column, response: Column) -> Column:
    """The defect of each pair of columns."""

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for requests, responses in batches:
            yield pd.Series([defect(q, r) for q, r in zip(requests, responses)], dtype=object)

    return run(request, response)


def stops_early(request: Column, response: Column, closed: Column) -> Column:
    """Whether a response stops before it is complete; of closed ones only the structure is looked at."""

    @F.pandas_udf(T.BooleanType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for requests, responses, ends in batches:
            yield pd.Series(
                [
                    unwrap(r)[0] == "json" and answer_is_cut(r) if done else defect(q, r) == "truncated"
                    for q, r, done in zip(requests, responses, ends)
                ],
                dtype=bool,
            )

    return run(request, response, closed)


def defects(df: DataFrame, key: str, request: str, response: str) -> DataFrame:
    """key and defect of every broken pair; re-deliveries once."""
    return df.select(key, defect_kind(F.col(request), F.col(response)).alias("defect")).filter("defect is not null").distinct()
