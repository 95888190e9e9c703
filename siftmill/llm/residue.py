"""Template residue and error-page text in documents.

A text is divided into segments (lines and sentences), and three kinds of evidence are combined:

* placeholder detectors: unfilled slots in any of the usual bracketings, values that were never filled in, filler text;
* wording: a notice speaks to its reader about the page it stands for, in the present, and has no place in a report about
  error pages or scripts, which tells in the past who saw, used or counted them; both sides are scored;
* terms: which words and pairs of words the notices of these documents have more often than their other text. They are
  learned from the segments that wording alone settles, against the counts over all texts (``Terms``), so that notices in
  other words of the same kind are weighed too. Segments that tell of the past get nothing from their terms;
* host evidence, for all segments with any wording or terms of a notice that don't report: in how many documents, of a
  source and of all, the segment stands, and how often it shares no terms with the address (source, kind) and the rest of
  the text. Alone it decides nothing: headings, list items and sentences on filler or TODO comments are copied into strange
  texts too, and are sound.

Wording, terms and host evidence add up to one score (``residue``).

Cases: null and empty texts have no residue; JSON answers, formulas, bracketed notes and code names are sound; where no
segment is settled by its wording there are no terms, and the rest decides.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from operator import eq, or_
from re import _constants as C
from re import _parser

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from siftmill.session import stage

_NAME = r"[A-Za-z][A-Za-z0-9_.\- ]{0,40}"
#: Unfilled slots, by bracketing.
SLOTS = [
    ("double braces", re.compile(r"\{\{[-~#/^>&]?\s*" + _NAME + r"(?:\|[^{}]{0,40})?\s*[-~]?\}\}")),
    ("block tag", re.compile(r"\{%-?\s*[a-z]+[^%{}]{0,60}-?%\}")),
    ("dollar braces", re.compile(r"\$\{\s*[A-Za-z_][A-Za-z0-9_.]{0,40}\s*\}(?!\$)")),
    ("percent name", re.compile(r"%\([A-Za-z_][A-Za-z0-9_]*\)[sdifr]\b|(?<![\d\w%])%[A-Z][A-Z_]{2,30}%")),
    ("server tag", re.compile(r"<%=?\s*[^<>%]{1,60}%>|<\?(?:php|=)[^<>]{0,80}\?>")),
    ("double angles", re.compile(r"<<\s*" + _NAME + r">>|«\s*[a-z]+_[a-z_]+\s*»")),
    ("escaped tag", re.compile(r"&lt;/?\s*" + _NAME + r"&gt;")),
    ("your ... here", re.compile(r"(?:[<\[{]\s*(?:your|insert|enter|add|type|put)|\(\s*(?:your|insert))\b[^<>\[\](){}]{0,40}\b(?:here|name|title|text)?\s*[>\])}]|\(\s*(?:enter|add|type|put)\b[^<>\[\](){}]{0,40}\b(?:here|name|title|text)\s*\)", re.I)),
    ("... here", re.compile(r"\[\s*(?:INSERT|ENTER|ADD|YOUR|TYPE|PLACEHOLDER|TODO|TBD|TK)\b[^\[\]]{0,40}\]|\[\s*[A-Z][A-Za-z_0-9 ]{0,40} HERE\s*\]")),
    ("to be added", re.compile(r"[\[(<]\s*[A-Za-z_0-9 ]{1,40}\bto be (?:added|completed|confirmed|determined|inserted|supplied|filled in)\s*[\])>]", re.I)),
    ("double square", re.compile(r"\[\[\s*[A-Za-z][A-Za-z0-9_ ]{0,40}\s*\]\]")),
    ("underscores", re.compile(r"(?<![A-Za-z0-9])__+[A-Z][A-Z0-9_]*?__+(?![A-Za-z0-9])")),
    ("at signs", re.compile(r"@@[A-Za-z_]{2,40}@@|##[A-Z_]{2,40}##|(?<![\w#])#[A-Z][A-Z_]{3,30}#")),
    ("bare slots", re.compile(r"\{[a-z]+(?:_[a-z]+)*\}[^{}\n]{0,60}\{[a-z]+(?:_[a-z]+)*\}|\{[a-z]+_[a-z_]+\}")),
]
#: Names that slots usually have.
FIELDS = frozenset(
    "author authors name title subtitle year date month day journal publisher country city region address email phone criteria outcome outcomes summary section sections evidence abstract keywords "
    "body text content topic subject company organisation organization institution affiliation firstname lastname username user recipient sender department department number amount value values label "
    "reference references citation doi url link reviewer review method methods result results study studies sample population intervention version volume issue pages".split()
)
#: A name between marks of any kind that touch it: $name$, #{name}, {name}, «name», ~name~, :name: and the like.
MARKED = re.compile(
    r"(?<![\w\\])([^\w\s.,;!?'\"“”‘’()\-–—/\\|*=+`&]{1,3})([A-Za-z]{4,}(?:[_.][A-Za-z0-9]+){0,4}|[a-z]{1,12}(?:_[a-z0-9]{2,}){1,4})([^\w\s.,;!?'\"“”‘’()\-–—/\\|*=+`&]{1,3})(?!\w)"
)
_NUMBERED = re.compile(r"\{\d\}[^{}\n]{0,80}\{\d\}|(?<![\w%])%\d\$[sd]\b|(?<![\w%])%s\b[^%\n]{0,60}(?<![\w%])%[sd]\b")
_MIRROR = {"{": "}", "[": "]", "<": ">", "«": "»", "‹": "›", "⟦": "⟧", "⟨": "⟩", "⌈": "⌉"}
#: References that were never resolved, and notes to an author in capitals.
UNRESOLVED = re.compile(r"\b(?:[Ss]ections?|[Tt]ables?|[Ff]ig(?:ures?|s?\.)?|[Ee]q(?:uations?|s?\.)?|[Rr]ef(?:erences?|s?\.)?|[Aa]ppendix|[Cc]hapters?)[\s~]?[(\[]?\?{2,}|[(\[]\?{2,}[)\]]|\\(?:ref|cite|label)\{[^{}]*\}")
CAPITALS = re.compile(r"\[[A-Z][A-Z_]+(?:[ _][A-Z0-9_]+)+[.:!?]?\]")
#: Values that a program never filled in.
UNFILLED = re.compile(
    r"\b(None|null|NULL|NaN|nan|undefined|nil|N/A)\b[\s(,:;/]{1,3}\1(?![\w])|#(?:REF|VALUE|NAME|DIV/0|NULL|NUM)[!?]|"
    r"\[object Object\]|\b(?:NaN|null|undefined)\b[^.!?\n]{0,24}\b(?:and|to|of|,|between|was moved)\s+(?:NaN|null|undefined)\b"
    r"|\b(?:[Dd]ear|paper|record|study of|titled|named|enrolled|between|from|by author)\s+(?:NaN|null|undefined)\b"
    r"|\bNaN\s+(?:participants|patients|records|studies|papers|subjects|items|articles|%|of)\b|\bundefined undefined\b"
)
FIGURES = re.compile(r"\b(?:XX+|YY+|ZZ+)\b[^.\n]{0,60}(?:\b(?:XX+|YY+|ZZ+)\b|\.X{2,})|\b(?:XX+|YY+|ZZ+)\s?%|[=<>]\s?\d*\.X{2,}|\bN ?= ?X{2,}\b")
FILLER = re.compile(
    r"(?i)^\W*(?:this is (?:a )?(?:placeholder|sample|dummy|example) text\b|(?:placeholder|sample|dummy|example) text (?:for|goes)\b|(?:placeholder|sample|dummy|example) (?:\w+ )?text\W*$|(?:type|insert|enter|add|write|put|paste) (?:the |your |a |some )?[\w ]{1,30} here\b"
    r"|your [\w ]{1,30} (?:goes|go|will appear|will go|belongs) here\b|(?:click|tap|double-click) (?:here )?to (?:edit|add)\b|replace this (?:text|paragraph|line)\b"
    r"|text (?:will follow|follows|to follow|coming soon)\b|(?:content )?coming soon\b|to be (?:completed|written|added|supplied)\b)"
    r"|\bwill be replaced (?:before|upon|on|after|at) (?:release|publication)\b"
    r"|^\W*(?:TODO|FIXME|TK)\s*:|\bTODO: (?:add|write|insert|fill|check|complete|update)\b|^\W*TBD\b(?:[\s.,]*TBD\b)*\W*$|\bTBD TBD\b"
)
#: One word over and over.
STUTTER = re.compile(r"\b([^\W\d_]{2,})(?:[\s.,;:]+\1\b){4,}")
REPEATED = re.compile(r"(?:x{3,}\s*){3,}|(?:asdf|qwer|blah)(?:\W+(?:asdf|qwer|blah|jkl)){2,}", re.I)
#: Words of the usual pseudo-Latin filler.
LATIN = frozenset(
    "lorem ipsum dolor dolore sit amet consectetur adipiscing elit sed sedum do eiusmod tempor tempora incididunt ut labore et magna aliqua enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat "
    "cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum mollis vestra vestibulum urna corpus facilis facilisis porta ornare pretium sapien quando lectus "
    "augue vitae finibus pellentesque habitant morbi tristique senectus netus malesuada fames ac turpis egestas curabitur vivamus integer donec nunc mauris tellus ligula nec vel at "
    "massa justo lacus purus orci risus rhoncus viverra maecenas fusce aliquam eget arcu dictum phasellus sollicitudin".split()
)
_WORD = re.compile(r"[^\W\d_]+")
_SEGMENT = re.compile(r"[.!?][\"”’»)\]]*\s+|\n+")
_MARKS = re.compile(r"[{$«#@~^§¤‹⟦⟨\[]|%[A-Za-z]|<[A-Za-z]|:[A-Za-z]{4,}:")

#: Wording of notices, with weights: the reader addressed, the thing that is not there, the technique, the failure.
NOTICE = [
    (2.0, re.compile(r"(?i)^\W*(?:please|sorry|notice|error|erreur|fehler|warning|w?hoops|oops|attention|veuillez|bitte|por favor)\b")),
    (4.0, re.compile(r"(?i)^\W*(?:[45]\d\d\W+)?(?:page not found|seite nicht gefunden|p[áa]gina n(?:o|ão) encontrada|page introuvable|not found|internal server error|bad gateway|gateway time-?out|forbidden|access denied|service (?:temporarily )?unavailable|too many requests|unauthori[sz]ed)\W*$")),
    (1.5, re.compile(r"(?i)\b(?:we (?:were unable|noticed|could not|cannot|are unable|are sorry)|our (?:systems?|servers?|site))\b")),
    (1.5, re.compile(r"(?i)\b(?:ad ?blocker|not authori[sz]ed|no subscription|to continue\W*$|to (?:see|view|read|open|show|access) (?:this|the)|to run this)\b")),
    (1.5, re.compile(r"(?i)\b(?:you|your|votre|vous|su navegador|ihr|ihren|ihrem|seu navegador|usted)\b")),
    (1.5, re.compile(r"(?i)^\W*(?:enable|activate|activer|active|activez|aktivieren|habilite|ative|allow|turn|switch|reload|refresh|try|return|go back|go to|log in|sign in|click|wait|check|contact|use(?! of\b)|type(?! (?:i+\b|\d)))\b")),
    (2.0, re.compile(r"(?i)\b(?:try again|reload|refresh the page|go back to|return to the|log in|sign in|start page|home page|help page|browser settings|out of date|mistyped)\b")),
    (1.5, re.compile(r"(?i)\b(?:this|the|cet|cette|diese[nmrs]?|este|esta|el|o) (?:requested |full |entire )?(?:page|site|website|app|application|server|archive|reader|address|network|browser|article|artículo|artigo|artikel|record|item|file|document|paper|text|full text|pdf|abstract|content|service|link|resource|identifier|seite|página)\b")),
    (1.5, re.compile(r"(?i)\b(?:javascript|js|scripts?|scripting|cookies|active content|client-side|browser|navegador|navigateur)\b")),
    (
        2.0,
        re.compile(
            r"(?i)\b(?:is|are|was|were|has been|have been|be) (?:not (?:available|found|on this|supported|possible|enabled|reachable)|unavailable|disabled|blocked|blocking|gone|down|needed|required|necessary|denied|expired|withdrawn|removed|moved|suspended|switched on|turned on|enabled|allowed|out of)\b"
        ),
    ),
    (
        2.0,
        re.compile(
            r"(?i)\b(?:cannot|can not|could not|can't|couldn't|unable to|failed to|does not|do not|did not|must|needs? to|relies on|requires?|without) (?:be |have |been )?(?:resolved?|displayed?|shown|show|loaded|load|found|find|retrieved?|fetch(?:ed)?|connect|reached?|completed?|processed|opened?|support|run|exist|enable|read|switched|turned|cookies|scripts?|javascript|js|active|client-side)\b"
        ),
    ),
    (2.5, re.compile(r"(?i)\b(?:timed out|time-?out|(?:page|file|article|resource|document) (?:was )?not found|internal server error|bad gateway|gateway timeout|service unavailable|too many requests|access denied|forbidden|session has expired|has expired|unusual traffic|down for maintenance|technical fault|technical difficult\w+|stays? blank|introuvable|nicht gefunden|no encontrad[ao]|não encontrad[ao]|fatal error|stack trace|on line \d+)\b")),
    (2.0, re.compile(r"(?i)\b(?:error|erreur|fehler|status|http|code)\s*:?\s*[45][0-9][0-9]\b|\b[45][0-9][0-9]\s*[:|–-]|^\W*[45][0-9][0-9]\W")),
    (2.5, re.compile(r"(?i)^\W*(?:request id|content-type|http/\d|x-[a-z-]+:|server:|ray id|incident id|reference #|error code)\b|\.(?:php|jsp|aspx|cgi)\b")),
    (2.0, re.compile(r"(?i)\bif (?:nothing happens|this persists|the problem persists|you (?:see|read|are seeing|believe|think))\b|\bblocking is off\b|\bad blocker\b|\b(?:switched|turned) (?:on|off)\b")),
    (6.0, re.compile(r"^\s*File \"[^\"]+\", line \d+|Traceback \(most recent call last\)|^\s*at [\w.$]+\([\w.]+:\d+\)|^\W*[A-Za-z.]*(?:Error|Exception): |\bSQLSTATE\b|\bstack trace:|^\s*Warning: \w+\(\)|^\s*Notice: Undefined ")),
    (1.0, re.compile(r"(?i)\b(?:request(?:ed)?|server|database|gateway|link(?! between)|session|account|connection|captcha|robot)\b")),
]
#: Wording of reports about such things.
REPORT = [
    (3.0, re.compile(r"(?i)\b(?:was|were|had been) (?:\w+ly )?(?:excluded|rendered|recorded|shown|used|renamed|coded|assessed|counted|sampled|compared|analy[sz]ed|measured|collected|observed|reported|asked|given|replaced|stored|logged|removed from the|included|classified)\b")),
    (3.0, re.compile(r"(?i)\b(?:participants?|nurses|patients|respondents|readers? in|trials?|controls?|clinics|schools|pupils|sample|cohort|arms?|per thousand|incidents|coders|reviewers|staff|interviewees|users in)\b")),
    (2.0, re.compile(r"\d\s?%|\bp\s?[=<>]|\d+ (?:clinics?|sites?|of)\b")),
    (2.0, re.compile(r"(?i)\b(?:saw|made up|had to|predicted|enrolled|stay missing|returned error|that required|that returned|failed to do so|intended)\b")),
    (2.5, re.compile(r"[“\"‘«][^”\"’»]{3,40}[”\"’»]")),
    (3.0, re.compile(r"(?i)\b(?:data|results?|findings?|evidence) (?:(?:do|does|did) not support|(?:was|were) (?:unavailable|not available))\b")),
]
SURE, OPEN = 3.0, 2.0
#: A segment that its wording leaves open is a notice if so many documents hold it, so often strange to the rest of their texts.
COPIES, STRANGE = 3, 0.8
#: One that speaks to its reader and has this score needs two.
ADDRESSED = 1.5
#: Length of a segment from which on its wording counts less, in proportion: long sentences say many things.
SHORT = 300
#: What terms add at most, and for each unit of their log-odds; least log-odds that make a segment worth a look.
TERMS_MOST, TERMS_WEIGHT, TERMS_LEAST = 3.5, 0.3, 3.0
#: What is added for copies in strange texts.
COPIED = 1.0
#: Buckets of terms.
TERM_BITS = 20
#: Reports tell of the past; notices, where they do, are known by their wording.
_PAST = re.compile(r"(?i)\b(?:was|were|had|been|\w{2,}ed)\b")
#: Letters that case-insensitive patterns take for plain ones.
_FOLD = (("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s"))


def fold(text: str) -> str:
    """text in lower case, character for character."""
    for letter, plain in () if text.isascii() else _FOLD:
        text = text.replace(letter, plain)
    return text.lower()


_SPACES = frozenset(chr(c) for c in range(0x3001) if chr(c).isspace())


def _all_of(op, av) -> set[str] | None:
    """Every text that a node of a parsed pattern matches, if they are few."""
    if op == C.LITERAL:
        return {fold(chr(av))}
    if op == C.AT or op in (C.ASSERT, C.ASSERT_NOT):
        return {""}
    if op == C.IN:
        found = set()
        for o, x in av:
            if o == C.LITERAL:
                found.add(fold(chr(x)))
            elif o == C.RANGE and x[1] - x[0] < 64:
                found |= {fold(chr(c)) for c in range(x[0], x[1] + 1)}
            elif o == C.CATEGORY and x == C.CATEGORY_SPACE:
                found |= _SPACES
            else:
                return None
        return found
    if op == C.SUBPATTERN:
        return _strung(av[3])
    if op == C.BRANCH:
        found = [_strung(x) for x in av[1]]
        return None if None in found else set().union(*found)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and av[1] <= 3 and (one := _strung(av[2])) is not None:
        return _crossed([one] * av[0] + [one | {""}] * (av[1] - av[0]))
    return None


def _crossed(sets: list[set[str]]) -> set[str] | None:
    found = {""}
    for x in sets:
        if len(found) * len(x) > 3000:
            return None
        found = {f + y for f in found for y in x}
    return found


def _strung(items) -> set[str] | None:
    sets = [_all_of(op, av) for op, av in items]
    return None if None in sets else _crossed(sets)


def required(items) -> set[str] | None:
    """Texts in lower case one of which every match of a parsed pattern holds: the set with the longest shortest one."""
    options: list[set[str]] = []
    run = {""}
    for op, av in items:
        every = _all_of(op, av)
        joined = None if every is None else _crossed([run, every])
        if joined is not None:
            run = joined
            continue
        if op in (C.MAX_REPEAT, C.MIN_REPEAT) and av[0] and (one := _strung(av[2])) is not None:
            options += [x for x in (_crossed([run] + [one] * av[0]), _crossed([one] * av[0])) if x]
            run = one  # the last of them stands before what follows
            continue
        options.append(run)
        run = {""} if every is None else every
        if op == C.SUBPATTERN and (inner := required(av[3])):
            options.append(inner)
        elif op == C.BRANCH and None not in (each := [required(x) for x in av[1]]):
            options.append(set().union(*each))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and av[0] and (inner := required(av[2])):
            options.append(inner)
    options.append(run)
    options = [x for x in options if min(map(len, x))]
    return max(options, key=lambda x: (min(map(len, x)), -len(x))) if options else None


class Bits:
    """A bit for every pattern, and the automaton of the texts that patterns require."""

    def __init__(self) -> None:
        import ahocorasick

        self.slots = [1 << i for i in range(len(SLOTS))]
        whole = [_NUMBERED, UNRESOLVED, CAPITALS, UNFILLED, FIGURES]
        patterns = [*(p for _, p in SLOTS), *whole, FILLER, REPEATED, *(p for _, p in NOTICE)]
        at = {id(p): 1 << i for i, p in enumerate(patterns)}  # a pattern's hash is slow
        self.of = lambda pattern: at[id(pattern)]
        self.any_slot = sum(self.slots)
        self.whole = [at[id(p)] for p in whole]
        self.filler, self.repeated = at[id(FILLER)], at[id(REPEATED)]
        self.notice = [at[id(p)] for _, p in NOTICE]
        self.any_notice = sum(self.notice)
        texts: dict[str, int] = {}
        self.always = 0
        for p in patterns:
            needed = required(_parser.parse(p.pattern, p.flags))
            if needed is None:
                self.always |= at[id(p)]
            for c in needed or ():
                texts[c] = texts.get(c, 0) | at[id(p)]
        self.found = ahocorasick.Automaton()
        for c, bit in texts.items():
            self.found.add_word(c, bit)
        self.found.make_automaton()


@lru_cache(maxsize=1)
def pattern_bits() -> Bits:
    return Bits()


def possible(low: str, ends: list[int]) -> list[int]:
    """Bits of the patterns that can match in each part of a folded text, in one pass; ends: where the parts end."""
    known = pattern_bits()
    masks, k = [known.always] * len(ends), 0
    last = len(ends) - 1
    for at, bit in known.found.iter(low):
        while k < last and at >= ends[k]:
            k += 1
        masks[k] |= bit
    return masks


#: Bits of all patterns.
ALL = -1


@lru_cache(maxsize=100_000)
def _most(mask: int) -> tuple[float, tuple[tuple[float, re.Pattern], ...]]:
    """(highest score of a notice, patterns of notices with their weights) that bits allow."""
    left = tuple((w, p) for (w, p), bit in zip(NOTICE, pattern_bits().notice) if mask & bit)
    return sum(w for w, _ in left), left


def spans(text: str) -> list[tuple[int, int]]:
    """Where the segments of a text lie."""
    found, at = [], 0
    for m in _SEGMENT.finditer(text):
        found.append((at, m.start() + (text[m.start()] != "\n")))  # a stop belongs to its sentence
        at = m.end()
    found.append((at, len(text)))
    return [(a, b) for a, b in found if a < b and not text[a:b].isspace()]


def segments(text: str) -> list[str]:
    return [text[a:b] for a, b in spans(text)]


#: No match of the patterns of unfilled values and figures is longer.
_REACH = 120


def placeholder(text: str, masks: list[int] | None = None, places: list[tuple[int, int]] | None = None) -> str | None:
    """The kind of unfilled slot that a whole text holds, if any; masks: the patterns that can match in its parts."""
    known = pattern_bits()
    mask = ALL if masks is None else reduce(or_, masks, 0)
    for (name, pattern), bit in zip(SLOTS, known.slots) if mask & known.any_slot else ():
        if mask & bit:
            for m in pattern.finditer(text):
                if name == "bare slots" and ('"' in m.group() or re.search(r"(?i)\b(?:slots?|variable|field|engine|syntax)\b", text[max(0, m.start() - 40) : m.end() + 40])):
                    continue
                return name
    seen: dict[tuple[str, str], set[str]] = {}
    for m in MARKED.finditer(text) if _MARKS.search(text) else ():
        before, name, after = m.groups()
        if _MIRROR.get(before[-1], before[-1]) != after[0]:
            continue
        around = text[max(0, m.start() - 40) : m.end() + 40]
        if re.search(r"(?i)\b(?:slots?|variable|engine|syntax|command|tag)\b", around):
            continue
        plain = name.lower().split("_")[0].rstrip("s")
        if before != "[" and before[-1] not in ":<" and (name.lower() in FIELDS or plain in FIELDS or "_" in name):
            return "marked name"
        names = seen.setdefault((before, after), set())
        names.add(name)
        if len(names) > 1 and before not in (":", "<"):
            return "marked names"
    for name, pattern, bit in zip(("numbered slots", "unresolved reference", "note in capitals", "unfilled value", "unfilled figure"), (_NUMBERED, UNRESOLVED, CAPITALS, UNFILLED, FIGURES), known.whole):
        if not mask & bit:
            continue
        if masks is None or pattern not in (UNFILLED, FIGURES):
            if pattern.search(text):
                return name
        elif any(m & bit and pattern.search(text, max(0, a - _REACH), b + _REACH) for (a, b), m in zip(places, masks)):
            return name
    return None


def filler(segment: str, mask: int = ALL, words: list[str] | None = None) -> str | None:
    """The kind of filler that a segment is, if any; words: its words in lower case, or none if they are no pseudo-Latin."""
    if mask & pattern_bits().filler and FILLER.search(segment):
        return "filler"
    if mask & pattern_bits().repeated and REPEATED.search(segment):
        return "repeated filler"
    words = _WORD.findall(segment.lower()) if words is None else words
    if len(LATIN.intersection(words)) >= 3 and sum(w in LATIN for w in words) >= 0.75 * len(words):
        return "pseudo-Latin"
    return None


def notice_score(segment: str, mask: int = ALL) -> float:
    """Evidence of a notice less that of a report about notices."""
    most, patterns = _most(mask & pattern_bits().any_notice)
    score = sum(w for w, p in patterns if p.search(segment)) if most else 0.0
    if len(segment) > SHORT:
        score *= SHORT / len(segment)
    return score - sum(w for w, p in REPORT if p.search(segment)) if score else score


# Words of texts in arrays.

_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]
_LETTER, _DIGIT, _STOP, _CLOSER, _SPACE, _LINE = 1, 2, 3, 4, 5, 6


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every character of the basic plane; others are letters where Python says so (their last entry)."""
    table = np.zeros(0x10001, np.uint8)
    for code in range(0x10000):
        c = chr(code)
        table[code] = _LETTER if _WORD.match(c) else _DIGIT if c.isdecimal() else _STOP if c in ".!?" else _CLOSER if c in "\"”’»)]" else _LINE if c == "\n" else _SPACE if c.isspace() else 0
    table[0x10000] = _LETTER
    return table


@lru_cache(maxsize=1)
def _powers() -> list[np.ndarray]:
    """Powers of an odd number and of its inverse, as many as the longest text so far has needed."""
    return [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(size: int) -> tuple[np.ndarray, np.ndarray]:
    held = _powers()
    while len(held[0]) < size:
        for k, base in enumerate((0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64))):
            with np.errstate(over="ignore"):
                held[k] = np.concatenate([held[k], held[k] * np.uint64(pow(base, len(held[k]), 1 << 64))])
    return held[0], held[1]


@dataclass
class Words:
    """The words of a text in lower case: buckets of each and of the pair that it begins, whether the next word is in the same
    segment, where they begin, and whether they are of letters. Digits are one word."""

    one: np.ndarray
    two: np.ndarray
    inside: np.ndarray
    begins: np.ndarray
    letters: np.ndarray

    @property
    def firsts(self) -> np.ndarray:
        """Index of each segment's first word."""
        return np.concatenate([[0], np.flatnonzero(~self.inside)[:-1] + 1]) if len(self.one) else np.empty(0, np.int64)


def words_of(low: str) -> Words:
    """All words of a text, whole arrays at a time: a word's hash is the difference of two prefix sums."""
    c = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _classes()[np.minimum(c, 0x10000)]
    word = (kind == _LETTER) | (kind == _DIGIT)
    edge = kind[1:] != kind[:-1]
    begins = np.flatnonzero(word & np.concatenate([[True], edge]))
    ends = np.flatnonzero(word & np.concatenate([edge, [True]])) + 1
    power, inverse = _grown(len(c) + 1)
    shift = np.uint64(64 - TERM_BITS)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum((c.astype(np.uint64) + _K[2]) * power[: len(c)])])
        h = (sums[ends] - sums[begins]) * inverse[begins]
        letters = kind[begins] == _LETTER
        h = np.where(letters, (h ^ (h >> np.uint64(29))) * _K[1], _K[0])
        after = np.append(h[1:], np.uint64(0))
        pair = h * _K[0] + after * _K[1]
        pair = (pair ^ (pair >> np.uint64(31))) * _K[1]
    stop = np.flatnonzero(kind == _STOP)
    last = np.append(kind, 0)
    at = stop + 1
    while (closer := last[at] == _CLOSER).any():
        at = at + closer
    stop = np.concatenate([stop[(last[at] == _SPACE) | (last[at] == _LINE)], np.flatnonzero(kind == _LINE)])
    segment = np.searchsorted(np.sort(stop), begins)
    inside = np.append(segment[1:] == segment[:-1], False) if len(begins) else np.empty(0, bool)
    return Words((h >> shift).astype(np.int64), (pair >> shift).astype(np.int64), inside, begins, letters)


@lru_cache(maxsize=1)
def _latin_buckets() -> np.ndarray:
    known = np.zeros(1 << TERM_BITS, bool)
    known[words_of(" ".join(sorted(LATIN))).one] = True
    return known


def latin_places(words: Words) -> list[int]:
    """Where words begin that stand in segments which may be pseudo-Latin: three words of it or more, and three in four."""
    hits = _latin_buckets()[words.one] & words.letters
    if np.count_nonzero(hits) < 3:
        return []
    firsts = words.firsts
    n, of = np.add.reduceat(hits.astype(np.int64), firsts), np.add.reduceat(words.letters.astype(np.int64), firsts)
    return words.begins[firsts[(n >= 3) & (n >= 0.75 * of)]].tolist()


#: What is said of a segment besides its score: strange to its host, speaking to its reader.
IS_STRANGE, IS_ADDRESS = 1, 2
_READER = NOTICE[4][1]
_DIGIT_RUN = re.compile(r"\d+")


def skeleton(segment: str) -> str:
    """What copies of a segment have in common: its words in lower case, numbers as one mark."""
    return _DIGIT_RUN.sub("#", " ".join(segment.split()))


def fingerprint(segment: str) -> int:
    return xxhash.xxh64_intdigest(skeleton(segment)) - (1 << 63)


def is_json(text: str) -> bool:
    return text.lstrip()[:1] == "{" and '":' in text


def _shared(said: list[list[str]], address: str) -> set[str]:
    """Words that the address or several segments have."""
    seen, shared = set(), set(_WORD.findall(address.lower()))
    for words in said:
        terms = set(words)
        shared |= terms & seen
        seen |= terms
    return shared


def examine(text: str | None, address: str = "", gated: bool = True, latin: list[int] | None = None) -> tuple[list[str], dict[int, tuple[float, int]], list[str]]:
    """(kinds of residue found; (score, bits above) by fingerprint of the segments whose wording says something for a
    notice; skeletons of those that it settles).

    gated: patterns are only tried where a text that each of their matches holds was seen; the outcome is the same.
    latin: where segments that may be pseudo-Latin begin, if that is known.
    """
    if not text:
        return [], {}, []
    found, left, sure, low = [], {}, [], fold(text)
    places = spans(text)
    masks = possible(low, [b for _, b in places] or [len(text)]) if gated else [ALL] * len(places)
    kind = placeholder(text, masks if gated else None, places)
    if kind:
        found.append(kind)
    parts = low.split()
    if sum(map(eq, parts, parts[1:])) >= 3 and STUTTER.search(low):  # marks may stand between some of them
        found.append("repeated word")
    warn = not is_json(text)
    scores: list[float] = []
    latin = [] if not gated else latin_places(words_of(low)) if latin is None else latin
    fillers, notices = pattern_bits().filler | pattern_bits().repeated, pattern_bits().any_notice if warn else 0
    for (a, b), mask in zip(places, masks):
        may_be_latin = not gated or latin and any(a <= at < b for at in latin)
        if (may_be_latin or mask & fillers) and (kind := filler(text[a:b], mask, None if may_be_latin else [])):
            found.append(kind)
        scores.append(notice_score(text[a:b], mask) if mask & notices else 0.0)
    if not any(score > 0 for score in scores):
        return found, left, sure
    said = [_WORD.findall(low[a:b]) for a, b in places]
    shared = _shared(said, address)
    for i, ((a, b), score) in enumerate(zip(places, scores)):
        if score <= 0:
            continue
        total = score + 1.0 if score >= OPEN and i + 1 < len(scores) and scores[i + 1] >= OPEN else score  # notices come in several sentences
        if total >= SURE:
            found.append("notice")
            sure.append(skeleton(low[a:b]))
        strange = not any(len(w) > 3 and w in shared for w in said[i])
        bits = strange * IS_STRANGE + bool(score >= ADDRESSED and _READER.search(text[a:b])) * IS_ADDRESS
        h = fingerprint(low[a:b])
        was = left.get(h, (score, bits))
        left[h] = (max(score, was[0]), bits & was[1])
    return found, left, sure


# Terms: which words do the notices of these documents have?


class Terms:
    """Log-odds of words and pairs of words in notices against all texts, in a table of fixed size."""

    def __init__(self, notices: np.ndarray, n_notices: int, texts: np.ndarray, n_segments: int):
        odds = np.log((notices + 0.05) / (n_notices + 1.0)) - np.log((texts + 0.5) / (n_segments + 1.0))
        self.odds = np.where(notices + texts > 0, odds, 0.0).astype(np.float32)

    def of(self, words: Words) -> np.ndarray:
        """Log-odds of each segment with words, over the root of its number of terms."""
        if not len(words.one):
            return np.empty(0)
        firsts = words.firsts
        sizes = np.diff(np.append(firsts, len(words.one)))
        return np.add.reduceat(self.odds[words.one] + np.where(words.inside, self.odds[words.two], 0.0), firsts) / np.sqrt(2 * sizes - 1)


class Counts:
    """Counts of terms in buckets, and of segments."""

    def __init__(self) -> None:
        self.n, self.segments, self.open = np.zeros(1 << TERM_BITS, np.int64), 0, []

    def add(self, words: Words) -> None:
        self.segments += len(words.inside) - int(words.inside.sum())
        self.open += [words.one, words.two[words.inside]]
        if len(self.open) > 2_000:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, count) of all that was added; bucket -1 holds the segments."""
        if self.open:
            self.n += np.bincount(np.concatenate(self.open), minlength=1 << TERM_BITS)
            self.open = []
        at = np.flatnonzero(self.n)
        return np.append(at, -1).astype(np.int32), np.append(self.n[at], self.segments)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = Counts()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.add(words_of(fold(text)))
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in counts.settle()], names=["at", "n"])


def _table(counts: DataFrame) -> tuple[np.ndarray, int]:
    """Counts (at, n) in a table of fixed size, which is all that reaches the driver, and the number of segments."""
    rows = counts.groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    at, n = rows.column("at").to_numpy(), rows.column("n").to_numpy()
    table = np.zeros(1 << TERM_BITS, np.float64)
    table[at[at >= 0]] = n[at >= 0]
    return table, int(n[at < 0].sum())


def train_terms(notices: DataFrame, texts: DataFrame) -> Terms | None:
    """The terms of the distinct notices (notice) against the counts (at, n) of all texts; None without notices."""
    known, n = _table(notices.select("notice").distinct().mapInArrow(_count, "at int, n bigint"))
    return Terms(known, n, *_table(texts)) if n else None


def weigh(text: str | None, address: str, terms: Terms, told: list[tuple[int, float]] | None = None) -> dict[int, tuple[float, int]]:
    """(what its terms add, bits) by fingerprint of the segments whose terms say something for a notice.

    told: where such segments begin, with their log-odds, if that is known.
    """
    if not text or is_json(text):
        return {}
    low = fold(text)
    if told is None:
        words = words_of(low)
        told = [(at, odds) for at, odds in zip(words.begins[words.firsts].tolist(), terms.of(words).tolist()) if odds >= TERMS_LEAST]
    found: dict[int, tuple[float, int]] = {}
    if not told:
        return found
    places = spans(low)
    said = [_WORD.findall(low[a:b]) for a, b in places]
    shared = _shared(said, address)
    for at, odds in told:
        i = bisect_right(places, (at, len(low))) - 1
        a, b = places[i]
        segment = text[a:b]
        if _PAST.search(segment) or any(p.search(segment) for _, p in REPORT):
            continue
        strange = not any(len(w) > 3 and w in shared for w in said[i])
        found[fingerprint(low[a:b])] = (min(TERMS_MOST, TERMS_WEIGHT * odds), strange * IS_STRANGE)
    return found


LEFT = "host string, h array<bigint>, score array<float>, said array<int>"
LOOKED = f"{LEFT}, kinds array<string>, sure array<string>, at array<int>, n array<bigint>"


def _left(keys: list, hosts: list, rows: list[dict[int, tuple[float, int]]]) -> dict[str, list]:
    return {"key": keys, "host": hosts, "h": [list(r) for r in rows], "score": [[v[0] for v in r.values()] for r in rows], "said": [[v[1] for v in r.values()] for r in rows]}


#: Characters of texts whose words are found in one go.
_CHUNK = 200_000


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], Words, np.ndarray]]:
    """Rows (key, host, address, text), the words of all their texts together, and where each text begins there."""
    for batch in batches:
        rows, size = [], 0
        for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
            rows.append(row)
            size += len(row[3])
            if size > _CHUNK:
                yield rows, *_joined(rows)
                rows, size = [], 0
        if rows:
            yield rows, *_joined(rows)


def _joined(rows: list[tuple]) -> tuple[Words, np.ndarray]:
    begins = np.cumsum([0, *(len(r[3]) + 1 for r in rows[:-1])])  # folding keeps lengths
    return words_of("\n".join(fold(r[3]) for r in rows)), begins


def _by_text(places: np.ndarray, begins: np.ndarray) -> tuple[list[int], list[int]]:
    """(number of its text, place within it) of every place."""
    of = np.searchsorted(begins, places, side="right") - 1
    return of.tolist(), (places - begins[of]).tolist()


def _looker(schema: pa.Schema):
    """Arrow function: each document with residue or wording of a notice, and, in a row of its own, the counts of terms of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        for rows, words, begins in _chunks(batches):
            counts.add(words)
            latin: dict[int, list[int]] = {}
            for i, at in zip(*_by_text(np.array(latin_places(words), np.int64), begins)):
                latin.setdefault(i, []).append(at)
            found = []
            for i, (key, host, address, text) in enumerate(rows):
                kinds, left, sure = examine(text, address, latin=latin.get(i, []))
                if kinds or left:
                    found.append((key, host, left, sorted(set(kinds)), sure))
            if found:
                keys, hosts, lefts, kinds, sure = map(list, zip(*found))
                yield pa.RecordBatch.from_pydict(_left(keys, hosts, lefts) | {"kinds": kinds, "sure": sure, "at": [None] * len(keys), "n": [None] * len(keys)}, schema=schema)
        at, n = counts.settle()
        yield pa.RecordBatch.from_pydict(_left([None], [None], [{}]) | {"kinds": [[]], "sure": [[]], "at": [at], "n": [n]}, schema=schema)

    return run


def _weigher(schema: pa.Schema, model):
    """Arrow function: each document whose terms say something for a notice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, words, begins in _chunks(batches):
            odds = model.value.of(words)
            high = np.flatnonzero(odds >= TERMS_LEAST)
            told: dict[int, list[tuple[int, float]]] = {}
            for i, at, value in zip(*_by_text(words.begins[words.firsts[high]], begins), odds[high].tolist()):
                told.setdefault(i, []).append((at, value))
            found = [(key, host, left) for i, places in told.items() for key, host, address, text in [rows[i]] if (left := weigh(text, address, model.value, places))]
            if found:
                yield pa.RecordBatch.from_pydict(_left(*map(list, zip(*found))), schema=schema)

    return run


def residue(df: DataFrame, key: str, text: str, slug: list[str]) -> DataFrame:
    """key and kinds (sorted, comma-separated) of the documents with residue; slug names the columns of their address, the
    first of which is the host.

    A segment is a notice if its wording reaches SURE; or if host evidence supports what wording and terms leave open:

    * wording, terms and COPIED, where COPIES documents of one host or of all hold it, STRANGE of them as a stranger to
      their text, reach SURE; with any wording at all such copies are enough;
    * it speaks to its reader, and two documents or more hold it, all as a stranger;
    * wording and terms reach SURE, and it has some of either.
    """
    spark = df.sparkSession
    address = F.translate(F.concat_ws(" ", *slug), "_", " ")
    texts = df.filter(F.length(text) > 0).select(F.col(key).alias("key"), F.coalesce(F.col(slug[0]).cast("string"), F.lit("")), address, text)
    kind = texts.schema["key"].dataType
    schema = lambda ddl: T.StructType([T.StructField("key", kind), *T.StructType.fromDDL(ddl).fields])
    found = stage(texts.mapInArrow(_looker(to_arrow_schema(schema(LOOKED))), schema(LOOKED)))
    looked, counts = found.filter("at is null"), found.filter("at is not null").select(F.explode(F.arrays_zip("at", "n")).alias("c")).select("c.*")
    sure = looked.filter(F.size("kinds") > 0).select("key", F.array_join("kinds", ", ").alias("kinds"))
    flat = lambda rows: rows.select("key", F.xxhash64("host").alias("host"), F.explode(F.arrays_zip("h", "score", "said")).alias("s")).select("key", "host", "s.*")
    held = flat(looked).withColumn("terms", F.lit(0.0).cast("float"))
    model = train_terms(looked.select(F.explode("sure").alias("notice")), counts)
    if model is not None:
        more = texts.mapInArrow(_weigher(to_arrow_schema(schema(LEFT)), spark.sparkContext.broadcast(model)), schema(LEFT))
        held = held.unionByName(flat(more).select("key", "host", "h", F.lit(0.0).cast("float").alias("score"), "said", F.col("score").alias("terms")))
    bit = lambda b: F.col("said").bitwiseAND(b) > 0
    # a document counts once however often it was delivered; partial sums keep hot segments small
    docs = stage(held.groupBy("host", "h", "key").agg(F.max("score").alias("score"), F.max("terms").alias("terms"), F.min(bit(IS_STRANGE)).alias("strange"), F.max(bit(IS_ADDRESS)).alias("reader")))
    parts = [F.max("score").alias("score"), F.max("terms").alias("terms"), F.max("reader").alias("reader")]
    by_host = docs.groupBy("host", "h").agg(F.count("*").alias("n"), F.sum(F.col("strange").cast("long")).alias("strange"), *parts)
    copied = (F.col("n") >= COPIES) & (F.col("strange") >= STRANGE * F.col("n"))
    open_ = F.col("score") + F.col("terms")
    supported = copied & ((F.col("score") > 0) | (open_ + COPIED >= SURE))
    by_host = stage(by_host.withColumn("known", supported))
    in_all = by_host.groupBy("h").agg(F.sum("n").alias("n"), F.sum("strange").alias("strange"), *parts)
    everywhere = in_all.filter(supported | (F.col("reader") & (F.col("n") >= 2) & (F.col("strange") == F.col("n"))) | (open_ >= SURE)).select("h")
    hosted = docs.join(everywhere, "h", "left_semi").select("key").unionByName(docs.join(by_host.filter("known").select("host", "h"), ["host", "h"], "left_semi").select("key"))
    return sure.unionByName(hosted.select("key", F.lit("copied notice").alias("kinds"))).groupBy(F.col("key").alias(key)).agg(F.max("kinds").alias("kinds"))
