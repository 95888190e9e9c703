"""Visually identical text with different characters: one consistent form for every value.

Per token (a stretch of letters and marks) the resolved script sets of its letters are intersected: a letter's set holds
its own script and every script with a letter that looks like it. A token whose letters belong to several scripts, while
Latin is in the intersection, is a mixed-script confusable and gets its Latin spelling; a token made of look-alikes only is a
whole-script confusable if nothing else in the value is written in that script. Then full-width forms, words in mathematical
letters, separate accents, invisible characters and unusual spaces are brought to their plain forms.

Left alone: dashes, quotation marks, fractions, superscripts, signs, ligatures, words properly Greek or Cyrillic, Greek
symbols beside Latin letters (``μm``, ``IFN-γ``), single Greek letters, accents for which no single character exists.

Cases: null gives null and is not changed; empty texts and ASCII without control characters are returned as they are. The
result is idempotent. What sends a value to Python (TRIGGER) is derived from the same tables that decide there.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters of other alphabets that look like a Latin letter, and that letter: those of Unicode's list of confusable
#: characters (ICU 77), without digits, Greek symbols (below), and three that are hardly alike but common in texts read in a
#: wrong encoding (Cyrillic ge and soft sign, Greek sigma).
_PAIRS = {
    "Cyrillic": ("аеорсухіјѕԁһӏԛԝ" "АВЕКМНОРСТУХІЈЅԚԜӀҮ" "ѡѴѵүҽԌꙇ", "aeopcyxijsdhlqw" "ABEKMHOPCTYXIJSQWIY" "wVvyeGi"),
    "Greek": ("ο" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "ϲϳ" "ͿϒϜϹϺᴦ", "o" "ABEZHIKMNOPTYX" "cj" "JYFCMr"),
    "Armenian": ("օոսցհ" "ՍՏՕագզռք", "onugh" "USOwqqnf"),
    "Coptic": ("ⲟⲣⲥ" "ⲂⲎⲒⲔⲘⲚⲞⲢⲤⲦⲬ" "ⲅⲨⳐ", "opc" "BHIKMNOPCTX" "rYL"),
    "Cherokee": ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏎᏒᏔᏙᏚᏞᏟᏢᏦᏴ" "ᎥᎩᎽᏂᏏᏕᏧᏳꭵꮁꮃꮓꮩꮪꮯ", "DRTAJEWMHGZ4RWVSLCPKB" "iYYhbSdGirwzvsc"),
    "Lisu": ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ" "ꓒ", "BPDTGKJCZFMNLSRVHWXYAEIOU" "d"),
    "Hebrew": ("וטןס", "lvlo"),
    "Arabic": ("اهھہەﮦﮧﮨﮩﮪﮫﮬﮭﺍﺎﻩﻪﻫﻬ", "loooooooooooolloooo"),
    "Nko": ("ߊ", "l"),
    "Oriya": ("ଠ", "O"),
    "Malayalam": ("ഠ", "o"),
    "Myanmar": ("ဝ", "o"),
    "Georgian": ("ყჿ", "yo"),
    "Ethiopic": ("ሀዐ", "UO"),
    "Canadian": ("ᐯᑌᑭᑯᑲᒍᒪᕁᕼᕽᖇᖯᖴᗅᗞᗪᗰᗷ", "VUPdbJLxHxRbFADDMB"),
    "Runic": ("ᚷᛁᛕᛖ", "XIKM"),
    "Tifinagh": ("ⴸⴹⵏⵔⵕⵝ", "VElOQX"),
    "Bamum": ("ꛟ", "V"),
    "Lycian": ("𐊂𐊆𐊇𐊊𐊐𐊒𐊕𐊖𐊗", "BEFIXOPST"),
    "Carian": ("𐊠𐊡𐊢𐊥𐊫𐊰𐊱𐊲𐊴𐋏", "ABCFOMTYXH"),
    "Old": ("𐌁𐌂𐌉𐌑𐌕𐌗", "BCIMTX"),
    "Deseret": ("𐐄𐐕𐐛𐐠𐐬𐐽𐑈", "OCLSocs"),
    "Osage": ("𐒴𐓂𐓎𐓪𐓶", "ROUou"),
    "Elbasan": ("𐔓𐔖𐔘𐔜𐔝𐔥𐔦𐔧", "NOKCVFLX"),
    "Ahom": ("𑜀𑜆𑜊𑜎𑜏", "mvwww"),
    "Warang": ("𑢠𑢢𑢣𑢤𑢦𑢩𑢮𑢲𑢵𑢸𑢼𑣀𑣁𑣂𑣃𑣄𑣈𑣗𑣘𑣜", "VFLYEZELOUTvsFizoouy"),
    "Miao": ("𖼈𖼊𖼖𖼨𖼵𖼺𖽀𖽂𖽃", "VTLIRSAUY"),
}
LOOKS_LIKE = {c: like for foreign, latin in _PAIRS.values() for c, like in zip(foreign, latin)}
#: Alphabets in which words are not joined with Latin ones; in texts in others (Hebrew), a particle may stand before a Latin word.
_APART = ("Cyrillic", "Greek", "Armenian", "Coptic", "Cherokee", "Lisu")


def _accented() -> dict[str, str]:
    """Look-alikes with accents (as single characters), and the Latin letters with the same accents."""
    found = {}
    for c in map(chr, (*range(0x370, 0x530), *range(0x1F00, 0x2000))):
        base, *marks = unicodedata.normalize("NFD", c)
        latin = unicodedata.normalize("NFC", "".join([LOOKS_LIKE.get(base, ""), *marks]))
        if marks and base in LOOKS_LIKE and len(latin) == 1:
            found[c] = latin
    return found


ACCENTED = _accented()
LOOKS_LIKE |= ACCENTED
#: Scripts in which each Latin letter has a look-alike.
_ALIKE: dict[str, set[str]] = {}
for _script, (_foreign, _latin) in _PAIRS.items():
    for _c in _latin:
        _ALIKE.setdefault(_c, set()).add(_script)
#: Greek letters in common use as symbols; look-alikes only between two small Latin letters.
SYMBOLS = dict(zip("αγικνρυχϱ", "ayikvpuxp"))


def _ranges(chars: Iterable[str | int]) -> list[tuple[int, int]]:
    """Code points as ranges."""
    found: list[list[int]] = []
    for cp in sorted({c if isinstance(c, int) else ord(c) for c in chars}):
        if found and found[-1][1] == cp - 1:
            found[-1][1] = cp
        else:
            found.append([cp, cp])
    return [(low, high) for low, high in found]


def _class(chars: Iterable[str | int], form: str = "\\U{:08x}") -> str:
    """Code points as the inside of a character class."""
    return "".join(form.format(a) if a == b else f"{form.format(a)}-{form.format(b)}" for a, b in _ranges(chars))


#: Characters without width (the default-ignorable ones, and control characters but tab and line ends).
_HIDDEN = [
    *range(0x00, 0x09), *range(0x0E, 0x1C), 0x7F, 0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x1810),
    *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0x3164, *range(0xFE00, 0xFE10), 0xFEFF, 0xFFA0,
    *range(0xFFF0, 0xFFFC), *range(0x1BCA0, 0x1BCA4), *range(0x1D173, 0x1D17B), *range(0xE0000, 0xE1000),
]
_SPACES = [0x0B, 0x0C, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_FULL_WIDTH = [*range(0xFF01, 0xFF61), *range(0xFFE0, 0xFFE7)]
#: Letters of mathematical styles, and those that Unicode has among the letter-like symbols.
_STYLES = [*range(0x1D400, 0x1D6A6)]
_STYLES_ELSEWHERE = "ℂℊℋℌℍℎℐℑℒℕℙℚℛℜℝℤℨℬℭℯℰℱℳℴ"
_MARKS = [*range(0x300, 0x370), *range(0x1AB0, 0x1B00), *range(0x1DC0, 0x1E00), *range(0x20D0, 0x2100)]
#: Marks outside those blocks that some letter takes into a single character.
_MARKS += [
    ord(d[1]) for c in range(0x590, 0x20000) if not 0xAC00 <= c < 0xE000
    if len(d := unicodedata.normalize("NFD", chr(c))) == 2 and unicodedata.combining(d[1]) and unicodedata.normalize("NFC", d) == chr(c)
]
INVISIBLE = re.compile(f"[{_class(_HIDDEN)}]")
SPACE = re.compile(f"[{_class(_SPACES)}]")
WIDE = re.compile(f"[{_class(_FULL_WIDTH)}]")
_ACCENT = re.compile(f"[^\\s{_class(_MARKS)}][{_class(_MARKS)}]+")
#: Words in letters of mathematical styles, and such letters between two small Latin ones; single ones are variables.
_STYLED = re.compile("[{0}]*[{1}][{0}{1}]+|[{0}]+[{1}]|(?<=[a-z])[{0}{1}](?=[a-z])".format(_class(_STYLES_ELSEWHERE), _class(_STYLES)))
#: The blocks of the alphabets above.
_FOREIGN = re.compile(
    "[\u0370-\u06ff\u0750-\u077f\u07c0-\u07ff\u0b00-\u0b7f\u0d00-\u0d7f\u1000-\u10ff\u1200-\u167f\u16a0-\u16ff\u1c80-\u1cbf\u1d26-\u1d2b\u1f00-\u1fff"
    "\u2c80-\u2d7f\u2de0-\u2dff\ua4d0-\ua4ff\ua640-\ua6ff\uab70-\uabbf\ufb1d-\ufdff\ufe70-\ufefc\U00010280-\U000102df\U00010300-\U0001032f"
    "\U00010400-\U0001044f\U000104b0-\U0001052f\U00011700-\U0001174f\U000118a0-\U000118ff\U00016f00-\U00016f9f]"
)
_TOKEN = regex.compile(r"[\p{L}\p{M}]+")
_ODD_ASCII = re.compile("[^ -~\t\n\r]")
#: What sends a value to Python at all (Java's syntax): every character that the above may change. Plain ones are passed over first.
TRIGGER = rf"(?![ -~\t\n\r])[{_class([*map(ord, (*LOOKS_LIKE, *SYMBOLS, *_STYLES_ELSEWHERE)), *_HIDDEN, *_SPACES, *_FULL_WIDTH, *_STYLES, *_MARKS], chr(92) + 'x{{{:x}}}')}]"


@lru_cache(maxsize=8192)
def own_script(char: str) -> str:
    """The script that a letter belongs to."""
    name = unicodedata.name(char, "").split(" ", 1)[0]
    return {"MICRO": "Greek"}.get(name, name.capitalize())


@lru_cache(maxsize=8192)
def scripts(char: str) -> frozenset[str]:
    """The scripts that a letter can be read in: its own, and those in which another letter looks like it."""
    if char in LOOKS_LIKE:  # by way of the Latin letter
        return frozenset({own_script(char), "Latin"} | _ALIKE.get(LOOKS_LIKE[char], set()))
    return frozenset({own_script(char)} | _ALIKE.get(char, set()))


def resolved(token: str) -> frozenset[str] | None:
    """The scripts that a whole token can be read in: the intersection of its letters' sets; None where nothing limits it."""
    found = None
    for i, c in enumerate(token):
        if unicodedata.combining(c):
            continue
        now = scripts(c)
        if c in SYMBOLS and 0 < i < len(token) - 1 and _plain_small(token[i - 1]) and _plain_small(token[i + 1]):
            now = now | {"Latin"}
        if c in ACCENTED and i and token[i - 1] in LOOKS_LIKE and token[i - 1].isupper():  # as in "Вї", an inverted question mark read in a wrong encoding
            now = frozenset({own_script(c)})
        found = now if found is None else found & now
    return found


def latin_spelling(token: str, accented: bool = True) -> str | None:
    """The Latin spelling of a token whose letters belong to several scripts while all can be read as Latin; else None.

    Without ``accented``, look-alikes of letters with accents are as good as none.
    """
    if not accented and not ACCENTED.keys().isdisjoint(token):
        return None
    if not _FOREIGN.search(token) or len({own_script(c) for c in token if not unicodedata.combining(c)}) < 2:
        return None
    if "Latin" not in (resolved(token) or ()):
        return None
    return "".join(LOOKS_LIKE.get(c) or SYMBOLS.get(c, c) for c in token)


def _plain_small(c: str) -> bool:
    return "a" <= c <= "z" or c in LOOKS_LIKE and LOOKS_LIKE[c].islower()


def _compose(m: re.Match) -> str:
    return unicodedata.normalize("NFC", m.group())


def _respell(text: str, spelled: dict[str, str]) -> str:
    """text with the tokens in other spellings, accents in single characters."""
    return _ACCENT.sub(_compose, _TOKEN.sub(lambda m: spelled.get(m.group(), m.group()), text)) if spelled else text


def unify(text: str | None) -> tuple[str | None, bool]:
    """(text in its consistent form, whether it was in another)."""
    if not text or text.isascii() and not _ODD_ASCII.search(text):
        return text, False
    now = INVISIBLE.sub("", text)
    if WIDE.search(now):
        now = WIDE.sub(lambda m: unicodedata.normalize("NFKC", m.group()), now)
    if _STYLED.search(now):
        now = _STYLED.sub(lambda m: unicodedata.normalize("NFKC", m.group()), now)
    now = SPACE.sub(" ", now)
    now = _ACCENT.sub(_compose, now)
    if _FOREIGN.search(now):
        proper: set[str] = set()  # scripts with words of their own
        seen: set[str] = set()
        spelled: dict[str, str] = {}
        whole: list[str] = []
        beside: set[str] = set()  # tokens that stand beside signs outside ASCII
        for m in _TOKEN.finditer(now):
            token = m.group()
            if not _FOREIGN.search(token):
                continue
            if not now[max(m.start() - 1, 0) : m.start()].isascii() or not now[m.end() : m.end() + 1].isascii():
                beside.add(token)
            if token in seen:
                continue
            seen.add(token)
            latin = latin_spelling(token)
            if latin is not None:
                spelled[token] = latin
            elif all(c in LOOKS_LIKE or unicodedata.combining(c) for c in token) and "Latin" in (resolved(token) or ()):
                whole.append(token)
            else:
                own = [own_script(c) for c in token if not unicodedata.combining(c)]
                proper.update(script for script in own if script != "Greek" or own.count(script) > 1)
        joined = proper - {"Latin", *_APART}
        if joined:
            spelled = {t: latin for t, latin in spelled.items() if joined.isdisjoint(map(own_script, t))}
        now = _respell(now, spelled)
        if re.search("[a-z]{2}", now):
            spelled = {}
            for token in whole:
                own = [own_script(c) for c in token if not unicodedata.combining(c)]
                if not proper.isdisjoint(own):
                    continue
                # a single letter: Greek ones are symbols, and beside signs outside ASCII it may be one of a sequence read in a wrong encoding
                if len(own) == 1 and (own == ["Greek"] or token in beside):
                    continue
                spelled[token] = "".join(LOOKS_LIKE.get(c, c) for c in token)
            now = _respell(now, spelled)
    return now, now != text


FORM = T.StructType([T.StructField("text", T.StringType()), T.StructField("changed", T.BooleanType())])


def consistent(column: Column) -> Column:
    """Struct (text, changed) of a text column; meant for rows that match TRIGGER."""

    @F.pandas_udf(FORM)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [unify(t) for t in texts]
            yield pd.DataFrame({"text": [f[0] for f in found], "changed": [f[1] for f in found]})

    return run(column)


def differing(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, value and consistent text of the values in another form; re-deliveries may repeat."""
    return (
        df.select(*keys, F.col(column).alias("value"))
        .filter(F.col("value").rlike(TRIGGER))
        .withColumn("f", consistent(F.col("value")))
        .filter("f.changed")
        .select(*keys, "value", F.col("f.text").alias("text"))
    )


def with_consistent(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with each column in its consistent form; plain rows don't leave the JVM's columns unchanged in value."""
    for c in columns:
        df = df.withColumn(c, F.when(F.col(c).rlike(TRIGGER), consistent(F.col(c))["text"]).otherwise(F.col(c)))
    return df
