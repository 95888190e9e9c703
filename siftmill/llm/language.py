"""Language of a short text by its function words and letters; no model, no state."""

from __future__ import annotations

import re
from functools import lru_cache

_WORD = re.compile(r"[^\W\d_]+")
#: Frequent function words of each language.
FUNCTION_WORDS = {
    "en": "the of and to in was were is are for with that by from on as at this which be has have been not no we our between after an or it its their these than but during who had into may should among more".split(),
    "fr": "le la les de des du et un une dans est été sont pour par sur avec que qui ne pas au aux ce cette ces chez selon nous ont été entre plus a après leur leurs ou d l n s sans être si".split(),
    "es": "el la los las de del y en un una que por para con se es fue su sus al no como más entre según fueron lo este esta estos tras sobre pero ha han sin si".split(),
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war wurde wurden oder vor durch".split(),
    "pt": "o a os as de do da dos das e em um uma que por para com se é foi não no na nos nas ao aos à ou mais como entre após foram seu sua pelo pela sobre são ser".split(),
    "it": "il lo la i gli le di del della dei e in un una che per con si è non come più tra sono stato stata nel nella dal alla da questo questa ma".split(),
    "nl": "de het een en van in is dat op te zijn met voor niet aan er om door bij naar uit ook werd werden tussen deze dit maar als na".split(),
}
_OF: dict[str, list[str]] = {}
for _lang, _words in FUNCTION_WORDS.items():
    for _w in dict.fromkeys(_words):
        _OF.setdefault(_w, []).append(_lang)
#: Letters that speak for a language.
_LETTERS = {"ß": "de", "ä": "de", "ö": "de", "ü": "de", "ñ": "es", "¿": "es", "ã": "pt", "õ": "pt", "ç": "pt", "è": "fr", "ê": "fr", "œ": "fr", "à": "fr", "ù": "fr"}
_CYRILLIC, _GREEK, _CJK = re.compile("[Ѐ-ӿ]"), re.compile("[Ͱ-Ͽ]"), re.compile("[぀-ヿ一-鿿가-힯]")


def votes(text: str) -> dict[str, float]:
    """Weight for each language: a function word shared by k languages gives each of them 1/k."""
    found: dict[str, float] = {}
    for word in _WORD.findall(text.lower()):
        for lang in _OF.get(word, ()):
            found[lang] = found.get(lang, 0.0) + 1.0 / len(_OF[word])
    if not text.isascii():
        for c in text.lower():
            if (lang := _LETTERS.get(c)) is not None:
                found[lang] = found.get(lang, 0.0) + 0.4
    return found


@lru_cache(maxsize=4096)
def language(text: str) -> str | None:
    """The language of text, or None where its words don't tell."""
    letters = sum(map(len, _WORD.findall(text))) or 1
    for name, pattern in (("ru", _CYRILLIC), ("el", _GREEK), ("cjk", _CJK)):
        if len(pattern.findall(text)) > 0.4 * letters:
            return name
    found = votes(text)
    if not found:
        return None
    best = max(found, key=lambda k: (found[k], k))
    rest = max((v for k, v in found.items() if k != best), default=0.0)
    return best if found[best] >= 1.0 and found[best] > 1.15 * rest else None
