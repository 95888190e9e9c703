import random

import pytest

from siftmill.llm import mojibake as M

CLEAN = {
    "fr": "L’effet de la thérapie sur la santé des élèves a été étudié après une année. Les résultats révèlent que la fréquence était élevée à l’école. Évaluation de la qualité du modèle côtier".split(". "),
    "es": "La reducción de la dosis y el rendimiento académico en niños. Según los cuadernos, la medición de la respiración varió. ¿Influye la práctica en la evaluación del índice".split(". "),
    "de": "Für ältere Menschen änderte sich die Größe der Übung. Überprüfung der Häufigkeit während der Prüfung. Die Fälle ließen sich später erklären".split(". "),
    "ru": "Изучено влияние обратной связи на качество жизни пациентов. Данные собирали в течение нескольких месяцев. Оценка показателя и связь с выборкой".split(". "),
    "en": "The “naïve” model was held at 25 °C – see the café’s façade. Values of ±2 µg or ½ dose were used. The coöperation rôle of the cliché remained".split(". "),
}


def texts(seed, n):
    rng = random.Random(seed)
    return [". ".join(rng.choice(CLEAN[lang]) for _ in range(3)) + "." for lang in CLEAN for _ in range(n)]


@pytest.fixture(scope="module")
def model(spark):
    df = spark.createDataFrame([(t, None if i % 3 else "plain title") for i, t in enumerate(texts(1, 40))], "a string, t string")
    return M.train(df, ["a", "t"])


GARBLE = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp1251"), ("utf-8", "cp1250"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("mac_roman", "cp1252"), ("cp1251", "cp1252"), ("koi8-r", "cp1251")]


def garbled(text, written, read):
    try:
        raw = text.encode(written)
    except UnicodeEncodeError:
        return None
    page = M._CHARS.get(read) or M._page(read)
    return "".join(chr(b) if b < 128 else page[b - 128] for b in raw)


@pytest.mark.parametrize(("written", "read"), GARBLE)
def test_found_and_restored(model, written, read):
    seen = found = right = 0
    for text in texts(2, 6):
        bad = garbled(text, written, read)
        if bad is None or bad == text or written != "utf-8" and not any("А" <= c <= "я" for c in text) and written in ("cp1251", "koi8-r"):
            continue
        f = M.examine(bad, model)
        seen, found, right = seen + 1, found + f.garbled, right + (f.text == text)
    assert seen and found >= 0.95 * seen and right >= 0.85 * seen


def test_garbled_twice_and_in_part(model):
    text = texts(3, 1)[0]
    twice = garbled(garbled(text, "utf-8", "cp1252"), "utf-8", "cp1252")
    assert M.examine(twice, model).text == text
    half = len(text) // 2
    part = text[:half] + garbled(text[half:], "utf-8", "cp1252")
    assert M.examine(part, model).text == text


def test_clean_texts_stay(model):
    sound = texts(4, 10) + ["SÃO NECESSÁRIAS NOVAS MEDIDAS?", "ÂGE ET PÂTURAGE", "A «ça va» answer; ¿qué tal?", "Größe ±5 ‰", "σύνοψη", "10 µg·kg⁻¹", "x̄ and p̂", "dose–dependent", "the space between"]
    assert [t for t in sound if M.examine(t, model).garbled] == []


def test_beyond_remedy(model):
    for text in ("l�anxi�t� chez", "effort (ï¿½ dose)"):
        f = M.examine(text, model)
        assert f.garbled and not f.restored


def test_frames(spark, model):
    rows = [("r", "1", None, "dÃ©pistage prÃ©coce chez les Ã©lÃ¨ves", 1), ("r", "1", None, "dÃ©pistage prÃ©coce chez les Ã©lÃ¨ves", 1), ("r", "2", "", "plain", 2), (None, "3", "Ã‰valuation de lâ€™indice", None, None), ("r", "4", "é" * 100_000, "x" * 300_000, 4)]
    df = spark.createDataFrame(rows, "review string, work_id string, title string, abstract string, field int").drop("field")
    got = {(r["review"], r["work_id"], r["field"]): r["text"] for r in M.restore(df, ["review", "work_id"], ["title", "abstract"], model).collect()}
    assert got == {("r", "1", "abstract"): "dépistage précoce chez les élèves", (None, "3", "title"): "Évaluation de l’indice"}
    empty = M.restore(df.limit(0), ["review", "work_id"], ["title", "abstract"])
    assert empty.count() == 0


def test_model_does_not_depend_on_garbled_rows(spark):
    clean = [(t,) for t in texts(5, 5)]
    bad = [(garbled(t[0], "utf-8", "cp1252"),) for t in clean[:4]]
    a, b = (M.train(spark.createDataFrame(rows, "a string"), ["a"]) for rows in (clean, clean + bad))
    assert a.score("étudié") == b.score("étudié")


def test_text_garbled_five_times(model):
    text = now = "L’école élevée a été étudiée à côté. Les résultats révèlent la fréquence."
    for _ in range(5):
        now = garbled(now, "utf-8", "cp1252")
    found = M.examine(now, model)
    assert found.garbled and (found.text == text) == found.restored


def test_accented_letters_before_unusual_spaces_are_sound():
    text = "L’anxiété s’est révélée liée à la durée du suivi, malgré un été très sec."
    assert M._step("é\u00a0", ("cp1252", "utf-8")) is None and M._step("à\u00a0", ("cp1250", "utf-8")) is None
    assert M._step("Ã\u00a0", ("cp1252", "utf-8"))[:2] == ("à", 1) and M._step("â€", ("cp1252", "utf-8"))[2] == 1
    assert not M.looks_garbled(text.replace(" ", "\u00a0"))
