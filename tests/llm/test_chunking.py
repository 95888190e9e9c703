import re

from hypothesis import given, settings
from hypothesis import strategies as st

from siftmill.llm import chunking as C

PART = st.sampled_from(["word", "a.", " ", "\n", "\n\n", "\t", ", ", ". ", "Next", "- item\n", "x" * 30, "é”", "第一", "e.g. ", "3.5 "])


@settings(max_examples=300, deadline=None)
@given(st.lists(PART, max_size=80).map("".join), st.integers(2, 60), st.integers(0, 59))
def test_pieces_cover_the_text_within_the_limit(text, limit, overlap):
    overlap = min(overlap, limit - 1)
    pieces = C.plan(text, limit, overlap)
    at = 0
    for i, (start, end, fresh, cut) in enumerate(pieces):
        assert end - start <= limit and fresh == at and start <= fresh <= end and fresh - start <= overlap
        if i < len(pieces) - 1 and cut == "boundary":
            assert text[end - 1] in " \t\n" or text[end] in " \t\n"
        at = end
    assert at == len(text)
    longest = max(map(len, re.split("[ \t\n]+", text)), default=0)
    assert any(p[3] == "forced" for p in pieces) == (longest > limit)


def test_an_edit_moves_only_neighbouring_cuts():
    text = " ".join(f"Sentence number {i} tells of {i * i} things in a plain way." for i in range(400))
    before = {p[1] for p in C.plan(text, 2000, 150)}
    edited = text[:300] + " inserted words" + text[300:]
    after = {p[1] - 15 for p in C.plan(edited, 2000, 150)}
    assert len(before & after) >= len(before) - 2


def test_cuts_are_natural():
    text = ("One sentence here, with a clause; and more. " * 30 + "\n\n") * 6
    cuts = [text[: p[1]] for p in C.plan(text, 1000, 100)[:-1]]
    assert all(c.endswith((". ", "\n\n", ".", "\n")) for c in cuts)


def test_frames(spark):
    rows = [("a", 1, "x" * 50, 7, "p"), ("a", 1, "x" * 50, 7, "p"), ("b", 1, None, 7, None), ("c", 1, "", None, "p"), ("d", 1, "word " * 20, 7, "p"), (None, 2, "y " * 30, 7, "p"), ("e", 1, "z" * 200_000, 7, "p")]
    df = spark.createDataFrame(rows, "k string, n int, text string, pieces int, cut string")  # columns that clash with the operator's own
    got = {(r["k"], r["n"]): r["cut"] for r in C.cut_kinds(df, ["k", "n"], "text", 40, 5).collect()}
    assert got == {("a", 1): "forced", ("d", 1): "boundary", (None, 2): "boundary", ("e", 1): "forced"}
    pieces = C.split(df, ["k", "n"], "text", 40, 5).orderBy("k", "piece_no").collect()
    texts = {k: [r for r in pieces if r["k"] == k] for k in ("c", "d")}
    assert [r["piece"] for r in texts["c"]] == [""]
    whole = "word " * 20
    assert all(r["piece"] == whole[r["start"] : r["end"]] for r in texts["d"])
    assert C.split(df.limit(0), ["k"], "text", 40, 5).count() == 0 and C.cut_kinds(df.limit(0), ["k"], "text", 40).count() == 0
