"""Cutting (problem 4) against brute force, exact cover and edge cases."""

import itertools
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import splitting as S
from quire.llm.splitting import cut, split_long

PARTS = st.lists(st.sampled_from(["word ", "a", "sentence. ", "\n\n", "line\n", "ẹ́", "x" * 37, "clause; ", "</p> ", "‍", " ) "]), min_size=0, max_size=120).map("".join)


@settings(max_examples=200, deadline=None)
@given(PARTS, st.integers(20, 90), st.integers(0, 15))
def test_pieces_cover_the_text(text, size, overlap):
    ps = cut(text, size, overlap)
    if not text:
        assert ps == []
        return
    assert ps[0][0] == 0 and ps[-1][1] == len(text)
    assert all(0 < e - s <= size for s, e, _ in ps)
    for (_, e, _), (s, _, _) in zip(ps, ps[1:]):
        assert e - s == overlap


def test_natural_boundaries_win():
    text = ("One two three four. " * 5).strip() + "\n\n" + ("Five six seven eight. " * 5).strip()
    ps = cut(text, 130, 0)
    assert [text[s:e] for s, e, _ in ps][0].endswith("\n\n") and len(ps) == 2


def test_exact_limit_and_bad_overlap():
    assert len(cut("x" * 50, 50, 10)) == 1 and len(cut("x" * 51, 50, 10)) == 2
    with pytest.raises(ValueError):
        cut("x", 10, 10)


def test_very_long_text_without_boundary():
    ps = cut("z" * 200_000, 1000, 100)
    assert max(e - s for s, e, _ in ps) <= 1000 and ps[-1][1] == 200_000


@pytest.mark.parametrize("sign", ["é", "ạ̈", "\U0001f469‍\U0001f33e"])
@pytest.mark.parametrize("signs", [0, 1, 4])
def test_no_piece_begins_or_ends_inside_a_sign(sign, signs):
    text = sign * 400
    for s, e, _ in cut(text, 101, signs * len(sign)):
        assert not unicodedata.combining(text[s]) and text[s] != "‍" and (e == len(text) or not unicodedata.combining(text[e]) and text[e] != "‍" and text[e - 1] != "‍")


def test_only_marks_are_cut_all_the_same():
    text = "é" * 400  # no beginning seven characters before an end can be whole; the ends still are
    assert all(not unicodedata.combining(text[e]) for _, e, _ in cut(text, 101, 7)[:-1])
    assert cut("́" * 300, 100, 10)[-1][1] == 300


def test_pieces_begin_at_words_where_they_can():
    text = "".join(f"{w} " for w in ["amen", "lord", "rest"] * 80)  # every fifth position begins a word
    ps = cut(text, 60, 10)
    assert all(s % 5 == 0 for s, _, _ in ps)


def test_table(spark):
    rows = [(1, None, 9), (2, "", 9), (3, "short", 9), (4, "word " * 30, 9), (4, "word " * 30, 9)]
    df = spark.createDataFrame(rows, "id long, t string, piece int")
    got = split_long(df, "t", 40, 5, ["id"])
    assert {r["id"] for r in got.collect()} == {3, 4}
    assert got.where("id = 3").first()["n_pieces"] == 1 and got.where("id = 4 and n_pieces < 4").count() == 0
    assert split_long(df.limit(0), "t", 40, 5, ["id"]).count() == 0


@pytest.mark.parametrize(("text", "size", "overlap"), [("aa bb. cc dd\nee ff, gg hh. ii jj kk", 18, 3), ("aa, bb cc dd ee; ff gg hh", 11, 2), ("One two. Three four. Five six.\n\nSeven.", 20, 0), ("ab cd ef. gh ij", 9, 4)])
def test_against_brute_force(text, size, overlap):
    """The cost of the chosen cuts is the least over all chains of boundaries, however they were searched."""
    pos, kind = S.boundaries(text)
    n = len(text)
    pieces = -(-(n - overlap) // (size - overlap))
    even = (n + (pieces - 1) * overlap) / pieces
    pen = dict(zip(pos.tolist(), S._WEIGHTS[kind].tolist()))

    def cost(chain):
        total, s = 0.0, 0
        for e in chain:
            if e - s > size or (e != n and e <= overlap) or e - s <= 0:
                return None
            begin = e - overlap
            total += pen[e] + S.BALANCE * ((e - s - even) / size) ** 2 + (S.INSIDE if e != n and overlap and begin not in pen and begin else 0)
            s = begin
        return total

    inner = [p for p in pos.tolist() if p < n]
    best = min(c for k in range(6) for ch in itertools.combinations(inner, k) if (c := cost([*ch, n])) is not None)
    got = cut(text, size, overlap)
    assert abs(cost([e for _, e, _ in got]) - best) < 1e-9
    assert set(S.KINDS) >= {k for _, _, k in got}
