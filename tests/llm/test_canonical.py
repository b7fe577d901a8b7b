"""The canonical list (problem 7) against brute force, and edge cases."""

import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import canonical as c


def plain(a: str, b: str) -> int:
    """Optimal string alignment with unit costs, by the book."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


WORD = st.text("abcde ", max_size=9)


@settings(max_examples=300, deadline=None)
@given(WORD, WORD)
def test_weighted_distance_is_bounded_by_the_plain_one(a, b):
    d, u = c.weighted_distance(a, b), plain(a, b)
    assert c.plain_distance(a, b) == u
    if u <= 3:
        assert 0.5 * u <= d <= 1.3 * u + 1e-9
    assert (d == 0) == (a == b)


FORM = st.text("abcdefg ", min_size=1, max_size=30)


@settings(max_examples=300, deadline=None)
@given(FORM, st.data())
def test_every_pair_within_the_bound_is_a_candidate(a, data):
    """Also long names, with all edits anywhere: whatever is within the bound shares a delete and passes the letter test."""
    b = a
    for _ in range(data.draw(st.integers(0, 3))):
        i = data.draw(st.integers(0, len(b)))
        op = data.draw(st.sampled_from("irdt"))
        ch = data.draw(st.sampled_from("abcdefg "))
        b = b[:i] + ch + b[i:] if op == "i" else b[:i] + ch + b[i + 1 :] if op == "r" else b[:i] + b[i + 1 :] if op == "d" else b[:i] + b[i : i + 2][::-1] + b[i + 2 :]
    if b and plain(a, b) <= c.edits(min(len(a), len(b))):
        d = c.Dictionary(pd.DataFrame([("x", 1, a, 0.0, "", 0.0), ("y", 2, a, 0.0, "", 0.0)], columns=["list_name", "entry_id", "ref_form", "ref_cost", "ref_kind", "freq"]))
        x, y = d.near([b], ["x"])
        assert list(zip(x.tolist(), y.tolist())) == [(0, 0)]


def test_recall_against_all_pairs():
    """Misspelt names of a list of 400: the dictionary finds every entry that comparing with the whole list finds."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    names = sorted({" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(400)})
    d = c.Dictionary(pd.DataFrame([("x", i + 1, n, 0.0, "", 0.0) for i, n in enumerate(names)], columns=["list_name", "entry_id", "ref_form", "ref_cost", "ref_kind", "freq"]))
    typed = []
    for _ in range(300):
        s = rng.choice(names)
        for _ in range(rng.randint(1, 3)):
            i = rng.randrange(len(s))
            s = rng.choice([s[:i] + s[i + 1 :], s[:i] + rng.choice("aeioust ") + s[i:], s[:i] + rng.choice("aeioust") + s[i + 1 :], s[:i] + s[i : i + 2][::-1] + s[i + 2 :]])
        typed.append(s)
    x, y = d.near(typed, ["x"] * len(typed))
    found = {(a, b) for a, b in zip(x.tolist(), y.tolist()) if c.distance(typed[a], names[b], "", 1) is not None}
    want = {(a, b) for a, s in enumerate(typed) for b, n in enumerate(names) if c.distance(s, n, "", 1) is not None}
    assert found == want and len({a for a, _ in want}) > 200


@pytest.fixture(scope="module")
def places(spark):
    rows = [(1, "country", "India", ["Bharat", "IN"], None), (2, "country", "United Kingdom", ["UK"], None), (3, "country", "Peru", [], None), (9, "country", "Nigeria", [], None), (4, "diocese", "Diocese of Upper Dunwell", [], "Peru"), (5, "diocese", "Vicariate of Marwen", [], "India"), (6, "diocese", "Society of the Upper Room", ["SUR"], None), (7, "diocese", "Diocese of Dunwell", None, "Peru")]
    return spark.createDataFrame(rows, "entry_id long, list_name string, entry_name string, other_names array<string>, country_name string")


CASES = [
    ("country", "iNDIA", 1), ("country", "Indai", 1), ("country", " India​", 1), ("country", "Shillong, India", 1), ("country", "Bharat", 1), ("country", "U.K.", 2), ("country", "Uintde Kingdom", 2), ("country", "Preu", 3), ("country", "Fiji", 0), ("country", "Niger", 0), ("country", "", 0), ("country", "🙏", 0), ("country", "everywhere", 0), ("country", "India", 1), ("country", "x" * 5000, 0),
    ("diocese", "Dunwell Diocese", 7), ("diocese", "D. of Upper Dunwel", 4), ("diocese", "Vic. of Marewn", 5), ("diocese", "S.U.R.", 6), ("diocese", "society of the uper room", 6), ("diocese", "Diocese of Oxquavith", 0), ("diocese", "retired", 0),
]


@pytest.mark.parametrize("most", [c.BROADCAST_DELETES, 0])
def test_assign(spark, places, most):
    """By the broadcast dictionary, and by the shuffle join that a larger list takes."""
    df = spark.createDataFrame([(a, b) for a, b, _ in CASES] + [("country", None), ("country", "Indai")], "list_name string, value string")
    got = {(r["list_name"], r["value"]): r["entry_id"] for r in c.assign(df, places, most).collect()}
    assert got == {(a, b): e for a, b, e in CASES}


def test_empty(spark, places):
    df = spark.createDataFrame([], "list_name string, value string")
    assert c.assign(df, places).count() == 0
    one = spark.createDataFrame([("country", "India")], "list_name string, value string")
    assert [r["entry_id"] for r in c.assign(one, places.limit(0)).collect()] == [0]


def test_repeated_entries_and_a_hot_value(spark, places):
    df = spark.createDataFrame([("country", "Indai")] * 500 + [("country", "India")] * 3, "list_name string, value string")
    got = {r["value"]: (r["entry_id"], r["n"]) for r in c.assign(df, places.unionByName(places)).collect()}
    assert got == {"Indai": (1, 500), "India": (1, 3)}
