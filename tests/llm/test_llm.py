"""Operators of the llm subpackage against brute force, round trips, held-out accuracy and edge cases."""

import itertools
import math
import random
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import langid, lookalike, mixing, packing, pairs, pii, quality, scans, tokens
from quire.llm import queries as Q
from quire.llm.crf import CRF

# --- p2 ------------------------------------------------------------------------------------------------------------


def brute(s: str) -> str:
    """Compatibility form, without invisible characters, then composed: what the plan must give where no look-alike is involved."""
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if unicodedata.category(c) not in ("Cf", "Zs"))
    return unicodedata.normalize("NFC", s)


def test_one_form_against_unicode(spark):
    rng = random.Random(2)
    letters = sorted(lookalike.composed_letters())
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(200)]
    dirty = [unicodedata.normalize(rng.choice(["NFD", "NFC"]), w).replace("ά", rng.choice(["ά", "ά"])) + rng.choice(["", "​", " "]) for w in words]
    got = {r["surface"]: r["canonical"] for r in lookalike.one_form(spark.createDataFrame([(d,) for d in dirty], "surface string")).collect()}
    assert all(got[d] == brute(d) for d in dirty)


def test_one_form_cases(spark):
    cases = {"тὸv": "τὸν", "λόɣoʋ": "λόγου", "τὴν": "τὴν", "ᾳ": "ᾳ", "ᾷ": "ᾷ", "ᾷ": "ᾷ", "ἐπ᾽": "ἐπ’", "ὁ；": "ὁ;", "‚": ",", "": "", "​": "", "𝛼": "α", "ａ": "α", "µ": "μ", "καὶ·": "καὶ·", "Α": "Α", "A": "Α", "x" * 3000: "χ" * 3000}
    rows = [(k, 1) for k in cases] * 2 + [(None, 1)]
    df = spark.createDataFrame(rows, "surface string, canonical int")
    got = {r["surface"]: r["canonical"] for r in lookalike.one_form(df).collect()}
    assert got == cases
    assert lookalike.one_form(df.limit(0)).count() == 0
    assert not lookalike.one_form(spark.createDataFrame([("漢",)], "surface string")).first()["is_clean"]


# --- the field -----------------------------------------------------------------------------------------------------


def test_viterbi_against_enumeration():
    rng = np.random.default_rng(1)
    m = CRF(20, ("a", "b", "c"))
    m.weights[:-1] = rng.normal(size=(20, 3))
    m.trans, m.start, m.end = rng.normal(size=(3, 3)).astype(np.float32), rng.normal(size=3).astype(np.float32), rng.normal(size=3).astype(np.float32)
    lengths = np.array([1, 4, 3, 5])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    feats = rng.integers(0, 20, (lengths.sum(), 4)).astype(np.int32)
    got = m.decode(feats, starts, lengths)
    for s, n in zip(starts, lengths):
        em = m.weights[feats[s : s + n]].sum(1)

        def score(y, em=em):
            return m.start[y[0]] + m.end[y[-1]] + sum(em[i, t] for i, t in enumerate(y)) + sum(m.trans[a, b] for a, b in zip(y, y[1:]))

        assert tuple(got[s : s + n]) == max(itertools.product(range(3), repeat=int(n)), key=score)


# --- p3 ------------------------------------------------------------------------------------------------------------


def test_pii_held_out():
    """Every fifth frame of each kind is kept from training: recall and precision by type on those frames alone."""
    from quire.llm.pii_examples import table

    crf, known = pii.fitted(held=False)
    rows = table(held=True, seed=99)
    seen = {"".join(p for p, _ in r) for r in table(held=False)}
    texts = ["".join(p for p, _ in r) for r in rows]
    assert len(seen & set(texts)) / len(texts) < 0.01  # chance fillings of bare slots only
    want = [{t for _, t in r if t} for r in rows]
    got = [{k for _, _, k in s} for s in pii.spans(crf, pii.Types(known), texts)]
    for kind, least in {"email": 0.9, "phone": 0.9, "id_number": 0.9, "address": 0.9, "person_name": 0.8}.items():
        both = sum(kind in a and kind in b for a, b in zip(want, got))
        assert both / sum(kind in a for a in want) > least and both / sum(kind in b for b in got) > least, kind


def test_words_known_from_the_corpus(spark):
    rows = [("The lamp burns for Teresa.",)] * 30 + [("lamp and pyrthei",)] * 20 + [("only once tarmore",)]
    assert {"lamp", "burns", "pyrthei"} <= (got := pii.corpus_words(spark.createDataFrame([*rows, (None,)], "text string"))) and not got & {"teresa", "tarmore"}


def test_redaction(spark):
    t = "Please ring +44 7700 900 239 after six. My name is Dariya Garossot."
    df = spark.createDataFrame([("x", 1, t), ("x", 2, None), ("x", 3, ""), ("x", 4, "Saint Martin, help us to persevere. " * 400)], "record_table string, record_id long, text string")
    parts = pii.parameters(df)
    got = {r["record_id"]: r["redacted"] for r in df.mapInPandas(lambda it: pii.redacted(it, parts), "record_table string, record_id long, redacted string").collect()}
    assert got[1] == "Please ring [PHONE] after six. My name is [PERSON_NAME]." and got[2] is None and got[3] == "" and "[" not in got[4]


# --- p5 ------------------------------------------------------------------------------------------------------------

HELD = {
    "en": "Nobody knows how long the journey will take, but we must begin it together.", "kha": "Ngi donkam ban ïatrei lang na ka bynta ka bha ka miat jong ki khun ki kti.", "es": "Los vecinos trajeron agua y pan para los que venían de lejos.",
    "fr": "Les voisins ont apporté de l'eau et du pain pour ceux qui venaient de loin.", "la": "Vicini aquam et panem portaverunt illis qui de longe venerant.", "de": "Die Nachbarn brachten Wasser und Brot für alle, die von weit her kamen.",
}


def test_languages(spark):
    s = langid.Scorer(langid.model())
    c, conf, _ = s.segments(pa.array(list(HELD.values())))
    assert [langid.LANGS[i] for i in c] == list(HELD) and conf.min() > 0.8
    mixed = HELD["en"] + " " + HELD["de"]
    row, _, _, cls, _, good = langid.tell(s, pa.array([mixed, None, "", "   ", "dGhpcyBpcyBub3QgdGV4dA9k3Jd8sKq0", HELD["fr"] * 500]))
    got = {r: {langid.LANGS[c] for c in cls[good & (row == r)]} for r in range(6)}
    assert got[0] == {"en", "de"} and got[1] == got[2] == got[3] == set() and got[5] == {"fr"}


def test_word_vectors_at_a_tiny_limit():
    """Words of a batch keep their vectors however few words the worker may remember."""
    words = [f"word{i}" for i in range(9)]
    free, tight = langid.Scorer(langid.model()), langid.Scorer(langid.model(), limit=4)
    for part in (words[:3], words, words[2:6], words[::-1]):
        assert np.array_equal(free._vector(part), tight._vector(part))


def test_language_of_held_out_sentences():
    """Sentences that training has not seen, and windows of three words and more of them."""
    held = langid.examples(True)
    und = len(langid.LANGS)
    assert not {tuple(f) for f, y in held if len(f) > 150 and y < und} & {tuple(f) for f, y in langid.examples(False) if y < und}
    scores, bias = langid.trained(langid.examples(False))
    right = [int((scores[f].mean(0) + bias).argmax()) == y for f, y in held]
    assert np.mean(right) > 0.95


def test_quoted_words_are_no_stretch():
    s = langid.Scorer(langid.model())
    t = "As the old chant has it, «ubi caritas et amor deus ibi est semper nobiscum omnibus diebus vitae nostrae», and we sang it all night long."
    row, _, _, cls, _, good = langid.tell(s, pa.array([t, "x" * 100_000]))
    assert {langid.LANGS[c] for c in cls[good & (row == 0)]} == {"en"}


def test_labels(spark):
    cases = {"en": ["en"], "EN": ["en"], "en_US": ["en"], "kha-IN": ["kha"], "Khasi": ["kha"], "both": ["en", "kha"], "en/fr": ["en", "fr"], "unknown": [], "??": [], " ": [], None: None}
    got = spark.createDataFrame([(k,) for k in cases], "l string").select("l", Q._label_languages(F.col("l")).alias("x")).collect()
    assert {r["l"]: r["x"] for r in got} == cases


# --- p10 -----------------------------------------------------------------------------------------------------------


def test_text_types(spark):
    prose = "The harvest was late, and the people waited. They sang in the evening, and nobody was sent away. "
    docs = [(i, prose * (1 + i % 5), 0) for i in range(60)] + [(100, "\n".join(f"{i}. hidden lamp" for i in range(20)), 0), (101, "\n".join(f"| {i} | bread | 12.{i} |" for i in range(20)), 0), (102, "@#$%^&*<>~/|=+ " * 20, 0), (103, None, 0), (104, "", 0), (105, prose * 3000, 0)]
    docs += [(200 + i, "\n".join(f"- {w} door" for w in ("plain", "old", "wide", "low", "red", "far")), 0) for i in range(6)] + [(300 + i, "\n".join("a,b,c" for _ in range(9)), 0) for i in range(6)] + [(400 + i, "qzxv bcdfg hjklm npqrs " * 9, 0) for i in range(6)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_words int")
    got = {r["doc_id"]: r["text_class"] for r in quality.classify(df).collect()}
    assert len(got) == len(docs) and all(got[i] == "prose" for i in [*range(60), 105])
    assert got[100] == "list" and got[101] == "table" and got[102] == got[103] == got[104] == "junk" and got[203] == "list" and got[303] == "table" and got[403] == "junk"
    assert quality.classify(df.limit(0)).count() == 0


def test_em_learns_trust():
    rng = random.Random(4)
    votes = []
    for _ in range(4000):
        y = rng.choices((0, 1, 2, 3), (8, 1, 1, 1))[0]
        votes.append("".join(str(y) if rng.random() < p else str(rng.randrange(4)) for p in (0.9, 0.85, 0.8, 0.3)) + str(y))
    pats = {}
    for v in votes:
        pats[v[:4]] = pats.get(v[:4], 0) + 1
    keys = sorted(pats.items())
    post = {k: int(p.argmax()) for (k, _), p in zip(keys, quality.fit(keys))}
    assert sum(post[v[:4]] == int(v[4]) for v in votes) / len(votes) > 0.9


def test_em_behaves_alike_at_every_size():
    """A hundred times as many documents of each pattern change no posterior."""
    rng = random.Random(9)
    pats = {"".join(rng.choice("0012399") for _ in range(5)): rng.randint(5, 400) for _ in range(60)}
    small, large = (quality.fit([(k, n * m) for k, n in sorted(pats.items())]) for m in (10, 1000))
    assert (small.argmax(1) == large.argmax(1)).mean() > 0.95 and np.abs(small - large).max() < 0.2


def test_hot_surface_is_joined_whole(spark):
    df = spark.createDataFrame([(i, "ὁ；" if i % 3 else "λόγος") for i in range(300)] + [(900, None)], "id int, surface string")
    assert {r["id"] for r in lookalike.not_canonical(df).collect()} == {i for i in range(300) if i % 3}
    got = {r["id"]: r["canonical"] for r in lookalike.canonical_column(df).collect()}
    assert len(got) == 301 and got[1] == "ὁ;" and got[3] == "λόγος" and got[900] is None


# --- p6 ------------------------------------------------------------------------------------------------------------


def test_pairs(spark):
    good = "Patience is a gift. The road is long, but the lamp burns. Let us begin with silence."
    rows = [(i, "What does the Church teach about patience?", good, "catholic") for i in range(40)]
    q = "What does the Church teach about patience?"
    cases = {
        100: (q, None, "empty"), 101: (q, "<p></p>", "empty"), 102: (q, "[no reply]", "empty"), 103: (q, "I am sorry, but I cannot answer that.", "refusal"), 104: (q, "You asked: " + q, "copy"), 105: (q, q.upper(), "copy"),
        106: (q, "La paroisse vous invite à une soirée de prière. Nous demandons la paix quand la route est longue.", "wrong_language"), 107: (q, good + " The road is long, but the", "truncated"), 108: (q, good + " The lamp...", "truncated"), 109: (q, good[:-1], None), 110: (q, "Yes.", None), 111: (None, good, None), 112: (q, q + "\n" + good, None), 113: (q, (good + " ") * 400, None),
    }
    rows += [(k, m, r, "catholic") for k, (m, r, _) in cases.items()] + [(200, "Tell me a joke.", "I cannot help with that request.", "out_of_scope")]
    df = spark.createDataFrame(rows, "exchange_id long, message string, reply string, scope string")
    got = {r["exchange_id"]: r["defect_type"] for r in pairs.judge(df).collect()}
    assert {k: got[k] for k in cases} == {k: d for k, (_, _, d) in cases.items()} and got[200] is None and got[0] is None
    assert pairs.judge(df.limit(0)).count() == 0


def test_long_clauses_are_read_whole(spark):
    q = "What does the Church teach about patience?"
    good = "Patience is a gift. The road is long, but the lamp burns. Let us begin with silence."
    late = "I have read your question about patience and the long road with great care this morning, and I thank you for sending it to us, but I am unable to provide that kind of guidance."
    bare = "patience is a gift and the road is long and the lamp burns and joy grows slowly like a seed under the snow and I cannot help with that request."
    sound = "Patience is a gift of the night, and the road is long for those who carry the bread of the poor, but the lamp burns in the window and joy grows slowly under the snow."
    rows = [(i, q, good, "catholic") for i in range(40)] + [(100, q, late, "catholic"), (101, q, bare, "catholic"), (102, q, sound, "catholic"), (103, sound, sound, "catholic")]
    got = {r["exchange_id"]: r["defect_type"] for r in pairs.judge(spark.createDataFrame(rows, "exchange_id long, message string, reply string, scope string")).collect()}
    assert [got[i] for i in (0, 100, 101, 102, 103)] == [None, "refusal", "refusal", None, "copy"]
    for t in (late, bare, sound, "word " * 1000, "a, " * 100):
        parts = pairs.pieces(t)
        assert [w for p in parts for w in pairs.norm(p)] == pairs.norm(t) and max(len(pairs.norm(p)) for p in parts) <= pairs.READ + 3


def test_ending_counts_are_exact(spark):
    """More distinct runs than hashed cells could hold without strangers' counts; each tail's counts are its own."""
    rng = random.Random(6)
    replies = [" ".join(f"w{rng.randrange(3000)}" for _ in range(30)) + "." for _ in range(5000)] + ["the lamp burns over bread and wine."] * 9 + ["the lamp burns over bread and wine", "they carry the road of bread and"]
    df = spark.createDataFrame([(i, "q", r, "catholic") for i, r in enumerate(replies)], "exchange_id long, message string, reply string, scope string")
    got = {r["exchange_id"]: r["tail_counts"] for r in pairs.with_endings(df).collect()}
    assert len(got) == len(replies) and got[0] is None
    assert got[5009] == [10, 9] * 5 and got[5010] == [11, 0, 11, 0, 1, 0, 1, 0, 1, 0]
    assert pairs.end_sign(replies[5009], pairs.norm(replies[5009]), got[5009]) == "fits" and pairs.end_sign(replies[5010], pairs.norm(replies[5010]), got[5010]) == "odd"
    for k in (2, 30):  # the same rates at any size
        assert pairs.end_sign("of bread", ["of", "bread"], [10 * k, 6 * k, 4 * k, 2 * k]) == "fits" and pairs.end_sign("of the", ["of", "the"], [10 * k, 0, 4 * k, 0]) == "odd"


def test_runs_of_words_hash_alike():
    w = np.array([7, 8, 9, 7, 8], np.uint64)
    for n in (1, 2):
        k, h = pairs.runs(w, np.array([0, 1, 2, 0, 1]), n)
        by = dict(zip(k.tolist(), h.tolist()))
        assert by[1] == by[4] and len(set(by.values())) == {1: 3, 2: 2}[n]


def test_pairs_held_out():
    """Parts and frames of refusals, answers and closings that training has not seen: recall and precision by tag."""
    from quire.llm.pair_examples import table

    crf, rows = pairs.fitted(held=False), table(held=True, seed=77, n=900)
    slots = 10 + 2 * max(len(pairs.norm(c[0])) for r in rows for c in r)
    feats = np.stack([pairs.row_features(pairs.norm(t), *rest, slots) for r in rows for t, _, *rest in r])
    lengths = np.array([len(r) for r in rows])
    got = crf.decode(feats, np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    want = np.array([pairs.TAGS.index(c[1]) for r in rows for c in r])
    for k, (recall, precision) in {"A": (0.9, 0.9), "R": (0.8, 0.9), "E": (0.9, 0.9), "F": (0.9, 0.9), "U": (0.9, 0.85)}.items():
        y = pairs.TAGS.index(k)
        both = ((got == y) & (want == y)).sum()
        assert both / (want == y).sum() > recall and both / (got == y).sum() > precision, k


# --- p1 ------------------------------------------------------------------------------------------------------------

LEX = {w: 6.0 for w in "the road is long and lamp burns before altar without regret well-being well being patience grows slowly like a seed under snow he said nothing but every ever-present ever present grace has door".split()}


@pytest.mark.parametrize(
    ("text", "repaired", "noise"),
    [
        ("The road is lo-\nng and the lamp burns.", "The road is long and the lamp burns.", {"hyphenation"}),
        ("Every ever-\npresent grace has a door.", "Every ever-present grace has a door.", set()),
        ("Tbe larnp burns w!thout regret.", "The lamp burns without regret.", {"characters"}),
        ("The road is long and the\n\nOF THE INNER LAMP\n\n— 206 —\n\nlamp burns.", "The road is long and the lamp burns.", {"header", "page_number"}),
        ("The road is pa-\n\n  12  \n\ntience and grows.", "The road is patience and grows.", {"hyphenation", "page_number"}),
        ("THE ROAD is long.", "THE ROAD is long.", set()),
        ("", "", set()),
        ("The road is long.\n\nThe lamp burns.", "The road is long.\n\nThe lamp burns.", set()),
    ],
)
def test_scan_repair(text, repaired, noise):
    got, kinds = scans.decode(text, scans.Decoder(dict(LEX)))
    assert (got, kinds) == (repaired, noise)


@pytest.mark.parametrize(
    ("text", "repaired", "noise"),
    [
        ("The roadislong and grace has a door.", "The road is long and grace has a door.", set()),  # three words run together
        ("The road is long, and pa ti ence grows.", "The road is long, and patience grows.", set()),  # one word in three pieces
        ("He said nothing with re gre t.", "He said nothing with regret.", set()),
        ("He said nothing without re gret.", "He said nothing without regret.", set()),
        ("The roadand larnpburns.", "The road and lamp burns.", {"characters"}),  # confused and run together
        ("The road and al tor.", "The road and al tor.", set()),
        ("The road and w!th out regret.", "The road and without regret.", {"characters"}),  # confused and torn
        ("Patience grow sslowly like a seed.", "Patience grows slowly like a seed.", set()),  # the space has moved
        ("The road is lo-\nngand the lamp burns.", "The road is long and the lamp burns.", {"hyphenation"}),  # a hyphen and run together
    ],
)
def test_scan_stream(text, repaired, noise):
    got, kinds = scans.decode(text, scans.Decoder(dict(LEX)))
    assert (got, kinds) == (repaired, noise)


def test_torn_words_that_are_words():
    lex = {"al": 3.0, "tar": 3.0, "altar": 8.0, "the": 11.0, "in": 10.0, "to": 10.5, "into": 8.5, "before": 8.0}
    assert scans.decode("Before the al tar, in to.", scans.Decoder(lex))[0] == "Before the altar, in to."


def test_stream_against_enumeration():
    """The pruned search finds what all ways to put spaces into a short stream give at best."""
    d = scans.Decoder({w: float(n) for n, w in enumerate("a at the he hen then then road roads is island land and".split(), 3)})
    rng = random.Random(8)
    for _ in range(150):
        s = " ".join("".join(rng.choice(["a", "the", "n", "and", "is", "l", "road", "s"]) for _ in range(rng.randint(1, 2))) for _ in range(2))
        units = s.split(" ")
        joined, best = "".join(units), sum(d.unit(u)[0] for u in units)
        for k in range(1 << len(joined) - 1):
            cuts = [0, *[i for i in range(1, len(joined)) if k >> (i - 1) & 1], len(joined)]
            ws = [joined[a:b] for a, b in zip(cuts, cuts[1:])]
            gap = len(units[0])
            dropped = sum(c != gap for c in cuts[1:-1])
            if all(w in d.lex and (len(w) > 1 or w in "aio") for w in ws):
                best = max(best, sum(d.lex[w] for w in ws) - scans.SPLIT_COST * dropped - scans.MERGE_COST * (gap not in cuts))
        got, flags = 0.0, d.doubtful(np.array([d.unit(u)[0] for u in units]), np.array([len(u) for u in units]), np.zeros(len(units), int))
        path = d.path(units)
        words = [(p, q, w) for p, q, w, _, _ in path]
        starts = {0: len(units[0]), len(units[0]) + 1: len(s)}
        for p, q, w in words:
            got += d.unit(s[p:q])[0] if starts.get(p) == q else max(v[0] for e, v in d.walk(s, p, -math.inf).items() if e == q)
        assert got >= best - 1e-9, (s, words, got, best)
        if not flags:
            assert [w for _, _, w in words] == [d.unit(u)[1] for u in units]


def test_clean_text_stays(spark):
    rng = random.Random(3)
    words = [w for w in LEX if "-" not in w]
    text = " ".join(rng.choice(words) for _ in range(20_000))
    assert scans.decode(text, scans.Decoder(dict(LEX))) == (text, set())


def test_decisions_do_not_change_with_size(spark):
    lex = {"the": 9.0, "lamp": 6.0, "burns": 5.0, "garossot": 2.5, "and": 8.0}
    text = "The larnp and garossat, theburns, la mp and garossot."
    want = scans.decode(text, scans.Decoder(lex))
    assert want[0] == "The lamp and garossot, the burns, lamp and garossot."
    for k in (2.3, 7.0, 12.0):  # every count ten, a thousand, 160,000 times
        assert scans.decode(text, scans.Decoder({w: v + k for w, v in lex.items()})) == want


def test_rare_words_stay_known(spark):
    """A word of a millionth of all words is in the lexicon, so its misreads are found and it is not bent to another."""
    df = spark.createDataFrame([("the road " * 2_000,)] * 1_000 + [("garossot",)] * 4, "text string").repartition(4)
    lex = scans.lexicon(df)
    assert set(lex) == {"the", "road", "garossot"}
    d = scans.Decoder(lex)
    assert d.word("garossot")[1:] == ("garossot", False) and d.word("gar0ssot")[1:] == ("garossot", True)


def test_many_readings_are_searched():
    """A misread first letter in a long word of letters that are all often confused: no limit on the readings tried."""
    lex = {"illimitabilities": 6.0, "the": 9.0, **{f"{a}{b}{c}": 3.0 for a in "iljtf" for b in "iljtf" for c in "iljtf"}}
    assert scans.Decoder(lex).word("lllimitabi1ities")[1:] == ("illimitabilities", True)


def test_scan_without_body():
    d = scans.Decoder(dict(LEX))
    assert scans.decode("  12  \n\n  13  ", d) == ("", {"page_number"}) and scans.decode("\n \n", d) == ("", set()) and scans.decode("— — —", d)[1] == set()


def test_lexicon_is_bounded(spark):
    df = spark.createDataFrame([("the road " * 50 + "rare",)] * 3 + [(None,)], "text string")
    assert set(scans.lexicon(df)) == {"the", "road"}


# --- p8, p9 --------------------------------------------------------------------------------------------------------


def _docs(spark, n=300):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["lamp", "road", "bread", "silence", "door"]) for _ in range(rng.randint(1, 120))), f"s{min(3, rng.randrange(8))}") for i in range(n)]
    rows += [(n, "word " * 700, "s0"), (n + 1, None, "s0"), (n + 2, "", "s0"), (0, rows[0][1], rows[0][2])]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_packing(spark):
    docs, cap = _docs(spark), 128
    got = packing.pack(docs.withColumn("shard", F.lit("x")), cap, shard=100).toPandas()
    enc = tokens.encoding(tokens.VOCABULARY)
    sizes = {r["doc_id"]: len(tokens.encode(enc, r["text"])) for r in docs.collect() if r["text"]}
    assert got.groupby("container_id").n_tokens.sum().max() <= cap
    assert got.groupby("doc_id").n_tokens.sum().to_dict() == sizes  # every text once and whole
    assert set(got[got.piece_no > 0].doc_id) == {d for d, n in sizes.items() if n > cap}
    assert got.n_tokens.sum() / (got.container_id.nunique() * cap) > 0.9
    assert packing.pack(docs.limit(0), cap).count() == 0


def test_packing_in_small_shards_is_whole_and_retrieves(spark):
    """Many shards: every text once, and neighbours (texts of one topic) mostly share a container, unlike with random shards."""
    rng = random.Random(6)
    topics = [[f"{a}{b}" for b in ("lamp", "road", "bread", "door", "seed", "net", "well", "vine")] for a in "abcdefgh"]
    rows = [(i, " ".join(rng.choice(topics[i % 8]) for _ in range(rng.randint(8, 20)))) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = packing.pack(docs, 200, shard=100).toPandas()
    assert sorted(got.doc_id) == list(range(800)) and got.groupby("container_id").n_tokens.sum().max() <= 200
    alike = got.assign(t=got.doc_id % 8).groupby("container_id").t.agg(lambda t: t.value_counts(normalize=True).iloc[0])
    assert alike.mean() > 0.7


def test_statistics_of_all_texts_reach_every_shard():
    lists = [np.array(x, np.uint16) for x in ([1, 1, 2], [2, 3])]
    idf = np.array([0.0, 5.0, 0.5, 1.0])
    ix = packing.Index(lists, idf, 10.0)
    norm = packing.K1 * (1 - packing.B + packing.B * 3 / 10)
    assert abs(ix.scores(np.array([1], np.uint16))[0] - 5.0 * 2 * (packing.K1 + 1) / (2 + norm)) < 1e-9


def test_bm25_against_formula():
    lists = [np.array(x, np.uint16) for x in ([1, 1, 2], [2, 3], [3, 3, 3, 4])]
    ix, n, avg = packing.Index(lists), 3, np.mean([3, 2, 4])
    q = np.array([1, 3], np.uint16)
    for d, toks in enumerate(lists):
        want = 0.0
        for t in set(q.tolist()):
            tf, df = (toks == t).sum(), sum(t in x for x in lists)
            want += np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(toks) / avg))
        assert abs(ix.scores(q)[d] - want) < 1e-9


def test_mixing(spark):
    docs = _docs(spark)
    targets = spark.createDataFrame([("s0", 0.5, 4), ("s1", 0.3, 2), ("s2", 0.15, 1), ("none", 0.05, 3)], "source string, target_share double, max_repeats int")
    m = mixing.mix(docs, targets, total_tokens=6000).toPandas()
    per = m.groupby("source").tokens_used.sum()
    avail = mixing.counted(docs).groupBy("doc_id", "source").agg(F.max("n_tokens").alias("n")).groupBy("source").agg(F.sum("n").alias("n")).toPandas().set_index("source").n
    for s, share, rep in (("s0", 0.5, 4), ("s1", 0.3, 2), ("s2", 0.15, 1)):
        assert per[s] == min(round(6000 * share), avail[s] * rep)
    assert m.groupby(["doc_id", "epoch"]).size().max() == 1 and (m.groupby("doc_id").epoch.max() <= m.groupby("doc_id").source.first().map({"s0": 4, "s1": 2, "s2": 1})).all()
    rep = {r["source"]: r for r in mixing.shares(docs, targets, exact=True).collect()}
    assert rep["none"]["status"] == "no text" and abs(rep["s0"]["actual_share"] - 0.5 / 0.95) < 1e-3
    assert mixing.mix(docs.limit(0), targets).count() == 0 and mixing.shares(docs.limit(0), targets).count() == 4


def test_mixing_uses_the_data(spark):
    """By default the total is all the targeted sources hold: small ones repeat up to their cap and are short beyond it."""
    rows = [(i, "bread and salt " * 10, "big") for i in range(90)] + [(100 + i, "bread and salt " * 10, "small") for i in range(8)] + [(200, "bread and salt " * 10, "tiny"), (300, "x y z", "no target")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.2, 4), ("tiny", 0.1, 2)], "source string, target_share double, max_repeats int")
    got = {r["source"]: r for r in mixing.shares(docs, targets).collect()}
    one = got["tiny"]["available_tokens"]
    assert [got[s]["status"] for s in ("big", "small", "tiny")] == ["met", "met", "short"] and got["tiny"]["used_tokens"] == 2 * one == got["tiny"]["max_repeats"] * one
    assert got["small"]["most_repeats"] == 3 and got["small"]["used_tokens"] == round(99 * one * 0.2) and got["big"]["used_tokens"] == round(99 * one * 0.7)
    m = mixing.mix(docs, targets).toPandas()
    assert m.tokens_used.sum() > 0.9 * 99 * one and m.epoch.max() == 3 and not (m.source == "no target").any()
    assert m[m.source == "small"].groupby("doc_id").epoch.nunique().isin([2, 3]).all()


def test_tokens_of_long_text():
    enc = tokens.encoding(tokens.VOCABULARY)
    t = "bread and silence " * 20_000
    assert enc.decode(tokens.encode(enc, t)) == t and tokens.encode(enc, "") == []


# --- the queries ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_runs(spark, sf, name):
    df = Q.QUERIES[name](spark, sf)
    assert df.count() > 0


def test_found_columns(spark, sf):
    want = {"p1_found": ["block_id", "noise_type"], "p2_found": ["id"], "p3_found": ["record_table", "record_id", "pii_type"], "p5_found": ["record_table", "record_id", "lang_found"], "p6_found": ["exchange_id", "defect_type"], "p10_found": ["doc_id", "text_class"]}
    for n, cols in want.items():
        assert Q.QUERIES[n](spark, sf).columns == cols
    assert isinstance(pd.DataFrame(), pd.DataFrame)
