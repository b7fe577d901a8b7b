"""Problem 3: find personal data in free text and replace it with typed placeholders.

Method: a linear-chain conditional random field over word-shape features, trained once per process from the small
labelled table of ``pii_examples``, decoded by Viterbi in numpy batches. The field alone decides; only the form of a
span is checked after it.

Plan: a scan that counts how often the corpus writes each word with and without a capital (a partial aggregate; at
most 1 / LEAST_SHARE words are sent to the workers), then a scan with one Arrow function; no other shuffle but the
final distinct on (table, id, type). Within a batch equal sentences are decoded once. The field is fixed in size
(features are hashed).

Defined results: null texts are no rows in the findings and stay null when redacted; empty texts stay empty; very
long texts are decoded sentence by sentence; a span that fails its exact check (an e-mail without an at, a telephone
number of fewer than seven digits, ...) is dropped.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.crf import CRF
from quire.llm.pii_examples import DIGITS, FUNCTION, table, unknown
from quire.session import materialise

TYPES = ("email", "phone", "id_number", "address", "person_name")
TAGS = ("O", *(f"{p}-{t}" for t in TYPES for p in "BI"))
FEATURES = 1 << 16

_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
_ABBREVIATED = "".join(rf"(?<!\b{x}\.)" for x in ("No", "no", "St", "Sr", "Mr", "Dr", "Fr", "Br", "Ms", "Mrs", "Sta", "tel", "Tel", "NO", "ST", "MR", "MRS", "DR", "SR", "FR", "mr", "mrs", "dr", "sr", "fr", "[A-Za-z]", "Lic"))
_SENTENCE = re.compile(_ABBREVIATED + r"(?<=[.!?])\s+|\s*\n\s*")

def _h(s: str) -> int:
    h = 14695981039346656037
    for b in s.encode():
        h = ((h ^ b) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
    return h & 0x7FFFFFFFFFFFFFFF


def _shape(w: str) -> str:
    if w.isdigit():
        return "9" * min(len(w), 12)
    if not w[0].isalpha():
        return w
    return ("X" if w[0].isupper() else "x") + ("" if len(w) == 1 else "X" if w.isupper() else "x") + ("." if len(w) < 4 else "")


class Types:
    """Hashed features of distinct tokens, kept for the life of a worker. ``known``: words of running text in the labelled table."""

    def __init__(self, known: frozenset[str]) -> None:
        self.known = known
        self.seen: dict[str, list[tuple[int, int, str]]] = {}  # sentences decoded so far and their spans
        self.index: dict[str, int] = {}
        self.rows: list[tuple[int, ...]] = []
        self.of("\x00")  # padding

    def of(self, token: str) -> int:
        k = self.index.get(token)
        if k is None:
            k = self.index[token] = len(self.rows)
            w = unicodedata.normalize("NFKC", token) or token
            low = w.lower()
            word = "#digit" if low in DIGITS else "#num" if w.isdigit() and len(w) > 3 else low
            self.rows.append(tuple(_h(x) for x in ("w" + word, "s" + _shape(w), "p" + low[:3], "q" + low[-3:], "r" + low[-2:] + ("9" if w.isdigit() else "a"), f"k{low in self.known}{_shape(w)}")))
        return k


def featurise(types: Types, sents: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers (tokens x slots) of all sentences, their starts and lengths."""
    flat: list[int] = []
    starts, lengths = np.zeros(len(sents), np.int64), np.zeros(len(sents), np.int64)
    for i, s in enumerate(sents):
        flat += (0, 0)
        starts[i], lengths[i] = len(flat), len(s)
        flat += [types.of(t) for t in s]
    flat += (0, 0, 0)
    ids = np.array(flat, np.int64)
    base = np.array(types.rows, dtype=np.int64)[ids]
    word, shape, pre, suf, suf2, seen = base.T

    def at(a: np.ndarray, d: int) -> np.ndarray:
        return np.roll(a, -d)

    def mix(slot: int, *xs: np.ndarray) -> np.ndarray:
        h = np.full(len(ids), slot * 0x1F3D5B79, np.int64)
        for x in xs:
            h = (h * 0x5851F42D4C957F2D + x) & 0x7FFFFFFFFFFFFFFF
            h ^= h >> 29
        return (h * 0x2545F491 & 0x7FFFFFFFFFFFFFFF) >> 21 & (FEATURES - 1)

    with np.errstate(over="ignore"):
        cols = [
            mix(1, word), mix(2, shape), mix(3, pre), mix(4, suf), mix(5, suf2),
            mix(6, at(word, -1)), mix(7, at(word, 1)), mix(8, at(word, -2)), mix(9, at(word, 2)),
            mix(10, at(shape, -1), shape), mix(11, shape, at(shape, 1)), mix(12, at(shape, -1), shape, at(shape, 1)),
            mix(13, at(word, -1), shape), mix(14, at(word, 1), shape), mix(15, at(word, -2), at(word, -1)), mix(16, at(word, 1), at(word, 2)),
            mix(17, at(shape, -2), at(shape, -1), shape), mix(18, shape, at(shape, 1), at(shape, 2)),
            mix(19, seen), mix(20, at(seen, -1), seen), mix(21, seen, at(seen, 1)), mix(22, at(seen, -1), seen, at(seen, 1)), mix(23, at(word, -1), seen), mix(24, seen, at(word, 1)),
        ]
    return np.stack(cols, 1).astype(np.int32), starts, lengths


#: Share of the words outside slots that training replaces by unknown ones, so that the field does not lean on one word.
DROPPED = 0.15


#: A word of at least this share of all words may be known from the corpus (so at most 100,000 are), if most of its occurrences are in lower case.
LEAST_SHARE, LOWER = 1e-5, 0.6


def corpus_words(texts: DataFrame, text: str = "text") -> frozenset[str]:
    """Words that the corpus itself writes in lower case: names, unlike other words, mostly have a capital.

    Counted over all texts by a partial aggregate. Shares, not counts, decide, leaning on a few occurrences of either
    kind, so that a word seen once proves nothing. At most ``1 / LEAST_SHARE`` words can be told.
    """
    words = texts.select(F.explode(F.split(text, r"[^\p{L}]+")).alias("w")).where("w <> ''")
    n = words.groupBy("w").agg(F.count("*").alias("n")).groupBy(F.lower("w").alias("word")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("w") == F.lower("w"), F.col("n")).otherwise(0)).alias("low"))
    n = materialise(n)  # read twice: for the total, and for the words
    total = n.agg(F.sum("n")).first()[0] or 0
    kept = n.where((F.col("n") >= LEAST_SHARE * total) & (F.col("low") + 1 >= LOWER * (F.col("n") + 4)))
    return frozenset(r["word"] for r in kept.select("word").collect())


def known_words(rows: list[list[tuple[str, str]]]) -> frozenset[str]:
    """Words that hold sentences together, and those of the table outside its labelled slots."""
    function = {w for ws in FUNCTION.values() for w in ws}
    return frozenset(function | {t.lower() for row in rows for text, kind in row if not kind and not text.endswith("\u200b") for t in _TOKEN.findall(text) if t.isalpha()})


#: Fields trained on fillings of their own and averaged.
FIELDS = 3


def fitted(held: bool | None = None, epochs: int = 4) -> tuple[CRF, frozenset[str]]:
    """The mean of ``FIELDS`` fields, each trained on the frames of the table (see ``table``) with other fillings, and the words they know."""
    tables = [table(held=held, seed=11 + k) for k in range(FIELDS)]
    known = known_words([row for rows in tables for row in rows])
    fields = [_one(rows, known, 17 + k, epochs) for k, rows in enumerate(tables)]
    mean = CRF(FEATURES, TAGS)
    mean.weights, mean.trans, mean.start, mean.end = (np.mean([getattr(f, x) for f in fields], axis=0, dtype=np.float32) for x in ("weights", "trans", "start", "end"))
    return mean, known


def _one(rows: list[list[tuple[str, str]]], known: frozenset[str], seed: int, epochs: int) -> CRF:
    rng = random.Random(seed)
    sents, tags = [], []
    for row in rows:
        words, ts = [], []
        for text, kind in row:
            toks = _TOKEN.findall(text)
            if not kind:
                toks = [unknown(rng, t) if t.isalpha() and rng.random() < DROPPED else t for t in toks]
            words += toks
            ts += [TAGS.index(("B-" if i == 0 else "I-") + kind) if kind else 0 for i in range(len(toks))]
        sents.append(words)
        tags.append(ts)
    feats, starts, lengths = featurise(Types(known), sents)
    flat = np.zeros(len(feats), np.int64)
    for s, t in zip(starts, tags):
        flat[s : s + len(t)] = t
    return CRF(FEATURES, TAGS).fit(feats, starts, lengths, flat, epochs=epochs, averaged=epochs - 1, seed=seed)


@lru_cache(maxsize=1)
def model() -> tuple[CRF, frozenset[str]]:
    """The field trained on the whole table."""
    return fitted()


def _exact(kind: str, span: str) -> bool:
    """The exact check that follows the field's decision: what a span of the type must hold by its form."""
    s = unicodedata.normalize("NFKC", span).lower()
    digits = len(re.findall(r"\d", s)) + len(re.findall(r"\b(?:" + "|".join(DIGITS) + r")\b", s))
    if kind == "email":
        return bool(re.search(r"@|\bat\b", s)) and bool(re.search(r"\.|\bdot\b", s))
    if kind == "person_name":
        return not digits and any(c.isalpha() for c in s)
    return digits >= {"phone": 7, "id_number": 4, "address": 1}[kind]


def spans(crf: CRF, types: Types, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """Checked ``(start, end, type)`` spans of each text. Equal sentences of a worker are decoded once."""
    if len(types.seen) > 200_000:  # bounds memory; a sentence that returns is decoded again
        types.seen.clear()
    sent_of: dict[str, int] = {}
    places: list[list[tuple[int, int]]] = []  # per text: (offset, sentence)
    for t in texts:
        here, a = [], 0
        for m in _SENTENCE.finditer(t):
            if m.start() > a:
                here.append((a, sent_of.setdefault(t[a : m.start()], len(sent_of))))
            a = m.end()
        if a < len(t):
            here.append((a, sent_of.setdefault(t[a:], len(sent_of))))
        places.append(here)
    if not sent_of:
        return [[] for _ in texts]
    every = list(sent_of)
    sents = [s for s in every if s not in types.seen]
    toks = [[(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(s)] for s in sents]
    feats, starts, lengths = featurise(types, [[x[0] for x in s] for s in toks])
    tags = crf.decode(feats, starts, lengths)
    for s, tk, st in zip(sents, toks, starts):
        out: list[tuple[int, int, str]] = []
        kind, a, z = "", 0, 0
        for k, (_, b, e) in enumerate([*tk, ("", 0, 0)]):
            tag = TAGS[tags[st + k]] if k < len(tk) else "O"
            if kind and not (tag[0] == "I" and tag[2:] == kind):
                if _exact(kind, s[a:z]):
                    out.append((a, z, kind))
                kind = ""
            if tag != "O":
                if not kind:
                    kind, a = tag[2:], b
                z = e
        types.seen[s] = out
    found = [types.seen[s] for s in every]
    return [[(o + a, o + z, k) for o, i in here for a, z, k in found[i]] for here in places]


def _worker(parts: tuple) -> tuple[CRF, Types]:
    crf = CRF(0, TAGS)
    crf.n_features, crf.weights, crf.trans, crf.start, crf.end, known = parts
    return crf, Types(known)


def parameters(texts: DataFrame, text: str = "text") -> tuple:
    """What a worker needs: the field, and the words known from the table and from the corpus."""
    m, known = model()
    return m.n_features, m.weights.astype(np.float16).astype(np.float32), m.trans, m.start, m.end, known | corpus_words(texts, text)


def find(batches: Iterator[pd.DataFrame], parts: tuple) -> Iterator[pd.DataFrame]:
    """record_table, record_id, text -> one row per record and type."""
    crf, types = _worker(parts)
    for b in batches:
        rows = [(t, i, k) for t, i, sp in zip(b["record_table"], b["record_id"], spans(crf, types, b["text"].tolist())) for k in sorted({x[2] for x in sp})]
        yield pd.DataFrame(rows, columns=["record_table", "record_id", "pii_type"])


def redact(text: str, sp: list[tuple[int, int, str]]) -> str:
    for a, z, k in reversed(sp):
        text = f"{text[:a]}[{k.upper()}]{text[z:]}"
    return text


def redacted(batches: Iterator[pd.DataFrame], parts: tuple) -> Iterator[pd.DataFrame]:
    """record_table, record_id, text -> the same with ``redacted`` in place of ``text``; nulls stay null."""
    crf, types = _worker(parts)
    for b in batches:
        has = b["text"].notna()
        texts = b.loc[has, "text"].tolist()
        out = pd.Series([None] * len(b), index=b.index, dtype=object)
        out[has] = [redact(t, s) for t, s in zip(texts, spans(crf, types, texts))]
        yield b[["record_table", "record_id"]].assign(redacted=out)
