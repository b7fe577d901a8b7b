"""Problem 5: the language of every document and of every stretch of a mixed one, with a confidence.

Method: averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient descent in numpy;
the confidence is calibrated by a temperature, and stretches below a confidence, or in the extra class ``und`` (no
language: code, numbers, random letters), are rejected. The temperature is fitted on every tenth sentence by a model
that was trained without these sentences; the model in use is then trained on all.

Training takes the labelled sentences of ``lang_seeds`` (about 300, a fixed number) and happens once per process.
The trained model is a few hundred kilobytes at any input size.

Scoring runs in Arrow batches: sentences are cut, lower-cased, split to words and dictionary-encoded by Arrow's
kernels; each distinct word of a worker is embedded once; sentences are sums of word vectors. No row is looped over.

Defined results: null or blank texts, and texts in no known language, have no stretch; a text whose stretches are
all too short to tell is judged as a whole; very long texts and words are read whole; words quoted within a sentence
belong to no stretch, as they do not count as a language of the text.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quire.llm.lang_seeds import SEEDS

LANGS = ("en", "kha", "es", "fr", "la", "de")
CLASSES = (*LANGS, "und")
BUCKETS, DIM = 1 << 15, 24
#: A stretch counts from so many words and so much confidence on.
MIN_WORDS, MIN_CONFIDENCE = 4, 0.80
#: Stretches of fewer words than this (names and notes, mostly) need more confidence.
FEW_WORDS, FEW_CONFIDENCE = 7, 0.97

# Sentences end at a final mark with space after it, at a line that the next does not continue, and between blocks.
_JOIN = r"[^\S\n]*\n[^\S\n]*(\p{Ll})"
_CUT = r"[.!?…]+[\"'”’»)\]]*\s+|\s*\n\s*|\s—\s|<[^>]{1,60}>"
_QUOTED = r"[“\"«][^“”\"«»\n.!?]*[”\"»]"
_NO_LANGUAGE = r"[^\s@＠\d]*[@＠\d][^\s]*?([.!?]?(?:\s|$))"
_NOT_WORD = r"[^\p{L}\p{M}'’-]+"


def _hash(gram: str) -> int:
    h = 2166136261
    for b in gram.encode():
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    return (h ^ (h >> 15)) % BUCKETS


def subwords(word: str) -> list[int]:
    """Buckets of the word's character 2- to 5-grams, with its ends marked, and of the word itself."""
    w = f"<{word}>"
    grams = [w[i : i + n] for n in (2, 3, 4, 5) for i in range(len(w) - n + 1)]
    return [_hash(g) for g in [*grams, "=" + w]]


def words_of(text: str) -> list[str]:
    return [w for w in re.sub(r"[^\w'’-]+|[\d_]+", " ", text.lower()).split() if w]


def _noise(rng: random.Random) -> str:
    kind = rng.randrange(5)
    if kind == 0:
        return " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(4, 9)))
    if kind == 1:
        return "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(60))
    if kind == 2:
        return rng.choice(["function f(){return null;} var x", "div class span td tr nbsp raquo href", "margin padding px nav td tr", "data image png base64 http www com", "x xxx xxxx test test asdf qwerty"])
    if kind == 3:
        return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzäöüàâîûéèñÃÂ") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(3, 9)))
    return " ".join(rng.choice(["Ã", "Â", "ï", "â€", "��", "tÂ", "Ãs", "aÃd"]) + rng.choice("abcdefst") for _ in range(8))


#: Every so many-th sentence of a language is held out to fit the temperature.
HOLD = 10


def examples(held: bool | None) -> list[tuple[np.ndarray, int]]:
    """Whole sentences and windows of them, as buckets and class: of all sentences (``None``), of those kept to train on, or of those held out."""
    rng = random.Random(7)
    data: list[tuple[list[int], int]] = []
    for y, lang in enumerate(LANGS):
        for k, s in enumerate(SEEDS[lang].strip().split("\n")):
            if held is not None and (k % HOLD == HOLD // 2) != held:
                continue
            w = words_of(s)
            for a, b in [(0, len(w)), *[(a, min(len(w), a + n)) for n in (3, 5, 7) for a in range(0, max(1, len(w) - n + 1), 2)]]:
                data.append(([h for x in w[a:b] for h in subwords(x)], y))
    data += [([h for x in words_of(_noise(rng)) for h in subwords(x)], len(LANGS)) for _ in range(len(data) // 12)]
    return [(np.array(f), y) for f, y in data if f]


def trained(train: list[tuple[np.ndarray, int]], epochs: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Scores of each bucket (BUCKETS x classes) and bias, by stochastic gradient descent on the softmax of averaged embeddings."""
    rng, train = random.Random(7), list(train)
    g = np.random.default_rng(7)
    emb = g.normal(0, 0.1, (BUCKETS, DIM))
    out = np.zeros((DIM, len(CLASSES)))
    bias = np.zeros(len(CLASSES))
    for e in range(epochs):
        rng.shuffle(train)
        for k, (f, y) in enumerate(train):
            rate = 0.5 * (1 - (e + k / len(train)) / epochs)
            x = emb[f].mean(0)
            z = x @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            gx = out @ p
            out -= rate * np.outer(x, p)
            bias -= rate * 0.1 * p
            np.add.at(emb, f, -rate * gx / len(f) * min(len(f), 8))
    return emb @ out, bias


def fitted_temperature(scores: np.ndarray, bias: np.ndarray, held: list[tuple[np.ndarray, int]]) -> float:
    """The temperature at which the held-out examples are likeliest."""
    z = np.array([scores[f].mean(0) + bias for f, _ in held])
    ys = np.array([y for _, y in held])

    def nll(t: float) -> float:
        s = z / t
        s = s - s.max(1, keepdims=True)
        return float(-(s[np.arange(len(ys)), ys] - np.log(np.exp(s).sum(1))).mean())

    return min((0.5, 0.6, 0.7, 0.85, 1.0, 1.2, 1.4, 1.7, 2.0, 2.4, 2.8, 3.4, 4.0), key=nll)


@lru_cache(maxsize=1)
def model() -> tuple[np.ndarray, np.ndarray, float]:
    """Scores of each bucket (BUCKETS x classes), bias and temperature."""
    temperature = fitted_temperature(*trained(examples(False)), examples(True))
    scores, bias = trained(examples(None))
    return scores.astype(np.float32), bias.astype(np.float32), float(temperature)


class Scorer:
    """Word vectors of one worker process; distinct words are embedded once.

    At most ``limit`` words are kept besides those of one batch. They are dropped between batches only, as the words
    of a batch point at them.
    """

    def __init__(self, params: tuple[np.ndarray, np.ndarray, float], limit: int = 400_000):
        self.scores, self.bias, self.temperature = params
        self.limit = limit
        self.index: dict[str, int] = {}
        self.vectors = np.zeros((1024, len(CLASSES) + 1), np.float32)  # the last column counts subwords

    def _vector(self, words: list[str]) -> np.ndarray:
        if len(self.index) + len(words) > self.limit:
            self.index.clear()
        out = np.empty(len(words), np.int64)
        for i, w in enumerate(words):
            k = self.index.get(w)
            if k is None:
                k = len(self.index)
                if k >= len(self.vectors):
                    self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
                f = subwords(w)
                self.vectors[k, :-1] = self.scores[f].sum(0)
                self.vectors[k, -1] = len(f)
                self.index[w] = k
            out[i] = k
        return self.vectors[out]

    def segments(self, segs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each string: class, confidence, number of words."""
        if len(segs) == 0:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        clean = pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(segs), _NOT_WORD, " "))
        lists = pc.utf8_split_whitespace(clean)
        flat = lists.flatten()
        # an empty string splits to one empty word
        enc = pc.dictionary_encode(flat)
        vec = self._vector(enc.dictionary.to_pylist())
        real = np.array([w != "" for w in enc.dictionary.to_pylist()], bool)
        vec[~real] = 0
        codes = enc.indices.to_numpy(zero_copy_only=False)
        offs = lists.offsets.to_numpy()
        offs = offs - offs[0]
        cum = np.zeros((len(codes) + 1, vec.shape[1]), np.float64)
        np.cumsum(vec[codes], axis=0, out=cum[1:])
        tot = cum[offs[1:]] - cum[offs[:-1]]
        n = np.concatenate([[0], np.cumsum(real[codes])])
        n = n[offs[1:]] - n[offs[:-1]]
        z = (tot[:, :-1] / np.maximum(tot[:, -1:], 1) + self.bias) / self.temperature
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        return p.argmax(1), p.max(1), n


def sentences(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Stretches of the texts in order, and the row of each."""
    t = pc.replace_substring_regex(pc.fill_null(texts, ""), _JOIN, r" \1")
    t = pc.replace_substring_regex(t, _QUOTED, " ")
    t = pc.replace_substring_regex(t, _NO_LANGUAGE, r" \1")  # addresses and numbers
    lists = pc.split_pattern_regex(t, _CUT)
    offs = lists.offsets.to_numpy()
    return lists.flatten(), np.repeat(np.arange(len(lists)), np.diff(offs))


def tell(scorer: Scorer, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Per stretch: row, number of words, string, class, confidence, and whether it counts for its row."""
    segs, row = sentences(texts)
    enc = pc.dictionary_encode(segs)
    cls, conf, n = scorer.segments(enc.dictionary)
    code = enc.indices.to_numpy(zero_copy_only=False)
    cls, conf, n = cls[code], conf[code], n[code]
    good = (n >= MIN_WORDS) & (conf >= np.where(n < FEW_WORDS, FEW_CONFIDENCE, MIN_CONFIDENCE)) & (cls < len(LANGS))
    told = np.zeros(len(texts), bool)
    told[row[good]] = True
    # texts without a stretch that counts are judged whole, from two words on
    rest = np.flatnonzero(~told)
    if len(rest):
        c, f, m = scorer.segments(pc.replace_substring_regex(pc.fill_null(texts.take(pa.array(rest)), ""), r"<[^>]{1,60}>|\s+", " "))
        ok = (m >= 2) & (f >= 0.6) & (c < len(LANGS))
        whole = dict(zip(rest[ok].tolist(), zip(c[ok].tolist(), f[ok].tolist())))
        for i in np.flatnonzero(np.isin(row, rest[ok]) & (n > 0)):
            cls[i], conf[i] = whole[row[i]]
            good[i] = True
    return row, n, segs, cls, conf, good


def languages(batches: Iterator[pa.RecordBatch], params: tuple) -> Iterator[pa.RecordBatch]:
    """Adds ``langs`` (sorted, distinct) and ``confidence`` (least over the languages) in place of the last column, the text."""
    scorer = Scorer(params)
    for b in batches:
        row, n, _, cls, conf, good = tell(scorer, b.column(b.num_columns - 1))
        best = np.zeros((b.num_rows, len(LANGS)))
        np.maximum.at(best, (row[good], cls[good]), conf[good])
        has = best > 0
        offs = np.concatenate([[0], np.cumsum(has.sum(1))]).astype(np.int32)
        names = pa.array([LANGS[k] for k in np.nonzero(has)[1].tolist()], pa.string())
        lists = pa.ListArray.from_arrays(pa.array(offs), names)
        low = np.where(has.any(1), np.where(has, best, 2).min(1), 0.0)
        cols = [*b.columns[:-1], lists, pa.array(low, pa.float64())]
        yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names[:-1], "langs", "confidence"])


def stretches(batches: Iterator[pa.RecordBatch], params: tuple) -> Iterator[pa.RecordBatch]:
    """Each stretch of a text that counts: the other columns, ``stretch_no``, ``lang_found``, ``confidence``, ``n_words``, ``stretch``.

    Neighbouring sentences in one language are one stretch.
    """
    scorer = Scorer(params)
    for b in batches:
        row, n, segs, cls, conf, good = tell(scorer, b.column(b.num_columns - 1))
        keep = np.flatnonzero(good)
        if not len(keep):
            continue
        r, c = row[keep], cls[keep]
        head = np.r_[True, (r[1:] != r[:-1]) | (c[1:] != c[:-1])]
        first = np.flatnonzero(head)
        group = np.cumsum(head) - 1
        text = segs.take(pa.array(keep)).to_pylist()
        bounds = [*first.tolist(), len(keep)]
        joined = [". ".join(text[a:z]) for a, z in zip(bounds, bounds[1:])]
        words = np.bincount(group, weights=n[keep])
        confid = np.bincount(group, weights=conf[keep] * n[keep]) / np.maximum(words, 1)
        rows = r[first]
        no = np.arange(len(first)) - np.searchsorted(rows, rows)
        other = [x.take(pa.array(rows)) for x in b.columns[:-1]]
        cols = [*other, pa.array(no, pa.int32()), pa.array([LANGS[k] for k in c[first].tolist()]), pa.array(confid), pa.array(words.astype(np.int32)), pa.array(joined)]
        yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names[:-1], "stretch_no", "lang_found", "confidence", "n_words", "stretch"])
