"""Problem 8: fill containers of fixed capacity with whole texts.

Method: lexical retrieval packing. Each shard of the texts has a BM25 inverted index over its tokens; a seed text
takes its unused neighbours in the order of their score, each that still fits its window, until nothing fits. Windows
left with room above ``LOOSE`` are emptied once and their texts packed again by best fit.

Neighbours meet in a shard: texts are ordered by the nearest of ``CENTRES`` centres of their weighted words (the
centres in an order in which neighbours are alike), then by a word drawn so that texts with the same rare words draw
the same one, and shards are stretches of this order. Document counts and the mean length are those of all texts; they
have at most as many rows as the tokenizer has tokens. Only the centres are fitted on a sample, of at most ``SAMPLE``
texts; every text is placed. Neighbours in other shards are not retrieved; README gives the share that is.

Plan: one scan encodes the texts and cuts those above the capacity (only those), written once; one pass counts the
documents of each token; one places the texts; one exchange by range brings each stretch together. A task reads its
range as a stream and packs it shard by shard, so that no source, key or copy can make a shard large.

Defined results: null and empty texts take no room and are left out; a text of exactly the capacity fills a container;
repeated rows of one document are packed once; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.tokens import VOCABULARY, encode, encoding
from quire.session import materialise

SHARD = 2048
CENTRES, SAMPLE, DIM = 128, 20_000, 256
K1, B = 1.2, 0.75
#: Windows with more than this part empty are packed again.
LOOSE = 0.03


def pieces(docs: DataFrame, capacity: int, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, piece_no, token_start, token_end, tokens`` (two bytes each): whole texts, or cuts of those above the capacity."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(vocabulary)
        for b in batches:
            rows = []
            for i, t in zip(b["doc_id"], b["text"]):
                ids = np.array(encode(enc, t), dtype=np.uint16 if enc.n_vocab <= 65_536 else np.uint32)
                rows += [(i, k, a, min(a + capacity, len(ids)), ids[a : a + capacity].tobytes()) for k, a in enumerate(range(0, len(ids), capacity))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece_no", "token_start", "token_end", "tokens"])

    return docs.select("doc_id", "text").where(F.length("text") > 0).mapInPandas(run, "doc_id long, piece_no int, token_start int, token_end int, tokens binary")


class Index:
    """BM25 over the token lists of one shard: for each token the pieces that hold it and their weights.

    ``idf`` (by token) and ``mean`` length are those of all texts; without them the shard's own are taken.
    """

    def __init__(self, lists: list[np.ndarray], idf: np.ndarray | None = None, mean: float | None = None):
        n = len(lists)
        sizes = np.array([len(x) for x in lists])
        owner = np.repeat(np.arange(n), sizes)
        flat = np.concatenate(lists).astype(np.int64) if n else np.zeros(0, np.int64)
        pair, tf = np.unique(flat * n + owner, return_counts=True)
        term, self.doc = pair // n, pair % n
        self.terms, first, df = np.unique(term, return_index=True, return_counts=True)
        self.bounds = np.append(first, len(term))
        own = np.log(1 + (n - df + 0.5) / (df + 0.5)) if idf is None else idf[self.terms]
        norm = K1 * (1 - B + B * sizes / max(mean if mean is not None else sizes.mean() if n else 1, 1))
        self.weight = np.repeat(own, df) * tf * (K1 + 1) / (tf + norm[self.doc])
        self.n = n
        # tokens of many pieces are held as rows over all of them: adding rows is far faster than gathering postings
        many = df >= max(n // 16, 4)
        self.row = np.where(many, np.cumsum(many) - 1, -1)
        self.rows = np.zeros((int(many.sum()), n))
        of = np.repeat(self.row, df)
        self.rows[of[of >= 0], self.doc[of >= 0]] = self.weight[of >= 0]

    def scores(self, query: np.ndarray) -> np.ndarray:
        """BM25 score of every piece for the distinct tokens of ``query``, which are tokens of the shard."""
        at = np.searchsorted(self.terms, np.unique(query))
        row = self.row[at]
        at = at[row < 0]
        lo, hi = self.bounds[at], self.bounds[at + 1]
        take = np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo) + np.arange((hi - lo).sum())
        return np.bincount(self.doc[take], self.weight[take], minlength=self.n) + self.rows[row[row >= 0]].sum(0)


def _best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing over ``sizes``; lists of positions."""
    bins: list[list[int]] = []
    room: list[int] = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fit = [(r - s, k) for k, r in enumerate(room) if r >= s]
        if fit:
            _, k = min(fit)
            bins[k].append(i)
            room[k] -= s
        else:
            bins.append([i])
            room.append(capacity - s)
    return bins


def fill(lists: list[np.ndarray], capacity: int, idf: np.ndarray | None = None, mean: float | None = None) -> list[list[int]]:
    """Containers of one shard, each a list of positions in ``lists``, the seed first."""
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    unused = np.ones(len(lists), bool)
    index = Index(lists, idf, mean)
    out: list[list[int]] = []
    for seed in np.argsort(-sizes, kind="stable").tolist():
        if not unused[seed]:
            continue
        unused[seed] = False
        here, room = [seed], capacity - int(sizes[seed])
        fits = np.flatnonzero(unused & (sizes <= room))
        if len(fits):
            sc = index.scores(lists[seed])[fits]
            for j in fits[np.lexsort((fits, -sizes[fits], -sc))].tolist():
                if sizes[j] <= room:
                    here.append(j)
                    unused[j] = False
                    room -= int(sizes[j])
                    if room == 0:
                        break
        out.append(here)
    loose = [c for c in out if capacity - sizes[c].sum() > LOOSE * capacity]
    if len(loose) > 1:
        items = np.array([j for c in loose for j in c])
        again = [items[b].tolist() for b in _best_fit(sizes[items], capacity)]
        if len(again) < len(loose):
            out = [c for c in out if capacity - sizes[c].sum() <= LOOSE * capacity] + again
    return out


@lru_cache(maxsize=2)
def _hashed(n_vocab: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token its place and sign in the sketch, and its draw."""
    g = np.random.default_rng(1)
    return g.integers(0, DIM, n_vocab), g.choice([-1.0, 1.0], n_vocab), -np.log(g.random(n_vocab))


def vectors(lists: list[np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the sketch of its weighted tokens (hashed with signs, of length one), and its draw.

    The draw is consistent: it is the least of its tokens' draws over their weights, so two texts have the same one
    with the probability with which their weighted tokens agree. Lists are not empty.
    """
    if not lists:
        return np.zeros((0, DIM), np.float32), np.zeros(0)
    place, sign, draw = _hashed(len(idf))
    sizes = np.array([len(t) for t in lists])
    flat = np.concatenate(lists).astype(np.int64)
    owner = np.repeat(np.arange(len(lists)), sizes)
    x = np.bincount(owner * DIM + place[flat], sign[flat] * idf[flat], len(lists) * DIM).reshape(-1, DIM).astype(np.float32)
    least = np.minimum.reduceat((draw / np.maximum(idf, 1e-9))[flat], np.cumsum(sizes) - sizes)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9), least


def centres(x: np.ndarray, k: int = CENTRES, rounds: int = 10) -> np.ndarray:
    """``k`` centres of unit vectors by cosine, in an order in which each is followed by the one most like it among those left."""
    k = min(k, len(x))
    c = x[np.random.default_rng(0).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        c = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(k)])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    path, left = [0], set(range(1, k))
    while left:
        j = max(left, key=lambda j: (float(c[path[-1]] @ c[j]), -j))
        path.append(j)
        left.remove(j)
    return c[path]


def _lists(tokens: pd.Series, wide: bool) -> list[np.ndarray]:
    return [np.frombuffer(t, dtype=np.uint32 if wide else np.uint16) for t in tokens]


def placed(docs: DataFrame, capacity: int, vocabulary: str) -> tuple[DataFrame, np.ndarray, float, int]:
    """The pieces with ``centre`` and ``drawn``, by which they are ordered, and what all texts tell: idf by token, mean length, number."""
    spark = docs.sparkSession
    n_vocab = encoding(vocabulary).n_vocab
    wide = n_vocab > 65_536
    cut = materialise(pieces(docs, capacity, vocabulary).distinct())
    n, mean = cut.agg(F.count("*"), F.avg(F.col("token_end") - F.col("token_start"))).first()

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(n_vocab, np.int64)
        for b in batches:
            lists = _lists(b["tokens"], wide)
            pairs = np.unique(np.repeat(np.arange(len(lists)), [len(t) for t in lists]) * n_vocab + np.concatenate(lists)) if lists else np.zeros(0, np.int64)
            df += np.bincount(pairs % n_vocab, minlength=n_vocab)
        t = np.flatnonzero(df)
        yield pd.DataFrame({"token": t, "n": df[t]})

    # at most one row for each token of the tokenizer
    df = np.zeros(n_vocab)
    for r in cut.select("tokens").mapInPandas(held, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toLocalIterator():
        df[r["token"]] = r["n"]
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    shared_idf = spark.sparkContext.broadcast(idf)

    def projected(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"x": list(vectors(_lists(b["tokens"], wide), shared_idf.value)[0])})

    every = max(1, -(-n // SAMPLE))
    some = cut.where(F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(every)) == 0).select("tokens").mapInPandas(projected, "x array<float>").toPandas()
    shared = spark.sparkContext.broadcast((idf, centres(np.array(some["x"].tolist(), np.float32).reshape(-1, DIM)) if len(some) else np.zeros((1, DIM), np.float32)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idf, c = shared.value
        for b in batches:
            x, drawn = vectors(_lists(b["tokens"], wide), idf)
            yield b.assign(centre=(x @ c.T).argmax(1).astype("int32"), drawn=drawn)

    order = cut.mapInPandas(place, "doc_id long, piece_no int, token_start int, token_end int, tokens binary, centre int, drawn double")
    return order, idf, float(mean or 0), int(n)


def pack(docs: DataFrame, capacity: int, vocabulary: str = VOCABULARY, shard: int = SHARD) -> DataFrame:
    """``container_id, slot, doc_id, piece_no, token_start, token_end, n_tokens``: where every text goes."""
    order, idf, mean, n = placed(docs, capacity, vocabulary)
    wide = encoding(vocabulary).n_vocab > 65_536
    shared = docs.sparkSession.sparkContext.broadcast((idf, mean))
    columns = ["container_id", "slot", "doc_id", "piece_no", "token_start", "token_end", "n_tokens"]

    def packed(b: pd.DataFrame, first: int) -> tuple[pd.DataFrame, int]:
        b = b.sort_values(["doc_id", "piece_no"], ignore_index=True)
        got = fill(_lists(b["tokens"], wide), capacity, *shared.value)
        at = [(first + c, s, j) for c, js in enumerate(got) for s, j in enumerate(js)]
        cid, slot, row = map(list, zip(*at))
        out = b.loc[row, ["doc_id", "piece_no", "token_start", "token_end"]].reset_index(drop=True)
        out.insert(0, "container_id", cid)
        out.insert(1, "slot", slot)
        return out.assign(n_tokens=out["token_end"] - out["token_start"])[columns], first + len(got)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = TaskContext.get().partitionId() << 32
        held: list[pd.DataFrame] = []
        for b in batches:
            held.append(b)
            while sum(map(len, held)) >= 2 * shard:
                whole = pd.concat(held, ignore_index=True)
                held = [whole.iloc[shard:]]
                out, first = packed(whole.iloc[:shard], first)
                yield out
        rest = pd.concat(held, ignore_index=True) if held else pd.DataFrame()
        # what is left is one shard, or two of the same size
        half = len(rest) if len(rest) <= 1.5 * shard else -(-len(rest) // 2)
        for a in range(0, len(rest), max(half, 1)):
            out, first = packed(rest.iloc[a : a + half], first)
            yield out

    ranges = max(1, round(n / shard))
    key = ["centre", "drawn", "doc_id", "piece_no"]
    return order.repartitionByRange(ranges, *key).sortWithinPartitions(*key).mapInPandas(run, "container_id long, slot int, doc_id long, piece_no int, token_start int, token_end int, n_tokens int")
