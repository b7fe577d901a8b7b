"""Problem 4: cut items above a size limit into overlapping pieces at natural boundaries.

Method: dynamic programming over boundary positions. The cost of a cut is the penalty of its boundary (paragraph,
line, sentence, clause, word, anywhere), plus a small one if the next piece, which begins ``overlap`` before the cut,
begins inside a word, plus the squared deviation of the piece from the even size. Pieces hold at most ``max_size`` code
points and each shares exactly ``overlap`` code points with the piece before it. No cut and no beginning falls on a
combining mark or inside a joined sign, unless no chain of pieces does without.

The programme runs over the strongest boundaries first. A chain that uses a weaker one costs at least its penalty, so
as soon as a chain of strong ones costs no more than that, it is the best of all and weaker positions are not tried.

Items within the limit never leave the JVM; only longer ones go to Python, one Arrow batch at a time, and each is
cut on its own, so there is no shuffle and no group. Time is O(boundaries x boundaries per piece), vectorised.

Defined results: null and empty texts give no piece; a text of exactly ``max_size`` is one piece; a run without any
boundary is cut between characters.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("end", "paragraph", "line", "sentence", "clause", "word", "character")
PENALTY = {"end": 0.0, "paragraph": 0.0, "line": 0.25, "sentence": 0.4, "clause": 1.5, "word": 3.0, "character": 50.0}
#: Penalty of a piece that begins inside a word.
INSIDE = 0.3
#: Weight of the squared relative deviation from the even size.
BALANCE = 2.0

_WEIGHTS = np.array([PENALTY[k] for k in KINDS])
_SPACE = np.array(sorted(ord(c) for c in map(chr, range(0x3001)) if c.isspace()), np.uint32)
_STOPS, _CLAUSE, _CLOSERS = (np.array(sorted(map(ord, s)), np.uint32) for s in (".!?…·", ",;:—–", "\"'”’»)]"))
_TAGS = re.compile(r"</(?:(p|div|ul|ol|table|blockquote)|li|h\d|tr)>\s*")

SCHEMA = "piece_no int, n_pieces int, start int, end int, cut string, piece string"


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted positions after white space and closing tags, the end last, and the index in ``KINDS`` of each."""
    n = len(text)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = np.isin(c, _SPACE)
    at = np.flatnonzero(space[:-1] & ~space[1:]) + 1 if n else np.zeros(0, np.int64)  # first characters after white space
    i = np.arange(n)
    solid = np.maximum.accumulate(np.where(space, -1, i)) if n else i  # the last character that is no white space
    core = np.maximum.accumulate(np.where(space | np.isin(c, _CLOSERS), -1, i)) if n else i  # nor a closing mark
    breaks = np.concatenate([[0], np.cumsum(c == 10)])
    last, end = solid[at - 1], core[at - 1]
    lines = breaks[at] - breaks[np.maximum(last, 0)]
    stop = (end >= 0) & np.isin(c[np.maximum(end, 0)], _STOPS)
    clause = (last >= 0) & np.isin(c[np.maximum(last, 0)], _CLAUSE)
    kind = np.select([lines >= 2, lines == 1, stop, clause], [1, 2, 3, 4], 5)
    kind = np.where(last < 0, 5, kind)
    if "</" in text:
        tags = [(m.end(), 1 if m.group(1) else 2) for m in _TAGS.finditer(text) if m.end() < n]
        if tags:
            p, k = np.array(tags).T
            at, kind = np.concatenate([at, p]), np.concatenate([kind, k])
            order = np.lexsort((kind, at))
            at, kind = at[order], kind[order]
            first = np.r_[True, at[1:] != at[:-1]]
            at, kind = at[first], kind[first]
    return np.append(at, n).astype(np.int64), np.append(kind, 0).astype(np.int64)


def _whole(text: str) -> np.ndarray:
    """At which positions a piece may begin or end: not on a combining mark, a joiner, or after a joiner."""
    ok = np.ones(len(text) + 1, bool)
    if not text.isascii():
        for k, ch in enumerate(text):
            if ch > "˿" and (unicodedata.combining(ch) or unicodedata.category(ch) in ("Mn", "Me") or ch in "‍︎️" or "\U0001f3fb" <= ch <= "\U0001f3ff"):
                ok[k] = False
                if ch == "‍":
                    ok[k + 1] = False
    ok[0] = ok[len(text)] = True
    return ok


def _chain(pos: np.ndarray, kind: np.ndarray, extra: np.ndarray, n: int, max_size: int, overlap: int, even: float) -> tuple[float, list[tuple[int, int, str]]]:
    """The cheapest chain of pieces over the positions (the last is the end of the text), and its cost."""
    pen = np.concatenate([[0.0], _WEIGHTS[kind] + extra])
    pos = np.concatenate([[0], pos])
    kind = np.concatenate([[0], kind])
    start = np.where(pos == 0, 0, pos - overlap)
    cost = np.full(len(pos), np.inf)
    cost[0] = 0.0
    back = np.zeros(len(pos), np.int64)
    first = np.searchsorted(start, pos - max_size, side="left").tolist()  # earliest i whose piece still fits
    end = len(pos) - 1
    for j in range(int(np.searchsorted(pos, overlap, side="right")), len(pos)):  # a cut before that could not share the whole overlap
        i = first[j]
        if i >= j:
            continue
        c = cost[i:j] + BALANCE * ((pos[j] - start[i:j] - even) / max_size) ** 2
        k = int(c.argmin())
        cost[j], back[j] = c[k] + pen[j], i + k
    if cost[end] == np.inf:
        return np.inf, []
    out, j = [], end
    while j:
        out.append((int(start[back[j]]), int(pos[j]), KINDS[kind[j]]))
        j = int(back[j])
    return float(cost[end]), out[::-1]


def cut(text: str, max_size: int, overlap: int) -> list[tuple[int, int, str]]:
    """``(start, end, boundary at the end)`` of the pieces of ``text``."""
    if not 0 <= overlap < max_size:
        raise ValueError(f"the overlap ({overlap}) must be less than the maximum size ({max_size})")
    n = len(text)
    if n <= max_size:
        return [(0, n, "end")] if n else []
    step = max_size - overlap
    pieces = -(-(n - overlap) // step)
    even = (n + (pieces - 1) * overlap) / pieces
    pos, kind = boundaries(text)
    whole = _whole(text)
    wordly = np.zeros(n + 1, bool)
    wordly[pos] = wordly[0] = True

    def tried(pos: np.ndarray, kind: np.ndarray, strict: int = 2) -> tuple[float, list[tuple[int, int, str]]]:
        begins = np.maximum(pos - overlap, 0)
        keep = (whole[pos] | (strict < 1)) & (whole[begins] | (strict < 2)) | (pos == n)
        keep &= (pos > overlap) | (pos == n)
        pos, kind, begins = pos[keep], kind[keep], begins[keep]
        extra = np.where(wordly[begins] | (pos == n) | (overlap == 0), 0.0, INSIDE)
        return _chain(pos, kind, extra, n, max_size, overlap, even)

    for weakest, next_penalty in ((3, PENALTY["clause"]), (4, PENALTY["word"]), (5, PENALTY["character"])):
        keep = kind <= weakest
        best, chain = tried(pos[keep], kind[keep])
        if best <= next_penalty:
            return chain
    # positions in the middle of words: some of each long run first, then every one, at last also those on marks,
    # for pieces to begin at, as where every sign is two characters long and the overlap is odd, and to end at
    for stride, strict in ((max(1, step // 8), 2), (1, 2), (1, 1), (1, 0)):
        more = np.setdiff1d(np.arange(stride, n, stride), pos) if stride > 1 else np.setdiff1d(np.arange(1, n), pos)
        if stride > 1:
            more = np.setdiff1d(np.concatenate([more + k for k in range(4)]), pos)  # and their neighbours, for those on marks
            more = more[more < n]
        at, k = np.concatenate([pos, more]), np.concatenate([kind, np.full(len(more), KINDS.index("character"))])
        order = np.argsort(at, kind="stable")
        found, other = tried(at[order], k[order], strict)
        if found < best:
            best, chain = found, other
        if best < np.inf:
            return chain
    raise AssertionError("every position was tried")


def split_long(df: DataFrame, text: str, max_size: int, overlap: int, keys: list[str]) -> DataFrame:
    """``keys`` and the pieces of each row's ``text``; rows within the limit are one piece, made in the JVM."""
    rows = df.select(*keys, F.col(text).alias("_text")).where(F.length("_text") > 0)
    short = rows.where(F.length("_text") <= max_size).select(*keys, F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start"), F.length("_text").alias("end"), F.lit("end").alias("cut"), F.col("_text").alias("piece"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(*r[:-1], k, len(ps), s, e, c, r[-1][s:e]) for r in b.itertuples(index=False, name=None) for ps in [cut(r[-1], max_size, overlap)] for k, (s, e, c) in enumerate(ps)]
            yield pd.DataFrame(got, columns=[*b.columns[:-1], "piece_no", "n_pieces", "start", "end", "cut", "piece"])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    cut_rows = rows.where(F.length("_text") > max_size).mapInPandas(run, f"{types}, {SCHEMA}")
    return short.unionByName(cut_rows)
