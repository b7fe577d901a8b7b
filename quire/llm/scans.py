"""Problem 1: repair text of scanned pages and tell which kinds of noise it holds.

Method: running headers and page numbers are labelled by a dynamic programme over the lines; the lines that are left
form one character stream, which is decoded jointly into words by Viterbi, allowing confused characters, hyphens at
line ends, words run together and words torn apart, any of them in one word; paragraph boundaries are chosen by a
second dynamic programme. Where bounds show that reading token by token is the best path, no other is searched.

The language model is the corpus' own word counts. They are counted over *all* blocks with a partial aggregate before
the one shuffle. Words score by their share of all words, so that decisions do not change with the number of blocks.
The lexicon keeps the words that make up at least ``MIN_SHARE`` of all words, the share at which a word scores no more
than an unknown one. Shares sum to one, so it has at most 1 / MIN_SHARE (13 million) entries. Decoding is one Arrow scan.

Misread words recur in a large corpus, so being in the lexicon proves nothing: a word gives way to one that it may be
misread from when that one is so much more frequent that the confusion explains it better.

Defined results: null texts have no noise and stay null; an empty text stays empty; blocks that are no paragraphs are
not read; very long texts are decoded whole, in time proportional to their length.
"""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import materialise

TYPES = ("hyphenation", "characters", "header", "page_number")
MIN_COUNT = 4

#: Signs that a scan puts at the end of a line for a hyphen.
HYPHENS = "-¬­‐‑="
#: What is read -> what may be printed. Signs that no word holds cost less than letters for letters.
SIGNS = {"6": "b", "0": "o", "1": "li", "!": "il", "9": "g", "$": "s", "5": "s", "†": "t", "‡": "t", "ɑ": "a", "ſ": "sf", "ç": "c", "ÿ": "y", "|": "li", "@": "a", "3": "e", "4": "a", "8": "b", "¢": "c", "£": "f", "€": "e", "ñ": "n", "ï": "i", "ì": "i", "í": "i", "ö": "o", "ü": "u", "è": "e", "é": "e", "ê": "e", "à": "a", "â": "a", "û": "u", "ô": "o", "ﬁ": ("fi",), "ﬂ": ("fl",), "ﬀ": ("ff",), "ﬃ": ("ffi",), "ﬄ": ("ffl",), "ﬅ": ("st",), "ﬆ": ("st",), "¡": "i", "ı": "i", "ĸ": "k", "7": "t", "2": "z", "°": "o", "©": "c", "®": "r", "§": "s", "µ": "u", "ß": "b", "]": "jl", "[": "l", "<": "c", "(": "c", "{": "f", "«": "c", "*": "s", "^": "n", "~": "n", "œ": ("oe",), "æ": ("ae",)}
LETTERS = {"c": "eo", "b": "h", "h": "b", "e": "c", "rn": "m", "m": ("rn", "in", "ni"), "ri": "n", "n": ("ri", "u"), "ii": "un", "u": ("ii", "n"), "cl": "d", "d": ("cl",), "vv": "w", "w": ("vv",), "li": "hu", "h ": "", "in": "m", "ni": "m", "nn": ("rm",), "i": "lj", "l": "it", "t": "lf", "f": "ts", "o": "ce", "a": "o", "s": "f", "v": "y", "y": "v", "q": "g", "g": "q", "r": "t", "ti": "n", "lc": "k", "tli": ("th",), "iu": ("in",), "ln": ("in",), "j": "i", "k": ("lc",), "z": "s", "il": "u", "iii": "m", "fl": ("fi",), "fi": ("fl",)}
SIGN_COST, LETTER_COST, EDITS = 2.2, 3.3, 3
MERGE_COST, SPLIT_COST, HYPHEN_COST, COMPOUND_COST = 8.0, 6.0, 1.0, 6.0
UNKNOWN, UNKNOWN_LETTER = -16.4, 3.26  # log share of a word that the lexicon lacks: five random letters; by so much less for each further letter where words may be run together or torn
TORN = 8  # the most pieces of one torn word
MIN_SHARE = math.exp(UNKNOWN)  # a rarer word scores as one that the lexicon lacks, so leaving it out changes no score
_CUTS = "\x01\x02"  # hyphens at line ends in the stream: hyphens, and signs read for one
_GAPS = " " + _CUTS
#: Words of one letter that may stand beside a dropped space.
_SINGLE = frozenset("aio")

_EDGE = ".,;:?\"“”‘’„«»()[]{}—–'…"
_ROMAN = r"(?=[ivxlcdm])m{0,3}(?:c[md]|d?c{0,3})(?:x[cl]|l?x{0,3})(?:i[xv]|v?i{0,3})"
_NUMBER = re.compile(rf"^\W*(?:page|pag|pg|p|s|fol|f)?\W*(?:\d{{1,4}}|{_ROMAN})\W*$", re.I)
_CHAPTER = re.compile(rf"[|,;]?\s*\[?\s*\b(?:chap|ch|chapter|cap|book|bk|part|vol|lib)\b\.?\s*(?:\d+|{_ROMAN})\b\.?\s*\]?\s*[.—–:-]*", re.I)
_PAGE_IN = re.compile(r"^\W*(\d{1,4})\b(?!\s*(?:st|nd|rd|th)\b)|\b(\d{1,4})\W*$")
_SMALL = frozenset("of the on in and to a an for against from with at by de la et du von der und y el".split())


# --- corpus statistics --------------------------------------------------------------------------------------------


def word_counts(blocks: DataFrame, text: str = "text") -> DataFrame:
    """``word, n`` over all texts; parts of words at line ends are left out."""
    h = re.escape(HYPHENS)
    low = F.lower(F.col(text))
    t = F.when(low.contains("\n"), F.regexp_replace(low, rf"(?<!\S)\S++(?<=\S[{h}])[ \t]*\n\s*\S+", " ")).otherwise(low)
    raw = blocks.select(F.explode(F.split(t, r"[—–\s]+")).alias("w")).groupBy("w").agg(F.count("*").alias("k"))
    # outer marks are taken off the distinct tokens, not off every occurrence
    e = re.escape(_EDGE)
    words = raw.select(F.regexp_replace("w", rf"^[{e}]+|[{e}!]+$", "").alias("word"), "k").where((F.length("word") > 0) & ~F.col("word").rlike(r"^\d+$"))
    return words.groupBy("word").agg(F.sum("k").alias("n"))


def lexicon(blocks: DataFrame, text: str = "text") -> dict[str, float]:
    """Log counts of the words that make up at least MIN_SHARE of the corpus (so at most 1 / MIN_SHARE entries)."""
    counts = materialise(word_counts(blocks, text))  # read twice: for the total, and for the words
    total = counts.agg(F.sum("n")).first()[0] or 0
    kept = counts.where((F.col("n") >= MIN_SHARE * total) & (F.col("n") >= MIN_COUNT)).toPandas()
    return {w: math.log(n) for w, n in zip(kept["word"].tolist(), kept["n"].tolist())}


# --- lines: body, header, page number ------------------------------------------------------------------------------


def _spaced(s: str) -> str:
    """``T H E   L A M P`` as ``THE LAMP``."""
    if re.match(r"^\W*(?:\w\W? ){3,}\w\W*$|^[\d\W]*(?:\w ){2,}\w(?: {2,}|$)", s):
        return re.sub(r"(?<=\b[^\W\d_]) (?=[^\W\d_]\b)", "", re.sub(r" {2,}", "\t", s)).replace("\t", " ")
    return s


def line_costs(line: str, before: str, after: str, first: bool, last: bool) -> tuple[float, float, float, float]:
    """Costs of a line as body, header, page number, header with page number. ``before`` and ``after`` are the nearest lines with letters."""
    s = line.strip()
    if _NUMBER.match(s):
        return (6.0, 9.0, 0.0, 9.0)
    spaced = _spaced(s)
    letterspaced = spaced != s
    core = _CHAPTER.sub(" ", spaced)
    page = _PAGE_IN.search(re.sub(r"^\W+|\W+$", "", core)) if re.search(r"\d", core) else None
    words = re.findall(r"[^\W\d_]+", core)
    chapter = bool(_CHAPTER.search(spaced)) and len(words) <= 9 and len(s) < 70
    if not words and not chapter:
        return (1.0, 6.0, 9.0, 9.0)
    letters = "".join(words)
    caps = bool(letters) and letters.upper() == letters and len(letters) >= 4
    title = bool(words) and len(words) <= 8 and words[0][0].isupper() and all(w[0].isupper() or w.lower() in _SMALL for w in words) and sum(w[0].isupper() for w in words) >= 2
    if len(words) > 10 or len(s) > 90 and not letterspaced:
        return (0.0, 12.0, 12.0, 12.0)
    # the body runs on over the line: what stands before has no end, and what comes after continues in lower case
    runs_on = bool(after) and after.lstrip()[:1].islower() and not (before.rstrip()[-1:] in ".!?" and before)
    hyphen = bool(before) and before.rstrip()[-1:] in HYPHENS
    cost = 5.0
    if caps or letterspaced:
        cost -= 7.0
    elif chapter:
        cost -= 6.0 if len(words) <= 1 or title else 2.0
    elif title:
        cost -= 5.5 if not re.search(r"[,;!?]", core) else 0.0
    cost -= 2.5 if runs_on and s[:1].isupper() else 0.0
    cost -= 2.0 if hyphen and after and after.lstrip()[:1].islower() and (caps or title or chapter) else 0.0
    cost -= 0.8 if first or last else 0.0
    if re.search(r"[a-z]{2,}[,;:!?]\s|\b(?:is|was|and the|that|which|who)\b", core) and not caps and not letterspaced:
        cost += 4.0
    return (0.0, cost + (9.0 if page else 0.0), 12.0, cost if page else 12.0)


def label_lines(lines: list[str]) -> list[str]:
    """``B``, ``H``, ``P``, ``HP`` or ``Z`` (blank) of each line, by dynamic programming.

    Headers and page numbers come in one group between stretches of body, so entering a group costs something.
    """
    n = len(lines)
    names = ("B", "H", "P", "HP")
    live = [i for i in range(n) if lines[i].strip()]
    if len(live) <= 1:
        if live and _NUMBER.match(lines[live[0]].strip()):
            return ["P" if i == live[0] else "Z" for i in range(n)]
        return ["B" if i in live else "Z" for i in range(n)]
    body_like = [i for i in live if not _NUMBER.match(lines[i].strip()) and _spaced(lines[i].strip()) == lines[i].strip() and re.search(r"[a-z]", lines[i])]
    score = [[0.0] * 4]
    back: list[list[int]] = []
    for k, i in enumerate(live):
        at = bisect.bisect_left(body_like, i)
        before = lines[body_like[at - 1]] if at else ""
        nxt = at + (at < len(body_like) and body_like[at] == i)
        after = lines[body_like[nxt]] if nxt < len(body_like) else ""
        c = line_costs(lines[i], before, after, k == 0, k == len(live) - 1)
        row, bk = [], []
        for y in range(4):
            opts = [score[-1][x] + (0.7 if k and x == 0 and y != 0 else 0.0) + (1.5 if x == y and y in (1, 2) else 0.0) for x in range(4)]
            b = min(range(4), key=opts.__getitem__)
            row.append(opts[b] + c[y])
            bk.append(b)
        score.append(row)
        back.append(bk)
    y = min(range(4), key=score[-1].__getitem__)
    out = ["Z"] * n
    for k in range(len(live) - 1, -1, -1):
        out[live[k]] = names[y]
        y = back[k][y]
    return out


# --- words ---------------------------------------------------------------------------------------------------------


class Decoder:
    """Readings of words and of stretches of the stream against the lexicon; what a worker has read once it remembers."""

    def __init__(self, lex: dict[str, float]):
        total = math.log(sum(map(math.exp, lex.values()))) if lex else 0.0
        self.lex = {w: v - total for w, v in lex.items()}  # log shares of all words
        self.words = sorted(self.lex)
        self.top = max(self.lex.values(), default=UNKNOWN)
        self.best_from = [UNKNOWN] * 42  # the greatest log share of a word of at least so many characters
        for w, v in self.lex.items():
            k = min(len(w), 41)
            self.best_from[k] = max(self.best_from[k], v)
        for k in range(40, -1, -1):
            self.best_from[k] = max(self.best_from[k], self.best_from[k + 1])
        self.rules = [(a, b, SIGN_COST) for a, bs in SIGNS.items() for b in bs] + [(a, b, LETTER_COST) for a, bs in LETTERS.items() for b in bs]
        self.by_first: dict[str, list[tuple[str, str, float]]] = {}
        for r in self.rules:
            self.by_first.setdefault(r[0][0], []).append(r)
        # the least that a joined word of so many characters can cost, whatever is misread in it
        self.joined = np.array([max(self.best_from[max(0, min(n, 41) - 2 * e)] - e * SIGN_COST for e in range(EDITS + 1)) for n in range(42)])
        self.known: dict[str, tuple[float, str, bool]] = {}
        self.forget()
        self.paths: dict[tuple[str, ...], list[tuple]] = {}

    def word(self, w: str) -> tuple[float, str, bool]:
        """Score, reading and whether a character was misread, of a lower-case word without its outer marks."""
        got = self.known.get(w)
        if got is None:
            got = self._word(w)
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[w] = got
        return got

    def _word(self, w: str) -> tuple[float, str, bool]:
        own = max(self.lex.get(w, UNKNOWN), UNKNOWN)
        if len(w) == 1 and not (w in SIGNS and w.isalpha()) or w.isdigit():
            return (own, w, False)
        if w in self.lex and "-" in w and all(p in self.lex for p in w.split("-")):
            return (own, w, False)
        odd = any(c in SIGNS and not (c.isalpha() and w in self.lex) for c in w)
        if w not in self.lex and not odd and "-" in w and all(len(p) > 1 for p in w.split("-")):
            parts = [self.word(p) for p in w.split("-")]
            return (min(p[0] for p in parts), "-".join(p[1] for p in parts), any(p[2] for p in parts))
        got = self.walk(w, 0, own, True).get(len(w))
        return got[:3] if got and got[2] and got[0] > own else (own, w, False)

    def _begins(self, out: str) -> bool:
        at = bisect.bisect_left(self.words, out)
        return at < len(self.words) and self.words[at].startswith(out)

    def walk(self, s: str, start: int, floor: float, whole: bool = False) -> dict[int, tuple[float, str, bool, bool]]:
        """Words of the lexicon that the stream may hold from ``start``: for each end the best score, the word, and whether a character was misread and a hyphen taken out.

        Characters may be confused, a space inside the word (MERGE_COST) or a hyphen at a line end is passed over, and
        unless ``whole`` the word may end inside a token (SPLIT_COST). Only beginnings of words of the lexicon are
        followed, and none whose best end would not beat ``floor``.
        """
        found: dict[int, tuple[float, str, bool, bool]] = {}
        n = len(s)
        todo: list[tuple[int, str, float, float, int, bool]] = [(start, "", 0.0, 0.0, 0, False)]
        best: dict[tuple[int, str, int, bool], float] = {}
        while todo:
            i, out, cost, misread, edits, cut = todo.pop()
            if self.top - cost <= floor or best.get((i, out, edits, cut), math.inf) <= cost:
                continue
            best[i, out, edits, cut] = cost
            end = i == n or s[i] in _GAPS
            if i > start and out and s[i - 1] not in _GAPS and (i == n or not whole and (s[i] == " " or not end)):
                v = self.lex.get(out)
                # beside a dropped space: nearly any ending can be misread into a word of one or two letters
                fair = not edits and (len(out) > 1 or out in _SINGLE) or len(out) > 2 or end and (start == 0 or s[start - 1] in _GAPS)
                if v is not None and fair:
                    v -= cost if end else cost + SPLIT_COST
                    if i not in found or v > found[i][0]:
                        found[i] = (v, out, edits > 0, cut)
            if i == n:
                continue
            c = s[i]
            if c == " ":
                todo.append((i + 1, out, cost + MERGE_COST, misread, edits, cut))
                continue
            if end:
                todo.append((i + 1, out, cost + HYPHEN_COST, misread, edits, True))
                if self._begins(out + "-"):
                    todo.append((i + 1, out + "-", cost, misread, edits, cut))
                continue
            sign = c in SIGNS and not (c.isalpha() and ord(c) < 128)
            if (not sign or c.isalpha() and ord(c) < 0x17F and c not in "ſÿ") and self._begins(out + c):
                todo.append((i + 1, out + c, cost, misread, edits, cut))
            if edits < EDITS + (sign and edits < 6):
                for a, b, k in self.by_first.get(c, ()):
                    if s.startswith(a, i) and (k == SIGN_COST or misread < 2 * LETTER_COST) and self._begins(out + b):
                        todo.append((i + len(a), out + b, cost + k, misread + k, edits + 1, cut))
        return found

    def unit(self, u: str) -> tuple[float, str, bool, bool]:
        """Score, reading, misread, hyphen taken out, of one token or of two about a hyphen at a line end, read by itself."""
        k = next((i for i, c in enumerate(u) if c in _CUTS), -1)
        if k < 0:
            score, reading, bad = self.word(u)
            kind = ""
        else:
            kind, reading, bad = self.broken(u[:k], u[k + 1 :], "-" if u[k] == _CUTS[0] else "=")
            score = max(self.lex.get(reading, UNKNOWN), self.word(u[:k] + u[k + 1 :])[0]) if kind == "hyphenation" or reading in self.lex else min(self.word(x)[0] for x in reading.split("-"))
        if score <= UNKNOWN:
            score = UNKNOWN - UNKNOWN_LETTER * max(0, len(u) - 5)
        return (score, reading, bad, kind == "hyphenation")

    def forget(self) -> None:
        """Drops the tokens read so far; only between texts, whose tokens are held by number."""
        self.ids: dict[str, int] = {}
        self.parts: list[tuple[str, str, str, str]] = []  # marks before, the word, marks after, its key
        self.shown: list[str] = []  # the token repaired by itself
        self.numbers = np.zeros((1024, 2))  # score, characters
        self.flags = np.zeros((1024, 7), bool)  # plain, marks before, after, first letter a capital, all capitals, misread, hyphen taken out

    def number(self, tok: str) -> int:
        """The number of a token, or of two about a hyphen at a line end (parted by a line end), read by itself once."""
        k = self.ids.get(tok)
        if k is None:
            k = self.ids[tok] = len(self.parts)
            if k >= len(self.numbers):
                self.numbers = np.concatenate([self.numbers, np.zeros_like(self.numbers)])
                self.flags = np.concatenate([self.flags, np.zeros_like(self.flags)])
            w, _, nxt = tok.partition("\n")
            if nxt:
                pre, a, _ = _core(w[:-1].rstrip(HYPHENS))
                _, b, post = _core(nxt)
                mark = _CUTS[0] if w[-1] in "-‐‑" else _CUTS[1]
                core, low = a + mark + b, a.lower() + mark + b.lower()
            else:
                pre, core, post = _core(w)
                low = core.lower()
            score, reading, bad, cut = self.unit(low) if low else (0.0, low, False, False)
            shown = core
            if bad or nxt:
                shown = _case(core, reading) if bad or core.lower() != reading else core
            self.parts.append((pre, core, post, low))
            self.shown.append(pre + shown + post)
            plain = bool(low) and len(low) == len(core) and len(low) <= 40 and any(x.isalpha() for x in low)
            self.numbers[k] = score, len(low)
            self.flags[k] = plain, bool(pre), bool(post), bool(core) and core[0].isupper(), bool(core) and core.isupper(), bad, cut
        return k

    def doubtful(self, scores: np.ndarray, chars: np.ndarray, run: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of units in which words run together or torn apart might beat the units read one by one.

        ``run``: the number of the run of plain units that a unit is in, -1 for none; no stretch leaves its run. The
        bounds are admissible: outside the stretches no such path can be the best one.
        """
        n = len(scores)
        inside = run >= 0
        c, size = np.concatenate([[0.0], np.cumsum(scores)]), np.concatenate([[0], np.cumsum(chars)]).astype(np.int64)
        reach = np.where(inside & (2 * self.top - SPLIT_COST > scores), 1, 0)  # how many units a stretch from here holds
        alive = inside.copy()
        for m in range(1, min(TORN, n)):
            total, long = c[m + 1 :] - c[: -m - 1], size[m + 1 :] - size[: -m - 1]
            ok = alive[: n - m] & (run[m:] == run[: n - m]) & (long <= 40)
            if not ok.any():
                break
            joined = np.where(total < self.top - MERGE_COST * m, self.joined[np.minimum(long, 41)], -np.inf)
            won = joined - MERGE_COST * m > total
            if m == 1:
                won |= 2 * self.top - MERGE_COST - SPLIT_COST > total
            reach[: n - m][ok & won] = m + 1
            alive = np.zeros(n, bool)
            alive[: n - m] = ok & (won | (m < 2))
        out: list[tuple[int, int]] = []
        for i in np.flatnonzero(reach).tolist():
            j = i + int(reach[i])
            if out and i < out[-1][1]:
                out[-1] = (out[-1][0], max(j, out[-1][1]))
            else:
                out.append((i, j))
        return out

    def path(self, units: list[str]) -> list[tuple[int, int, str, bool, bool]]:
        """The best segmentation of a stretch: ``start, end, reading, misread, hyphen taken out`` over the characters of the joined units.

        Viterbi over the character positions; edges are units as they stand and all words that ``walk`` reads.
        """
        key = tuple(units)
        got = self.paths.get(key)
        if got is None:
            if len(self.paths) > 200_000:
                self.paths.clear()
            got = self.paths[key] = self._path(units)
        return got

    def _path(self, units: list[str]) -> list[tuple[int, int, str, bool, bool]]:
        s = " ".join(units)
        n = len(s)
        ends: dict[int, tuple[int, tuple[float, str, bool, bool]]] = {}
        at = 0
        for u in units:
            ends[at] = (at + len(u), self.unit(u))
            at += len(u) + 1
        starts = sorted(ends)
        score: dict[int, float] = {0: 0.0}
        back: dict[int, tuple[int, int, str, bool, bool]] = {}

        def reach(p: int, q: int, v: float, w: str, bad: bool, cut: bool) -> None:
            to = q + 1 if q < n and s[q] == " " else q
            if to not in score or v > score[to]:
                score[to], back[to] = v, (p, q, w, bad, cut)

        for p in range(n):
            if p not in score:
                continue
            if p in ends:
                q, (v, w, bad, cut) = ends[p]
                reach(p, q, score[p] + v, w, bad, cut)
            # no word is worth more than the units that it may replace
            first = starts[bisect.bisect_right(starts, p) - 1]
            own = sum(ends[a][1][0] for a in starts if first <= a <= first + 80)
            for q, (v, w, bad, cut) in self.walk(s, p, own).items():
                if p not in ends or ends[p][0] != q:
                    reach(p, q, score[p] + v, w, bad, cut)
        out = []
        p = n
        while p > 0:
            out.append(back[p])
            p = back[p][0]
        return out[::-1]

    def broken(self, a: str, b: str, sign: str) -> tuple[str, str, bool]:
        """A word of two parts about a line end: ``(kind, reading, misread)``; kind is hyphenation, compound or two words."""
        ja, jb = self.word(a + b), self.word(f"{a}-{b}")
        none = -math.inf
        comp = self.lex.get(f"{a}-{b}", none)
        if not jb[2]:
            jb = (comp, f"{a}-{b}", False)
        elif jb[1] not in self.lex:
            jb = (none, f"{a}-{b}", False)
        wa, wb = self.word(a), self.word(b)
        both = min(wa[0], wb[0]) - COMPOUND_COST if not (wa[2] or wb[2]) and a in self.lex and b in self.lex and len(a) > 1 and len(b) > 1 else none
        joined = ja[0] - HYPHEN_COST
        if jb[0] >= joined and jb[0] > none:
            return ("compound", jb[1], jb[2])
        if ja[0] == UNKNOWN and both > joined and sign in "-‐‑":
            return ("compound", f"{wa[1]}-{wb[1]}", wa[2] or wb[2])
        return ("hyphenation", ja[1], ja[2])


_TOKEN = re.compile(r"\S+")
_DASH = re.compile(r"([—–]+)")


def _case(like: str, w: str) -> str:
    letters = [c for c in like if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return w.upper()
    return w[:1].upper() + w[1:] if letters and letters[0].isupper() and like[:1] == letters[0] else w


def _core(tok: str) -> tuple[str, str, str]:
    """Outer marks before, the word, outer marks after."""
    a = len(tok) - len(tok.lstrip(_EDGE))
    rest = tok[a:].rstrip(_EDGE + "!" if len(tok) > 1 else _EDGE)
    return tok[:a], rest, tok[a + len(rest) :]


def decode(text: str, dec: Decoder) -> tuple[str, set[str]]:
    """The repaired text (paragraphs parted by blank lines) and the kinds of noise found in it."""
    noise: set[str] = set()
    if "\n" in text:
        lines = text.split("\n")
        labels = label_lines(lines)
    else:
        lines, labels = [text], ["B" if text.strip() else "Z"]
    for y in labels:
        if y in ("H", "HP"):
            noise.add("header")
        if y in ("P", "HP"):
            noise.add("page_number")
    body = [lines[i] for i, y in enumerate(labels) if y == "B"]
    gaps = _paragraphs(lines, labels) if len(lines) > 1 else [False] * len(body)
    words: list[str] = []
    ends: set[int] = set()  # words after which a line ends with a hyphen
    breaks: set[int] = set()
    for k, line in enumerate(body):
        toks = line.split()
        if "—" in line or "–" in line:
            toks = [part for tok in toks for part in _DASH.split(tok) if part]
        words += toks
        if words and words[-1][-1] in HYPHENS and len(words[-1]) > 1 and k + 1 < len(body) and words[-1][-2].isalnum() | (words[-1][-2] in SIGNS):
            ends.add(len(words) - 1)
        if gaps[k]:
            breaks.add(len(words))
    # the stream: units, each a token or two about a hyphen at a line end
    if len(dec.ids) > 300_000:
        dec.forget()
    if ends:
        units, at, i = [], [], 0
        while i < len(words):
            two = i in ends and i + 1 < len(words) and bool(_core(words[i][:-1].rstrip(HYPHENS))[1]) and bool(_core(words[i + 1])[1])
            units.append(dec.number(f"{words[i]}\n{words[i + 1]}" if two else words[i]))
            at.append(i)
            i += 1 + two
    else:
        units, at = [dec.number(w) for w in words], range(len(words))
    if not units:
        return "", noise
    ids = np.array(units, np.int64)
    flags = dec.flags[ids]
    plain, pre, post, capital, capitals, bad, cut = flags.T
    # inside a torn word there is neither a mark nor a capital after a small letter, and no paragraph ends
    on = plain[1:] & plain[:-1] & ~post[:-1] & ~pre[1:] & (~capital[1:] | capitals[:-1] & capitals[1:])
    if breaks:
        on &= ~np.isin(np.asarray(at)[1:], sorted(breaks))
    run = np.where(plain, np.cumsum(np.concatenate([[True], ~on])), -1)
    scores, chars = dec.numbers[ids].T
    out: list[str] = []
    where: list[int] = []
    alone = np.ones(len(ids), bool)
    done = 0
    for x, y in dec.doubtful(scores, chars, run):
        out += [dec.shown[u] for u in units[done:x]]
        where += at[done:x]
        alone[x:y] = False
        done = y
        part = [dec.parts[u] for u in units[x:y]]
        stream, like = dec.path([u[3] for u in part]), " ".join(u[1] for u in part)
        first, spans = 0, []  # where each unit begins and ends in the stream
        for k, u in enumerate(part):
            spans.append((first, first + len(u[1]), x + k))
            first += len(u[1]) + 1
        for p, q, reading, misread, taken in stream:
            a, k = next((a, k) for a, e, k in spans if a <= p < e)
            e, v = next((e, k) for _, e, k in spans if q <= e)
            where.append(at[k])
            if (a, e) == (p, q) and k == v:
                out.append(dec.shown[units[k]])
                alone[k] = True
                continue
            if taken:
                noise.add("hyphenation")
            if misread:
                noise.add("characters")
            shown = re.sub(f"[{_GAPS}]", "", like[p:q])
            out.append((dec.parts[units[k]][0] if a == p else "") + (_case(shown, reading) if misread or shown.lower() != reading else shown) + (dec.parts[units[v]][2] if e == q else ""))
    out += [dec.shown[u] for u in units[done:]]
    where += at[done:]
    if (alone & bad).any():
        noise.add("characters")
    if (alone & cut).any():
        noise.add("hyphenation")
    if not breaks:
        return " ".join(out), noise
    text_out: list[str] = []
    for w, here in zip(out, where):
        if text_out:
            text_out.append("\n\n" if any(here >= x > prev for x in breaks) else " ")
        text_out.append(w)
        prev = here
    return "".join(text_out), noise


def _paragraphs(lines: list[str], labels: list[str]) -> list[bool]:
    """After which body line a paragraph ends, by dynamic programming over the gaps between body lines."""
    at = [i for i, y in enumerate(labels) if y == "B"]
    if not at:
        return []
    width = max(len(lines[i].rstrip()) for i in at)
    cost = []  # cost of ending a paragraph minus cost of going on, per gap
    for a, b in zip(at, at[1:]):
        s, t = lines[a].rstrip(), lines[b].lstrip()
        furniture = any(labels[k] in ("H", "P", "HP") for k in range(a + 1, b))
        c = 2.0
        c -= 4.0 if b > a + 1 and not furniture else 0.0
        c += 5.0 if not s or s[-1] not in ".!?\"”’»" else 0.0
        c += 4.0 if t[:1].islower() else 0.0
        c -= 1.5 if len(s) < 0.7 * width and s[-1:] in ".!?\"”" else 0.0
        c -= 1.0 if lines[b][:1] in " \t" else 0.0
        cost.append(c)
    # two states per gap; two ends in a row make a paragraph of one line, which is dear unless it is short
    go, end = 0.0, 0.0
    back: list[tuple[int, int]] = []
    for k, c in enumerate(cost):
        lone = 1.0 if len(lines[at[k]].rstrip()) > 0.7 * width else 0.3
        g = min((go, 0), (end, 1))
        e = min((go, 0), (end + lone, 1))
        back.append((g[1], e[1]))
        go, end = g[0], e[0] + c
    out, y = [], int(end < go)
    for g, e in reversed(back):
        out.append(bool(y))
        y = e if y else g
    return [*out[::-1], False]


def find(batches: Iterator[pd.DataFrame], shared) -> Iterator[pd.DataFrame]:
    """block_id, text -> block_id, noise_type."""
    dec = Decoder(shared.value)
    for b in batches:
        rows = [(i, k) for i, t in zip(b["block_id"], b["text"]) for k in sorted(decode(t, dec)[1])]
        yield pd.DataFrame(rows, columns=["block_id", "noise_type"])


def repair(batches: Iterator[pd.DataFrame], shared) -> Iterator[pd.DataFrame]:
    """block_id, text -> block_id, repaired, noise (comma-separated kinds)."""
    dec = Decoder(shared.value)
    for b in batches:
        got = [(None, None) if t is None else decode(t, dec) for t in b["text"]]
        yield pd.DataFrame({"block_id": b["block_id"], "repaired": [g[0] for g in got], "noise": [None if g[1] is None else ",".join(sorted(g[1])) for g in got]})
