"""Problem 6: prompt and response pairs, each sound or with the one defect of its response.

Method: a conditional random field tags the clauses of a response (long ones in pieces, all words of them) as answer,
refusal, echo, foreign, unfinished or neither; the coverage of the tags gives the defect of the pair. It is trained once
per process from the small labelled table of ``pair_examples``. No rule overrides a tag.

Signs of a clause beside its words: how far the message holds it (echo), whether it is in a language that the message
does not use (the model of ``langid``), and whether it ends like a sentence. The last needs the corpus: of every
run of one to five words, how often it occurs and how often it stands before a final mark, over *all* responses.
Runs are counted under 64-bit hashes (two of a billion runs meet with a chance of one in 10^10 for each lookup);
only the distinct last words of replies without a final mark look theirs up.

Plan: three scans (counts; last words; tagging); the shuffles are of partial counts, of distinct last words, and of
the rows to their counts. No group is collected. Equal clauses of a worker are parsed once.

Defined results: a null, blank or content-free response is ``empty``; a null message has no words, so nothing echoes
it and no language is foreign to it; repeated rows give repeated results.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import langid
from quire.llm.crf import CRF
from quire.llm.pair_examples import table

TAGS = ("A", "R", "E", "F", "U", "N")
FEATURES, SLOTS = 1 << 16, 44
KEEN = 2.0  # occurrences that the rate of a shorter run counts for
READ = 14  # words of a clause that are read in one piece

_CLAUSE = re.compile(r"(?<=[.!?…])[\"'”’»)]*\s+|\s*\n+\s*")
_J = "and|or|so|but|yet|because|though|although|while|however|hynrei|bad|mais|et|car|pero|y|porque|aber|und|denn|sed|quia"
_INNER = re.compile(rf"(?<=[,;:])\s+|\s+(?=(?:{_J})\s)", re.I)
_JOINS = frozenset(_J.split("|"))
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_MARKER = re.compile(r"^\s*(?:\(?(?:\d{1,3}|[a-zA-Z])[.)]|[-•*–])\s*(?=\S|$)")
_TAGS = re.compile(r"<[^>]{0,60}>|&[a-z]+;")
#: What stands for nothing.
NOTHING = frozenset("null none nil na n a nan undefined empty no reply no answer no response blank tbd todo nothing".split()) | {"no reply", "no response", "no answer", "not available", "n a"}
_ENDS = (".", "!", "?", "。", "।")
_OPEN = "([{“«„‘<"


@lru_cache(maxsize=1 << 19)
def _h(s: str) -> int:
    h = 2166136261
    for b in s.encode():
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    return h ^ (h >> 13)


def clauses(reply: str) -> list[str]:
    """Clauses with words, and such as only open something (a list item, a quotation, a bracket)."""
    return [c for c in _CLAUSE.split(_TAGS.sub(" ", reply)) if c.strip() and (_WORD.search(c) or c.strip()[-1] in _OPEN or c.strip() in ("...", "…", "-", "•", "*"))]


def pieces(clause: str) -> list[str]:
    """A clause as it is if it has at most READ words; else parts of at most READ + 3, cut at inner marks and conjunctions where there are any."""
    if len(clause) < 2 * READ or len(norm(clause)) <= READ:
        return [clause]
    parts: list[tuple[str, int]] = []
    for x in _INNER.split(clause):
        n = len(norm(x))
        if n <= READ:
            parts.append((x, n))
            continue
        words, k = x.split(), -(-n // READ)
        size = -(-len(words) // k)
        parts += [(" ".join(words[a : a + size]), len(norm(" ".join(words[a : a + size])))) for a in range(0, len(words), size)]
    out: list[tuple[str, int]] = []
    for k, (x, n) in enumerate(parts):
        tail = k == len(parts) - 1 and n < 4
        if out and out[-1][1] + n <= READ + 3 * (out[-1][1] < 4 or tail):
            out[-1] = (f"{out[-1][0]} {x}", out[-1][1] + n)
        elif x.strip():
            out.append((x, n))
    return [x for x, _ in out]


def norm(s: str) -> list[str]:
    return _WORD.findall(unicodedata.normalize("NFKC", s).lower().replace("’", "'"))


def is_nothing(reply: str | None) -> bool:
    """Nothing is said: no word at all, or only a word that stands for nothing."""
    if reply is None:
        return True
    bare = _TAGS.sub(" ", reply)
    if sum(1 for _ in islice(_WORD.finditer(bare), 4)) > 3:  # no phrase for nothing is so long
        return False
    w = norm(bare)
    return not w or " ".join(w) in NOTHING or (len(w) == 1 and w[0] in NOTHING)


# --- how sentences end, over the whole corpus ---------------------------------------------------------------------


class Reader:
    """Clauses of one worker process; equal ones are parsed once."""

    def __init__(self) -> None:
        self.seen: dict[str, tuple] = {}
        self.codes: dict[str, int] = {}

    def clause(self, c: str) -> tuple[str, list[str], list[tuple[str, list[str]]]]:
        """The clause without its list marker, its words, and its pieces with their words."""
        got = self.seen.get(c)
        if got is None:
            if len(self.seen) > 100_000:  # bounds memory; a clause that returns is parsed again
                self.seen.clear()
            body = _MARKER.sub("", c)
            w = norm(body)
            ps = pieces(body)
            got = self.seen[c] = (body, w, [(body, w)] if len(ps) == 1 else [(p, norm(p)) for p in ps])
        return got

    def code(self, words: list[str]) -> list[int]:
        if len(self.codes) > 500_000:
            self.codes.clear()
        out = []
        for w in words:
            k = self.codes.get(w)
            if k is None:
                k = self.codes[w] = xxhash.xxh64_intdigest(w)
            out.append(k)
        return out


def runs(w: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``n`` words: position of the last word of each, and the hash. ``at`` is a word's place in its clause."""
    k = np.flatnonzero(at >= n - 1)
    h = np.full(len(k), n, np.uint64)
    for d in range(n - 1, -1, -1):
        h = (h ^ w[k - d]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return k, h.view(np.int64)


def _laid(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all lists in a row, the place of each in its list, and the list's number."""
    sizes = np.array([len(x) for x in lists], np.int64)
    w = np.array([x for xs in lists for x in xs], np.uint64)
    of = np.repeat(np.arange(len(lists)), sizes)
    return w, np.arange(len(w)) - np.repeat(np.cumsum(sizes) - sizes, sizes), of


def count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``gram, seen, ended``: hashes of runs of one to five words, how often they occur and stand before a final mark; partial counts."""
    reader = Reader()
    for b in batches:
        cs = Counter(c for r in b["reply"].dropna() for c in clauses(r))
        texts = list(cs)
        times = np.fromiter(cs.values(), np.int64, len(cs))
        words = [norm(c) for c in texts]
        marked = np.array([c.rstrip("\"'”’»)] ").endswith(_ENDS) and not c.rstrip().endswith(("...", "…")) for c in texts], bool)
        w, at, of = _laid([reader.code(x) for x in words])
        last = np.zeros(len(w), bool)
        ends = np.cumsum([len(x) for x in words]) - 1 if words else np.zeros(0, np.int64)
        last[ends[np.array([bool(x) for x in words], bool)]] = True if len(w) else False
        grams, seen, ended = [], [], []
        for n in range(1, 6):
            k, h = runs(w, at, n)
            grams.append(h)
            seen.append(times[of[k]])
            ended.append(times[of[k]] * (last[k] & marked[of[k]]))
        g, inv = np.unique(np.concatenate(grams), return_inverse=True)
        yield pd.DataFrame({"gram": g, "seen": np.bincount(inv, np.concatenate(seen), len(g)).astype(np.int64), "ended": np.bincount(inv, np.concatenate(ended), len(g)).astype(np.int64)})


def shown_end(clause: str, words: list[str]) -> str | None:
    """``open`` (breaks off visibly) or ``mark``; none where only the corpus can tell."""
    c = clause.rstrip()
    if c.endswith(("...", "…", "-", "–", "—", ",", ";", ":")) or c[-1] in _OPEN or not words:
        return "open"
    return "mark" if c.rstrip("\"'”’»)]").endswith(_ENDS) else None


def tail(reply: str | None) -> str | None:
    """The last words of a reply, five at most, where the corpus must tell whether they end a sentence."""
    cs = [] if is_nothing(reply) else clauses(reply)
    body = _MARKER.sub("", cs[-1]) if cs else ""
    if not body.strip():
        return None
    w = norm(body)
    return None if shown_end(body, w) else " ".join(w[-5:])


def tail_grams(replies: pd.Series) -> pd.Series:
    """Of each reply with a tail the hashes of its last word, last two words and so on; null for the others."""
    tails, reader = [tail(r) for r in replies], Reader()
    w, at, of = _laid([reader.code(t.split(" ")) if t else [] for t in tails])
    ends = np.append(of[1:] != of[:-1], True) if len(of) else np.zeros(0, bool)
    out: list[list[int] | None] = [[] if t else None for t in tails]
    for n in range(1, 6):
        k, h = runs(w, at, n)
        for i, g in zip(of[k[ends[k]]].tolist(), h[ends[k]].tolist()):
            out[i].append(g)
    return pd.Series(out, index=replies.index, dtype=object)


def with_endings(df: DataFrame) -> DataFrame:
    """``df`` with ``tail_counts``: of the last 1 to 5 words of each reply, how often they occur and end a sentence in the whole table.

    Only the distinct tails are joined to the counts. Rows without a tail get keys of their own kind, spread out.
    """
    rows = df.withColumn("tail", F.pandas_udf(tail_grams, "array<long>")("reply"))
    need = rows.where("tail is not null").select("tail").distinct().select("tail", F.posexplode("tail").alias("n", "gram"))
    counts = df.select("reply").mapInPandas(count_grams, "gram long, seen long, ended long").groupBy("gram").agg(F.sum("seen").alias("seen"), F.sum("ended").alias("ended"))
    told = need.join(counts, "gram").groupBy("tail").agg(F.array_sort(F.collect_list(F.struct("n", "seen", "ended"))).alias("x"))
    told = told.select(F.col("tail").alias("key"), F.flatten(F.transform("x", lambda x: F.array(x["seen"], x["ended"]))).alias("tail_counts"))
    key = F.coalesce("tail", F.array(F.lit(-1).cast("long"), F.lit(-1).cast("long"), F.pmod(F.xxhash64("exchange_id", "reply"), F.lit(4096))))
    return rows.withColumn("key", key).join(told, "key", "left").drop("key", "tail")


def end_sign(clause: str, words: list[str], counts: list[int]) -> str:
    """``mark``, ``open`` (breaks off visibly), ``fits`` (ends as sentences do) or ``odd`` (does not).

    ``counts``: seen and ended of the last word, of the last two, and so on. The rate at which a run ends a sentence
    leans on that of the shorter run as on KEEN occurrences, so a run that never occurred elsewhere changes nothing.
    """
    shown = shown_end(clause, words)
    if shown:
        return shown
    c = clause.rstrip()
    # the clause itself was counted once, without a mark
    if len(counts) < 2 or counts[0] <= 1 or not c[-1].isalnum():
        return "odd" if c[-1].isalpha() else "fits"  # an unknown word; or a closing sign
    rate = 0.0
    for seen, ended in zip(counts[::2], counts[1::2]):
        rate = (ended + KEEN * rate) / (seen - 1 + KEEN)
    return "fits" if rate >= 0.3 else "odd"


# --- features ------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=4096)
def sign_features(echo: int, foreign: int, end: str, last: int, only: int, size: int) -> np.ndarray:
    f = (f"e{echo}", f"f{foreign}", f"d{end}{last}", f"l{last}{only}", f"z{size}", f"ez{echo}{size}", f"dz{end}{last}{size}", f"ee{echo}{end}{last}", "b")
    return np.array([_h(x) % FEATURES for x in f], np.int32)


@lru_cache(maxsize=100_000)
def word_features(words: tuple[str, ...]) -> np.ndarray:
    f = [f"t{' '.join(words[:3])}", *(f"w{x}" for x in words), *(f"g{a} {b}" for a, b in zip(("^", *words), words))]
    return np.array([_h(x) % FEATURES for x in f], np.int32)


def row_features(words: list[str], echo: int, foreign: int, end: str, last: int, only: int, slots: int = SLOTS) -> np.ndarray:
    n = len(words)
    signs = sign_features(echo, foreign, end, last, only, 0 if n == 0 else 1 if n <= 2 else 2 if n <= 5 else 3 if n <= 9 else 4)
    of_words = word_features(tuple(words))
    out = np.full(slots, FEATURES, np.int32)
    out[: len(signs)] = signs
    out[len(signs) : len(signs) + len(of_words)] = of_words
    return out


#: Fields trained on rows of their own and averaged.
FIELDS = 4


def fitted(held: bool | None = None) -> CRF:
    """The mean of ``FIELDS`` fields, each trained on other rows of the label table (see ``table``)."""
    fields = [_one(table(held=held, seed=5 + k), k) for k in range(FIELDS)]
    mean = CRF(FEATURES, TAGS)
    mean.weights, mean.trans, mean.start, mean.end = (np.mean([getattr(f, x) for f in fields], axis=0, dtype=np.float32) for x in ("weights", "trans", "start", "end"))
    return mean


def _one(rows: list, seed: int) -> CRF:
    split = [[(norm(t), tag, *rest) for t, tag, *rest in r] for r in rows]
    slots = 10 + 2 * max(len(c[0]) for r in split for c in r)
    feats = np.stack([row_features(w, echo, foreign, end, last, only, slots) for r in split for w, _, echo, foreign, end, last, only in r])
    lengths = np.array([len(r) for r in rows])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    tags = np.array([TAGS.index(c[1]) for r in rows for c in r])
    return CRF(FEATURES, TAGS).fit(feats, starts, lengths, tags, epochs=6, rate=0.15, averaged=4, seed=3 + seed)


@lru_cache(maxsize=1)
def model() -> CRF:
    return fitted()


def parameters() -> tuple:
    m = model()
    return m.n_features, m.weights, m.trans, m.start, m.end


def _echo(words: list[str], clause: str, message: set[str], joined: str) -> int:
    """0..3: how far the message holds the clause; what comes before a colon may be left out."""
    best = 0
    for w in (words, norm(clause.split(":", 1)[1]) if ":" in clause else None):
        if not w or not message:
            continue
        if len(w) >= 3 and f" {' '.join(w)} " in joined:
            return 3
        share = sum(x in message for x in w) / len(w)
        best = max(best, 3 if share > 0.95 and len(w) >= 4 else 2 if share > 0.8 and len(w) >= 3 else 1 if share > 0.5 else 0)
    return best


def tag(batches: Iterator[pd.DataFrame], parts: tuple, lang: tuple) -> Iterator[pd.DataFrame]:
    """exchange_id, message, reply, scope, tail_counts -> exchange_id, defect_type (null if sound), and the words under each tag."""
    crf = CRF(0, TAGS)
    crf.n_features, crf.weights, crf.trans, crf.start, crf.end = parts
    scorer, reader = langid.Scorer(lang), Reader()
    for b in batches:
        ends = [[] if x is None else list(x) for x in b["tail_counts"]]
        replies, messages = b["reply"].tolist(), b["message"].tolist()
        void = [is_nothing(r) for r in replies]
        cl = [[] if v else clauses(r) for r, v in zip(replies, void)]
        flat = [c for cs in cl for c in cs]
        lengths = np.array([len(cs) for cs in cl], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        # languages of the messages (all their stretches) and of the clauses
        row, _, _, mcls, _, good = langid.tell(scorer, pa.array([m if isinstance(m, str) else None for m in messages], pa.string()))
        uses = np.zeros((len(b), len(langid.LANGS)), bool)
        uses[row[good], mcls[good]] = True
        enc = pa.array(flat, pa.string()).dictionary_encode()
        ccls, cconf, cn = scorer.segments(enc.dictionary)
        code = enc.indices.to_numpy(zero_copy_only=False)
        ccls, cconf, cn = ccls[code], cconf[code], cn[code]
        owner = np.repeat(np.arange(len(b)), lengths)
        clear = (cn >= 3) & (cconf >= 0.85) & (ccls < len(langid.LANGS)) & uses.any(1)[owner]
        foreign = clear & ~uses[owner, np.minimum(ccls, len(langid.LANGS) - 1)]
        # what the field tags: the pieces of the clauses
        parsed = [reader.clause(c) for c in flat]
        parted = np.array([len(p[2]) for p in parsed], np.int64)
        total = int(parted.sum())
        feats = np.full((total, SLOTS), FEATURES, np.int32)
        sizes = np.zeros(total, np.int64)
        k = row_at = 0
        for i, cs in enumerate(cl):
            m = norm(messages[i]) if cs and isinstance(messages[i], str) else []
            ms, joined = set(m), f" {' '.join(m)} "
            for j in range(len(cs)):
                last = int(j == len(cs) - 1)
                body, w, parts_of = parsed[k]
                end = end_sign(body, w, ends[i]) if last and body.strip() else "open" if last else "mark"
                echo = _echo(w, body, ms, joined)
                for at, (part, pw) in enumerate(parts_of):
                    final = int(last and at == len(parts_of) - 1)
                    sizes[row_at] = len(pw)
                    own = echo if echo == 3 or len(parts_of) == 1 else _echo(pw, part, ms, joined)
                    read = pw[1:] if at and len(pw) > 1 and pw[0] in _JOINS else pw  # the piece as a clause by itself
                    feats[row_at] = row_features(read, own, int(foreign[k]), end if final else "mark", final, int(len(cs) == 1))
                    row_at += 1
                k += 1
        owner = np.repeat(owner, parted)
        lengths = np.bincount(owner, minlength=len(b)).astype(np.int64) if len(b) else lengths
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        tags = crf.decode(feats, starts, lengths) if total else np.zeros(0, np.int64)
        cover = np.zeros((len(b), len(TAGS)), np.int64)
        np.add.at(cover, (owner, tags), np.maximum(sizes, 1))
        has_refusal = np.zeros(len(b), bool)
        has_refusal[owner[tags == 1]] = True
        cut = np.zeros(len(b), bool)
        final = starts + lengths - 1
        live = lengths > 0
        cut[live] |= tags[final[live]] == 4
        told = cover[:, [0, 1, 3, 4]].sum(1)
        copy = (cover[:, 2] > 0) & (cover[:, [0, 1, 3]].sum(1) == 0) & (cover[:, 4] <= 2)
        wrong = cover[:, 3] * 2 > np.maximum(told, 1)
        oos = (b["scope"] == "out_of_scope").to_numpy()
        defect = np.select([np.array(void, bool), has_refusal & ~oos, copy, wrong, cut & ~has_refusal], ["empty", "refusal", "copy", "wrong_language", "truncated"], default="")
        out = pd.DataFrame({"exchange_id": b["exchange_id"].to_numpy(), "defect_type": pd.Series(defect, dtype=object).where(defect != "", None)})
        for t, name in enumerate(("answer", "refusal", "echo", "foreign", "unfinished", "other")):
            out[f"{name}_words"] = cover[:, t]
        yield out


SCHEMA = "exchange_id long, defect_type string, answer_words long, refusal_words long, echo_words long, foreign_words long, unfinished_words long, other_words long"


def judge(df: DataFrame) -> DataFrame:
    """Defect and clause coverage of every pair of ``df`` (exchange_id, message, reply, scope)."""
    parts, lang = parameters(), langid.model()
    shared = df.sparkSession.sparkContext.broadcast((parts, lang))
    return with_endings(df.select("exchange_id", "message", "reply", "scope")).mapInPandas(lambda it: tag(it, *shared.value), SCHEMA)
