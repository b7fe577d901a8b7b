"""Problem 7: map freely typed values to the entries of a canonical list, and report those that have none.

Method: symmetric-delete dictionary, broadcast, for bounded edit-distance lookups; ranking by a weighted
Damerau-Levenshtein distance and by how often the entry itself occurs in the data.

The bound: two forms may be ``edits(n)`` edits apart, ``n`` the length of the shorter one, and their weighted distance
must be at most ``allowed``. A form is looked up under its first ``PREFIX`` characters with up to ``edits`` of them
left out. Two forms within the bound always share such a delete: of the prefixes' characters those that the edits
leave in place, at most ``edits`` left out on either side. So no pair within the bound is missed.

Plan: the distinct values (partial aggregate, so a hot value is one row) are written once; the list's forms and their
deletes are made in the cluster. Up to ``BROADCAST_DELETES`` deletes (counted before) the dictionary goes to the
workers, and one Arrow function reads the values, spread over the cores; more deletes than that are joined with those
of the values by shuffle. Deletes are 64-bit hashes; every candidate is scored, so a collision costs time only. Values
are joined back to the records by a broadcast of checked size, or salted.

Defined results: null values are no rows; values that are empty, or blank once cleaned, map to 0; of candidates of
equal cost the more frequent entry wins, then the smaller ``entry_id``; repeated list entries do no harm.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import materialise
from quire.tables import spread

BROADCAST_DELETES = 2_000_000
PREFIX = 10

#: Words that may stand before or after a name without changing what is meant.
COUNTRY_NOISE = frozenset("the of de la republic republica republique federal state kingdom ka ri in from gb great britain islands country nation commonwealth union socialist democratic people peoples".split())
#: Short words written out before comparing.
ABBREVIATED = {"rep": "republic", "dem": "democratic", "st": "saint", "utd": "united", "n": "new", "s": "south"}
#: Further names of countries that locale data lack.
ALSO = {"states": "united states", "america": "united states", "united states of america": "united states", "england": "united kingdom", "scotland": "united kingdom", "wales": "united kingdom", "britain": "united kingdom", "estados unidos mexicanos": "mexico", "drc": "democratic republic of the congo"}
#: Kinds of jurisdiction, their abbreviations and the words around them.
KIND = {"diocese": "diocese", "dioc": "diocese", "dio": "diocese", "d": "diocese", "archdiocese": "archdiocese", "archdioc": "archdiocese", "archd": "archdiocese", "arch": "archdiocese", "ad": "archdiocese", "vicariate": "vicariate", "vic": "vicariate", "eparchy": "eparchy", "ep": "eparchy", "epar": "eparchy", "prefecture": "prefecture", "pref": "prefecture", "exarchate": "exarchate"}
DIOCESE_NOISE = frozenset("the of de di da do rc r c catholic roman latin apostolic metropolitan holy fr".split())
INSTITUTE_HEAD = frozenset("congregation society order institute missionaries fathers brothers oratory servants sisters the of".split())
#: Languages whose names of countries are taken from the JVM's locale data as further names.
LANGUAGES = ("fr", "es", "de", "it", "pt", "pl", "nl", "id", "vi", "hr", "hu", "sk", "sl", "lt", "cs", "ro", "sv", "tl", "sw", "ms")


def clean(s: str) -> str:
    """Lower case without marks, invisible characters and punctuation; separators of parts are kept as ``|``."""
    s = unicodedata.normalize("NFKD", s)
    s = "".join(c for c in s if not unicodedata.combining(c) and unicodedata.category(c) not in ("Cf", "So", "Sk", "Cs"))
    s = s.casefold()
    s = re.sub(r"\s*[,/;|()\[\]–—]+\s*|\s+-\s+", "|", s)
    s = re.sub(r"(?<=\b\w)\.\s*(?=\w\b)", "", s)  # p.n.g. is png
    s = re.sub(r"['’`]", "", s)
    s = re.sub(r"[^\w|]+", " ", s)
    return re.sub(r"\s*\|[\s|]*", "|", s).strip(" |")


def _strip_kind(words: list[str]) -> tuple[str, str]:
    kinds = [KIND[w] for w in words if w in KIND and len(w) > 1] or [KIND[w] for w in words[:1] if w in KIND]
    rest = list(words)
    while rest and (rest[0] in DIOCESE_NOISE or rest[0] in KIND):
        rest.pop(0)
    while rest and (rest[-1] in DIOCESE_NOISE or rest[-1] in KIND):
        rest.pop()
    return (kinds[0] if kinds else ""), " ".join(rest)


def forms(list_name: str, value: str, longest: int = 12) -> list[tuple[str, float, str]]:
    """``(form, cost of reading the value so, kind of jurisdiction named)``, cheapest first.

    ``longest``: the most words that a name of the list has; longer beginnings and endings of a value are no names.
    """
    parts = [p for p in clean(value).split("|") if p.strip()]
    out: dict[str, tuple[float, str]] = {}

    def add(form: str, cost: float, kind: str = "") -> None:
        form = form.strip()
        if form and (form not in out or out[form][0] > cost):
            out[form] = (cost, kind)

    whole = " ".join(parts)
    if list_name == "country":
        add(whole, 0.0)
        for k, p in enumerate(parts):
            add(p, 0.1 + 0.02 * k)
            w = p.split()
            lo, hi = 0, len(w)
            while lo < hi - 1 and w[lo] in COUNTRY_NOISE:
                lo += 1
            while hi > lo + 1 and w[hi - 1] in COUNTRY_NOISE:
                hi -= 1
            add(" ".join(w[lo:hi]), 0.2 + 0.02 * k)
        add(whole.replace(" ", ""), 0.3)
        words = [ABBREVIATED.get(x, x) for x in whole.split()]
        add(" ".join(words), 0.1)
        add(" ".join(x for x in words if x not in ("of", "the", "de")), 0.2)
        for n in range(max(1, len(words) - longest), len(words)):  # a place before or after the country's name, which then must stand as it is
            add(" ".join(words[n:]), 0.5, "=")
        for n in range(1, min(longest + 1, len(words))):
            add(" ".join(words[:n]), 0.55, "=")
    else:
        kind, base = _strip_kind(whole.split())
        add(whole, 0.0, kind)
        add(base, 0.05, kind)
        add(" ".join(x for x in whole.split() if x not in ("of", "the", "de")), 0.2, kind)
        named = [(p, *_strip_kind(p.split())) for p in parts]
        for k, (p, kd, b) in enumerate(named):
            own = kd or (kind if len(parts) > 1 and any(not x[2] for x in named) else "")
            # what follows the first part of a name is a place within it
            later = 0.0 if not any(x[2] for x in named[:k]) else 1.2
            add(p, 0.1 + later, own)
            add(b, 0.15 + later, own)
    return sorted(((f, c, k) for f, (c, k) in out.items()), key=lambda x: (x[1], x[0]))


def reference_forms(list_name: str, entry_name: str, others: list[str]) -> list[tuple[str, float, str]]:
    """The forms under which an entry is found; short names of the list (acronyms) only as they stand."""
    out = [(clean(entry_name).replace("|", " "), 0.0, "")]
    if list_name == "diocese":
        kind, base = _strip_kind(out[0][0].split())
        if kind:
            out = [(out[0][0], 0.0, kind), (base, 0.0, kind)]
        else:
            w = out[0][0].split()
            while w and w[0] in INSTITUTE_HEAD:
                w.pop(0)
            out.append((" ".join(w), 0.1, ""))
        out.append((" ".join(x for x in out[0][0].split() if x not in ("of", "the", "de")), 0.1, kind))
    else:
        out.append((out[0][0].replace(" ", ""), 0.2, ""))
        out.append((" ".join(x for x in out[0][0].split() if x not in ("of", "the", "de")), 0.1, ""))
    out += [(clean(o).replace("|", " "), 0.1, "") for o in others if o]
    return [x for x in out if x[0]]


def edits(n: int) -> int:
    """The most edits between two forms of which the shorter has ``n`` characters."""
    return 0 if n < 3 else 1 if n == 3 else 2 if n <= 9 else 3


def plain_distance(a: str, b: str) -> int:
    """Optimal string alignment distance: insertions, deletions, replacements and transpositions count one each."""
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row = [i + 1]
        for j, y in enumerate(b):
            c = min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1)
            if i and j and x == b[j - 1] and a[i - 1] == y:
                c = min(c, before[j - 1] + 1)
            row.append(c)
        before, last = last, row
    return last[-1]


@lru_cache(maxsize=64)
def _kept(size: int, left_out: int) -> np.ndarray:
    """Positions that stay when ``left_out`` of ``size`` characters are left out: one row a choice."""
    return np.array([[i for i in range(size) if i not in gone] for gone in combinations(range(size), left_out)], np.int64).reshape(-1, size - left_out)


def delete_hashes(forms_of: list[str], lists: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all deletes of the forms, and the number of the form of each. Forms of different lists share none."""
    hashes, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    groups: dict[tuple[int, int], list[int]] = {}
    for i, f in enumerate(forms_of):
        groups.setdefault((min(len(f), PREFIX), edits(len(f))), []).append(i)
    seeds = np.array([xxhash.xxh64_intdigest(x) for x in lists], np.uint64)
    for (size, depth), members in groups.items():
        for at in range(0, len(members), 20_000):
            which = np.array(members[at : at + 20_000])
            chars = np.array([[ord(c) for c in forms_of[i][:size]] for i in which], np.uint64).reshape(len(which), size)
            for gone in range(depth + 1):
                kept = _kept(size, gone)
                h = np.repeat(seeds[which][:, None], len(kept), 1)
                for j in range(kept.shape[1]):
                    h = (h ^ chars[:, kept[:, j]]) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(29)
                hashes.append(h.ravel())
                owners.append(np.repeat(which, len(kept)))
    return np.concatenate(hashes), np.concatenate(owners)


VOWELS = frozenset("aeiouy")


def weighted_distance(a: str, b: str, stop: float = 9.0) -> float:
    """Damerau-Levenshtein (optimal string alignment) with weights.

    A doubled letter costs 0.6, a vowel for a vowel 0.8, a transposition 0.9, a space 0.5, any other edit 1; an edit
    of the first letter costs 0.3 more.
    """
    if a == b:
        return 0.0
    n, m = len(a), len(b)

    def gap(s: str, i: int) -> float:
        if s[i] == " ":
            return 0.5
        return (0.6 if i and s[i] == s[i - 1] or i + 1 < len(s) and s[i] == s[i + 1] else 1.0) + (0.3 if i == 0 else 0.0)

    before: list[float] = []
    last = [0.0]
    for j in range(m):
        last.append(last[-1] + gap(b, j))
    for i in range(n):
        row = [last[0] + gap(a, i)]
        for j in range(m):
            if a[i] == b[j]:
                c = last[j]
            else:
                c = last[j] + (0.8 if a[i] in VOWELS and b[j] in VOWELS else 1.0) + (0.3 if i == 0 and j == 0 else 0.0)
            c = min(c, last[j + 1] + gap(a, i), row[j] + gap(b, j))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j] and a[i] != a[i - 1]:
                c = min(c, before[j - 1] + (0.6 if " " in (a[i], a[i - 1]) else 0.9))
            row.append(c)
        before, last = last, row
        if min(row) > stop:
            return stop
    return last[-1]


def allowed(n: int) -> float:
    """The greatest weighted distance at which a form of ``n`` characters is still taken for an entry."""
    return 0.0 if n <= 3 else 1.05 if n <= 4 else 1.35 if n <= 5 else 2.05 if n <= 9 else 2.7 if n <= 14 else 3.3


@lru_cache(maxsize=4)
def _locale_names(spark: SparkSession) -> list[tuple[str, str, str, tuple[str, ...]]]:
    """ISO codes, English name and names in LANGUAGES, from the JVM's locale data."""
    L = spark._jvm.java.util.Locale
    tongues = [L.forLanguageTag(t) for t in LANGUAGES]
    out = []
    for code in L.getISOCountries():
        place = L("", code)
        shown = clean(place.getDisplayCountry(L.ENGLISH))
        english = re.sub(r"\|.*", "", shown)
        english = english.replace("congo kinshasa", "democratic republic of the congo").replace("congo brazzaville", "republic of the congo")
        if code == "CD":
            english = "democratic republic of the congo"
        known = {"MM": "myanmar", "TL": "east timor"}.get(code, english)
        foreign = tuple(re.sub(r"\|.*", "", clean(place.getDisplayCountry(t))) for t in tongues)
        out.append((code.lower(), place.getISO3Country().lower(), known, (english, *foreign)))
    return out


def _names_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Forms of each entry; ``own`` tells names that the list itself gives."""
    for b in batches:
        rows = []
        for ln, e, name, others in b[["list_name", "entry_id", "entry_name", "other_names"]].itertuples(index=False, name=None):
            given = [x for x in (others if others is not None else ()) if x]
            rows += [(ln, e, f, c, k, False) for f, c, k in reference_forms(ln, name, given)]
            rows += [(ln, e, clean(x).replace("|", " "), 9.0, "", True) for x in (name, *given)]
        yield pd.DataFrame(rows, columns=["list_name", "entry_id", "ref_form", "ref_cost", "ref_kind", "own"])


_REF = "list_name string, entry_id long, ref_form string, ref_cost double, ref_kind string"


def reference(spark: SparkSession, places: DataFrame) -> DataFrame:
    """``list_name, entry_id, ref_form, ref_cost, ref_kind`` of the list, made in the cluster.

    Countries also get their names in other languages and ISO codes from the JVM's locale data (a fixed table of some
    250 rows); countries of that data which the list lacks come in as entry 0, so that their names are not bent to a
    similar entry.
    """
    made = places.select("list_name", "entry_id", "entry_name", "other_names").mapInPandas(_names_of, _REF + ", own boolean")
    made = materialise(made.where("ref_form <> ''").distinct())
    own = made.where("not own").drop("own")
    listed = made.where("own and list_name = 'country'").groupBy("ref_form").agg(F.min("entry_id").alias("entry_id")).select(F.col("ref_form").alias("name"), "entry_id")
    world = [(code, code3, english, list(dict.fromkeys((english, *foreign)))) for code, code3, english, foreign in _locale_names(spark)]
    lands = spark.createDataFrame(world, "code string, code3 string, english string, names array<string>")
    entry = lands.join(listed.withColumnRenamed("name", "english"), "english", "left")
    # names in other languages only of countries that the list holds
    names = entry.select("entry_id", F.explode(F.when(F.col("entry_id").isNotNull(), F.col("names")).otherwise(F.array("english"))).alias("ref_form"), F.lit(0.15).alias("ref_cost"), F.lit(True).alias("_land"))
    codes = entry.select("entry_id", F.explode(F.array("code", "code3")).alias("ref_form"), F.lit(0.25).alias("ref_cost"), F.lit(False).alias("_land"))
    extra = names.unionByName(codes).where("ref_form <> ''").join(listed.select(F.col("name").alias("ref_form")), "ref_form", "left_anti")
    extra = extra.where(F.col("entry_id").isNotNull() | ~F.col("_land") | ~F.col("ref_form").isin(sorted(ALSO)))
    also = spark.createDataFrame(sorted(ALSO.items()), "ref_form string, name string").join(listed, "name").select("entry_id", "ref_form", F.lit(0.15).alias("ref_cost"))
    lands_of = extra.select("entry_id", "ref_form", "ref_cost").unionByName(also).select(F.lit("country").alias("list_name"), F.coalesce("entry_id", F.lit(0)).cast("long").alias("entry_id"), "ref_form", "ref_cost", F.lit("").alias("ref_kind"))
    has_countries = made.where("list_name = 'country'").limit(1).select("list_name").distinct()
    return own.unionByName(lands_of.join(has_countries, "list_name", "left_semi")).distinct()


_BAG = {c: k for k, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789 ")}


def _bags(forms_of: list[str]) -> np.ndarray:
    """How often each letter and digit occurs in each form; each edit changes at most two of the counts, by one."""
    out = np.zeros((len(forms_of), len(_BAG) + 1), np.int16)
    for i, f in enumerate(forms_of):
        for c in f:
            out[i, _BAG.get(c, len(_BAG))] += 1
    return out


def distance(form: str, ref: str, kind: str, entry: int) -> float | None:
    """Weighted distance of a form of a value to a form of the list, or none beyond the bound."""
    if form == ref:
        return 0.0 if kind != "=" or entry and len(ref) > 3 else None
    if kind == "=" or not entry or min(len(form), len(ref)) < 3:  # these count as they stand only
        return None
    most = allowed(max(len(form), len(ref)))
    d = weighted_distance(form, ref, most + 0.01)
    return d if d <= most and plain_distance(form, ref) <= edits(min(len(form), len(ref))) else None


class Dictionary:
    """The forms of a list with their deletes, as a worker holds them."""

    def __init__(self, ref: pd.DataFrame):
        self.lists, self.forms = ref["list_name"].tolist(), ref["ref_form"].tolist()
        self.entry, self.cost, self.kind, self.freq = ref["entry_id"].tolist(), ref["ref_cost"].tolist(), ref["ref_kind"].tolist(), ref["freq"].tolist()
        self.longest = max((len(f.split(" ")) for f in self.forms), default=1)
        h, of = delete_hashes(self.forms, self.lists)
        order = np.argsort(h, kind="stable")
        self.hashes, self.of = h[order], of[order]
        self.exact: dict[tuple[str, str], list[int]] = {}
        for i, key in enumerate(zip(self.lists, self.forms)):
            self.exact.setdefault(key, []).append(i)
        self.bags = _bags(self.forms)
        self.list_of = np.array(self.lists, object)
        self.sizes = np.array([len(f) for f in self.forms], np.int64)

    def near(self, forms_of: list[str], lists: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (form, form of the list) that share a delete and that their letters do not rule out."""
        h, of = delete_hashes(forms_of, lists)
        lo, hi = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        n = hi - lo
        a = np.repeat(of, n)
        b = self.of[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else lo, n) + np.arange(n.sum())]
        pairs = np.unique(a * max(len(self.forms), 1) + b)
        a, b = pairs // max(len(self.forms), 1), pairs % max(len(self.forms), 1)
        shorter = np.minimum(np.array([len(f) for f in forms_of], np.int64)[a], self.sizes[b]) if len(a) else a
        most = np.select([shorter < 3, shorter == 3, shorter <= 9], [0, 1, 2], 3)
        bags = _bags(forms_of)
        keep = np.zeros(len(a), bool)
        here = np.array(lists, object)
        own = self.list_of[b] == here[a] if len(a) else keep
        for s in range(0, len(a), 200_000):
            keep[s : s + 200_000] = np.abs(bags[a[s : s + 200_000]] - self.bags[b[s : s + 200_000]]).sum(1) <= 2 * most[s : s + 200_000]
        keep &= own
        return a[keep], b[keep]


#: No inexact reading costs less than this: the cheapest edit, less what the frequency of an entry may take off.
SETTLED = 0.38


def match(batches: Iterator[pd.DataFrame], ref: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """list_name, value -> the same with ``entry_id`` and ``score`` of the best entry; values without one give no row."""
    words = Dictionary(ref)
    for b in batches:
        lists = b["list_name"].tolist()
        read = [forms(ln, v, words.longest) for ln, v in zip(lists, b["value"])]
        best: list[tuple[float, int] | None] = [None] * len(read)

        def take(i: int, cost: float, kind: str, r: int, d: float, best=best) -> None:
            other = 0.4 if kind and words.kind[r] and kind != words.kind[r] else 0.0
            got = (d + cost + words.cost[r] + other - 0.01 * words.freq[r], words.entry[r])
            if best[i] is None or got < best[i]:
                best[i] = got

        open_forms: dict[tuple[str, str], int] = {}
        waiting: list[tuple[int, float, str, int]] = []
        for i, (ln, fs) in enumerate(zip(lists, read)):
            for f, c, k in fs:
                for r in words.exact.get((ln, f), ()):
                    if distance(f, f, k, words.entry[r]) is not None:
                        take(i, c, k, r, 0.0)
            if best[i] is None or best[i][0] > SETTLED:
                waiting += [(i, c, k, open_forms.setdefault((ln, f), len(open_forms))) for f, c, k in fs if k != "=" and len(f) >= 3]
        keys = list(open_forms)
        a, r = words.near([f for _, f in keys], [ln for ln, _ in keys])
        close: dict[int, list[tuple[int, float]]] = {}
        for x, y in zip(a.tolist(), r.tolist()):
            d = distance(keys[x][1], words.forms[y], "", words.entry[y])
            if d:
                close.setdefault(x, []).append((y, d))
        for i, c, k, u in waiting:
            for y, d in close.get(u, ()):
                take(i, c, k, y, d)
        at = [i for i, x in enumerate(best) if x is not None]
        yield b.iloc[at].assign(entry_id=[best[i][1] for i in at], score=[best[i][0] for i in at])


def _value_deletes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(ln, v, f, c, k) for ln, v in zip(b["list_name"], b["value"]) for f, c, k in forms(ln, v)]
        x = pd.DataFrame(rows, columns=["list_name", "value", "form", "cost", "kind"])
        h, of = delete_hashes(x["form"].tolist(), x["list_name"].tolist())
        yield x.iloc[of].assign(del_hash=h.view(np.int64))


def _reference_deletes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        h, of = delete_hashes(b["ref_form"].tolist(), b["list_name"].tolist())
        yield b.iloc[of].assign(del_hash=h.view(np.int64))


def _score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        kept = []
        for ln, v, f, c, k, e, rf, rc, rk, freq in b.itertuples(index=False, name=None):
            d = distance(f, rf, k, e)
            if d is not None:
                kept.append((ln, v, e, d + c + rc + (0.4 if k and rk and k != rk else 0.0) - 0.01 * freq))
        yield pd.DataFrame(kept, columns=["list_name", "value", "entry_id", "score"])


def _matched(values: DataFrame, ref: DataFrame, most_deletes: int) -> DataFrame:
    """``list_name, value, entry_id, score`` of the values that have an entry."""
    deletes = ref.select("list_name", "ref_form").distinct().select("list_name", F.least(F.length("ref_form"), F.lit(PREFIX)).alias("p"), F.length("ref_form").alias("n"))
    choose = F.when(F.col("n") < 3, 1).when(F.col("n") == 3, 4).when(F.col("n") <= 9, 1 + F.col("p") + F.col("p") * (F.col("p") - 1) / 2).otherwise(1 + F.col("p") + F.col("p") * (F.col("p") - 1) / 2 + F.col("p") * (F.col("p") - 1) * (F.col("p") - 2) / 6)
    if (deletes.agg(F.sum(choose)).first()[0] or 0) <= most_deletes:
        shared = values.sparkSession.sparkContext.broadcast(ref.toPandas())
        return spread(values).mapInPandas(lambda it: match(it, shared.value), "list_name string, value string, entry_id long, score double")
    val_del = spread(values).mapInPandas(_value_deletes, "list_name string, value string, form string, cost double, kind string, del_hash long")
    ref_del = ref.mapInPandas(_reference_deletes, _REF + ", freq double, del_hash long")
    pairs = val_del.join(ref_del, ["list_name", "del_hash"]).select("list_name", "value", "form", "cost", "kind", "entry_id", "ref_form", "ref_cost", "ref_kind", "freq").distinct()
    scored = pairs.mapInPandas(_score, "list_name string, value string, entry_id long, score double")
    return scored.groupBy("list_name", "value").agg(F.min(F.struct("score", "entry_id")).alias("b")).select("list_name", "value", "b.entry_id", "b.score")


def assign(values: DataFrame, places: DataFrame, most_deletes: int = BROADCAST_DELETES) -> DataFrame:
    """``values`` has ``list_name`` and ``value``; returns each distinct value with its ``entry_id``, or 0, and ``score``.

    Values that literally are an entry's name get that entry at score 0.
    """
    spark = values.sparkSession
    names = places.select("list_name", F.col("entry_name").alias("value"), F.col("entry_id").alias("own")).groupBy("list_name", "value").agg(F.min("own").alias("own"))
    counted = values.where(F.col("value").isNotNull()).groupBy("list_name", "value").agg(F.count("*").alias("n"))
    literal = materialise(counted.join(names, ["list_name", "value"], "left"))
    # how often each entry occurs literally: one row per entry
    freq = literal.where("own is not null").groupBy(F.col("own").alias("entry_id")).agg(F.log10(F.sum("n") + 1).alias("freq"))
    ref = materialise(reference(spark, places).join(freq, "entry_id", "left").select("list_name", "entry_id", "ref_form", "ref_cost", "ref_kind", F.coalesce("freq", F.lit(0.0)).alias("freq")))
    best = _matched(literal.where("own is null").select("list_name", "value"), ref, most_deletes)
    found = literal.where("own is null").select("list_name", "value", "n").join(best, ["list_name", "value"], "left").select("list_name", "value", F.coalesce("entry_id", F.lit(0)).cast("long").alias("entry_id"), "score", F.lit(False).alias("is_literal"), "n")
    return found.unionByName(literal.where("own is not null").select("list_name", "value", F.col("own").alias("entry_id"), F.lit(0.0).alias("score"), F.lit(True).alias("is_literal"), "n"))
