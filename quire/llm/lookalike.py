"""Problem 2: text that looks the same but is written with different characters.

Method: explode text to positioned code points, broadcast-join decomposition and look-alike mappings, order
combining marks by class, recompose, rebuild the strings. Everything is a DataFrame plan; no Python runs per row.

The plan works on the *distinct* strings: strings of a corpus repeat, a hot string (an article, a third of all
rows) is one row after the partial aggregate, and every later step (window over a string's code points, the two
group-bys) is partitioned by the string, so the distinct is the only shuffle of the normalisation. The strings that
change are written once and joined back on the string: by a broadcast if they are few (counted), else with salt, so
that a string of a third of all rows is no one task's work.

The mapping tables are bounded by Unicode, not by the data: at most one row for each of 0x110000 code points
(about 10,000 after selection), so broadcasting them is safe at any input size.

Defined results: null stays null; an empty string stays empty; a string that holds nothing but invisible
characters becomes empty; a character with no counterpart in the target script stays and ``is_clean`` is false.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.session import materialise
from quire.tables import lookup

#: Punctuation of the one form.
PUNCTUATION = (",", ".", ";", "·", "’", "⸀", "⸁", "⸂")

#: Punctuation that stands for one of the above and has no decomposition to it.
PUNCTUATION_ALIKE = {
    "'": "’", "ʼ": "’", "ʹ": "’", "ʻ": "’", "ʽ": "’", "‘": "’", "‛": "’", "`": "’", "´": "’",
    "᾽": "’", "᾿": "’", "῾": "’", "ʹ": "’", "΄": "’", "′": "’", "＇": "’", "՚": "’", "ꞌ": "’",
    "‚": ",", "،": ",", "、": ",", "､": ",", "ˏ": ",", "¸": ",", "︐": ",", "﹐": ",", "﹑": ",",
    "․": ".", "。": ".", "｡": ".", "۔": ".", "﹒": ".", "ꓸ": ".", "܁": ".", "܂": ".",
    ";": ";", "؛": ";", "⁏": ";", "︔": ";", "﹔": ";",
    "·": "·", "‧": "·", "⋅": "·", "∙": "·", "•": "·", "・": "·", "･": "·", "ᐧ": "·", "⸱": "·", "᛫": "·",
    "׳": "’", "״": "’",
}

#: Letters that pass for a Greek one in print although the confusables data keep them apart.
LETTER_ALIKE = {
    "w": "ω", "x": "χ", "k": "κ", "p": "ρ", "u": "υ", "v": "ν", "n": "η", "o": "ο", "i": "ι", "l": "ι", "t": "τ", "y": "γ", "a": "α", "e": "ε", "d": "δ", "b": "β", "h": "η", "s": "ς", "m": "μ", "z": "ζ", "f": "φ",
    "х": "χ", "п": "π", "т": "τ", "к": "κ", "ѡ": "ω", "ѵ": "ν", "о": "ο", "а": "α", "у": "γ", "и": "η", "ф": "φ", "є": "ε", "е": "ε", "і": "ι", "ѕ": "ς", "ѱ": "ψ", "ѯ": "ξ", "ѳ": "θ", "ө": "θ", "с": "ϲ",
    "ɛ": "ε", "ɩ": "ι", "ʋ": "υ", "ɣ": "γ", "ɑ": "α", "ɸ": "φ", "ɵ": "θ", "ʟ": "λ", "ß": "β", "ĸ": "κ", "ı": "ι", "ꭓ": "χ", "ꞵ": "β", "ƞ": "η", "ŋ": "η", "ɷ": "ω", "ƛ": "λ", "ȣ": "ου",
    "Ʃ": "Σ", "Λ": "Λ", "Ф": "Φ", "П": "Π", "Г": "Γ", "Л": "Λ", "Ѱ": "Ψ", "Ѳ": "Θ", "Ѡ": "Ω", "Ω": "Ω", "∆": "Δ", "∑": "Σ", "∏": "Π",
}


def _greek(ch: str) -> bool:
    return 0x370 <= ord(ch) <= 0x3FF or 0x1F00 <= ord(ch) <= 0x1FFF


@lru_cache(maxsize=1)
def composed_letters() -> frozenset[str]:
    """Composed letters of the Greek script: letters that no normalisation changes."""
    spans = [*range(0x370, 0x400), *range(0x1F00, 0x2000)]
    return frozenset(c for c in map(chr, spans) if unicodedata.category(c) in ("Lu", "Ll", "Lt", "Lo") and unicodedata.normalize("NFKC", c) == c)


def _alike(spark: SparkSession) -> dict[str, str]:
    """Foreign letter -> Greek letter: the Unicode confusables (ICU in the JVM), then the fixed supplement."""
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    plain = sorted(c for c in composed_letters() if len(unicodedata.normalize("NFD", c)) == 1)
    foreign = [c for c in map(chr, range(0x21, 0x1E000)) if unicodedata.category(c)[0] in "LNS" and not _greek(c) and not 0xAC00 <= ord(c) < 0xD7B0 and not 0x3400 <= ord(c) < 0xA000 and not 0xD800 <= ord(c) < 0xE000 and not 0x17000 <= ord(c) < 0x18D00]
    skeletons = checker.getSkeleton("\n".join([*plain, *foreign])).split("\n")
    by: dict[str, list[str]] = {}
    for c, s in zip(plain, skeletons):
        by.setdefault(s, []).append(c)
    out = {}
    for c, s in zip(foreign, skeletons[len(plain) :]):
        if s in by:
            # of several Greek letters the one of the same case, then the vowel omicron before sigma, then the first
            out[c] = min(by[s], key=lambda g: (g.isupper() != c.isupper(), g == "σ", g))
    return out | LETTER_ALIKE


@lru_cache(maxsize=4)
def _rows(key: int, spark: SparkSession) -> list[tuple[str, list[tuple[str, int]]]]:
    alike = _alike(spark)
    keep = composed_letters() | set(PUNCTUATION)

    def decompose(c: str, depth: int = 0) -> str:
        if c in PUNCTUATION_ALIKE:
            return PUNCTUATION_ALIKE[c]
        if c in keep:
            return unicodedata.normalize("NFD", c)
        if unicodedata.category(c) in ("Cf", "Cc", "Zs", "Zl", "Zp", "Cn", "Co", "Cs") or 0xFE00 <= ord(c) <= 0xFE0F or ord(c) in (0x34F, 0x115F, 0x1160, 0x3164, 0xFFA0, 0x2800):
            return ""
        kd = unicodedata.normalize("NFKD", c)
        if kd != c and depth < 4:
            return "".join(decompose(x, depth + 1) for x in kd)
        g = alike.get(c)
        return unicodedata.normalize("NFD", g) if g else c

    out = []
    for n in [*range(0x0, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x10000), *range(0x10000, 0x17000), *range(0x1B000, 0x20000), *range(0xE0000, 0xE01F0)]:
        c = chr(n)
        if 0xD800 <= n < 0xE000:
            continue
        d = decompose(c)
        if d != c or unicodedata.combining(c):
            if unicodedata.category(c) == "Cn":
                continue
            out.append((c, [(x, unicodedata.combining(x)) for x in d]))
    return out


def mapping(spark: SparkSession) -> DataFrame:
    """``ch``, ``seq array<struct<c, k>>``: what a code point is written as, each with its combining class."""
    return spark.createDataFrame(_rows(id(spark._jsc), spark), "ch string, seq array<struct<c:string,k:int>>")


def compositions(spark: SparkSession) -> DataFrame:
    """``run``, ``composed``: a letter with its ordered marks, and the one code point it composes to."""
    rows = [(unicodedata.normalize("NFD", c), c) for c in sorted(composed_letters()) if len(unicodedata.normalize("NFD", c)) > 1]
    return spark.createDataFrame(rows, "run string, composed string")


def one_form(strings: DataFrame, column: str = "surface") -> DataFrame:
    """``surface``, ``canonical``, ``is_clean`` for each distinct non-null value of ``column``.

    ``is_clean`` tells that ``canonical`` holds nothing outside the one form.
    """
    spark = strings.sparkSession
    values = strings.select(F.col(column).alias("surface")).where(F.col("surface").isNotNull()).distinct()
    points = values.select("surface", F.posexplode_outer(F.split("surface", "")).alias("pos", "ch")).where((F.col("ch") != "") | (F.col("surface") == ""))
    mapped = points.join(F.broadcast(mapping(spark)), "ch", "left").select("surface", "pos", F.posexplode(F.coalesce("seq", F.array(F.struct(F.col("ch").alias("c"), F.lit(0).alias("k"))))).alias("sub", "p"))
    w = Window.partitionBy("surface").orderBy("pos", "sub")
    runs = mapped.select("surface", "pos", "sub", "p.c", "p.k").withColumn("run", F.sum((F.col("k") == 0).cast("int")).over(w))
    marks = runs.groupBy("surface", "run").agg(F.array_sort(F.collect_list(F.struct("k", "pos", "sub", "c"))).alias("cs"))
    ordered = marks.select("surface", F.col("run").alias("at"), F.array_join("cs.c", "").alias("run"))
    recomposed = ordered.join(F.broadcast(compositions(spark)), "run", "left").select("surface", "at", F.coalesce("composed", "run").alias("part"))
    built = recomposed.groupBy("surface").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("ps")).select("surface", F.array_join("ps.part", "").alias("canonical"))
    allowed = "".join(sorted(composed_letters())) + "".join(PUNCTUATION)
    # strings of which nothing is left have no exploded row
    return values.join(built, "surface", "left").select("surface", F.coalesce("canonical", F.lit("")).alias("canonical")).withColumn("is_clean", F.translate("canonical", allowed, "") == "")


def changed(strings: DataFrame, column: str = "surface") -> DataFrame:
    """Those of ``one_form`` whose string differs from its one form, or cannot be brought to it."""
    return one_form(strings, column).where((F.col("surface") != F.col("canonical")) | ~F.col("is_clean"))


def canonical_column(df: DataFrame, column: str = "surface", out: str = "canonical") -> DataFrame:
    """``df`` with ``out``: ``column`` in its one form. Rows whose string does not change find no partner."""
    ch = materialise(changed(df, column).select(F.col("surface").alias(column), F.col("canonical").alias("_c")))
    got = lookup(df, ch, [column]).withColumn(out, F.coalesce("_c", column))
    return got.select(*df.columns, out)


def not_canonical(df: DataFrame, column: str = "surface") -> DataFrame:
    """Rows of ``df`` whose string is not in the one form."""
    ch = materialise(changed(df, column).select(F.col("surface").alias(column)))
    return lookup(df, ch, [column], "left_semi").select(*df.columns)
