"""Problem 10: per-document quality statistics and the type of text (prose, list, table, junk).

Method: thresholds on the statistics are noisy labelling functions; expectation-maximisation on their agreements
learns how far each can be trusted (a table of vote given type); the posterior of the types is the result.

The statistics are built-in expressions over the text: no shuffle, no Python. The labelling functions reduce each
document to a pattern of votes. Patterns are counted over *all* documents; their number is bounded by the functions
(2 to 3 votes each), not by the data, so the counts may go to the driver, where the EM runs, and the posterior per
pattern may be broadcast. Statistics and patterns are written once to the shared checkpoint folder, so the text is
read once.

Defined results: null and blank texts have null statistics and the type ``junk`` (nothing in them means anything);
very long texts are read whole; repeated rows and extra columns do not matter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import materialise

TYPES = ("prose", "list", "table", "junk")

#: Very common words of the corpus languages, which any running text holds.
COMMON = (
    "the and of to in a is that for it with as was on be are by this we our you not but who what when from at or have his her they their will let us "  # English
    "ka ki u ba ha na bad la jong ïa ngi lah ban da don long ruh kata ia "  # Khasi
    "el la los las de del y que en un una por con para no es su se lo al más "  # Spanish
    "le les des et du une est dans pour qui sur pas nous vous avec il elle ne au "  # French
    "et in non est ad cum qui quia sed ita nec sicut omnes per "  # Latin
    "der die das und ist nicht ein eine den dem mit zu von auf für wir ihr im des sich wenn auch "  # German
).split()

_MARK = r"^(?:[-–—•*·◦▪‣+>]|\(?[0-9]{1,3}[.)]|\(?[A-Za-z][.)]|\([A-Za-z0-9]{1,4}\)|[ivxlcIVXLC]{1,7}[.)]|\[[ xX]?\]|[0-9]{1,2}[:.h][0-9]{2})\s+\S"
#: Columns set by tabs, bars or runs of spaces: these lines are rows even where they begin like a list item.
_COLUMNS = r"\t|^\s*\|.*\|\s*$|\s[│┃]\s|\s\|\s.*\s\|\s|\S {3,}\S.*\S {3,}\S|^ {6,}\S.* {3,}\S|^ {14,}\S|^[\s|+─━═=:-]{5,}$|^\S+(?: \S+)? {4,}\S+(?: \S+)?$"
#: Cells parted by commas or semicolons without a space.
_CELLS = r"\";\"|^[^,;]{0,25}(?:[,;](?! )[^,;]{0,25}){2,}$"
_MARKUP = r"</?[a-zA-Z][^>]*>|&[a-z]+;|function ?\w*\(|\{[^}]*[:;][^}]*\}|data:[a-z]+/"
#: What is no letter: ASCII marks and digits, Latin-1 signs, general punctuation, arrows to symbols, and the replacement sign.
_NO_WORD = "[\\x00-&(-,.-@\\[-`{-\\x7f\\u00a0-\\u00b4\\u00b6-\\u00bf\\u00d7\\u00f7\\u2000-\\u2018\\u201a-\\u206f\\u2190-\\u2bff\\u3000-\\u303f\\ufffd]+"
_MOJI = "�ÂÃ¿½¤€™œâï"


def _share(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def _chars(lines: Column) -> Column:
    return F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(x))


def _left_out(t: Column, pattern: str) -> Column:
    """Characters of ``t`` that ``pattern`` matches."""
    return F.length(t) - F.length(F.regexp_replace(t, pattern, ""))


def statistics(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df`` with the statistics of its text.

    Written for throughput: plain character classes, one pass each; patterns with alternatives only see the lines
    that hold one of their characters.
    """
    t = F.col("t")
    d = df.select(F.col(key).alias("doc_id"), F.col(text).alias("t")).withColumn("n_chars", F.length(t)).withColumn("low", F.lower(t))
    d = d.withColumn("lines", F.filter(F.split(t, "\n"), lambda x: F.trim(x) != ""))
    d = d.withColumn("words", F.split(F.trim(F.regexp_replace("low", _NO_WORD, " ")), " "))
    d = d.withColumn("n_words", F.when(F.element_at("words", 1) == "", 0).otherwise(F.size("words"))).withColumn("n_lines", F.size("lines"))
    d = d.withColumn("letters", F.aggregate("words", F.lit(0), lambda a, w: a + F.length(w)))
    # what is no letter, a fifth of a text, holds all that these four count
    d = d.withColumn("rest", F.regexp_replace(t, "[A-Za-z\\u00c0-\\u024f]+", ""))
    d = d.withColumn("digits", _left_out(F.col("rest"), "[0-9]+")).withColumn("spaces", _left_out(F.col("rest"), "[ \\n\\t\\r]+"))
    d = d.withColumn("stops", _left_out(F.col("rest"), "[.!?…]+")).withColumn("marks", F.col("stops") + _left_out(F.col("rest"), "[,;:]+"))
    d = d.withColumn("ends", F.transform("lines", lambda x: F.substring(F.rtrim(x), -2, 2)))
    columns = lambda x: (x.contains("\t") | x.contains("   ") | x.contains("|") | x.contains("│") | x.contains("┃") | x.contains("---") | x.contains("───") | x.contains("===")) & x.rlike(_COLUMNS)
    marked = lambda x: F.trim(x).rlike(_MARK)
    d = d.withColumn("list_lines", F.filter("lines", lambda x: (F.length(x) <= 120) & (marked(x) & (F.size(F.split(F.trim(x), " +")) <= 11) & ~columns(x) | x.contains("....") & x.rlike(r"\.{4,}\s*\d+\s*$"))))
    d = d.withColumn("table_lines", F.filter("lines", lambda x: columns(x) | (x.contains(",") | x.contains(";")) & x.rlike(_CELLS) & ~marked(x)))
    d = d.withColumn("bare_lines", F.filter("lines", lambda x: (F.length(F.trim(x)) <= 52) & ~F.substring(F.rtrim(x), -1, 1).isin(*".,;:!?…\"'”’»)") & (F.size(F.split(F.trim(x), " +")) <= 9)))
    # one-line lists: short parts between separators, of which few read as sentences
    few = (F.col("n_lines") <= 3) & (F.col("stops") < 0.03 * F.col("n_words"))
    d = d.withColumn("parts", F.when(few, F.filter(F.split(F.regexp_replace(t, r"^[^:\n]{0,40}:\s", ""), r" */ +| *[;,] *| +[·•|] +"), lambda x: x != "")).otherwise(F.array(t)))
    common = F.size(F.filter("words", lambda w: w.isin(sorted(set(COMMON)))))
    n_words, n_lines, n_chars = F.col("n_words"), F.col("n_lines"), F.col("n_chars")
    return d.select(
        "doc_id",
        "n_chars",
        "n_words",
        "n_lines",
        _share(F.col("letters"), n_words).alias("mean_word_length"),
        _share(n_chars - F.col("letters") - F.col("digits") - F.col("spaces"), n_chars).alias("symbol_ratio"),
        _share(F.col("digits"), n_chars).alias("digit_ratio"),
        _share(F.size(F.filter("ends", lambda x: x.rlike(r"[.!?…][\"'”’»)]?$"))), n_lines).alias("ending_share"),
        _share(F.size(F.filter("ends", lambda x: x.rlike(r"[,;:][\"'”’»)]?$"))), n_lines).alias("comma_ending_share"),
        _share(common, n_words).alias("common_share"),
        _share(F.size(F.array_distinct("words")), n_words).alias("distinct_share"),
        _share(_chars(F.col("list_lines")), n_chars).alias("list_share"),
        _share(_chars(F.col("table_lines")), n_chars).alias("table_share"),
        _share(_chars(F.col("bare_lines")), n_chars).alias("bare_share"),
        F.when(t.contains("<") | t.contains("&") | t.contains("{") | t.contains("data:"), _share(_chars(F.filter("lines", lambda x: x.rlike(_MARKUP))), n_chars)).otherwise(0.0).alias("markup_share"),
        F.when(t.contains("�") | t.contains("Ã") | t.contains("â"), _share(n_chars - F.length(F.translate(t, _MOJI, "")), n_chars)).otherwise(0.0).alias("moji_ratio"),
        _share(_left_out(F.col("low"), "[bcdfghjklmnpqrstvwxz]{5,}"), F.col("letters")).alias("gibberish_share"),
        _share(_left_out(t, r"[^ \n\t\r]{31,}"), n_chars).alias("long_token_share"),
        _share(F.col("marks"), n_words).alias("mark_rate"),
        _share(F.col("stops"), n_words).alias("stop_rate"),
        F.size("parts").alias("n_parts"),
        _share(n_words, F.size("parts")).alias("words_per_part"),
        _share(F.size(F.filter("parts", lambda p: p.rlike(r"^[A-ZÀ-Þ\d][^.!?]*$"))), F.size("parts")).alias("title_part_share"),
        _share(n_words, n_lines).alias("words_per_line"),
    )


def votes() -> list[tuple[str, Column]]:
    """The labelling functions: name, and vote 0..3 (index in TYPES) or 9 for none."""
    c = F.col

    def fn(*pairs: tuple[Column, int]) -> Column:
        w = F.when(F.lit(False), 9)
        for cond, y in pairs:
            w = w.when(cond, y)
        return F.coalesce(w, F.lit(9))

    inline = (c("n_parts") >= 5) & (c("words_per_part") <= 5.5) & ((c("title_part_share") >= 0.7) & (c("stop_rate") < 0.03) | (c("stop_rate") < 0.005)) & (c("n_lines") <= 3) & (c("gibberish_share") < 0.1)
    tabled = c("table_share") >= 0.5
    return [
        ("marked_lines", fn((c("list_share") >= 0.5, 1), ((c("list_share") < 0.2) & (c("table_share") < 0.2) & (c("bare_share") < 0.3) & ~inline & (c("markup_share") < 0.2), 0))),
        ("delimited_lines", fn((tabled & (c("markup_share") < 0.4), 2))),
        ("bare_lines", fn((((c("bare_share") + c("list_share")) >= 0.6) & ~tabled & (c("symbol_ratio") < 0.25) & (c("common_share") >= 0.03) & (c("n_lines") >= 3) & (c("gibberish_share") < 0.1) & ((c("stop_rate") < 0.02) | (c("list_share") >= 0.3)), 1))),
        ("one_line_list", fn((inline, 1))),
        ("sentences", fn((c("stop_rate").between(0.015, 0.3) & (c("common_share") >= 0.08) & (c("list_share") < 0.5) & ~tabled & (c("markup_share") < 0.5) & (c("gibberish_share") < 0.1) & (c("moji_ratio") < 0.03), 0))),
        ("line_ends", fn(((c("ending_share") + c("comma_ending_share") >= 0.5) & (c("list_share") < 0.4) & (c("markup_share") < 0.3) & (c("common_share") >= 0.12), 0), ((c("ending_share") < 0.1) & (c("n_lines") >= 6) & (c("words_per_line") < 7) & ~tabled & (c("list_share") >= 0.3), 1))),
        ("common_words", fn((c("common_share") >= 0.25, 0), ((c("common_share") < 0.04) & ~tabled & (c("list_share") < 0.3), 3))),
        ("symbols", fn(((c("symbol_ratio") > 0.3) & (~tabled | (c("digit_ratio") < 0.05) & (c("n_words") * c("mean_word_length") < 0.15 * c("n_chars"))), 3), ((c("symbol_ratio") < 0.05) & (c("digit_ratio") < 0.03) & (c("stop_rate") > 0.01), 0))),
        ("digits", fn(((c("digit_ratio") > 0.12) & (c("table_share") >= 0.3), 2), ((c("digit_ratio") > 0.6) & ~tabled, 3))),
        ("mojibake", fn((c("moji_ratio") > 0.06, 3))),
        ("markup", fn((c("markup_share") > 0.5, 3))),
        ("gibberish", fn(((c("gibberish_share") > 0.25) & ~tabled, 3))),
        ("long_tokens", fn((c("long_token_share") > 0.5, 3))),
        ("repetition", fn(((c("distinct_share") < 0.08) & (c("n_words") >= 15), 3), ((c("n_words") == 0) & ~tabled, 3))),
        ("no_marks", fn(((c("mark_rate") < 0.01) & (c("words_per_line") >= 9) & (c("n_words") >= 12) & ~tabled & ~inline, 3))),
    ]


def fit(patterns: list[tuple[str, int]], rounds: int = 60, trust: float = 0.85, prior: float = 0.5) -> np.ndarray:
    """EM over ``(pattern, count)``; returns the posterior of each pattern."""
    return learned(patterns, rounds, trust, prior)[0]


def learned(patterns: list[tuple[str, int]], rounds: int = 60, trust: float = 0.85, prior: float = 0.5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of each pattern, and the table of vote given type of each function as it ends and as it began.

    Model: a type, and given the type each function votes independently. Starts from ``trust`` in every function;
    pseudo-counts of ``prior`` times the documents *of the type* keep functions that rarely vote near that start, at
    any size of the corpus and of the type.
    """
    n_fn = len(patterns[0][0])
    v = np.array([[{"0": 0, "1": 1, "2": 2, "3": 3}.get(ch, 4) for ch in p] for p, _ in patterns])
    n = np.array([c for _, c in patterns], dtype=float)
    k = len(TYPES)
    start = np.full((n_fn, k, 5), 0.0)
    for f in range(n_fn):
        cast = sorted(set(v[:, f].tolist()) - {4})
        rate = [n[v[:, f] == x].sum() / n.sum() for x in range(4)]
        for y in range(k):
            for x in cast:
                # a vote is far more likely under its own type than under another, however rarely it is cast
                own = min(max(rate[x] / (0.75 if x == 0 else 0.08) * trust, 0.15), 0.9)
                start[f, y, x] = own if x == y else max(min(rate[x], own) * (1 - trust), 1e-4)
            start[f, y, 4] = max(1 - start[f, y, :4].sum(), 0.05)
            start[f, y] += 1e-4
            start[f, y] /= start[f, y].sum()
    emit, mix = start.copy(), np.array([0.7, 0.1, 0.1, 0.1])
    post = np.zeros((len(v), k))
    for _ in range(rounds):
        ll = np.log(mix)[None, :] + sum(np.log(emit[f][:, v[:, f]]).T for f in range(n_fn))
        ll -= ll.max(1, keepdims=True)
        new = np.exp(ll)
        new /= new.sum(1, keepdims=True)
        done = np.abs(new - post).max() < 1e-6
        post = new
        if done:
            break
        w = post * n[:, None]
        mix = (w.sum(0) + 1) / (w.sum() + k)
        emit = start * (prior * w.sum(0) + 1)[None, :, None]
        for f in range(n_fn):
            for x in range(5):
                emit[f, :, x] += w[v[:, f] == x].sum(0)
        emit /= emit.sum(2, keepdims=True)
    return post, emit, start


def _patterns(df: DataFrame, key: str, text: str) -> tuple[DataFrame, list[tuple[str, int]]]:
    pattern = F.concat(*[v.cast("string") for _, v in votes()])
    stats = materialise(statistics(df, key, text).withColumn("pattern", F.when(F.col("n_words").isNotNull() & (F.col("n_lines") > 0), pattern)))
    return stats, [(r["pattern"], r["n"]) for r in stats.where("pattern is not null").groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect()]


def trust(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``function, text_class, vote, at_start, learned``: how likely each function casts each vote on texts of each type."""
    counts = _patterns(df, key, text)[1]
    schema = "function string, text_class string, vote string, at_start double, learned double"
    if not counts:
        return df.sparkSession.createDataFrame([], schema)
    _, emit, start = learned(counts)
    rows = [(name, t, "none" if x == 4 else TYPES[x], float(start[f, y, x]), float(emit[f, y, x])) for f, (name, _) in enumerate(votes()) for y, t in enumerate(TYPES) for x in range(5)]
    return df.sparkSession.createDataFrame(rows, schema)


def classify(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Statistics, ``text_class`` and its posterior (``p_prose`` .. ``p_junk``) of every row."""
    spark = df.sparkSession
    stats, counts = _patterns(df, key, text)
    types = ", ".join(f"p_{t} double" for t in TYPES)
    post = fit(counts) if counts else []
    table = spark.createDataFrame([(p, TYPES[int(np.argmax(q))], *map(float, q)) for (p, _), q in zip(counts, post)], f"pattern string, text_class string, {types}")
    return stats.join(F.broadcast(table), "pattern", "left").withColumn("text_class", F.coalesce("text_class", F.lit("junk")))
