"""Functions over Greek and Hebrew words for which Spark has no built-in: Arrow functions over whole batches."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def fold(word: str | None) -> str | None:
    """Case-folded letters of a word without any mark: the key under which forms of one word meet."""
    if word is None:
        return None
    return "".join(c for c in unicodedata.normalize("NFD", word).casefold() if c.isalpha() and not unicodedata.combining(c))


def fold_hebrew(word: str | None) -> str | None:
    """Hebrew letters of a word without points and accents."""
    if word is None:
        return None
    return "".join(c for c in unicodedata.normalize("NFD", word) if "֐" <= c <= "׿" and not unicodedata.combining(c))


def align_key(word: str | None) -> str | None:
    """Composed, case-folded word without punctuation, elision or editorial marks."""
    if word is None:
        return None
    # folding may take composed letters apart again
    return "".join(c for c in unicodedata.normalize("NFC", word.casefold()) if unicodedata.category(c)[0] not in "PSZC" and c not in "ʼ")


def build_key(word: str | None) -> str | None:
    """Letters of a word alone, case-folded, marks and punctuation dropped before anything else: the key that indexes are built under."""
    if word is None:
        return None
    return "".join(c for c in unicodedata.normalize("NFD", word.casefold()) if unicodedata.category(c)[0] not in "MP" and c.isalpha())


def plain_ascii(text: str | None) -> str | None:
    """ASCII characters of the compatibility form."""
    return None if text is None else unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode("ascii")


def nfkc(text: str | None) -> str | None:
    """The compatibility form, composed."""
    return None if text is None else unicodedata.normalize("NFKC", text)


#: The usual letters.
_LATIN = dict(zip("αβγδεζηθικλμνξοπρστυφχψως", "a b g d e z ē th i k l m n x o p r s t y ph ch ps ō s".split()))


def transliterate(word: str | None) -> str | None:
    """Latin letters for Greek ones: rough breathing as h, initial rho as rh, iota subscript dropped, diphthong u."""
    if word is None:
        return None
    out: list[str] = []
    rough = False
    base = [(c, [m for m in ms]) for c, ms in _clusters(word)]
    for i, (c, marks) in enumerate(base):
        low = c.lower()
        s = _LATIN.get(low)
        if s is None:
            continue
        if low == "υ" and i and base[i - 1][0].lower() in "αεοη" and "̈" not in marks:
            s = "u"
        if low == "γ" and i + 1 < len(base) and base[i + 1][0].lower() in "γκξχ":
            s = "n"
        if "̔" in marks:
            rough = True
            if low == "ρ":
                s = "rh"
        out.append(s)
    word_out = "".join(out)
    if rough and not word_out.startswith("rh"):
        word_out = "h" + word_out
    first = next((c for c, _ in base if c.isalpha()), "")
    return word_out[:1].upper() + word_out[1:] if first.isupper() else word_out


def _clusters(word: str):
    cur, marks = "", []
    for c in unicodedata.normalize("NFD", word):
        if unicodedata.combining(c):
            marks.append(c)
        else:
            if cur:
                yield cur, marks
            cur, marks = c, []
    if cur:
        yield cur, marks


def _vector(fn):
    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        # words repeat: each distinct word of a batch is worked out once
        return s.map({w: fn(w) for w in s.dropna().unique()})

    return run


fold_udf, fold_hebrew_udf, align_key_udf, transliterate_udf = map(_vector, (fold, fold_hebrew, align_key, transliterate))
build_key_udf, ascii_udf, nfkc_udf = map(_vector, (build_key, plain_ascii, nfkc))
