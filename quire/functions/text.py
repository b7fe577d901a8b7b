"""Scalar text functions as Catalyst expressions. Nothing here starts a Python worker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse(c: Column) -> Column:
    """Runs of white space as one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def or_default(c: Column, default: Column) -> Column:
    """``default`` where ``c`` is null or empty (an empty value counts as missing)."""
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), default)


def capped(c: Column, n: int) -> Column:
    """Trimmed, null if empty, at most ``n`` characters."""
    return F.left(F.nullif(F.trim(c), F.lit("")), F.lit(n))


def strip_tags(c: Column) -> Column:
    """Markup removed, white space collapsed."""
    return collapse(F.regexp_replace(c, r"<[^>]*>", " "))


#: What the five XML entities and the space that does not break stand for.
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def unescaped(c: Column) -> Column:
    """Entities as the characters they stand for, the ampersand last."""
    for a, b in _ENTITIES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def markup_free(c: Column) -> Column:
    """Entities resolved, tags out, double underlines and pilcrows as spaces, white space collapsed."""
    return collapse(F.translate(F.replace(F.regexp_replace(unescaped(F.coalesce(c, F.lit(""))), "<[^>]*>", " "), F.lit("__"), F.lit(" ")), "¶", " "))


def context_gloss(c: Column) -> Column:
    """A gloss in context without brackets and pilcrows, slashes set apart."""
    return collapse(F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), "¶<>[]", ""), r"\s*/\s*", " / "))


def first_strong(c: Column) -> Column:
    """The first lexicon number of a field, or null."""
    return F.nullif(F.regexp_extract(c, r"([GH]\d{4,5}[A-Z]?)", 1), F.lit(""))


def all_strongs(c: Column) -> Column:
    """All lexicon numbers of a field in order, each once."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"([GH]\d{4,5}[A-Z]?)")))


def reference(book: Column, chapter: Column, first: Column, last: Column) -> Column:
    """``Book 3``, ``Book 3:4`` or ``Book 3:4-6``."""
    return F.when(first.isNull(), F.concat_ws(" ", book, chapter)).when(last.isNull() | (last == first), F.concat(book, F.lit(" "), chapter, F.lit(":"), first)).otherwise(F.concat(book, F.lit(" "), chapter, F.lit(":"), first, F.lit("-"), last))


def summary(c: Column, n: int = 360) -> Column:
    """Plain text of at most ``n`` characters."""
    return F.left(strip_tags(F.coalesce(c, F.lit(""))), F.lit(n))


def slug(c: Column, n: int = 96, fallback: str = "section") -> Column:
    """Lower case letters and digits joined by single hyphens."""
    s = F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")
    return or_default(F.left(F.regexp_replace(s, "^-+|-+$", ""), F.lit(n)), F.lit(fallback))


def terms(c: Column, shortest: int = 3, stop: tuple[str, ...] = ()) -> Column:
    """Distinct lower-case words of letters and digits, of at least ``shortest`` characters."""
    ws = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)")))
    return F.filter(ws, lambda w: (F.length(w) >= shortest) & ~w.isin(list(stop)) if stop else F.length(w) >= shortest)


def blob_sha1(c: Column) -> Column:
    """The SHA-1 that version control gives the text: of a header with its length, then the text."""
    return F.sha1(F.concat(F.encode(F.lit("blob "), "UTF-8"), F.encode(F.octet_length(c).cast("string"), "UTF-8"), F.unhex(F.lit("00")), F.encode(c, "UTF-8")))


def reference_form(c: Column) -> Column:
    """A typed reference in one form: no dots, plain hyphens, single spaces, lower case, tight colons and hyphens."""
    s = F.regexp_replace(F.translate(c, "–—.", "--"), r"\s+", " ")
    return F.regexp_replace(F.lower(F.trim(s)), r"\s*([:-])\s*", "$1")


def video_id(c: Column) -> Column:
    """Eleven-character id of a video from its long, short, embedded or live address, or the bare id."""
    got = F.coalesce(*[F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in (r"[?&]v=([A-Za-z0-9_-]{11})(?:[&#]|$)", r"youtu\.be/([A-Za-z0-9_-]{11})", r"/(?:embed|live|shorts)/([A-Za-z0-9_-]{11})", r"^([A-Za-z0-9_-]{11})$")])
    return got


def safe_url(c: Column, image: bool = False) -> Column:
    """The address if its scheme is allowed (https only for images) or it is relative, else null."""
    scheme = F.lower(F.regexp_extract(F.trim(c), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    ok = scheme == "https" if image else scheme.isin("http", "https", "mailto", "tel", "")
    return F.when(ok & ~F.trim(c).rlike(r"[\x00-\x20]"), F.trim(c))


def page_path(c: Column) -> Column:
    """Path of a page without query or fragment, with one leading slash; ``/`` and folders as their index page."""
    p = F.regexp_replace(F.regexp_replace(F.trim(c), r"^[a-z]+://[^/]*", ""), r"[?#].*$", "")
    p = F.concat(F.lit("/"), F.regexp_replace(p, "^/+", ""))
    return F.when(p.endswith("/"), F.concat(p, F.lit("index.html"))).otherwise(p)


def feast_year(month: Column, day: Column, common: int = 2026, leap: int = 2028) -> Column:
    """The year a yearly feast is first written for: a leap year for 29 February."""
    return F.when((month == 2) & (day == 29), F.lit(leap)).otherwise(F.lit(common))


def calendar_escape(c: Column) -> Column:
    """Text as calendar files write it: backslash, comma, semicolon and line end escaped."""
    s = F.regexp_replace(c, r"([\\,;])", r"\\$1")
    return F.regexp_replace(s, r"\r?\n", r"\\n")


def leading_int(c: Column, otherwise: int = 1_000_000_000) -> Column:
    """The integer that a label starts with; labels that start otherwise sort last."""
    return F.coalesce(F.regexp_extract(c, "^([0-9]+)", 1).try_cast("int"), F.lit(otherwise))


#: Elements that stay, and schemes that a link may have.
SAFE_ELEMENTS = ("p", "br", "em", "strong", "b", "i", "ul", "ol", "li", "h2", "h3", "blockquote", "a")
SAFE_SCHEMES = ("http", "https", "mailto", "tel")


def sanitised(c: Column, allowed: tuple[str, ...] = SAFE_ELEMENTS) -> Column:
    """Markup of which only the allowed elements are left; scripts and styles go with their content.

    Of the attributes only the address of a link stays, if it is relative or of an allowed scheme.
    """
    s = F.regexp_replace(c, r"(?is)<(script|style|iframe|object|template)\b.*?(?:</\1\s*>|$)|<!--.*?(?:-->|$)", "")
    names = "|".join(allowed)
    s = F.regexp_replace(s, rf"(?i)<(?!/?(?:{names})\b)[^>]*>?", "")
    # links with a safe address first, under marks that no text holds; the rest lose their attributes
    s = F.translate(s, "\x01\x02", "")
    schemes = "|".join(SAFE_SCHEMES)
    s = F.regexp_replace(s, rf"""(?i)<a\b[^>]*?\bhref\s*=\s*["']((?:(?:{schemes}):|[/#?]|(?![a-z][a-z0-9+.-]*:))[^"'<>\s\x00-\x20]*)["'][^>]*>""", "\x01a href=\"$1\"\x02")
    s = F.regexp_replace(s, rf"(?i)<(/?)({names})\b[^>]*>?", "<$1$2>")
    return F.translate(s, "\x01\x02", "<>")
