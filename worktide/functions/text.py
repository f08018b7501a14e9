"""Text functions as columns: folding, keys, tokens, notes, similarity, parsing.

Native expressions throughout; ``nfkc`` alone needs Python and is meant for the
small dimension of distinct names.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F

# Reply prefixes, file endings that carry a version, compound endings.
REPLY = r"(?i)^\s*(?:(?:re|fw|fwd|aw|wg)\s*:\s*)+"
VERSIONED = r"\.(prt|asm|drw|frm|sec|lay|mfg|gph|neu)\.\d{1,4}$"
COMPOUND = ("cas.gz", "dat.gz", "cas.h5", "dat.h5", "msh.h5", "msh.gz", "tar.gz", "tar.bz2")


def collapse(text: Column, most: int | None = None) -> Column:
    out = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.substring(out, 1, most) if most else out


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def minutes_of(text: Column) -> Column:
    """HH:MM to minutes of the day; 24:00 is 1440, anything else wrong is null."""
    hour, minute = (F.try_to_number(F.regexp_extract(F.trim(text), r"^(\d{1,2}):(\d{2})$", g), F.lit("99")).cast("int") for g in (1, 2))
    return F.when((minute < 60) & ((hour < 24) | ((hour == 24) & (minute == 0))), hour * 60 + minute)


def strict_timestamp(text: Column) -> Column:
    """Three formats; a time part that does not parse gives null, not midnight."""
    value = F.trim(text)
    formats = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")
    tries = [F.when(F.length(value) == len(f), F.try_to_timestamp(value, F.lit(f))) for f in formats]
    return F.coalesce(*tries).cast("timestamp_ntz")


def fold(name: Column) -> Column:
    """Lower case, separators to one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[\s_\-./·,]+", " "))


def nfkc(names: Column) -> Column:
    import unicodedata

    def normal(batch: pd.Series) -> pd.Series:
        return batch.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s).casefold())

    normal.__annotations__ = {"batch": pd.Series, "return": pd.Series}
    return F.pandas_udf(normal, "string")(names)


def identity_key(name: Column) -> Column:
    return F.regexp_replace(fold(name), " ", "")


def note(name: Column) -> Column:
    """Text in the final parentheses, else empty."""
    return F.regexp_extract(F.coalesce(name, F.lit("")), r"\(([^()]*)\)\s*$", 1)


def without_note(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"\([^()]*\)\s*$", ""))


def numbers(name: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit(r"(\d+)"), 1)))


def base_name(name: Column) -> Column:
    """Lower case, without the extension and a version number behind it; a name that
    is all extension stays."""
    low = F.lower(F.trim(name))
    bare, ext = F.regexp_replace(low, r"\.\d{1,4}$", ""), extension(name)
    known = (ext != "") & F.endswith(bare, F.concat(F.lit("."), ext))
    cut = F.when(known, F.substr(bare, F.lit(1), F.length(bare) - F.length(ext) - 1)).otherwise(F.regexp_replace(bare, r"(?<=[^.])\.[^.]*$", ""))
    return F.coalesce(blank_to_null(cut), low)


def extension(name: Column) -> Column:
    """Lower-case extension: compound ones whole, the ending in front of a version
    number where files are numbered so, else what follows the last dot."""
    low = F.lower(F.trim(name))
    plain = F.regexp_extract(low, r"^\.*[^.]+.*\.([^.]+)$", 1)
    return F.coalesce(blank_to_null(F.regexp_extract(low, VERSIONED, 1)), *(F.when(F.endswith(low, F.lit("." + c)), F.lit(c)) for c in COMPOUND), plain)


def signal_name(text: Column) -> Column:
    """The file's name in a signal's text: before hint and folder, lower case, without
    the notes on size."""
    head = F.substring_index(F.substring_index(F.coalesce(text, F.lit("")), " \u00a7 ", 1), " | folder:", 1)
    return F.trim(F.regexp_replace(F.lower(F.trim(head)), r"( and \d+ more| \((?:batch|output) \d+\))+$", ""))


def person(name: Column) -> Column:
    """A person's name or account to compare: no domain, mail host, note or separators."""
    account = F.substring_index(F.substring_index(F.lower(F.trim(F.coalesce(name, F.lit("")))), "\\", -1), "@", 1)
    return F.regexp_replace(F.regexp_replace(account, r"[(\[/|].*$", ""), r"[\s._\-]+", "")


def loose(name: Column) -> Column:
    """fold(), with brackets as separators too."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[\s_\-./·,()\[\]{}]+", " "))


def core(text: Column, most: int = 60) -> Column:
    """What a subject is about: reply prefixes and leading brackets off, up to four
    times, one space between words."""
    out = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    for _ in range(4):
        out = F.regexp_replace(F.regexp_replace(out, r"^\s*(re|fw|fwd|aw|wg)\s*[:)\]]\s*", ""), r"^\s*[\[(][^\])]{0,24}[\])]\s*", "")
    return F.substring(F.regexp_replace(out, r"\s+", " "), 1, most)


def detail_words(name: Column, stop: tuple[str, ...] = ("work", "task", "misc", "support", "and", "for")) -> Column:
    """The distinct words of a detail's name that tell it from others."""
    words = F.split(F.lower(F.coalesce(name, F.lit(""))), r"[\s_\-·/()\[\],]+")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*stop))))


def count_or(value: Column, items: Column, default: int = 0) -> Column:
    """A count written as a number, or as the list that it counts."""
    return F.coalesce(F.when(items.isNotNull(), F.size(items)), value.try_cast("double").cast("int"), F.lit(default))


def row_signature(*parts: Column) -> Column:
    """One hash of a row's parts; null is not the empty text."""
    return F.xxhash64(*(F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts))


def folder_label(path: Column, generic: tuple[str, ...] = ("documents", "desktop", "downloads", "data", "tmp", "temp")) -> Column:
    """The last part of a path that names something."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda p: (F.trim(p) != "") & ~F.lower(p).isin(*generic) & ~p.rlike(r"^[A-Za-z]:$") & ~p.rlike(r"^\d{2,4}([-_.]?\d{2}){0,2}$"))
    return F.element_at(F.when(F.size(parts) > 0, parts), -1)


def tokens(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """Distinct lower-case words of 2 to 24 letters; no digits, no stop words."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), REPLY, "")), r"[^\p{L}\p{N}]+", " ")
    keep = lambda w: (F.length(w) >= 2) & (F.length(w) <= 24) & ~w.rlike(r"\d")
    words = F.filter(F.split(F.trim(plain), " "), keep)
    return F.array_distinct(F.array_except(words, F.array(*map(F.lit, stop))) if stop else words)


def bigrams(name: Column) -> Column:
    key = identity_key(name)
    return F.when(F.length(key) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(key) - 1), lambda i: F.substr(key, i, F.lit(2)))))


def dice(a: Column, b: Column) -> Column:
    """Dice index of two sets (arrays without repeats)."""
    return F.when(F.size(a) + F.size(b) > 0, 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) - common > 0, common / (F.size(a) + F.size(b) - common)).otherwise(0.0)


def safe_key(owner: Column) -> Column:
    return F.substring(F.regexp_replace(F.trim(owner), r'[\\/:*?"<>|\s]+', "_"), 1, 40)


def domain_only(address: Column) -> Column:
    return F.coalesce(blank_to_null(F.regexp_extract(F.lower(address), r"(@[a-z0-9.-]+)", 1)), F.lit("(none)"))


def strip_html(html: Column) -> Column:
    """Text of a page: scripts, styles and tags out, common entities back."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return collapse(text)


def island(html: Column, element: str) -> Column:
    """The JSON inside the script element with an id."""
    return F.regexp_extract(html, rf'(?is)<script[^>]*\bid="{element}"[^>]*>(.*?)</script>', 1)


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def heat_bucket(value: Column, most: Column) -> Column:
    return F.when(most > 0, F.least(F.lit(5), F.floor(value / most * 6))).otherwise(0).cast("int")


def percent(value: Column) -> Column:
    """At most one decimal, no trailing zero."""
    return F.concat(F.regexp_replace(F.format_number(value, 1), r"\.0$", ""), F.lit("%"))


def number_or(value: Column, default: float) -> Column:
    number = value.try_cast("double")
    return F.when(number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")), F.lit(default)).otherwise(number)
