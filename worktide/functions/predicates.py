"""Rules as boolean columns or named reasons, from tables of words."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from worktide.functions import text as T


def keyword_hit(text: Column, words: list[str]) -> Column:
    """The first keyword found, else null. ASCII words need word borders, others
    may stand anywhere."""
    ascii_words = sorted((w.lower() for w in words if w.isascii()), key=len, reverse=True)
    others = sorted((w.lower() for w in words if not w.isascii()), key=len, reverse=True)
    parts = [rf"(?<![a-z0-9])(?:{'|'.join(map(re.escape, ascii_words))})(?![a-z0-9])"] * bool(ascii_words) + ["|".join(map(re.escape, others))] * bool(others)
    return T.blank_to_null(F.regexp_extract(F.lower(text), "(" + "|".join(parts) + ")", 1)) if parts else F.lit(None).cast("string")


def redact_lines(text: Column, words: list[str]) -> Column:
    """Without the lines that hold a keyword; headings (#) stay."""
    keep = lambda line: keyword_hit(line, words).isNull() | F.startswith(F.ltrim(line), F.lit("#"))
    return F.array_join(F.filter(F.split(text, "\n"), keep), "\n")


def has_token_suffix(text: Column, endings: list[str], first: int = 8) -> Column:
    """Whether one of the first tokens is an ending, or ends in it behind something
    that is not a number."""
    words = F.slice(F.split(F.lower(T.collapse(text)), " "), 1, first)

    def fits(w: Column) -> Column:
        out = F.lit(False)
        for e in endings:
            stem = F.substring(w, F.lit(1), F.length(w) - len(e))
            out = out | (w == e) | (F.endswith(w, F.lit(e)) & (F.length(w) > len(e)) & ~stem.rlike(r"^\d+$"))
        return out

    return F.exists(words, fits)


def is_absence(subject: Column, words: list[str], guards: list[str]) -> Column:
    """A leave word unless a guard word (notice, statistics, survey) vetoes it."""
    return keyword_hit(subject, words).isNotNull() & keyword_hit(subject, guards).isNull()


def is_half_day(subject: Column) -> Column:
    return F.lower(subject).rlike(r"(?<![a-z0-9])(half[ -]?day|am off|pm off|a\.m\.|p\.m\.)")


def meeting_skip(subject: Column, response: Column, busy: Column, tentative: str = "skip") -> Column:
    """Why a calendar entry is no meeting, else null."""
    return (
        F.when(F.lower(subject).rlike(r"^\s*(cancel?led|canceled)\b"), "cancelled")
        .when(response == 4, "declined")
        .when((busy == 0) & ~response.isin(1, 3), "free")
        .when((response == 2) & (busy == 1) & F.lit(tentative == "skip"), "tentative")
    )


def is_view_only(folder: Column, modified: Column, target: Column, paths: list[str]) -> Column:
    """A document that was looked at: under a temporary path, or last changed more than
    two minutes before it was opened."""
    low = F.lower(F.replace(F.coalesce(folder, F.lit("")), F.lit("\\"), F.lit("/")))
    under = F.lit(False)
    for path in paths:
        under = under | F.contains(low, F.lit(path.lower().replace("\\", "/")))
    return under | F.coalesce(F.timestamp_diff("SECOND", target, modified) > 120, F.lit(False))


def is_ide(process: Column, title: Column, hints: list[str], endings: list[str]) -> Column:
    """A window of a programming tool: a hint in its name or title, or a file of code."""
    both = F.lower(F.concat_ws(" ", F.coalesce(process, F.lit("")), F.coalesce(title, F.lit(""))))
    out = F.lit(False)
    for h in hints:
        out = out | F.contains(both, F.lit(h))
    for e in endings:
        out = out | F.contains(both, F.lit(e + " ")) | F.endswith(both, F.lit(e))
    return out


def is_noise(process: Column, prefixes: list[str]) -> Column:
    """No program that a person uses: nameless, or a service by its beginning."""
    name = F.regexp_replace(F.lower(F.trim(F.coalesce(process, F.lit("")))), r"\.exe$", "")
    out = name == ""
    for p in prefixes:
        out = out | F.startswith(name, F.lit(p))
    return out


def is_notice(sender: Column, words: list[str], generic: list[str]) -> Column:
    """A sender of notices, by the parts of the shown name: a generic word must be a
    whole part, a word of several parts may stand anywhere, others begin a part."""
    low = F.lower(F.trim(F.coalesce(sender, F.lit(""))))
    cut = r"[\s/|,;()\[\]<>\"'@._-]+"
    parts = F.filter(F.split(low, cut), lambda x: x != "")
    out = F.lit(False)
    for w in words:
        if re.search(cut, w):
            out = out | F.contains(low, F.lit(w))
        elif w in generic:
            out = out | F.array_contains(parts, w)
        else:
            out = out | _begins(parts, w)
    return out


def _begins(parts: Column, word: str) -> Column:
    return F.exists(parts, lambda x: F.startswith(x, F.lit(word)))


def snap(value: Column, names: list[str]) -> Column:
    """The category whose key equals a value's, else the only one that shares its first
    three letters with it, else empty: no guess between several."""
    key, keys = T.identity_key(value), {re.sub(r"[\s_\-./·,]+", "", n.lower()): n for n in names}
    exact = F.coalesce(*(F.when(key == k, F.lit(n)) for k, n in keys.items()), F.lit(None).cast("string"))
    close = F.filter(F.array(*(F.when(F.startswith(F.lit(k), F.substring(key, 1, 3)) | F.startswith(key, F.lit(k[:3])), F.lit(n)) for k, n in keys.items())), lambda x: x.isNotNull())
    only = F.when((key != "") & (F.size(F.array_distinct(close)) == 1), F.element_at(F.array_distinct(close), 1))
    return F.coalesce(exact, only, F.lit(""))


def match_score(text: Column, name: str, keywords: list[str], described: list[str]) -> Column:
    """1 for a project's name or a keyword of it, 0.67 for two words of its
    description, else 0."""
    low, words = F.lower(F.coalesce(text, F.lit(""))), T.tokens(text)
    named = token_hit(words, name) | (F.contains(low, F.lit(name.lower())) if len(name) >= 5 else F.lit(False))
    for k in keywords:
        named = named | (token_hit(words, k) if len(k) >= 2 else F.lit(False))
    common = F.size(F.array_intersect(words, F.array(*map(F.lit, described)))) if described else F.lit(0)
    return F.when(low == "", 0.0).when(named, 1.0).when(common >= 2, 0.67).otherwise(0.0)


def is_block(busy: Column, minutes: Column, offsite: Column) -> Column:
    """A calendar block that is not a meeting: free, or long without a status."""
    return (busy == 0) | (busy.isNull() & (minutes > 300) & ~offsite)


def is_off_site(all_day: Column, minutes: Column, busy: Column, word: Column) -> Column:
    return (all_day | (minutes >= 360)) & (busy.isin(3, 4) | ((busy == 2) & word))


def is_me(author: Column, names: list[str]) -> Column:
    """Blank is me; else a name equals the author or, of three letters or more, is in it."""
    key = T.identity_key(author)
    mine = [re.sub(r"[\s_\-./·,]+", "", n.lower()) for n in names]
    out = key == ""
    for n in mine:
        out = out | (key == n) | (F.contains(key, F.lit(n)) if len(n) >= 3 else F.lit(False))
    return out


def first_rule(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The label of the first pattern that matches."""
    out = F.lit(default)
    for pattern, label in reversed(rules):
        out = F.when(F.lower(text).rlike(pattern), label).otherwise(out)
    return out


def longest_prefix(value: Column, prefixes: dict[str, str]) -> Column:
    """The label of the longest prefix of a value; a literal table."""
    ordered = sorted(prefixes, key=len, reverse=True)
    low = F.lower(value)
    return F.coalesce(*(F.when(F.startswith(low, F.lit(p.lower())), F.lit(prefixes[p])) for p in ordered), F.lit(None).cast("string"))


def is_placeholder(text: Column) -> Column:
    return F.trim(text).rlike(r"^<[^<>]*>$")


def token_hit(words: Column, keyword: str) -> Column:
    """All parts of a keyword occur among tokens: equal, or as a beginning or end
    from four letters on, or nearly equal from five on (at most one edit in ten)."""
    out = F.lit(True)
    for part in keyword.lower().split():
        out = out & _near(words, part)
    return out


def _near(words: Column, part: str) -> Column:
    n, part = len(part), F.lit(part)

    def fits(w: Column) -> Column:
        out = w == part
        if n >= 4:
            out = out | F.startswith(w, part) | F.endswith(w, part)
        if n >= 5:
            out = out | (F.levenshtein(w, part) * 10 <= F.greatest(F.length(w), F.lit(n)))
        return out

    return F.exists(words, fits)
