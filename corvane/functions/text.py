"""Text functions as Column expressions; none needs Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(text: Column, limit: int | None = None) -> Column:
    """No-break spaces become spaces, runs of white space one space, ends are trimmed; at most ``limit`` characters."""
    out = F.trim(F.regexp_replace(F.translate(text, " ", " "), r"[ \t\r\n\f\x0B]+", " "))
    return F.substring(out, 1, limit) if limit else out


def scrub(text: Column) -> Column:
    """Drops zero-width, private-use and replacement characters and URLs; squeezes spaces and blank lines."""
    out = F.regexp_replace(text, "[​-‍⁠﻿-�]", "")
    out = F.regexp_replace(out, r"https?://[^ \t\r\n]+", "")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    return F.trim(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def broken(text: Column) -> Column:
    """Composed form that keeps zero-width spaces, which part words: joiners become such spaces, marks of byte order go; spaces are squeezed,
    those around line feeds go, and at most one line stays empty."""
    from .udfs import nfc

    out = F.when(F.regexp_like(text, F.lit(r"[^\x00-\x7F]")), nfc(text)).otherwise(text)
    out = F.translate(out, "\u200c\u200d\ufeff", "\u200b\u200b")
    out = F.regexp_replace(F.regexp_replace(out, r"[\t\f\x0B ]+", " "), r" *\n *", "\n")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^[\s\p{Z}\x1C-\x1F\x85]+|[\s\p{Z}\x1C-\x1F\x85]+$", "")


def tokens(text: Column) -> Column:
    """Lower-case Latin and digit runs and Thai runs."""
    return F.regexp_extract_all(F.lower(text), F.lit("([ก-๙]+|[a-z0-9]+)"), F.lit(1))


def words(text: Column) -> Column:
    """Runs of letters of any script in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))


def compact(text: Column) -> Column:
    """Lower case without anything but a-z, digits and Thai."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9ก-๙]", "")


def unstretched(text: Column) -> Column:
    """A letter that repeats three times or more stays once."""
    return F.regexp_replace(text, r"(\p{L})\1{2,}", "$1")


def unspaced(text: Column) -> Column:
    """The normalised form without spaces, the same however a text is spaced: letters that repeat across a space are one run too."""
    return unstretched(F.replace(normalised(text), F.lit(" "), F.lit("")))


def normalised(text: Column) -> Column:
    """Composed form in lower case; Thai digits as ASCII, no commas between digits, unified dashes, comparisons in two signs.

    A letter that repeats three times or more stays once, digits as they are; signs other than .-฿<>= become spaces. White space is one space,
    and spaces, points and dashes go from the ends.
    """
    from .udfs import nfc

    # composed form matters only where there is more than ASCII
    out = F.lower(F.when(F.regexp_like(text, F.lit(r"[^\x00-\x7F]")), nfc(text)).otherwise(text))
    out = F.translate(F.translate(out, "๐๑๒๓๔๕๖๗๘๙–—−\u00a0", "0123456789--- "), "\u200b\ufeff", "")
    out = F.regexp_replace(out, r"(?<=[0-9]),(?=[0-9])", "")
    out = F.replace(F.replace(out, F.lit("≥"), F.lit(">=")), F.lit("≤"), F.lit("<="))
    out = unstretched(out)
    out = F.regexp_replace(out, r"[^\p{L}\p{N}_ก-๙\s.\-฿<>=]", " ")
    return F.regexp_replace(F.regexp_replace(out, r"\s+", " "), r"^[ .\-]+|[ .\-]+$", "")


def character_ngrams(text: Column, size: int = 2) -> Column:
    """Distinct n-grams; a shorter text is its own only one, an empty one has none."""
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substr(text, i, F.lit(size))))
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).when(F.length(text) <= size, F.array(text)).otherwise(grams)


def word_ngrams(text: Column, size: int = 3) -> Column:
    """Character n-grams within words that a space pads on both sides; a shorter padded word is its own only one."""
    padded = F.transform(words(text), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    grams = lambda w: F.when(F.length(w) <= size, F.array(w)).otherwise(F.transform(F.sequence(F.lit(1), F.length(w) - size + 1), lambda i: F.substr(w, i, F.lit(size))))
    return F.flatten(F.transform(padded, grams))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 for two empty sets."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def sentences(text: Column, least: int = 8) -> Column:
    """Parts between line feeds or after a terminator and a space, trimmed, at least ``least`` characters."""
    marked = F.regexp_replace(text, r"([.!?]) +", "$1\n")
    return F.filter(F.transform(F.split(marked, "\n"), lambda x: F.trim(x)), lambda s: F.length(s) >= least)


def first_phrase(text: Column, phrases: list[str]) -> Column:
    """The phrase that begins first, the longest of those; null if there is none."""
    found = F.filter(F.transform(F.array(*map(F.lit, phrases)), lambda p: F.struct(F.position(p, text).alias("at"), (-F.length(p)).alias("long"), p.alias("phrase"))), lambda x: x["at"] > 0)
    return F.array_min(found)["phrase"]


def without(text: Column, fillers: list[str]) -> Column:
    """The text with each filler removed in turn."""
    for filler in fillers:
        text = F.replace(text, F.lit(filler), F.lit(""))
    return F.trim(F.regexp_replace(text, " +", " "))


def comparison(text: Column) -> Column:
    """The two sides of "a vs b" or "a versus b", trimmed; null where there is no comparison."""
    parts = F.transform(F.split(text, r"(?i) (?:vs\.?|versus) ", 2), lambda x: F.trim(x))
    return F.when(F.size(parts) == 2, parts)


def citations(text: Column) -> Column:
    """Labels like S3 that stand in brackets, in order, once each."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[(S[0-9]+)\]"), F.lit(1)))


def without_citations(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\[S[0-9]+\]", ""), " +", " "))


def https_url(url: Column) -> Column:
    """https, lower-case host, no query, no fragment, no slash at the end; null for anything but http(s)."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"[?#].*$", ""), "/+$", "")
    host = F.lower(F.regexp_extract(bare, "^https?://([^/]*)", 1))
    path = F.regexp_extract(bare, "^https?://[^/]*(.*)$", 1)
    return F.when(host != "", F.concat(F.lit("https://"), host, path))


def tag_list(value: Column) -> Column:
    """A bracketed list of quoted tags or a pipe-separated one; trimmed, without empties."""
    inner = F.regexp_replace(F.regexp_replace(F.trim(value), r"^\[|\]$", ""), "['\"]", "")
    parts = F.when(F.trim(value).startswith("["), F.split(inner, ",")).otherwise(F.split(value, r"\|"))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda t: t != "")


def fenced_json(text: Column) -> Column:
    """The outermost {...} of a text with or without a code fence; null if there is none."""
    found = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def stable_id(*parts: Column, length: int = 16) -> Column:
    """First digits of the SHA-256 of the parts joined by bars; a null part is empty."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, length)


def key_text(value: Column) -> Column:
    """2106, 2106.0 and "2106" as one text; other texts trimmed."""
    whole = value.cast("string").try_cast("double")
    as_long = whole.try_cast("bigint")
    return F.when(whole.isNotNull() & (whole == as_long), as_long.cast("string")).otherwise(F.trim(value.cast("string")))


def dirty_date(value: Column) -> Column:
    """ISO, ``Mon dd, yyyy`` or ``dd/MM/yyyy``; null for anything else."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(value), F.lit(f)).cast("date") for f in ("yyyy-MM-dd", "MMM d, yyyy", "dd/MM/yyyy")])


def iso_date(text: Column) -> Column:
    """The first ISO date inside a text, if it is one."""
    return F.try_to_timestamp(F.regexp_extract(text, r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.lit("yyyy-MM-dd")).cast("date")


def number(text: Column) -> Column:
    """The first non-negative number of a text with thousands commas; null if there is none."""
    found = F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), r"([0-9]+(?:\.[0-9]+)?)", 1)
    return F.when(found != "", found.try_cast("double"))


def amount(text: Column) -> Column:
    """A number with an optional thousand or ten-thousand sign."""
    unit = F.regexp_extract(F.lower(text), r"[0-9] *(k|พัน|หมื่น)", 1)
    return number(text) * F.when(unit.isin("k", "พัน"), 1000.0).when(unit == "หมื่น", 10000.0).otherwise(1.0)


def boolean(value: Column) -> Column:
    low = F.lower(F.trim(value.cast("string")))
    return F.when(low.isin("true", "1", "yes", "y", "in_stock", "instock"), True).when(low.isin("false", "0", "no", "n", "out_of_stock", "outofstock"), False)


def path_parts(text: Column, depth: int = 4) -> Column:
    """``a > b > c`` as at most ``depth`` trimmed names."""
    return F.slice(F.filter(F.transform(F.split(text, ">"), lambda x: F.trim(x)), lambda p: p != ""), 1, depth)


def has_prefix(path: Column, prefix: Column) -> Column:
    """Whether an array begins with another."""
    return F.slice(path, 1, F.size(prefix)) == prefix


def distinct_ignoring_case(values: Column) -> Column:
    """First spelling of each value, in order."""
    empty = F.array().cast("array<string>")
    return F.aggregate(values, empty, lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))


def mentions(text: Column, name: Column) -> Column:
    """Whether a name stands in a text with no letter, digit, or dotted digit beside it."""
    return F.regexp_like(F.lower(text), F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), F.lower(name), F.lit(r"\E(?![\p{L}\p{N}]|\.[0-9])")))


def source_markers(text: Column) -> Column:
    """A line feed before numbered items."""
    return F.regexp_replace(text, r" +([0-9]+[.)] )", "\n$1")
