"""Column functions on text: cleaning, rule counts, region markers, templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations, in the order in which they are replaced.
ABBREVIATIONS = [("u.s.a.", "USA"), ("u.s.", "USA"), ("u.k.", "UK"), ("e.g.", "for example"), ("i.e.", "that is"), ("etc.", "etcetera")]

# Explicit region words by region.
MARKERS = {
    "CHN": ["china", "chinese", "beijing", "shanghai", "guangzhou"],
    "HKG": ["hong kong", "hongkong", "hong konger", "hong kongers", "cantonese"],
    "IDN": ["indonesia", "indonesian", "indonesians", "jakarta"],
    "JPN": ["japan", "japanese", "tokyo", "osaka"],
    "KOR": ["korea", "korean", "koreans", "south korea", "seoul", "busan"],
    "PAK": ["pakistan", "pakistani", "pakistanis", "islamabad", "karachi"],
    "PHL": ["philippines", "filipino", "filipinos", "manila"],
    "SIN": ["singapore", "singaporean", "singaporeans"],
    "THA": ["thailand", "thai", "thais", "bangkok"],
    "TWN": ["taiwan", "taiwanese", "taipei"],
    "ENS": [],
}

# Error patterns, each counted without regard to case.
ERROR_PATTERNS = {
    "doubled word": r"\b(\w+) \1\b",
    "sentence-start capitalization": r"(?<=[.!?]\s)[a-z]",
    "article a/an": r"\ba ([aeiou])\w*\b",
    "missing space after punctuation": r"[a-z][,.][a-z]",
    "uncountable plural": r"\b(peoples|informations|advices|furnitures|equipments|staffs)\b",
    "double comparative": r"\bmore (better|worse|easier|harder|faster|slower|bigger|smaller|higher|lower)\b",
    "be + base verb": r"\b(?:am|is|are|was|were) (agree|like|want|need|have|know|think|believe|hope|love|hate)\b",
}


def one_line(text: Column) -> Column:
    """Line breaks and runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[\r\n]+", " "), r"\s+", " "))


def cleaned(text: Column, topic: Column) -> Column:
    """Byte-order marks out, one kind of line break, a title line dropped, lines joined, abbreviations written out, a trailing word count cut; '' for null or blank."""
    plain = F.regexp_replace(F.regexp_replace(text, "[﻿￾]", ""), r"\r\n?", "\n")
    lines = F.split(plain, "\n", -1)
    first = F.lower(F.trim(F.get(lines, F.lit(0))))
    named = F.exists(F.filter(F.split(F.lower(F.coalesce(topic, F.lit(""))), r"\s+"), lambda k: F.length(k) > 3), lambda k: F.contains(first, k))
    title = (F.length(first) < 100) & (F.contains(first, F.lit("title:")) | F.startswith(first, F.lit("topic:")) | named)
    kept = F.filter(F.transform(F.when(title, F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    out = F.regexp_replace(F.array_join(kept, " "), r"(?U)\s+", " ")
    for short, full in ABBREVIATIONS:
        out = F.regexp_replace(out, r"(?i)\b" + short.replace(".", r"\."), full)
    out = F.regexp_replace(out, r"(?i)\s*\((?:\d+\s+words?|word count[:\s]+\d+)\)\s*$", "")
    return F.when(text.isNull() | (F.trim(text) == ""), "").otherwise(F.trim(out))


def error_counts(text: Column) -> dict[str, Column]:
    """The count of each error pattern."""
    return {name: F.regexp_count(text, F.lit("(?iuU)" + p)).cast("long") for name, p in ERROR_PATTERNS.items()}


def marker_pattern() -> str:
    """All markers, the longest first, as whole words."""
    words = sorted({w for ws in MARKERS.values() for w in ws}, key=lambda w: (-len(w), w))
    return r"(?iuU)(?<!\w)(?:" + "|".join(words) + r")(?!\w)"


def masked(text: Column) -> Column:
    """The text with each marker as [REGION]; null gives ''."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), marker_pattern(), "[REGION]")


def markers_in(text: Column) -> Column:
    """The markers of a text in lower case, in order, none within another."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(marker_pattern()), F.lit(0)), F.lower)


def filled(template: str, **fields: Column) -> Column:
    """A template with {name} fields filled from columns, null as ''."""
    out = F.lit(template)
    for name, value in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def windows(ids: Column, width: int, unknown: int) -> Column:
    """Windows of `width` ids one after the other; an empty list is one window with the unknown id."""
    n = F.size(ids)
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(n, F.lit(1)) - 1) / width).cast("int")), lambda i: F.slice(ids, i * width + 1, F.lit(width)))
    return F.when(n > 0, cut).otherwise(F.array(F.array(F.lit(unknown))))
