"""Text functions that the loaders and reports use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where sentences end, and what a tagged section looks like.
SENTENCE_END = r"(?U)(?<=[.!?。！？])\s+"
TAGGED = r"(?s)<([a-zA-Z0-9_]+)>(.*?)<[/\\]\1>"


def strip(text: Column) -> Column:
    """Text without white space, Unicode's too, at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def filled(text: Column) -> Column:
    """Stripped text, or null if nothing is left."""
    return F.nullif(strip(text), F.lit(""))


def first_filled(*texts: Column) -> Column:
    """The first of several texts that is more than white space."""
    return F.coalesce(*(filled(t) for t in texts))


def stringify(value: Column, kind: str) -> Column:
    """A value of a column type as stripped text or JSON; null gives empty text."""
    if kind == "string":
        return F.coalesce(strip(value), F.lit(""))
    if kind.startswith(("struct", "array", "map")):
        return F.coalesce(F.to_json(value), F.lit(""))
    return F.coalesce(value.cast("string"), F.lit(""))


def sorted_json(entries: Column) -> Column:
    """A map as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))


def payload_text(value: Column, kind: str) -> Column:
    """Any payload as stable text: maps as JSON in key order, arrays and structs as JSON, else the value."""
    return sorted_json(value) if kind.startswith("map") else F.to_json(value) if kind.startswith(("array", "struct")) else value.cast("string")


def first_words(text: Column, n: int = 20) -> Column:
    """The first n words, joined by single blanks."""
    return F.array_join(F.slice(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""), 1, n), " ")


def first_sentences(text: Column, n: int = 1) -> Column:
    """The first n sentences, joined by single blanks; without a sentence end, the whole text."""
    parts = F.filter(F.transform(F.split(text, SENTENCE_END), strip), lambda s: s != "")
    return F.array_join(F.slice(parts, 1, n), " ")


def summary(text: Column, most: int = 160) -> Column:
    """Text with white space collapsed, cut to `most` characters with an ellipsis."""
    flat = strip(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.left(flat, F.lit(most - 3)), F.lit("..."))).otherwise(flat)


def tagged_sections(text: Column) -> Column:
    """array<struct<tag, body>> of sections <tag>...</tag>, closed by a slash or a backslash, with bodies stripped."""
    tags, bodies = (F.regexp_extract_all(text, F.lit(TAGGED), F.lit(i)) for i in (1, 2))
    return F.zip_with(tags, bodies, lambda t, b: F.struct(t.alias("tag"), strip(b).alias("body")))


def parse_ratio(text: str) -> tuple[int, int]:
    """(searches, inserts) of a ratio written a:b or a/b; both positive."""
    parts = text.replace("/", ":").split(":")
    if len(parts) != 2 or not all(p.strip().isdigit() and int(p) > 0 for p in parts):
        raise ValueError(f"not a ratio of two positive numbers: {text}")
    return int(parts[0]), int(parts[1])
