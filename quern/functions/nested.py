"""Aligned arrays held as one array of structs; text only at the borders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_strings(c: Column) -> Column:
    """A JSON array of strings; null or malformed text is an error of the running job, blank text the empty array."""
    parsed = F.from_json(c, "array<string>")
    blank = F.coalesce(F.trim(c), F.lit("")) == ""
    bad = F.when(parsed.isNull(), F.raise_error(F.lit("not a JSON array of strings")).cast("array<string>")).otherwise(parsed)
    return F.when(blank, F.array().cast("array<string>")).otherwise(bad)


def zip_labels(labels: Column, names: Column) -> Column:
    """array<struct<label,name>> of two arrays of one length."""
    both = F.zip_with(labels, names, lambda a, b: F.struct(a.alias("label"), b.alias("name")))
    return F.when(F.size(labels) == F.size(names), both).otherwise(F.raise_error(F.lit("arrays differ in length")).cast("array<struct<label:string,name:string>>"))


def retain(pairs: Column, allowed: Column) -> Column:
    return F.filter(pairs, lambda p: F.array_contains(allowed, p["label"]))


def remove(pairs: Column, banned: Column) -> Column:
    return F.filter(pairs, lambda p: ~F.array_contains(banned, p["label"]))


def labels_of(pairs: Column) -> Column:
    return F.transform(pairs, lambda p: p["label"])


def names_of(pairs: Column) -> Column:
    return F.transform(pairs, lambda p: p["name"])


def joined_set(c: Column, separator: str = ";") -> Column:
    """Sorted distinct members as one text."""
    return F.array_join(F.array_sort(F.array_distinct(c)), separator)
