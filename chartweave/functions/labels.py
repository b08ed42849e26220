"""Identifier and label expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordered rules (substring, label); the first hit wins.
ETHNICITY_MULTI = (
    ("ASIAN", "ASIAN"),
    ("AFRICAN", "BLACK"),
    ("HISPANIC", "HISPANIC"),
    ("WHITE", "WHITE"),
)
# Ordered rules (substring, label) of the two-way map.
ETHNICITY_BINARY = (
    ("ASIAN", "NON-WHITE"),
    ("AFRICAN", "NON-WHITE"),
    ("HISPANIC", "NON-WHITE"),
    ("NATIVE", "NON-WHITE"),
    ("WHITE", "WHITE"),
)


def map_label(text: Column, rules: Sequence[tuple[str, str]], default: str = "OTHER") -> Column:
    """Case-sensitive substring rules, in order."""
    out = None
    for needle, label in rules:
        hit = text.contains(needle)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit(default))


def subject_of_stay(stay: Column) -> Column:
    """Number in front of the first underscore; a value without one raises."""
    ok = F.instr(stay, "_") > 0
    return F.when(ok, F.substring_index(stay, "_", 1).cast("bigint")).otherwise(
        F.raise_error(F.concat(F.lit("no '_' in stay id: "), F.coalesce(stay, F.lit("null")))).cast(
            "bigint"
        )
    )


def initials(name: Column) -> Column:
    """First letters of the upper-cased words, without non-word characters."""
    words = F.filter(F.split(F.upper(name), r"\s+"), lambda w: w != "")
    letters = F.array_join(F.transform(words, lambda w: F.left(w, F.lit(1))), "")
    return F.regexp_replace(letters, r"\W+", "")
