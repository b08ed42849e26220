"""Keyed hashes standing in for random draws: the same on every run and retry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def keyed_hash(seed: int | str, *parts: Column | str) -> Column:
    """md5 hex of ``seed|part|part...``; sorting by it is a seeded permutation."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[_text(p) for p in parts]))


def hash_int(h: Column, first: int) -> Column:
    """Eight hex digits of ``h`` from position ``first`` (1-based) as a bigint."""
    return F.conv(F.substring(h, first, 8), 16, 10).cast("bigint")


def _text(part):
    return (F.col(part) if isinstance(part, str) else part).cast("string")
