"""Result tables: latest run, long and wide forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Report groups in column order.
GROUPS = ("all", "men", "women", "white", "black", "asian", "hispanic")


def latest(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key by ``order``; an aggregate, so it combines map-side."""
    rest = [c for c in rows.columns if c not in by]
    return (
        rows.groupBy(*by)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*by, *[F.col(f"_row.{c}").alias(c) for c in rest])
    )


def results_wide(
    long: DataFrame, groups: Sequence[str] = GROUPS, keys: Sequence[str] = ("model", "task", "metric")
) -> DataFrame:
    """Groups as columns; the fixed list spares the pivot a pass for its values.  Several values for
    one cell, as of runs that were not reduced to the last, raise."""
    several = F.raise_error(F.concat_ws(" ", F.lit("several results for"), *keys, "grp"))
    cells = long.groupBy(*keys, "grp").agg(F.count(F.lit(1)).alias("_n"), F.max("value").alias("value"))
    one = cells.select(*keys, "grp", F.when(F.col("_n") > 1, several).otherwise(F.col("value")).alias("value"))
    return one.groupBy(*keys).pivot("grp", list(groups)).agg(F.max("value"))


def results_long(
    wide: DataFrame, groups: Sequence[str] = GROUPS, keys: Sequence[str] = ("model", "task", "metric")
) -> DataFrame:
    return wide.unpivot(list(keys), list(groups), "grp", "value").filter("value is not null")


def select_results(long: DataFrame, groups: Sequence[str], task: str | None = None) -> DataFrame:
    out = long.filter(F.col("grp").isin(*groups))
    return out if task is None else out.filter(F.col("task") == task)
