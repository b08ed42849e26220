"""Ordered work inside groups that may hold any share of the data.

A window over a key runs each key in one task.  That is the best plan while
every group fits a task, and a dead job when one subject or one class holds a
third of the rows.  ``running_totals`` measures the largest group first and
switches to range slices with carried sums when it is too big; both ways give
the same rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartweave.session import cut_lineage

MAX_GROUP_ROWS = 2_000_000
SALTS = 64


def largest_group(df: DataFrame, group: Sequence[str]) -> int:
    """Rows of the biggest group (one map-side combined aggregate)."""
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max("n").alias("n")).first()["n"] or 0


def running_totals(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    sums: Mapping[str, Column],
    max_group_rows: int = MAX_GROUP_ROWS,
    slices: int | None = None,
    group_rows: int | None = None,
) -> DataFrame:
    """Add inclusive running sums of ``sums`` inside each ``group``.

    ``order`` must identify a row within its group.  ``group_rows`` is a known
    bound on the group size; without it the largest group is measured.
    """
    if group_rows is None:
        group_rows = largest_group(df, group)
    if group_rows <= max_group_rows:
        w = (
            Window.partitionBy(*group)
            .orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        return df.select("*", *[F.sum(c).over(w).alias(n) for n, c in sums.items()])
    return _sliced_totals(df, list(group), list(order), sums, slices)


def _sliced_totals(df, group, order, sums, slices):
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(g) for g in group]
    # Written once here, as range sampling would run the whole input again; and once
    # with slices, as the slice of a row must not change when a task is rerun.
    sliced = cut_lineage(
        cut_lineage(df).repartitionByRange(n, *keys, *order).withColumn("_slice", F.spark_partition_id())
    )
    per_slice = sliced.groupBy(*group, "_slice").agg(
        *[F.sum(c).alias(f"_{name}") for name, c in sums.items()]
    )
    before = (
        Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = per_slice.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.col("_slice").alias("_s"),
        F.count(F.lit(1)).over(before).alias("_earlier"),
        *[F.sum(f"_{name}").over(before).alias(f"_{name}") for name in sums],
    ).filter("_earlier > 0")
    # A slice continues at most one group from the slice before it, so ``carried``
    # has fewer rows than there are slices.
    same = F.col("_slice") == F.col("_s")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inside = (
        Window.partitionBy(*group, "_slice")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = sliced.select(
        "*", *[F.sum(c).over(inside).alias(f"_in_{name}") for name, c in sums.items()]
    )
    return local.join(F.broadcast(carried), same, "left").select(
        *df.columns,
        *[
            (F.col(f"_in_{name}") + F.coalesce(F.col(f"_{name}"), F.lit(0))).alias(name)
            for name in sums
        ],
    )


def ranked(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "rank", **kw
) -> DataFrame:
    """1-based position of each row in its group."""
    return running_totals(df, group, order, {name: F.lit(1).cast("bigint")}, **kw)


def top_k(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    k: int,
    tie_key: Sequence[str],
    name: str = "rank",
    salts: int = SALTS,
) -> DataFrame:
    """First ``k`` rows of each group.  Rows are cut to k per (group, salt) before
    they meet, so a hot group sends at most ``k * salts`` rows to one task."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*tie_key), F.lit(salts)))
    near = Window.partitionBy(*group, "_salt").orderBy(*order)
    final = Window.partitionBy(*group).orderBy(*order)
    return (
        salted.withColumn("_r", F.row_number().over(near))
        .filter(F.col("_r") <= k)
        .withColumn(name, F.row_number().over(final))
        .filter(F.col(name) <= k)
        .select(*df.columns, name)
    )
