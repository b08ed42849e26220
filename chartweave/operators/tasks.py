"""Probing tasks: labels, names, splits and balanced samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartweave.functions.hashing import keyed_hash
from chartweave.functions.labels import initials, subject_of_stay
from chartweave.operators.distribution import ranked, top_k


def narrow_labels(
    stays: DataFrame, stay: str = "stay", y: str = "y_true", keep: Sequence[str] = ()
) -> DataFrame:
    """``(subject_id, y)`` from a stay table."""
    return stays.select(
        subject_of_stay(F.col(stay)).alias("subject_id"), F.col(y).alias("y"), *keep
    )


def unpivot_tasks(wide: DataFrame, ids: Sequence[str], tasks: Sequence[str]) -> DataFrame:
    """One row per task and row of the wide label table; ``y`` as text."""
    typed = wide.select(*ids, *[F.col(t).cast("string").alias(t) for t in tasks])
    return typed.unpivot(list(ids), list(tasks), "task", "y")


def task_demographics(task_rows: DataFrame, demo: DataFrame) -> DataFrame:
    return task_rows.join(demo, "subject_id")


def task_abbreviations(names: DataFrame, name: str = "name", pos: str = "pos") -> DataFrame:
    """Initials per task name; repeats get ``-2``, ``-3``, ... in position order."""
    short = names.withColumn("_i", initials(F.col(name)))
    placed = ranked(short, ["_i"], [F.col(pos)], name="_n")
    abv = F.when(F.col("_n") == 1, F.col("_i")).otherwise(
        F.concat_ws("-", F.col("_i"), F.col("_n").cast("string"))
    )
    return placed.select(pos, name, abv.alias("abv"))


def task_catalogue(lines: DataFrame, mini: bool = False, value: str = "value") -> DataFrame:
    """Dataset names from ``abv,name`` lines.  More than one comma is an error."""
    parts = F.split(F.col(value), ",")
    checked = F.when(F.size(parts) == 2, parts[0]).otherwise(
        F.raise_error(F.concat(F.lit("not 'abv,name': "), F.col(value))).cast("string")
    )
    return lines.select(
        F.concat(F.lit("mini-" if mini else ""), checked).alias("dataset"),
        F.get(parts, F.lit(1)).alias("name"),
    )


def manifest_slices(names: DataFrame, files: int, order: Sequence[Column]) -> DataFrame:
    """Number the task names and deal them to ``files`` manifest files in runs of
    ``int(n / files) + 1``."""
    n = names.count()
    size = n // files + 1
    placed = ranked(names, [], list(order), name="line", group_rows=n)
    return placed.withColumn("file", (F.floor((F.col("line") - 1) / size) + 1).cast("bigint"))


def stratified_split(
    rows: DataFrame,
    strata: Sequence[str],
    key: Sequence[str],
    share: float = 0.8,
    seed: int = 1,
    by_subject: str | None = None,
    names: tuple[str, str] = ("train", "val"),
    **kw,
) -> DataFrame:
    """First ``floor(share * n)`` rows of each stratum in a seeded order train, the
    rest validate.  With ``by_subject`` all rows of a subject hash alike, and a
    subject is assigned by its share of the hash range instead of by rank."""
    if by_subject:
        limit = f"{int(share * 0x100000000):08x}"
        h = F.substring(keyed_hash(seed, by_subject), 1, 8)
        return rows.withColumn("split", F.when(h < limit, names[0]).otherwise(names[1]))
    hashed = rows.withColumn("_h", keyed_hash(seed, *strata, *key))
    order = [F.col("_h"), *[F.col(k) for k in key]]
    placed = ranked(hashed, strata, order, name="_r", **kw)
    sizes = rows.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
    first = F.col("_r") <= F.floor(F.col("_n") * F.lit(share))
    return (
        placed.join(sizes, list(strata))
        .withColumn("split", F.when(first, names[0]).otherwise(names[1]))
        .drop("_h", "_r", "_n")
    )


def mini_split(
    rows: DataFrame, order: Sequence[Column], tie_key: Sequence[str], k: int = 1000
) -> DataFrame:
    """First ``k`` rows of each task and split."""
    return top_k(rows, ["task", "split"], order, k, tie_key, name="line")


def class_counts(rows: DataFrame, by: Sequence[str] = ("task",)) -> DataFrame:
    return rows.groupBy(*by, "y").agg(F.count(F.lit(1)).alias("n"))


def class_balance(rows: DataFrame, by: Sequence[str] = ("task",)) -> DataFrame:
    """Smallest class of each task (ties: the smaller label) and its size."""
    return (
        class_counts(rows, by)
        .groupBy(*by)
        .agg(
            F.min_by("y", F.struct("n", "y")).alias("minority"),
            F.min("n").alias("min_count"),
            F.count(F.lit(1)).alias("n_classes"),
        )
    )


def balanced_users(rows: DataFrame, order: Sequence[Column], **kw) -> DataFrame:
    """Minority class of each task, and as many of the first other rows."""
    small = class_balance(rows).select("task", "minority", "min_count")
    marked = rows.join(small, "task").withColumn("_minor", F.col("y") == F.col("minority"))
    placed = ranked(marked, ["task", "_minor"], order, name="_r", **kw)
    return placed.filter(F.col("_minor") | (F.col("_r") <= F.col("min_count"))).select(
        *rows.columns
    )


def label_vocabulary(rows: DataFrame, splits: Sequence[str] = ("train", "val")) -> DataFrame:
    """``(task, y, idx)``: labels seen in the given splits, numbered from 0."""
    seen = rows.filter(F.col("split").isin(*splits)).select("task", "y").distinct()
    return ranked(seen, ["task"], [F.col("y")], name="_r").select(
        "task", "y", (F.col("_r") - 1).alias("idx")
    )


def index_labels(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Label numbers for every split; a label seen only in test gets null."""
    return rows.join(vocabulary, ["task", "y"], "left")


def subgroup_names(catalogue: Mapping[str, Mapping[str, str]]) -> Column:
    """Array of the groups a row belongs to: ``all`` and one per listed attribute
    value.  ``catalogue`` is ``{column: {value: group name}}``."""
    members = [F.lit("all")]
    for column, values in catalogue.items():
        one = None
        for value, name in values.items():
            hit = F.col(column) == value
            one = F.when(hit, name) if one is None else one.when(hit, name)
        members.append(one)
    return F.array_compact(F.array(*members))


def with_subgroups(rows: DataFrame, catalogue: Mapping[str, Mapping[str, str]]) -> DataFrame:
    return rows.withColumn("grp", F.explode(subgroup_names(catalogue)))


# Demographic subgroups reported besides ``all``.
SUBGROUPS = {
    "gender": {"M": "men", "F": "women"},
    "ethnicity": {"WHITE": "white", "BLACK": "black", "ASIAN": "asian", "HISPANIC": "hispanic"},
}
