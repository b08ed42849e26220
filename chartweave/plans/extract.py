"""Raw tables to demographics, note corpora and task tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartweave.functions.labels import subject_of_stay
from chartweave.operators import cohort, tasks
from chartweave.sources import tables

DEMOGRAPHIC_TASKS = ("gender", "ethnicity", "ethnicity_binary")


@dataclass(frozen=True)
class Extract:
    demographics: DataFrame
    notes_all: DataFrame
    notes_cohort: DataFrame
    notes_filtered: DataFrame
    tasks: DataFrame
    names: DataFrame
    audit: DataFrame


def _with_subject(stays: DataFrame) -> DataFrame:
    return stays.withColumn("subject_id", subject_of_stay(F.col("stay")))


def task_names(pheno: DataFrame, conditions: Sequence[str]) -> DataFrame:
    """``(pos, name, abv)`` of the mortality task and the condition columns."""
    rows = [(i, c) for i, c in enumerate(conditions, 1)]
    short = tasks.task_abbreviations(pheno.sparkSession.createDataFrame(rows, "pos int, name string"))
    first = pheno.sparkSession.createDataFrame([(0, "In Hospital Mortality", "IHM")], short.schema)
    return first.unionByName(short)


def task_table(
    ihm: DataFrame,
    pheno: DataFrame,
    demo: DataFrame,
    ids: DataFrame,
    names: DataFrame,
    conditions: Sequence[str],
    seed: int = 1,
) -> DataFrame:
    """``(task, split, stay, subject_id, y)`` of every task.  The given training rows
    are split into train and val per task and label; test rows stay as they are."""
    key = ["stay", "subject_id", "split"]
    mortality = cohort.keep_subjects(ihm, ids).select(
        F.lit("IHM").alias("task"), *key, F.col("y_true").cast("string").alias("y")
    )
    wide = tasks.task_demographics(cohort.keep_subjects(pheno, ids), demo)
    condition = (
        tasks.unpivot_tasks(wide, key, conditions)
        .join(names.select(F.col("name").alias("task"), "abv"), "task")
        .select(F.col("abv").alias("task"), *key, "y")
    )
    people = tasks.unpivot_tasks(wide, key, DEMOGRAPHIC_TASKS).select(
        F.upper("task").alias("task"), *key, "y"
    )
    every = mortality.unionByName(condition).unionByName(people)
    train = every.filter("split = 'train'").drop("split")
    split = tasks.stratified_split(train, ["task", "y"], ["stay"], seed=seed)
    return split.unionByName(every.filter("split = 'test'")).select("task", "split", "stay", "subject_id", "y")


def extract(
    patients: DataFrame,
    admissions: DataFrame,
    notes: DataFrame,
    ihm: DataFrame,
    pheno: DataFrame,
    conditions: Sequence[str],
    categories: Sequence[str] = cohort.TASK_CATEGORIES,
    seed: int = 1,
) -> Extract:
    """``ihm(stay, y_true, split)`` and ``pheno(stay, *conditions, split)`` carry the
    given train/test split.  Notes are filtered before they are cleaned."""
    ihm, pheno = _with_subject(ihm), _with_subject(pheno)
    demo = cohort.demographics(patients, admissions)
    in_tasks = cohort.subject_ids(ihm, pheno)
    demo = cohort.keep_subjects(demo, in_tasks)
    of_cohort = cohort.keep_subjects(notes, demo)
    filtered = cohort.filter_category(of_cohort, categories)
    ids = filtered.select("subject_id").distinct()
    names = task_names(pheno, conditions)
    counted = ihm.select(F.lit("IHM").alias("task"), "split", "subject_id").unionByName(
        pheno.select(F.lit("PHENO").alias("task"), "split", "subject_id")
    )
    return Extract(
        demographics=demo,
        notes_all=cohort.subject_documents(cohort.clean_notes(notes)),
        notes_cohort=cohort.subject_documents(cohort.clean_notes(of_cohort)),
        notes_filtered=cohort.subject_documents(cohort.clean_notes(filtered)),
        tasks=task_table(ihm, pheno, demo, ids, names, conditions, seed),
        names=names,
        audit=cohort.membership_audit(counted, [patients, admissions, cohort.filter_category(notes, categories)]),
    )


def save(result: Extract, path: str, manifests: int = 2, mini_rows: int = 1000) -> None:
    """Write everything below ``path``; small copies of the tasks go to ``mini``."""
    result.demographics.write.mode("overwrite").parquet(f"{path}/demographics")
    for name in ("notes_all", "notes_cohort", "notes_filtered"):
        getattr(result, name).write.mode("overwrite").parquet(f"{path}/{name}")
    tables.write_tasks(result.tasks, f"{path}/tasks")
    spark = result.tasks.sparkSession
    written = spark.read.parquet(f"{path}/tasks")
    mini = tasks.mini_split(written, [F.col("stay")], ["stay"], mini_rows)
    tables.write_tasks(mini.drop("line"), f"{path}/mini")
    sliced = tasks.manifest_slices(result.names, manifests, [F.col("pos")])
    tables.write_manifest(sliced, f"{path}/manifests")
    lines = [(f"{t.upper()},{t}",) for t in DEMOGRAPHIC_TASKS]
    spark.createDataFrame(lines, "value string").coalesce(1).write.mode("overwrite").text(
        f"{path}/demographic_tasks"
    )
    result.audit.write.mode("overwrite").parquet(f"{path}/audit")
