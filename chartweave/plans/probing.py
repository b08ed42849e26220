"""Task tables and features to evaluated probes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartweave.operators import features, metrics, probe, report, tasks
from chartweave.sources import tables

# Positive labels of the demographic tasks.
DEMOGRAPHIC_POSITIVE = {"GENDER": "M", "ETHNICITY": "WHITE", "ETHNICITY_BINARY": "WHITE"}


def run(
    task_rows: DataFrame,
    demographics: DataFrame,
    vectors: DataFrame,
    model: str,
    positive: Mapping[str, str],
    catalogue: Mapping[str, Mapping[str, str]] = tasks.SUBGROUPS,
) -> DataFrame:
    """Long metrics of all tasks in ``positive``: every task is fitted on its own, and
    one query evaluates all tasks and subgroups."""
    labelled = tasks.task_demographics(task_rows, demographics)
    ready = features.feature_rows(labelled, vectors)
    scored = probe.probe(ready, model, positive, list(catalogue))
    grouped = tasks.with_subgroups(scored, catalogue)
    return metrics.metric_rows(metrics.subgroup_metrics(metrics.mark_positive(grouped, dict(positive))))


def clinical(task_rows, demographics, vectors, model, names, metric: str = "auroc") -> DataFrame:
    """Condition tasks, positive label 1, one metric."""
    positive = {name: "1" for name in names}
    return run(task_rows, demographics, vectors, model, positive).filter(f"metric = '{metric}'")


def demographic(task_rows, demographics, vectors, model) -> DataFrame:
    """Demographic tasks, always reported by macro F1."""
    out = run(task_rows, demographics, vectors, model, DEMOGRAPHIC_POSITIVE)
    return out.filter("metric = 'macro_f1'")


def log(results: DataFrame, path: str, seed: int = 0, run: str | None = None) -> str:
    """Append a run's results with its seed and time; a job that is repeated names its run, so that
    its rows are there once."""
    timed = results.withColumn("seed", F.lit(seed)).withColumn("run_ts", F.current_timestamp())
    return tables.append_results(timed, path, run)


def report_of(spark: SparkSession, path: str, groups: Sequence[str] = report.GROUPS) -> DataFrame:
    """The log's report: the last result of each model, task, metric and group, as a wide table and
    back, the listed groups kept."""
    return report.select_results(report.results_long(table(tables.read_results(spark, path)), groups), list(groups))


def table(results: DataFrame) -> DataFrame:
    """One row per model, task and metric with the groups as columns; of repeated runs in the
    log the last one counts."""
    keys = ["model", "task", "metric", "grp"]
    last = report.latest(results.select(*keys, "value", "run_ts"), keys, ["run_ts"])
    return report.results_wide(last.drop("run_ts"))
