"""Sources and sinks: what is written comes back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import inputs as I
from checks.cohort_queries import TASK_ROWS, task_rows
from checks.metric_queries import LATEST, latest_long
from checks.registry import query
from chartweave.session import ensure_checkpoint_dir
from chartweave.sources import tables


def _folder(spark) -> str:
    """A new folder that all executors see."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/source-{uuid.uuid4()}"


_LOGGED = f"SELECT model, task, metric, grp, value FROM {LATEST}"


@query("result_log", _LOGGED)
def result_log(spark, sf):
    """The last results appended to a log, one run twice, and read back by its manifest."""
    path = _folder(spark)
    rows = latest_long(spark, sf).select("model", "task", "metric", "grp", "value")
    for _ in range(2):
        tables.append_results(rows, path, "run-1")
    return tables.read_results(spark, path).select(
        "model", F.col("task").cast(rows.schema["task"].dataType).alias("task"), "metric", "grp", "value"
    )


@query("tsv_round_trip", f"SELECT task, subject_id, y FROM {TASK_ROWS}")
def tsv_round_trip(spark, sf):
    path = _folder(spark)
    rows = task_rows(spark, sf).select("task", "subject_id", "y")
    tables.write_tsv(rows, path)
    return tables.read_delimited(spark, path, rows.schema, "\t")


@query("gz_csv_scan", "SELECT conv_id AS subject_id, turn AS note_id, role AS category, text FROM conversations")
def gz_csv_scan(spark, sf):
    """Notes as gzipped CSV with texts over several lines, read by column name."""
    path = _folder(spark)
    notes = I.notes(spark, sf).select("subject_id", "note_id", "category", "text")
    notes.write.option("header", True).option("escape", '"').option("quoteAll", True).option("compression", "gzip").csv(path)
    columns = {"subject_id": "bigint", "note_id": "bigint", "category": "string", "text": "string"}
    return tables.read_gz_csv(spark, path, columns)


@query("feature_cache", "SELECT vec_id, label FROM embeddings")
def feature_cache(spark, sf):
    """A table built because it was not there, then found."""
    path = f"{_folder(spark)}/{tables.feature_name('U2V', 'vectors/U_mean.txt')}"
    rows = I.table(spark, sf, "embeddings").select("vec_id", "label")
    tables.build_if_absent(spark, path, lambda: rows)
    return tables.build_if_absent(spark, path, lambda: rows.limit(0))
