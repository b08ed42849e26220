"""Task labels and user vectors to mean ROC curves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartweave.operators import similarity, tasks


def mean_curves(task_rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """Mean ROC curve per task and label over a balanced sample of the training users:
    how well the nearest users share a user's label."""
    train = task_rows.filter("split = 'train'").groupBy("task", "subject_id").agg(
        F.min_by("y", "stay").alias("y")
    )
    # Users without a vector leave before the classes are balanced.
    train = train.join(vectors.select("subject_id"), "subject_id", "left_semi")
    sample = tasks.balanced_users(train, [F.col("subject_id")])
    users = sample.join(vectors.select("subject_id", "vec"), "subject_id").select(
        "task", F.col("subject_id").alias("user"), "y", "vec"
    )
    return similarity.mean_roc(similarity.user_roc(users))


def areas(curves: DataFrame) -> DataFrame:
    return similarity.mean_roc_auc(curves).withColumn("auc", F.round("auc", 2))
