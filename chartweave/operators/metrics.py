"""Classification metrics per model, task and subgroup, in one pass over the scores.

Input rows: ``model, task, grp, y, yhat, score, positive, predicted_positive`` where
the last two tell whether truth and prediction are the positive label of the task.
``cells`` counts equal rows first; everything else works on those counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartweave.operators.distribution import MAX_GROUP_ROWS, largest_group, running_totals
from chartweave.session import cut_lineage

KEYS = ["model", "task", "grp"]
METRICS = ["micro_f1", "macro_f1", "auroc", "auprc", "specificity", "sensitivity"]


def cells(rows: DataFrame) -> DataFrame:
    """Rows that agree in everything, counted."""
    return rows.groupBy(
        *KEYS, "y", "yhat", "score", "positive", "predicted_positive"
    ).agg(F.count(F.lit(1)).alias("n"))


def confusion(counted: DataFrame) -> DataFrame:
    """Counts per ``(y, yhat)``: as many rows as there are pairs of labels."""
    return counted.groupBy(*KEYS, "y", "yhat", "positive", "predicted_positive").agg(
        F.sum("n").alias("n")
    )


def mark_positive(rows: DataFrame, positive: dict[str, str]) -> DataFrame:
    """Positive means: the label equals the positive label named for its task."""
    label = None
    for task, value in positive.items():
        hit = F.col("task") == task
        label = F.when(hit, value) if label is None else label.when(hit, value)
    return rows.withColumn("_pos", label).select(
        *KEYS,
        "y",
        "yhat",
        "score",
        (F.col("y") == F.col("_pos")).alias("positive"),
        F.coalesce(F.col("yhat") == F.col("_pos"), F.lit(False)).alias("predicted_positive"),
    )


def micro_f1(conf: DataFrame) -> DataFrame:
    """Accuracy, which micro-averaged F1 is when every row has one label."""
    return conf.groupBy(*KEYS).agg(_accuracy())


def _accuracy() -> Column:
    right = F.sum(F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0))
    return (right / F.sum("n")).alias("micro_f1")


def macro_f1(conf: DataFrame) -> DataFrame:
    """Plain mean of F1 over the labels that occur as truth or prediction."""
    same = F.col("y").eqNullSafe(F.col("yhat"))
    n = F.col("n")
    sides = conf.select(
        *KEYS,
        F.explode(
            F.array(
                F.struct(
                    F.col("y").alias("label"),
                    F.when(same, n).otherwise(0).alias("tp"),
                    F.when(same, F.lit(0)).otherwise(n).alias("fn"),
                    F.lit(0).cast("bigint").alias("fp"),
                ),
                F.struct(
                    F.col("yhat").alias("label"),
                    F.lit(0).cast("bigint").alias("tp"),
                    F.lit(0).cast("bigint").alias("fn"),
                    F.when(same, F.lit(0)).otherwise(n).alias("fp"),
                ),
            )
        ).alias("s"),
    )
    per_label = sides.groupBy(*KEYS, "s.label").agg(
        F.sum("s.tp").alias("tp"), F.sum("s.fn").alias("fn"), F.sum("s.fp").alias("fp")
    )
    whole = 2 * F.col("tp") + F.col("fn") + F.col("fp")
    f1 = F.when(whole > 0, 2 * F.col("tp") / whole).otherwise(F.lit(0.0))
    return per_label.groupBy(*KEYS).agg(F.avg(f1).alias("macro_f1"))


def _rates() -> tuple[Column, Column]:
    t, p = F.col("positive"), F.col("predicted_positive")

    def total(cond: Column) -> Column:
        return F.sum(F.when(cond, F.col("n")).otherwise(0))

    tn, fp, fn, tp = total(~t & ~p), total(~t & p), total(t & ~p), total(t & p)
    labels = F.size(F.array_union(F.collect_set("y"), F.collect_set("yhat")))
    zero = F.lit(0)
    return (
        F.when(labels != 2, 0.0).otherwise(tn / F.nullif(tn + fp, zero)).alias("specificity"),
        F.when(labels != 2, 0.0).otherwise(tp / F.nullif(fn + tp, zero)).alias("sensitivity"),
    )


def specificity_sensitivity(conf: DataFrame) -> DataFrame:
    """Both 0 unless truth and prediction together use exactly two labels."""
    return conf.groupBy(*KEYS).agg(*_rates())


def curve_steps(
    counted: DataFrame, max_group_rows: int = MAX_GROUP_ROWS, slices: int | None = None
) -> DataFrame:
    """Score steps with running counts: ties collapse before anything is ordered."""
    # Cells bound steps; the steps are only measured when that bound is too weak.
    bound = largest_group(counted, KEYS)
    steps = counted.groupBy(*KEYS, "score").agg(
        F.sum(F.when(F.col("positive"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("positive"), 0).otherwise(F.col("n"))).alias("fp"),
    )
    return running_totals(
        steps,
        KEYS,
        [F.col("score").desc()],
        {"ctp": F.col("tp"), "cfp": F.col("fp")},
        max_group_rows=max_group_rows,
        slices=slices,
        group_rows=bound if bound <= max_group_rows else None,
    )


def ranking_areas(steps: DataFrame) -> DataFrame:
    """ROC and precision-recall areas from the running counts.

    ROC: a negative counts the positives above it, ties one half.  PR: trapezoids
    over recall, starting from precision 1 at recall 0.
    """
    tp, fp, ctp, cfp = (F.col(c).cast("double") for c in ("tp", "fp", "ctp", "cfp"))
    seen = ctp + cfp
    before = seen - tp - fp
    precision = ctp / seen
    previous = F.when(before == 0, F.lit(1.0)).otherwise((ctp - tp) / F.nullif(before, F.lit(0.0)))
    p, n = F.sum(tp), F.sum(fp)
    return steps.groupBy(*KEYS).agg(
        F.when((p > 0) & (n > 0), F.sum(fp * (ctp - tp / 2)) / F.nullif(p * n, F.lit(0.0)))
        .otherwise(0.0)
        .alias("auroc"),
        F.when(p > 0, F.sum(tp * (precision + previous) / 2) / F.nullif(p, F.lit(0.0)))
        .otherwise(0.0)
        .alias("auprc"),
    )


def _true_labels() -> Column:
    return F.size(F.collect_set("y")).alias("_labels")


def _binary_only(metric: str) -> Column:
    """Areas of a group with more than two true labels are 0."""
    return F.when(F.col("_labels") <= 2, F.col(metric)).otherwise(0.0).alias(metric)


def areas(rows: DataFrame, **kw) -> DataFrame:
    counted = cut_lineage(cells(rows))
    few = confusion(counted).groupBy(*KEYS).agg(_true_labels())
    out = ranking_areas(curve_steps(counted, **kw)).join(few, KEYS)
    return out.select(*KEYS, _binary_only("auroc"), _binary_only("auprc"))


def subgroup_metrics(rows: DataFrame, digits: int | None = 3, **kw) -> DataFrame:
    """All six metrics, one row per model, task and group."""
    # The scores are read once; what follows uses their counts several times.
    counted = cut_lineage(cells(rows))
    conf = confusion(counted)
    out = (
        conf.groupBy(*KEYS)
        .agg(_accuracy(), *_rates(), _true_labels())
        .join(macro_f1(conf), KEYS)
        .join(ranking_areas(curve_steps(counted, **kw)), KEYS)
        .withColumn("auroc", _binary_only("auroc"))
        .withColumn("auprc", _binary_only("auprc"))
    )
    if digits is None:
        return out.select(*KEYS, *METRICS)
    return out.select(*KEYS, *[F.round(m, digits).alias(m) for m in METRICS])


def metric_rows(wide: DataFrame) -> DataFrame:
    """``(model, task, grp, metric, value)``."""
    return wide.unpivot(KEYS, METRICS, "metric", "value")
