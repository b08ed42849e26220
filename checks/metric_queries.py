"""Classification metrics and result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as I
from checks.registry import query
from chartweave.functions import text as X
from chartweave.operators import metrics as M
from chartweave.operators import report, tasks

# The score of a document is its type-token ratio; it stands in for a fitted model.
POSITIVE = {"quality": "1", "toxic": "1", "lang": "en"}
CATALOGUE = {
    "lang": {"en": "english", "fr": "french", "de": "german"},
    "source": {"src0": "src0", "src1": "src1", "src2": "src2"},
}
SCORED = r"""(
    SELECT 'ttr' AS model, task, doc_id, y, yhat, score, lang, source FROM (
      SELECT doc_id, lang, source, w,
             CAST(len(list_distinct(w)) AS DOUBLE) / len(w) AS score FROM (
        SELECT doc_id, lang, source, list_filter(regexp_split_to_array(lower(text), '\s+'),
                 lambda x: x <> '') AS w FROM documents)) s
    JOIN (
      SELECT 'quality' AS task, doc_id AS id, CAST(quality AS VARCHAR) AS y FROM labels
      UNION ALL SELECT 'toxic', doc_id, CAST(toxic AS VARCHAR) FROM labels
      UNION ALL SELECT 'lang', doc_id, lang FROM documents) t ON t.id = s.doc_id
    , LATERAL (SELECT CASE
        WHEN task = 'lang' AND list_contains(w, 'the') THEN 'en'
        WHEN task = 'lang' AND list_contains(w, 'le') THEN 'fr'
        WHEN task = 'lang' AND list_contains(w, 'der') THEN 'de'
        WHEN task = 'lang' THEN 'es'
        WHEN score >= 0.75 THEN '1' ELSE '0' END AS yhat) p)"""
MARKED = f"""(SELECT model, task, grp, y, yhat, score, y = pos AS positive, yhat = pos AS predicted FROM (
    SELECT *, CASE task WHEN 'lang' THEN 'en' ELSE '1' END AS pos, unnest(['all',
        CASE lang WHEN 'en' THEN 'english' WHEN 'fr' THEN 'french' WHEN 'de' THEN 'german' END,
        CASE WHEN source IN ('src0', 'src1', 'src2') THEN source END]) AS grp FROM {SCORED})
    WHERE grp IS NOT NULL)"""
LABELS_OF = f"""(SELECT model, task, grp, count(DISTINCT y) AS n_true FROM {MARKED} GROUP BY ALL)"""
MICRO = f"""(SELECT model, task, grp, avg(CAST(y = yhat AS DOUBLE)) AS micro_f1 FROM {MARKED} GROUP BY ALL)"""
MACRO = f"""(SELECT model, task, grp, avg(f1) AS macro_f1 FROM (
    SELECT model, task, grp, label, CAST(2 * sum(tp) AS DOUBLE) / sum(2 * tp + fn + fp) AS f1 FROM (
      SELECT model, task, grp, y AS label, CAST(y = yhat AS BIGINT) AS tp, CAST(y <> yhat AS BIGINT) AS fn, 0 AS fp FROM {MARKED}
      UNION ALL
      SELECT model, task, grp, yhat, 0, 0, CAST(y <> yhat AS BIGINT) FROM {MARKED})
    GROUP BY ALL) GROUP BY model, task, grp)"""
RATES = f"""(SELECT model, task, grp,
      CASE WHEN n <> 2 THEN 0.0 ELSE tn / nullif(tn + fp, 0) END AS specificity,
      CASE WHEN n <> 2 THEN 0.0 ELSE tp / nullif(fn + tp, 0) END AS sensitivity FROM (
    SELECT model, task, grp, len(list_distinct(list_concat(list(DISTINCT y), list(DISTINCT yhat)))) AS n,
      CAST(count(*) FILTER (NOT positive AND NOT predicted) AS DOUBLE) AS tn,
      CAST(count(*) FILTER (NOT positive AND predicted) AS DOUBLE) AS fp,
      CAST(count(*) FILTER (positive AND NOT predicted) AS DOUBLE) AS fn,
      CAST(count(*) FILTER (positive AND predicted) AS DOUBLE) AS tp
    FROM {MARKED} GROUP BY model, task, grp))"""
AUROC = f"""(SELECT model, task, grp, CASE WHEN n_true <= 2 AND p > 0 AND n > 0
      THEN (ranks - p * (p + 1) / 2.0) / (CAST(p AS DOUBLE) * n) ELSE 0.0 END AS auroc FROM (
    SELECT model, task, grp, count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS n,
           coalesce(sum(mid) FILTER (positive), 0) AS ranks FROM (
      SELECT *, rank() OVER (PARTITION BY model, task, grp ORDER BY score)
        + (count(*) OVER (PARTITION BY model, task, grp, score) - 1) / 2.0 AS mid FROM {MARKED})
    GROUP BY model, task, grp) JOIN {LABELS_OF} USING (model, task, grp))"""
AUPRC = f"""(SELECT model, task, grp, CASE WHEN max(n_true) <= 2 AND max(p) > 0 THEN
      sum((recall - r0) * (prec + p0) / 2) ELSE 0.0 END AS auprc FROM (
    SELECT *, lag(recall, 1, 0.0) OVER w AS r0, lag(prec, 1, 1.0) OVER w AS p0 FROM (
      SELECT *, ctp / nullif(p, 0) AS recall, ctp / (ctp + cfp) AS prec FROM (
        SELECT model, task, grp, score,
          CAST(sum(tp) OVER (PARTITION BY model, task, grp ORDER BY score DESC) AS DOUBLE) AS ctp,
          CAST(sum(fp) OVER (PARTITION BY model, task, grp ORDER BY score DESC) AS DOUBLE) AS cfp,
          CAST(sum(tp) OVER (PARTITION BY model, task, grp) AS DOUBLE) AS p FROM (
          SELECT model, task, grp, score, count(*) FILTER (positive) AS tp,
                 count(*) FILTER (NOT positive) AS fp FROM {MARKED} GROUP BY ALL)))
    WINDOW w AS (PARTITION BY model, task, grp ORDER BY score DESC))
    JOIN {LABELS_OF} USING (model, task, grp) GROUP BY model, task, grp)"""
WIDE = f"""SELECT model, task, grp, round(micro_f1, 3) AS micro_f1, round(macro_f1, 3) AS macro_f1,
      round(auroc, 3) AS auroc, round(auprc, 3) AS auprc, round(specificity, 3) AS specificity,
      round(sensitivity, 3) AS sensitivity
    FROM {MICRO} JOIN {MACRO} USING (model, task, grp) JOIN {AUROC} USING (model, task, grp)
    JOIN {AUPRC} USING (model, task, grp) JOIN {RATES} USING (model, task, grp)"""


def scored(spark, sf):
    docs = I.documents(spark, sf)
    words = docs.select("doc_id", "lang", "source", X.words_of(F.col("text")).alias("w"))
    task = F.col("task")

    def has(word):
        return F.array_contains("w", word)

    # Score and guesses are computed once per document, before the tasks fan out.
    docs = words.select(
        "doc_id",
        "lang",
        "source",
        (F.size(F.array_distinct("w")).cast("double") / F.size("w")).alias("score"),
        F.when(has("the"), "en").when(has("le"), "fr").when(has("der"), "de").otherwise("es").alias("guess"),
    )
    labels = I.table(spark, sf, "labels")
    typed = [F.col(t).cast("string").alias(t) for t in ("quality", "toxic")]
    rows = labels.select("doc_id", *typed).unpivot(["doc_id"], ["quality", "toxic"], "task", "y")
    langs = docs.select("doc_id", F.lit("lang").alias("task"), F.col("lang").alias("y"))
    yhat = F.when(task == "lang", F.col("guess")).when(F.col("score") >= 0.75, "1").otherwise("0")
    out = rows.unionByName(langs).join(docs, "doc_id")
    return out.select(
        F.lit("ttr").alias("model"), "task", "doc_id", "y", yhat.alias("yhat"), "score", "lang", "source"
    )


def marked(spark, sf):
    return M.mark_positive(tasks.with_subgroups(scored(spark, sf), CATALOGUE), POSITIVE)


@query("subgroup_metrics", WIDE)
def subgroup_metrics(spark, sf):
    return M.subgroup_metrics(marked(spark, sf))


@query("metric_micro_f1", f"SELECT model, task, grp, round(micro_f1, 6) AS micro_f1 FROM {MICRO}")
def metric_micro_f1(spark, sf):
    out = M.micro_f1(M.confusion(M.cells(marked(spark, sf))))
    return out.withColumn("micro_f1", F.round("micro_f1", 6))


@query("metric_macro_f1", f"SELECT model, task, grp, round(macro_f1, 6) AS macro_f1 FROM {MACRO}")
def metric_macro_f1(spark, sf):
    out = M.macro_f1(M.confusion(M.cells(marked(spark, sf))))
    return out.withColumn("macro_f1", F.round("macro_f1", 6))


@query("metric_auroc", f"SELECT model, task, grp, round(auroc, 6) AS auroc FROM {AUROC}")
def metric_auroc(spark, sf):
    return M.areas(marked(spark, sf)).select("model", "task", "grp", F.round("auroc", 6).alias("auroc"))


@query("metric_auprc", f"SELECT model, task, grp, round(auprc, 6) AS auprc FROM {AUPRC}")
def metric_auprc(spark, sf):
    return M.areas(marked(spark, sf)).select("model", "task", "grp", F.round("auprc", 6).alias("auprc"))


@query(
    "metric_confusion",
    f"""SELECT model, task, grp, round(specificity, 6) AS specificity,
    round(sensitivity, 6) AS sensitivity FROM {RATES}""",
)
def metric_confusion(spark, sf):
    out = M.specificity_sensitivity(M.confusion(M.cells(marked(spark, sf))))
    return out.select(
        *M.KEYS, F.round("specificity", 6).alias("specificity"), F.round("sensitivity", 6).alias("sensitivity")
    )


@query(
    "round_metrics",
    f"SELECT task, doc_id, round(score, 3) AS score FROM {SCORED}",
)
def round_metrics(spark, sf):
    return scored(spark, sf).select("task", "doc_id", F.round("score", 3).alias("score"))


@query(
    "metric_rows",
    f"""WITH w AS ({WIDE}) UNPIVOT w ON micro_f1, macro_f1, auroc, auprc, specificity, sensitivity
    INTO NAME metric VALUE value""",
)
def metric_rows(spark, sf):
    return M.metric_rows(subgroup_metrics(spark, sf)).filter("value is not null")


# ---- result tables: events as a log of runs --------------------------------------

EVENT_GROUPS = ["click", "error", "purchase", "signup", "view"]
LOG = """(SELECT 'events' AS model, CAST(user_id AS VARCHAR) AS task, 'value' AS metric,
    event_type AS grp, value, ts, event_id FROM events)"""
LATEST = f"""(SELECT model, task, metric, grp, value, event_id FROM {LOG}
    QUALIFY row_number() OVER (PARTITION BY model, task, metric, grp ORDER BY ts DESC, event_id DESC) = 1)"""
PIVOTED = f"""(SELECT model, task, metric, {', '.join(f"max(value) FILTER (grp = '{g}') AS {g}" for g in EVENT_GROUPS)}
    FROM {LATEST} GROUP BY model, task, metric)"""


def latest_long(spark, sf):
    log = I.table(spark, sf, "events").select(
        F.lit("events").alias("model"),
        F.col("user_id").cast("string").alias("task"),
        F.lit("value").alias("metric"),
        F.col("event_type").alias("grp"),
        "value",
        "ts",
        "event_id",
    )
    out = report.latest(log, ["model", "task", "metric", "grp"], ["ts", "event_id"])
    return out.select("model", "task", "metric", "grp", "value", "event_id")


def wide_results(spark, sf):
    return report.results_wide(latest_long(spark, sf), EVENT_GROUPS)


@query("latest_result", f"SELECT * FROM {LATEST}")
def latest_result(spark, sf):
    return latest_long(spark, sf)


@query("results_wide", f"SELECT * FROM {PIVOTED}")
def results_wide(spark, sf):
    return wide_results(spark, sf)


@query(
    "results_long",
    f"UNPIVOT {PIVOTED} ON {', '.join(EVENT_GROUPS)} INTO NAME grp VALUE value",
)
def results_long(spark, sf):
    return report.results_long(wide_results(spark, sf), EVENT_GROUPS)


@query(
    "results_filtered",
    f"""SELECT model, task, metric, grp, value FROM (UNPIVOT {PIVOTED} ON {', '.join(EVENT_GROUPS)}
    INTO NAME grp VALUE value) WHERE grp IN ('click', 'error')""",
)
def results_filtered(spark, sf):
    long = report.results_long(wide_results(spark, sf), EVENT_GROUPS)
    return report.select_results(long, ["click", "error"])
