"""Neighbours and ROC curves over the embedding table, one task per label."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as I
from checks.registry import query
from chartweave.operators import similarity as S
from chartweave.operators import tasks

# Averages of fractions often end exactly between two roundings; both sides add this.
TIE = 1e-9
COSINE = """CAST(round(list_dot_product(q.vec, c.vec)
    / (sqrt(list_dot_product(q.vec, q.vec)) * sqrt(list_dot_product(c.vec, c.vec))) * 1000000) AS BIGINT)"""
TASKS = """(SELECT CAST(t.label AS VARCHAR) AS task, vec_id AS user,
      CASE WHEN e.label = t.label THEN '1' ELSE '0' END AS y, CAST(embedding AS DOUBLE[]) AS vec
    FROM embeddings e, (SELECT DISTINCT label FROM embeddings) t)"""
BALANCED = f"""(WITH r AS (SELECT *, count(*) OVER (PARTITION BY task, y) AS n FROM {TASKS}),
    m AS (SELECT task, arg_min(y, (n, y)) AS minority, min(n) AS min_count FROM r GROUP BY task)
    SELECT task, "user", y, vec FROM (
      SELECT r.*, y = minority AS small, min_count,
        row_number() OVER (PARTITION BY r.task, y = minority ORDER BY "user") AS rn
      FROM r JOIN m ON r.task = m.task)
    WHERE small OR rn <= min_count)"""
STEPS = f"""(SELECT task, "user", y, score, sum(hit) AS tp, count(*) - sum(hit) AS fp FROM (
      SELECT q.task, q."user", q.y, {COSINE} AS score, CAST(q.y = c.y AS BIGINT) AS hit
      FROM {BALANCED} q JOIN {BALANCED} c ON q.task = c.task)
    GROUP BY ALL)"""
# Vertices of each curve with (0,0); per false-positive rate the lowest and highest
# true-positive rate; then linear interpolation to the next rate.
CURVES = f"""(WITH run AS (SELECT task, "user", y,
        CAST(sum(tp) OVER w AS DOUBLE) / sum(tp) OVER (PARTITION BY task, "user") AS tpr,
        sum(fp) OVER w AS cfp, sum(fp) OVER (PARTITION BY task, "user") AS n
      FROM {STEPS} WINDOW w AS (PARTITION BY task, "user" ORDER BY score DESC)),
    pts AS (SELECT task, "user", y, cfp, n, tpr FROM run
            UNION ALL SELECT DISTINCT task, "user", y, 0, n, 0.0 FROM run),
    v AS (SELECT task, "user", y, cfp AS x0, n, max(tpr) AS hi, min(tpr) AS lo FROM pts GROUP BY ALL),
    seg AS (SELECT *, lead(x0) OVER u AS x1, lead(lo) OVER u AS y1 FROM v
            WINDOW u AS (PARTITION BY task, "user" ORDER BY x0))
    SELECT task, "user", y, k, CASE WHEN x1 IS NULL OR k * n = 99 * x0 THEN hi
        ELSE hi + (y1 - hi) * (CAST(k * n AS DOUBLE) / 99 - x0) / (x1 - x0) END AS tpr
    FROM seg JOIN (SELECT unnest(range(100)) AS k) g
      ON 99 * x0 <= k * n AND (x1 IS NULL OR k * n < 99 * x1))"""
MEANS = f"""(SELECT task, y, k, n_users, CASE k WHEN 0 THEN 0.0 WHEN 99 THEN 1.0 ELSE m END AS tpr
    FROM (SELECT task, y, k, count(*) AS n_users, avg(tpr) AS m FROM {CURVES} GROUP BY task, y, k))"""


def all_tasks(spark, sf):
    users = I.users(spark, sf)
    # The class set: one value per label, not per user.
    labels = [r["label"] for r in users.select("label").distinct().orderBy("label").collect()]
    return S.one_vs_rest(users, "label", labels)


def balanced(spark, sf):
    return tasks.balanced_users(all_tasks(spark, sf), [F.col("user")])


NEAREST = f"""SELECT 'all' AS task, "user", CAST(rank AS INTEGER) AS rank, neighbour, score / 1000000.0 AS score FROM (
      SELECT "user", neighbour, score, row_number() OVER (PARTITION BY "user" ORDER BY score DESC, neighbour) AS rank
      FROM (SELECT q."user", c."user" AS neighbour, {COSINE} AS score
        FROM (SELECT vec_id AS "user", CAST(embedding AS DOUBLE[]) AS vec FROM embeddings) q
        JOIN (SELECT vec_id AS "user", CAST(embedding AS DOUBLE[]) AS vec FROM embeddings) c
          ON q."user" <> c."user"))
    WHERE rank <= 10"""


def one_task(spark, sf):
    return I.users(spark, sf).select(
        F.lit("all").alias("task"), "user", F.col("label").cast("string").alias("y"), "vec"
    )


@query("neighbour_topk", NEAREST)
def neighbour_topk(spark, sf):
    return S.neighbour_topk(one_task(spark, sf), 10)


@query("neighbour_topk_blocks", NEAREST)
def neighbour_topk_blocks(spark, sf):
    """Many small blocks and groups, as of a table that no task holds."""
    return S.neighbour_topk(one_task(spark, sf), 10, block_rows=32, group_rows=128, pivots=16)


ROC = f'SELECT task, "user", y, k, round(k / 99, 6) AS fpr, round(tpr + 1e-9, 6) AS tpr FROM {CURVES}'


@query("user_roc_blocks", ROC)
def user_roc_blocks(spark, sf):
    out = S.user_roc(balanced(spark, sf), block_rows=16, group_rows=48)
    return out.withColumn("fpr", F.round("fpr", 6)).withColumn("tpr", F.round(F.col("tpr") + TIE, 6))


@query("user_roc", ROC)
def user_roc(spark, sf):
    out = S.user_roc(balanced(spark, sf))
    return out.withColumn("fpr", F.round("fpr", 6)).withColumn("tpr", F.round(F.col("tpr") + TIE, 6))


@query(
    "mean_roc",
    f"SELECT task, y, k, n_users, round(k / 99, 6) AS fpr, round(tpr + 1e-9, 6) AS tpr FROM {MEANS}",
)
def mean_roc(spark, sf):
    out = S.mean_roc(S.user_roc(balanced(spark, sf)))
    return out.withColumn("fpr", F.round("fpr", 6)).withColumn("tpr", F.round(F.col("tpr") + TIE, 6))


@query(
    "mean_roc_auc",
    f"""SELECT task, y, round(sum(CASE WHEN k IN (0, 99) THEN tpr / 2 ELSE tpr END) / 99 + 1e-9, 6) AS auc
    FROM {MEANS} GROUP BY task, y""",
)
def mean_roc_auc(spark, sf):
    out = S.mean_roc_auc(S.mean_roc(S.user_roc(balanced(spark, sf))))
    return out.withColumn("auc", F.round(F.col("auc") + TIE, 6))
