"""Vocabularies, feature vectors, encoders and probes."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as I
from checks.cohort_queries import TASK_ROWS, task_rows
from checks.metric_queries import CATALOGUE
from checks.registry import query
from chartweave.functions import text as X
from chartweave.operators import encoders, features, probe, registry, tasks, vocab
from chartweave.operators import metrics as M
from chartweave.session import cut_lineage
from chartweave.sources import tables

TERMS = f"""(SELECT doc_id, token, count(*) AS n FROM
    (SELECT doc_id, unnest(string_split(text, ' ')) AS token FROM {I.CLEAN_DOCS}) GROUP BY doc_id, token)"""
COUNTS = f"(SELECT token, CAST(sum(n) AS BIGINT) AS n FROM {TERMS} GROUP BY token)"
# The embeddings table is dense in vec_id, so a hash modulo its size finds a row.
VECTORS = f"""(WITH c AS (SELECT token, CAST(CAST('0x' || left(md5(token), 8) AS UBIGINT)
      % (SELECT count(*) FROM embeddings) AS BIGINT) AS at FROM {COUNTS})
    SELECT token, embedding FROM c JOIN embeddings e ON e.vec_id = c.at)"""


def _summed(weight: str, scale: str = "") -> str:
    return f"""SELECT doc_id, n_tokens, CAST(dim - 1 AS INTEGER) AS dim, round(v{scale}, 6) AS value FROM (
      SELECT doc_id, dim, CAST(sum(n) AS BIGINT) AS n_tokens, sum(CAST(x AS DOUBLE) * {weight}) AS v FROM (
        SELECT doc_id, n, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dim
        FROM {TERMS} JOIN {VECTORS} USING (token)) GROUP BY doc_id, dim)"""


def terms(spark, sf):
    return features.bow_freq(*_named(spark, sf))


def _named(spark, sf):
    return I.clean_documents(spark, sf), "doc_id", F.split("text", " ")


def counts(spark, sf):
    return vocab.token_counts(I.clean_documents(spark, sf), F.split("text", " "))


def vectors(spark, sf):
    return I.token_vectors(spark, sf, counts(spark, sf))


def _bag(spark, sf, job, whole=False):
    """``job`` of the documents' terms and the vectors of their tokens, which share the embeddings' rows.
    Sums need no ``whole`` documents."""
    lists = features.bow_lists(*_named(spark, sf), whole)
    kinds = lists.select(F.explode("tokens").alias("token")).distinct()
    docs = I.documents(spark, sf).count()
    shared = {"matrix": I.vector_rows(spark, sf), "docs": docs}
    return job(lists, I.token_rows(spark, sf, kinds), "doc_id", _dims(spark, sf), **shared)


def _dims(spark, sf):
    return features.width(I.table(spark, sf, "embeddings"), "embedding")


@query(
    "token_vocab",
    f"SELECT row_number() OVER (ORDER BY n DESC, token) - 1 AS id, token, n FROM {COUNTS}",
)
def token_vocab(spark, sf):
    return vocab.token_vocab(counts(spark, sf))


@query("min_word_freq", f"SELECT token, n FROM {COUNTS} WHERE n >= 5")
def min_word_freq(spark, sf):
    return vocab.frequent(counts(spark, sf), 5)


@query("bow_bin", f"SELECT doc_id, token, CAST(1 AS BIGINT) AS n FROM {TERMS}")
def bow_bin(spark, sf):
    return features.bow_bin(*_named(spark, sf))


@query("bow_freq", f"SELECT doc_id, token, n FROM {TERMS}")
def bow_freq(spark, sf):
    return terms(spark, sf)


@query(
    "token_embeddings",
    f"""SELECT token, n, round(CAST(embedding[1] AS DOUBLE), 6) AS first,
    round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total
    FROM {COUNTS} JOIN {VECTORS} USING (token)""",
)
def token_embeddings(spark, sf):
    joined = features.token_embeddings(counts(spark, sf), vectors(spark, sf))
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)
    return joined.select(
        "token", "n", F.round(F.element_at("vec", 1), 6).alias("first"), F.round(total, 6).alias("total")
    )


@query("boe_sum", _summed("n"))
def boe_sum(spark, sf):
    out = _bag(spark, sf, features.boe_sum)
    return features.long_vectors(out, "doc_id", "n_tokens")


@query("boe_bin", _summed("1"))
def boe_bin(spark, sf):
    out = _bag(spark, sf, features.boe_bin, whole=True)
    return features.long_vectors(out, "doc_id", "n_tokens")


@query("user_embedding_mean", _summed("n", " / n_tokens"))
def user_embedding_mean(spark, sf):
    out = _bag(spark, sf, features.user_embedding_mean)
    return features.long_vectors(out, "doc_id", "n_tokens")


@query(
    "user_vectors",
    """SELECT doc_id, CAST(dim - 1 AS INTEGER) AS dim, round(CAST(x AS DOUBLE), 6) AS value FROM (
      SELECT doc_id, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM (
        SELECT doc_id, coalesce(embedding, list_resize([]::FLOAT[], 64, 0)) AS v
        FROM documents LEFT JOIN embeddings ON vec_id = doc_id))""",
)
def user_vectors(spark, sf):
    known = I.users(spark, sf).select(F.col("user").alias("doc_id"), "vec")
    out = features.user_vectors(I.documents(spark, sf), known, "doc_id")
    return features.long_vectors(out, "doc_id")


@query(
    "feature_lookup",
    f"""SELECT task, subject_id, y, round(CAST(embedding[1] AS DOUBLE), 6) AS first,
    round(CAST(embedding[64] AS DOUBLE), 6) AS last
    FROM {TASK_ROWS} JOIN embeddings ON vec_id = subject_id""",
)
def feature_lookup(spark, sf):
    known = I.users(spark, sf).select(F.col("user").alias("subject_id"), "vec")
    out = features.feature_rows(task_rows(spark, sf), known)
    return out.select(
        "task", "subject_id", "y",
        F.round(F.element_at("vec", 1), 6).alias("first"),
        F.round(F.element_at("vec", 64), 6).alias("last"),
    )


@query(
    "embedding_lines",
    """SELECT CAST(vec_id AS VARCHAR) AS key, CAST(dim - 1 AS INTEGER) AS dim, round(CAST(x AS DOUBLE), 6) AS value
    FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings)""",
)
def embedding_lines(spark, sf):
    """The vectors written as ``key v1 v2 ...`` lines and parsed again."""
    lines = I.users(spark, sf).select(
        F.concat_ws(" ", F.col("user").cast("string"), F.col("vec").cast("array<string>")).alias("value")
    )
    return features.long_vectors(tables.parse_embedding_lines(lines), "key")


@query(
    "window_chunks",
    f"""SELECT doc_id, CAST((pos - 1) // 128 AS INTEGER) AS part, string_agg(token, ' ' ORDER BY pos) AS text
    FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS token,
                 generate_subscripts(string_split(text, ' '), 1) AS pos FROM {I.CLEAN_DOCS})
    GROUP BY doc_id, (pos - 1) // 128""",
)
def window_chunks(spark, sf):
    parts = X.chunks(F.split("text", " "), 128)
    out = I.clean_documents(spark, sf).select("doc_id", F.posexplode(parts).alias("part", "w"))
    return out.select("doc_id", "part", F.array_join("w", " ").alias("text"))


# Pooling over the vectors of an orders-like 1:n relation: users of the same label.
@query(
    "pool_mean",
    """SELECT CAST(label AS BIGINT) AS label, n_parts, CAST(dim - 1 AS INTEGER) AS dim, round(v / n_parts, 6) AS value FROM (
      SELECT label, dim, count(*) AS n_parts, sum(CAST(x AS DOUBLE)) AS v FROM (
        SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings)
      GROUP BY label, dim)""",
)
def pool_mean(spark, sf):
    parts = I.users(spark, sf).select(F.col("label").cast("bigint").alias("label"), F.col("user").alias("part"), "vec")
    return features.long_vectors(features.pool_mean(parts, "label"), "label", "n_parts")


@query(
    "pool_first",
    """SELECT CAST(label AS BIGINT) AS label, n_parts, CAST(dim - 1 AS INTEGER) AS dim, round(CAST(x AS DOUBLE), 6) AS value FROM (
      SELECT label, n_parts, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM (
        SELECT label, count(*) AS n_parts, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY label))""",
)
def pool_first(spark, sf):
    parts = I.users(spark, sf).select(F.col("label").cast("bigint").alias("label"), F.col("user").alias("part"), "vec")
    return features.long_vectors(features.pool_first(parts, "label"), "label", "n_parts")


# ---- encoders: the check encoder turns a token into the roots of its md5 bytes ----

_BYTES = " , ".join(
    f"sqrt(CAST(CAST('0x' || substr(md5(token), {2 * i + 1}, 2) AS UBIGINT) AS DOUBLE))" for i in range(8)
)


def _encoded(parts: str, only_first_token: bool, pooled: str, key: str = "doc_id") -> str:
    """SQL of encode + pool over ``parts(doc_id, part, text)``."""
    keep = "WHERE pos = 1" if only_first_token else ""
    pool = "avg(v)" if pooled == "mean" else "arg_min(v, part)"
    return f"""SELECT doc_id, dim, round({pool}, 6) AS value FROM (
      SELECT doc_id, part, dim, avg(x) AS v FROM (
        SELECT doc_id, part, unnest([{_BYTES}]) AS x, CAST(unnest(range(8)) AS INTEGER) AS dim FROM (
          SELECT doc_id, part, unnest(string_split(text, ' ')) AS token,
                 generate_subscripts(string_split(text, ' '), 1) AS pos FROM {parts}) {keep})
      GROUP BY doc_id, part, dim) GROUP BY doc_id, dim"""


_WHOLE = f"(SELECT doc_id, 0 AS part, text FROM {I.CLEAN_DOCS})"
_WINDOWS = f"""(SELECT doc_id, part, string_agg(token, ' ' ORDER BY pos) AS text FROM (
    SELECT doc_id, pos, token, CAST((pos - 1) // 128 AS INTEGER) AS part FROM (
      SELECT doc_id, unnest(string_split(text, ' ')) AS token,
             generate_subscripts(string_split(text, ' '), 1) AS pos FROM {I.CLEAN_DOCS}))
    GROUP BY doc_id, part)"""


def _encode(spark, sf, feature):
    docs = I.clean_documents(spark, sf)
    out = encoders.encode_features(docs, feature, encoders.hash_encoder(), "doc_id")
    return features.long_vectors(out, "doc_id")


@query("encode_pool", _encoded(_WHOLE, False, "mean"))
def encode_pool(spark, sf):
    return _encode(spark, sf, "BERT-POOL")


@query("encode_cls", _encoded(_WHOLE, True, "mean"))
def encode_cls(spark, sf):
    return _encode(spark, sf, "BERT-CLS")


@query("encode_multi_pool", _encoded(_WINDOWS, False, "mean"))
def encode_multi_pool(spark, sf):
    return _encode(spark, sf, "MULTI-BERT-POOL")


@query("encode_multi_cls", _encoded(_WINDOWS, True, "first"))
def encode_multi_cls(spark, sf):
    return _encode(spark, sf, "MULTI-BERT-CLS")


# ---- probes: a fitted model has no SQL ---------------------------------------------


def _probe_rows(spark, sf):
    vec = _bag(spark, sf, features.user_embedding_mean)
    rows = tasks.stratified_split(
        task_rows(spark, sf), ["task", "y"], ["subject_id"], names=("train", "test")
    )
    docs = I.documents(spark, sf).select(F.col("doc_id").alias("subject_id"), "lang", "source")
    known = vec.select(F.col("doc_id").alias("subject_id"), "vec")
    return features.feature_rows(rows.join(docs, "subject_id"), known)


_TWO = {"quality": "1", "toxic": "1"}
_TASKS_SOLVED = f"SELECT DISTINCT CAST(task AS VARCHAR) AS task, TRUE AS converged FROM {TASK_ROWS}"


@query("probe_convergence", _TASKS_SOLVED)
def probe_convergence(spark, sf):
    """All tasks are solved: the gradient of the penalised loss vanishes."""
    return probe.convergence(_probe_rows(spark, sf), _TWO)


# ---- bags of words as features of a probe, by name -----------------------------------

BOW_SIZE = 2000
_BOW = f"""(SELECT doc_id, id, n FROM {TERMS} JOIN (SELECT token, row_number() OVER (ORDER BY n DESC, token) - 1 AS id
    FROM {COUNTS}) USING (token) WHERE id < {BOW_SIZE})"""


def _bow_features(spark, sf, name):
    """Bags over the commonest words; the texts are cleaned once, for the vocabulary and for the bags."""
    clean = cut_lineage(I.clean_documents(spark, sf))
    known = vocab.token_vocab(vocab.token_counts(clean, F.split("text", " ")), BOW_SIZE)
    return registry.build(name, clean.select("doc_id", F.split("text", " ").alias("tokens")), "doc_id", vocabulary=known)


def _vector_sql(weight):
    return f"""SELECT doc_id, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY id) AS ids,
    string_agg(CAST({weight} AS VARCHAR), ' ' ORDER BY id) AS weights FROM {_BOW} GROUP BY doc_id"""


def _joined(out):
    whole = F.col("weights").cast("array<bigint>").cast("array<string>")
    return out.select(
        "doc_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"), F.array_join(whole, " ").alias("weights")
    )


@query("bow_freq_vectors", _vector_sql("n"))
def bow_freq_vectors(spark, sf):
    return _joined(_bow_features(spark, sf, "BOW-FREQ"))


@query("bow_bin_vectors", _vector_sql(1))
def bow_bin_vectors(spark, sf):
    return _joined(_bow_features(spark, sf, "BOW-BIN"))


def _bow_rows(spark, sf):
    rows = tasks.stratified_split(task_rows(spark, sf), ["task", "y"], ["subject_id"], names=("train", "test"))
    return features.feature_rows(rows, _bow_features(spark, sf, "BOW-FREQ").withColumnRenamed("doc_id", "subject_id"))


@query("bow_probe_convergence", _TASKS_SOLVED)
def bow_probe_convergence(spark, sf):
    return probe.convergence(_bow_rows(spark, sf), _TWO)


@query("bow_probe")
def bow_probe(spark, sf):
    """Scores of a probe on word counts."""
    return probe.probe(_bow_rows(spark, sf), "BOW-FREQ", _TWO)


@query(
    "probe_coverage",
    f"""SELECT task, 'train' AS split, count(*) AS n_rows, count(vec_id) AS n_kept
    FROM {TASK_ROWS} LEFT JOIN embeddings ON vec_id = subject_id GROUP BY task""",
)
def probe_coverage(spark, sf):
    known = I.users(spark, sf).select(F.col("user").alias("subject_id"), "vec")
    return features.feature_coverage(task_rows(spark, sf).withColumn("split", F.lit("train")), known)


@query("probe_scores")
def probe_scores(spark, sf):
    positive = {"quality": "1", "toxic": "1"}
    return probe.probe(_probe_rows(spark, sf), "U_mean", positive, ["lang", "source"])


@query("clinical_probe")
def clinical_probe(spark, sf):
    """Fit, score and evaluate all tasks, overall and per subgroup."""
    out = tasks.with_subgroups(probe_scores(spark, sf), CATALOGUE)
    return M.subgroup_metrics(M.mark_positive(out, {"quality": "1", "toxic": "1"}))


@query("demographics_probe")
def demographics_probe(spark, sf):
    """Predict the demographic attribute itself from user vectors; macro F1 is reported."""
    docs = I.documents(spark, sf)
    rows = docs.select(
        F.lit("LANG").alias("task"), F.col("doc_id").alias("subject_id"), F.col("lang").alias("y"), "lang", "source"
    )
    rows = tasks.stratified_split(rows, ["task", "y"], ["subject_id"], names=("train", "test"))
    known = _bag(spark, sf, features.user_embedding_mean)
    ready = features.feature_rows(rows, known.select(F.col("doc_id").alias("subject_id"), "vec"))
    scored = probe.probe(ready, "U_mean", {"LANG": "en"}, ["lang", "source"])
    wide = M.subgroup_metrics(
        M.mark_positive(tasks.with_subgroups(scored, CATALOGUE), {"LANG": "en"})
    )
    return wide.select("model", "task", "grp", "macro_f1")
