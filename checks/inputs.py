"""The given tables in the roles of the jobs, for Spark and as SQL subqueries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartweave.functions import text as X
from chartweave.functions.hashing import hash_int
from chartweave.sources.tables import read_table


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    key = {"documents": "doc_id", "conversations": "conv_id"}.get(name)
    return read_table(spark, f"{sf}/{name}.parquet", key)


ETHNICITY_BY_PRIORITY = {
    "1-URGENT": "ASIAN - CHINESE",
    "2-HIGH": "BLACK/AFRICAN AMERICAN",
    "3-MEDIUM": "HISPANIC OR LATINO",
    "4-NOT SPECIFIED": "WHITE - RUSSIAN",
    "5-LOW": "AMERICAN INDIAN/ALASKA NATIVE",
}
CATEGORIES = ("user", "assistant")


def patients(spark, sf) -> DataFrame:
    gender = F.when(F.col("c_nationkey") % 2 == 0, "F").otherwise("M")
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("subject_id"), gender.alias("gender")
    )


def admissions(spark, sf) -> DataFrame:
    e: Column | None = None
    for k, v in ETHNICITY_BY_PRIORITY.items():
        hit = F.col("o_orderpriority") == k
        e = F.when(hit, v) if e is None else e.when(hit, v)
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("subject_id"),
        F.col("o_orderkey").alias("admission_id"),
        F.col("o_orderstatus").alias("insurance"),
        e.alias("ethnicity"),
    )


def stays(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.concat_ws("_", "o_custkey", "o_orderkey").alias("stay"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y_true"),
        F.when(F.col("o_orderdate") < "1997-01-01", "train").otherwise("test").alias("split"),
    )


def notes(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("subject_id"),
        F.col("turn").alias("note_id"),
        F.col("turn").alias("charttime"),
        F.col("role").alias("category"),
        "text",
    )


def wide_labels(spark, sf) -> DataFrame:
    return table(spark, sf, "labels").select(F.col("doc_id").alias("subject_id"), "quality", "toxic")


def documents(spark, sf) -> DataFrame:
    return table(spark, sf, "documents")


def clean_documents(spark, sf) -> DataFrame:
    return documents(spark, sf).select("doc_id", X.clean(F.col("text")).alias("text"))


def users(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("user"), F.col("embedding").cast("array<double>").alias("vec"), "label"
    )


def token_rows(spark, sf, counts: DataFrame) -> DataFrame:
    """The embedding row that the hash of every token points to."""
    n = table(spark, sf, "embeddings").count()
    return counts.select("token", F.pmod(hash_int(F.md5("token"), 1), F.lit(n)).alias("row"))


def vector_rows(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("row"), F.col("embedding").cast("array<double>").alias("vec"))


def token_vectors(spark, sf, counts: DataFrame) -> DataFrame:
    """A vector for every token: the embedding row its hash points to."""
    return token_rows(spark, sf, counts).join(vector_rows(spark, sf), "row").select("token", "vec")


# ---- the same roles as SQL ------------------------------------------------------

PATIENTS = """(SELECT c_custkey AS subject_id,
    CASE WHEN c_nationkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender FROM customer)"""
_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ETHNICITY_BY_PRIORITY.items())
ADMISSIONS = f"""(SELECT o_custkey AS subject_id, o_orderkey AS admission_id,
    o_orderstatus AS insurance, CASE o_orderpriority {_CASES} END AS ethnicity FROM orders)"""
STAYS = """(SELECT o_custkey || '_' || o_orderkey AS stay,
    CAST(o_orderstatus = 'F' AS INTEGER) AS y_true,
    CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 'train' ELSE 'test' END AS split
    FROM orders)"""
NOTES = """(SELECT conv_id AS subject_id, turn AS note_id, turn AS charttime,
    role AS category, text FROM conversations)"""
LABELS = "(SELECT doc_id AS subject_id, quality, toxic FROM labels)"


def sql_normalise(x: str) -> str:
    out = f"regexp_replace(translate(lower({x}), chr(10) || chr(9), '  '), '[0-9]+', 'NUM', 'g')"
    for found, label in X.PLACEHOLDERS:
        out = f"replace({out}, '{found}', '{label}')"
    return out


def sql_tokens(x: str) -> str:
    return rf"regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]')"


def sql_breaks(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '\s+$', ''), '([.!?])\s+', '\1' || chr(1), 'g')"


def sql_squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def sql_clean(x: str) -> str:
    words = f"array_to_string({sql_tokens(sql_normalise(sql_breaks(x)))}, ' ')"
    return sql_squeeze(f"replace({words}, ' ' || chr(1) || ' ', ' [EOS] ')")


CLEAN_DOCS = f"(SELECT doc_id, {sql_clean('text')} AS text FROM documents)"
CLEAN_NOTES = f"""(SELECT conv_id AS subject_id, turn AS note_id, turn AS charttime,
    role AS category, {sql_clean('text')} AS text FROM conversations)"""
CATEGORY_LIST = ", ".join(f"'{c}'" for c in CATEGORIES)
