"""From raw documents to packed training sequences.

Quality classifier, near-duplicates, personal data, mixing, packing: each stage works on all
that the one before kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartweave.llm import mixing, neardup, packing, pii, quality
from chartweave.llm.queries import surrogate_key
from chartweave.session import ensure_checkpoint_dir

#: No SQL trains a network, draws permutations or packs; tests hold the stages against
#: brute-force versions.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, predicts good."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    longest = "_" * max(len(c) for c in docs.columns)  # longer than any column's name, so no column is replaced
    scored = quality.score(docs, model, (f"score{longest}", f"predicted{longest}"))
    return scored.filter(F.col(f"predicted{longest}") == 1).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies (five-word shingles).
    Rows with a null id stay.  Of rows that repeat an id and a text the one whose other columns are
    least stays; rows that repeat an id with another text stay if one of them does."""
    kept = neardup.near_duplicates(docs.select("doc_id", "text")).filter("kept").select("doc_id").distinct()
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    named = docs.join(kept.filter("doc_id is not null"), "doc_id", "left_semi").select(
        "doc_id", "text", (F.struct(*rest) if rest else F.lit(0)).alias("boxed")
    )
    least = named.groupBy("doc_id", "text").agg(F.min("boxed").alias("boxed"))
    back = [F.col(c) if c in ("doc_id", "text") else F.col("boxed")[c].alias(c) for c in docs.columns]
    return least.select(*back).unionByName(docs.filter("doc_id is null"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data; ``n_chars`` follows the text."""
    out = pii.pseudonymised(docs, surrogate_key(spark), count_col=None)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with the words that the mix takes from it."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", keep_good),
    ("minhash_near_dedup", drop_near_copies),
    ("pii_surrogates", replace_personal_data),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.  What a stage returns is written to the folder that
    executors share and read again, so a lost executor repeats one stage's tasks at most."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            # Nothing reads a stage's rows again once the next stage's are written.
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
