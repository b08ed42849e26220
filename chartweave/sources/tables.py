"""Readers and writers for the file formats of the jobs."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from pathlib import PurePath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PATIENTS = {"subject_id": "bigint", "gender": "string"}
ADMISSIONS = {
    "subject_id": "bigint",
    "admission_id": "bigint",
    "insurance": "string",
    "ethnicity": "string",
}
NOTES = {
    "subject_id": "bigint",
    "note_id": "bigint",
    "charttime": "timestamp",
    "category": "string",
    "text": "string",
}


def read_gz_csv(spark: SparkSession, path: str, columns: Mapping[str, str], parts: int | None = None) -> DataFrame:
    """Header CSV in gzip with multi-line text, columns by name in any case.

    A gzip file is one task however large, so the rows are spread right after the
    scan; write them to Parquet once and read that from then on.
    """
    raw = (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .csv(path)
    )
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return raw.select(
        *[F.col(name).cast(kind).alias(name) for name, kind in columns.items()]
    ).repartition(n)


def read_table(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """Parquet table.  With ``key``, a table of fewer files than cores is spread by
    that key, so that text work on a small input uses every core; a large table is
    already spread by its files and is not shuffled."""
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if key and len(df.inputFiles()) < cores:
        return df.repartition(cores, key)
    return df


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = "\t") -> DataFrame:
    return spark.read.csv(path, schema=schema, sep=sep, header=True, multiLine=True, escape='"')


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(path, sep="\t", header=True, escape='"')


def parse_embedding_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """``(key, vec)`` from ``key v1 v2 ...`` lines."""
    parts = F.split(F.trim(value), " ")
    numbers = F.slice(parts, F.lit(2), F.size(parts) - 1).cast("array<double>")
    return lines.select(F.get(parts, F.lit(0)).alias("key"), numbers.alias("vec"))


def read_embeddings(spark: SparkSession, path: str, vocabulary: DataFrame, key: str = "token") -> DataFrame:
    """Vectors of the keys in ``vocabulary``."""
    vectors = parse_embedding_lines(spark.read.text(path))
    return vectors.join(vocabulary.select(F.col(key).alias("key")), "key", "left_semi")


def write_tasks(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """All tasks and splits in one table, a folder per task and split."""
    rows.write.mode(mode).partitionBy("task", "split").parquet(path)


def committed(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` came to its end; a half-written folder has no mark."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def append_results(long: DataFrame, path: str, run: str | None = None) -> str:
    """Append the rows of a run to the result log, which is created on first use; the run's name.

    Rows are written first, a folder per run, in as many files as ``long`` has partitions however
    many models and tasks there are; the run's line in the manifest comes last.  Readers follow the
    manifest, so a run that failed midway is not there, and writing it again replaces what it left.
    A run that is there already is not written again.  Without a name each call is a run of its own.
    """
    spark, run = long.sparkSession, run or str(uuid.uuid4())
    line = f"{path}/runs/run={run}"
    if not committed(spark, line):
        long.write.mode("overwrite").parquet(f"{path}/results/run={run}")
        spark.range(1).select(F.current_timestamp().alias("written")).write.mode("overwrite").parquet(line)
    return run


def read_results(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Rows of all runs in the manifest of a result log, with their ``run``.  ``schema`` saves the
    reader from looking into the files of runs that never ended.  Runs of older logs, with a folder
    per model and task under ``rows``, are read as well."""
    runs = spark.read.option("basePath", f"{path}/runs").schema("written timestamp, run string").parquet(f"{path}/runs")

    def under(folder: str, schema) -> DataFrame:
        rows = spark.read.option("basePath", f"{path}/{folder}")
        rows = rows.schema(schema) if schema else rows
        return rows.parquet(f"{path}/{folder}").withColumn("run", F.col("run").cast("string"))

    if not _exists(spark, f"{path}/results"):
        rows = under("rows", schema)
    else:
        rows = under("results", schema)
        if _exists(spark, f"{path}/rows"):
            same = T.StructType([f for f in rows.schema if f.name != "run"])
            rows = rows.unionByName(under("rows", same))
    return rows.join(runs.select("run").distinct(), "run", "left_semi")


def read_cache(spark: SparkSession, path: str) -> DataFrame | None:
    """A cached table, or None when it was never written, or not to the end."""
    return spark.read.parquet(path) if committed(spark, path) else None


def write_cache(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def build_if_absent(spark: SparkSession, path: str, build) -> DataFrame:
    """Read ``path``, building it first when it is missing or half-written."""
    found = read_cache(spark, path)
    if found is None:
        write_cache(build(), path)
        found = spark.read.parquet(path)
    return found


def write_manifest(sliced: DataFrame, path: str, columns: Sequence[str] = ("abv", "name")) -> None:
    """``abv,name`` lines, one folder per manifest file number."""
    lines = sliced.select("file", F.concat_ws(",", *columns).alias("value"), "line")
    lines.repartition("file").sortWithinPartitions("file", "line").drop("line").write.mode(
        "overwrite"
    ).partitionBy("file").text(path)


def feature_name(feature: str, embeddings_path: str | None = None) -> str:
    """Name of a feature table; user vectors carry the stem of their file."""
    if feature == "U2V" and embeddings_path:
        return f"{feature}_{PurePath(embeddings_path).stem}"
    return feature


def write_arrays(features: DataFrame, path: str) -> None:
    """Fixed-width training arrays, a folder per split."""
    features.write.mode("overwrite").partitionBy("split").parquet(path)
