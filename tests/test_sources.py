import gzip

import numpy as np
import pytest

from chartweave.operators import encoders, features, probe
from chartweave.plans import probing
from chartweave.sources import tables


def test_gz_csv_with_multi_line_text(spark, tmp_path):
    path = tmp_path / "NOTES.csv.gz"
    with gzip.open(path, "wt") as f:
        f.write('SUBJECT_ID,NOTE_ID,CHARTTIME,CATEGORY,TEXT\n7,1,2101-10-20 10:00:00,Nursing,"two\nlines, ""q"""\n7,2,,Nursing,x\n')
    got = tables.read_gz_csv(spark, str(path), tables.NOTES, 2).orderBy("note_id").collect()
    assert got[0]["text"] == 'two\nlines, "q"' and got[1]["charttime"] is None


def test_tsv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"\nc'), (2, "d")], "subject_id bigint, text string")
    tables.write_tsv(df, str(tmp_path / "t"))
    got = tables.read_delimited(spark, str(tmp_path / "t"), df.schema)
    assert sorted(got.collect()) == sorted(df.collect())


def test_embeddings_are_filtered_by_vocabulary(spark, tmp_path):
    (tmp_path / "e.txt").write_text("a 0.5 1\nb 2 3\nc 4 5\n")
    words = spark.createDataFrame([("a",), ("c",), ("z",)], "token string")
    got = tables.read_embeddings(spark, str(tmp_path / "e.txt"), words).collect()
    assert {r["key"]: r["vec"] for r in got} == {"a": [0.5, 1.0], "c": [4.0, 5.0]}


def test_result_log_appends(spark, tmp_path):
    row = spark.createDataFrame([("m", "t", "auroc", "all", 0.5)], "model string, task string, metric string, grp string, value double")
    for _ in range(2):
        tables.append_results(row, str(tmp_path / "log"))
    assert tables.read_results(spark, str(tmp_path / "log")).count() == 2


class Stop(Exception):
    pass


def failing(spark, rows):
    """Rows of which the last partition fails while it is written."""
    from pyspark.sql import functions as F

    @F.udf("double")
    def value(x):
        if x == 9:
            raise Stop
        return float(x)

    return spark.range(10).repartition(5, "id").select(
        F.lit("m").alias("model"), F.concat(F.lit("t"), (F.col("id") % 2).cast("string")).alias("task"), F.lit("auroc").alias("metric"),
        F.lit("all").alias("grp"), (value("id") if rows == "bad" else F.col("id").cast("double")).alias("value"),
    )


def test_a_run_that_fails_midway_is_not_there_and_can_be_repeated(spark, tmp_path):
    path = str(tmp_path / "log")
    tables.append_results(failing(spark, "good").limit(3), path, "first")
    with pytest.raises(Exception):
        tables.append_results(failing(spark, "bad"), path, "second")
    assert {r["run"] for r in tables.read_results(spark, path).collect()} == {"first"}
    # Rows of a run that stopped between its rows and its line are not there either.
    failing(spark, "good").write.partitionBy("model", "task").parquet(f"{path}/rows/run=third")
    assert tables.read_results(spark, path).count() == 3
    for _ in range(2):
        assert tables.append_results(failing(spark, "good"), path, "second") == "second"
    got = tables.read_results(spark, path)
    assert got.filter("run = 'second'").count() == 10 and got.count() == 13
    assert {r["value"] for r in got.filter("run = 'second'").collect()} == {float(i) for i in range(10)}


def test_a_table_that_failed_midway_is_built_again(spark, tmp_path):
    path = str(tmp_path / "cache")
    with pytest.raises(Exception):
        tables.build_if_absent(spark, path, lambda: failing(spark, "bad"))
    assert tables.read_cache(spark, path) is None
    for _ in range(2):
        assert tables.build_if_absent(spark, path, lambda: failing(spark, "good")).count() == 10


def test_the_report_reads_the_log(spark, tmp_path):
    path = str(tmp_path / "log")
    schema = "model string, task string, metric string, grp string, value double"
    for value, run in ((0.9, "a"), (0.6, "b"), (0.1, "b")):
        rows = [("m", "t", "auroc", "all", value), ("m", "t", "auroc", "men", value / 2)]
        probing.log(spark.createDataFrame(rows, schema), path, 1, run)
    got = {r["grp"]: r["value"] for r in probing.report_of(spark, path, ["all", "men"]).collect()}
    assert got == {"all": 0.6, "men": 0.3}


def test_report_takes_the_last_run(spark, tmp_path):
    path = str(tmp_path / "log")
    for value, seed in ((0.9, 1), (0.6, 2)):
        row = [("m", "t", "auroc", "all", value)]
        schema = "model string, task string, metric string, grp string, value double"
        probing.log(spark.createDataFrame(row, schema), path, seed)
    log = tables.read_results(spark, path)
    assert {r["seed"] for r in log.collect()} == {1, 2}
    assert [r["all"] for r in probing.table(log).collect()] == [0.6]


def test_cache_and_build_if_absent(spark, tmp_path):
    path = str(tmp_path / "c")
    assert tables.read_cache(spark, path) is None
    first = tables.build_if_absent(spark, path, lambda: spark.range(3))
    again = tables.build_if_absent(spark, path, lambda: spark.range(9))
    assert first.count() == again.count() == 3


def test_manifest_files(spark, tmp_path):
    df = spark.createDataFrame([("A", "a x", 1, 1), ("B", "b", 2, 1), ("C", "c", 3, 2)], "abv string, name string, line int, file int")
    tables.write_manifest(df, str(tmp_path / "m"))
    got = [r["value"] for r in spark.read.text(str(tmp_path / "m" / "file=1")).collect()]
    assert got == ["A,a x", "B,b"]


def test_feature_names():
    assert tables.feature_name("U2V", "/x/U_mean.txt") == "U2V_U_mean"
    assert tables.feature_name("BOW-BIN") == "BOW-BIN"


def test_encoder_pooling_and_names(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "b")], "id bigint, text string")

    def make():
        return lambda texts: [np.array([[ord(t), 1.0] for t in x.split(" ")]) for x in texts]

    mean = {r["id"]: r["vec"] for r in encoders.encode_features(df, "BERT-POOL", make, "id").collect()}
    first = {r["id"]: r["vec"] for r in encoders.encode_features(df, "CLINICALBERT-CLS", make, "id").collect()}
    assert mean[1] == [98.0, 1.0] and first[1] == [97.0, 1.0] and mean[2] == first[2]
    parts = encoders.encode_multi(df, make, "id", window=2, max_parts=1).collect()
    assert {r["id"]: r["vec"][0] for r in parts} == {1: 97.5, 2: 98.0}
    long = spark.createDataFrame([(1, " ".join(["a"] * 40 + ["c"] * 40))], "id bigint, text string")
    assert encoders.encode_multi(long, make, "id", window=2).first()["vec"][0] == 98.0
    with pytest.raises(NotImplementedError):
        encoders.encode_features(df, "ELMO", make, "id")


def test_parts_of_a_subject_are_pooled(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "subject_id bigint, y string")
    vec = spark.createDataFrame(
        [(1, [5.0, 1.0]), (1, [2.0, 9.0]), (2, [0.1, 0.2]), (3, None)], "subject_id bigint, vec array<double>"
    )
    got = {r["subject_id"]: r["vec"] for r in features.feature_rows(rows, vec).collect()}
    assert got == {1: [3.5, 5.0], 2: [0.1, 0.2]}


def test_missing_user_vector_is_zero(spark):
    ids = spark.createDataFrame([(1,), (2,)], "k bigint")
    vec = spark.createDataFrame([(1, [1.0, 2.0])], "k bigint, vec array<double>")
    got = {r["k"]: r["vec"] for r in features.user_vectors(ids, vec, "k").collect()}
    assert got == {1: [1.0, 2.0], 2: [0.0, 0.0]}


def test_probe_learns_a_separable_task(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(200):
        y = int(rng.integers(0, 2))
        split = "train" if i < 120 else "val" if i < 150 else "test"
        rows.append(("t", split, i, "yes" if y else "no", [float(y * 4 + rng.normal()), float(rng.normal())]))
    df = spark.createDataFrame(rows, "task string, split string, subject_id bigint, y string, vec array<double>")
    got = probe.probe(df, "m", {"t": "yes"}).collect()
    assert len(got) == 50 and sum(r["y"] == r["yhat"] for r in got) > 44
    yes = [r["score"] for r in got if r["y"] == "yes"]
    no = [r["score"] for r in got if r["y"] == "no"]
    assert min(np.mean(yes), 1) > np.mean(no) + 0.5


def test_folders_of_a_log_do_not_grow_with_its_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    path = tmp_path / "log"
    rows = spark.range(200).selectExpr("'m' AS model", "concat('0', id) AS task", "'f1' AS metric", "'all' AS grp", "id * 1.0D AS value")
    rows.limit(5).withColumn("task", F.lit("7")).write.partitionBy("model", "task").parquet(f"{path}/rows/run=old")
    spark.range(1).select(F.current_timestamp().alias("written")).write.parquet(f"{path}/runs/run=old")
    tables.append_results(rows.coalesce(2), str(path), "new")
    assert len(list(path.rglob("results/**/*.parquet"))) == 2
    got = tables.read_results(spark, str(path))
    new = {(r["task"], r["value"]) for r in got.filter("run = 'new'").collect()}
    assert new == {(f"0{i}", float(i)) for i in range(200)}
    # A run of a log of the older layout is still there.
    assert {r["task"] for r in got.filter("run = 'old'").collect()} == {"7"} and got.count() == 205
