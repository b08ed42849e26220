"""What the physical plans must and must not contain."""

import pytest
from pyspark.sql import functions as F

from chartweave.functions import text as X
from chartweave.operators import entities
from checks import QUERIES
from checks import inputs as I

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    [
        "clean_documents",
        "cohort_audit",
        "notes_filtered",
        "stratified_split",
        "bow_freq",
        "word_types",
        "results_wide",
    ],
)
def test_no_python_where_columns_do(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "Python" not in text and "InPandas" not in text


def test_filters_and_columns_reach_the_scan(spark):
    df = I.notes(spark, SF).filter("category = 'user'").select("subject_id")
    text = plan(df)
    assert "EqualTo(role,user)" in text
    assert "ReadSchema: struct<conv_id:bigint,role:string>" in text


def test_cleaning_is_one_generated_expression(spark):
    df = I.documents(spark, SF).select("doc_id", X.clean(F.col("text")).alias("t"))
    text = plan(df)
    assert "lambda" not in text and "Python" not in text


@pytest.mark.parametrize("job", [entities.link_entities, entities.annotate_text, entities.raw_and_annotated])
def test_notes_are_read_once_and_stay_in_place(spark, job):
    """Entities are found beside the text: one scan of the notes, nothing shuffled or joined."""
    notes = spark.read.parquet(f"{SF}/documents.parquet").withColumn("tokens", F.split("text", " "))
    gazetteer = spark.createDataFrame([("the of", "T047", "C1")], "phrase string, tui string, cui string")
    text = plan(job(notes, gazetteer, "doc_id"))
    assert text.count("FileScan") == 1
    assert "Join" not in text and "Exchange" not in text


def test_the_audit_reads_each_use_of_a_table_once(spark):
    """Patients, admissions, stays, notes and labels: no table is read for a second question."""
    text = plan(QUERIES["cohort_audit"](spark, SF))
    assert text.count("FileScan") == 5 and "Join" not in text
