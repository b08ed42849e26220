"""The registered queries against their SQL, and the pipeline's stages on the smallest data."""

import pytest

import corpus_pipeline
from chartweave.llm.queries import ORACLES, QUERIES
from checks.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), ORACLES[name], connect(SF)) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"op7_exact_top_k"}))
def test_query_covers_documents(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r[0] for r in QUERIES[name](spark, SF).select("doc_id").distinct().collect()}
    assert ids == {r[0] for r in docs.select("doc_id").collect()}


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        kept[name] = {r[0] for r in docs.select("doc_id").collect()}
        if name != "best_fit_packing":
            assert docs.columns == columns
    sizes = [len(kept[n]) for n, _ in corpus_pipeline.STAGES]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == sizes[-2] > 0
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


CLASHES = (
    "score predicted n_entities size source_size target taken parts rank start lane before base block boxed row key "
    "between entities odd item surrogate found id y m1 m2 terms _w _key kept component_id n_shingles d1 d2 piece length"
).split()


def test_stages_keep_columns_whose_names_they_use(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.select("*", *[F.concat(F.lit(f"{c}-"), "doc_id").alias(c) for c in CLASHES])
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        if name == "best_fit_packing":
            assert docs.count() > 0
            continue
        assert docs.columns == columns
        assert docs.filter(" or ".join(f"`{c}` <> concat('{c}-', doc_id)" for c in CLASHES)).count() == 0


def test_queries_run_where_workers_lack_the_package(tmp_path):
    """Workers start in a folder of their own, without the repository on their path."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).resolve().parents[2]
    code = f"""
import sys
sys.path.insert(0, {str(repo)!r})
import __spark_entry__ as e
from chartweave.session import local_session
s = local_session("away", 2)
for name in ("op10_quality_classifier", "op13_toxicity", "op12_prefix_trie"):
    print(name, e.queries()[name](s, {SF!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "op10_quality_classifier 200" in done.stdout
