"""The three jobs end to end on a small made-up hospital."""

import numpy as np
import pytest

from chartweave.operators import vocab
from chartweave.plans import extract, mlm_corpus, probing, similarity_report
from chartweave.sources import tables

N = 80


@pytest.fixture(scope="module")
def hospital(spark):
    rng = np.random.default_rng(7)
    patients = spark.createDataFrame([(i, "MF"[i % 2]) for i in range(N)], "subject_id bigint, gender string")
    kinds = ["WHITE", "BLACK/AFRICAN AMERICAN", "ASIAN", "HISPANIC OR LATINO"]
    admissions = spark.createDataFrame(
        [(i, i * 10 + j, "Medicare", kinds[(i // 5 + j) % 4]) for i in range(N) for j in range(2)],
        "subject_id bigint, admission_id bigint, insurance string, ethnicity string",
    )
    words = ["pain", "chest", "cough", "fever", "stable", "severe"]
    notes = spark.createDataFrame(
        [
            (i, j, j, ["Nursing", "ECG"][j % 2], ". ".join(" ".join(rng.choice(words, 6)) for _ in range(4)) + ".")
            for i in range(N + 5)
            for j in range(5)
        ],
        "subject_id bigint, note_id bigint, charttime int, category string, text string",
    )
    split = ["train" if i % 4 else "test" for i in range(N)]
    ihm = spark.createDataFrame([(f"{i}_e", i // 4 % 2, split[i]) for i in range(N)], "stay string, y_true int, split string")
    pheno = spark.createDataFrame(
        [(f"{i}_e", i // 4 % 2, i // 3 % 2, split[i]) for i in range(N)],
        ["stay", "Heart failure", "Septic shock", "split"],
    )
    return extract.extract(patients, admissions, notes, ihm, pheno, ["Heart failure", "Septic shock"]), notes


def test_extract(spark, hospital, tmp_path):
    got, _ = hospital
    assert got.demographics.count() == N
    assert got.notes_all.count() == N + 5 and got.notes_cohort.count() == N
    assert got.notes_filtered.filter("n_notes = 3").count() == N
    n = {(r["task"], r["split"]): r["count"] for r in got.tasks.groupBy("task", "split").count().collect()}
    assert {t for t, _ in n} == {"IHM", "HF", "SS", "GENDER", "ETHNICITY", "ETHNICITY_BINARY"}
    assert n[("HF", "train")] == 48 and n[("HF", "val")] == 12 and n[("HF", "test")] == 20
    assert {r["n_after"] for r in got.audit.collect()} == {60, 20}
    extract.save(got, str(tmp_path / "out"), mini_rows=5)
    assert spark.read.parquet(str(tmp_path / "out/mini")).count() == 5 * 18
    assert spark.read.parquet(str(tmp_path / "out/tasks")).count() == 6 * N


def vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(i // 4 % 2) * 3 + float(rng.normal()), float(i % 2) * 3 + float(rng.normal()), 1.0]) for i in range(N)]
    return spark.createDataFrame(rows, "subject_id bigint, vec array<double>")


def test_probing(spark, hospital, tmp_path):
    got, _ = hospital
    long = probing.clinical(got.tasks, got.demographics, vectors(spark), "u", ["IHM", "HF"])
    rows = {(r["task"], r["grp"]): r["value"] for r in long.collect()}
    assert rows[("HF", "all")] > 0.8
    probing.log(long, str(tmp_path / "log"))
    wide = probing.table(tables.read_results(spark, str(tmp_path / "log"))).collect()
    assert len(wide) == 2 and wide[0]["all"] is not None
    people = probing.demographic(got.tasks, got.demographics, vectors(spark), "u")
    assert {r["metric"] for r in people.collect()} == {"macro_f1"}


def test_similarity_report(spark, hospital):
    got, _ = hospital
    tasks = got.tasks.filter("task in ('HF', 'GENDER')")
    curves = similarity_report.mean_curves(tasks, vectors(spark))
    assert curves.count() == 2 * 2 * 100
    assert all(r["auc"] > 0.5 for r in similarity_report.areas(curves).collect())


def test_mlm_corpus(spark, hospital):
    _, notes = hospital
    from chartweave.operators import cohort

    cleaned = cohort.clean_notes(notes)
    gaz = spark.createDataFrame([("chest pain", "T184", "C1"), ("severe cough", "T184", "C2")], "phrase string, tui string, cui string")
    anno = mlm_corpus.annotated_notes(cleaned, gaz, [2])
    assert anno.count() == cleaned.count()
    tagged = anno.filter("text like '%[T184] [C1]%'").count()
    assert tagged == cleaned.filter("text like '%chest pain%'").count() > 0
    units = mlm_corpus.build_units(cleaned, ["[T184]", "[C1]", "[C2]"], 120)
    assert units[0] == "[PAD]" and "[C2]" in units and len(units) <= 120
    rows = mlm_corpus.instances(cleaned, units, max_len=32, min_len=10, max_preds=8).collect()
    assert {r["split"] for r in rows} == {"train", "val"}
    assert all(len(r["token_ids"]) == len(r["mask"]) == 32 and len(r["label_ids"]) == len(r["indices"]) == 8 for r in rows)
    assert all(r["token_ids"][0] == vocab.SPECIALS.index("[CLS]") for r in rows)
