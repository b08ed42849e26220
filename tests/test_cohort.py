import random

import pytest
from pyspark.sql import functions as F

from chartweave.operators import cohort, entities, report, tasks


def notes(spark, rows):
    return spark.createDataFrame(rows, "subject_id bigint, note_id bigint, charttime int, category string, text string")


def test_newest_note_first_and_missing_time_last(spark):
    df = notes(spark, [(1, 1, 1, "x", "a"), (1, 2, 3, "x", "b"), (1, 3, None, "x", "c")])
    assert cohort.subject_documents(df).first()["text"] == "b [EOD] a [EOD] c"


def test_a_long_subject_continues_in_parts(spark):
    df = notes(spark, [(1, i, i, "x", f"n{i}") for i in range(25)] + [(2, 0, 0, "x", "m")])
    for kw in ({}, {"max_group_rows": 4}):
        rows = cohort.subject_documents(df, per_part=10, **kw).orderBy("subject_id", "part").collect()
        assert [(r["subject_id"], r["part"], r["n_notes"]) for r in rows] == [
            (1, 0, 10), (1, 1, 10), (1, 2, 5), (2, 0, 1),
        ]
        assert " [EOD] ".join(r["text"] for r in rows[:3]).split(" [EOD] ") == [f"n{i}" for i in range(24, -1, -1)]


def test_category_keeps_the_trailing_space(spark):
    df = notes(spark, [(1, 1, 1, "Physician ", "a"), (1, 2, 1, "Physician", "b"), (1, 3, 1, "Nursing", "c")])
    assert {r["text"] for r in cohort.filter_category(df).collect()} == {"a", "c"}


def test_holdout_sizes(spark):
    df = notes(spark, [(4, i, i, "x", "t") for i in range(4)] + [(5, i, i, "x", "t") for i in range(5)])
    got = cohort.note_holdout(df, 0.2, 123).groupBy("subject_id", "split").count().collect()
    assert {(r["subject_id"], r["split"]): r["count"] for r in got} == {
        (4, "train"): 4, (5, "train"): 4, (5, "val"): 1,
    }


def test_abbreviations(spark):
    df = spark.createDataFrame([(1, "Acute X"), (2, "Alpha Xi"), (3, "acute xx"), (4, "Heart (left)")], "pos int, name string")
    got = [r["abv"] for r in tasks.task_abbreviations(df).orderBy("pos").collect()]
    assert got == ["AX", "AX-2", "AX-3", "H"]


def test_manifest(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "pos int, name string")
    got = tasks.manifest_slices(df, 2, [F.col("pos")]).groupBy("file").count().collect()
    assert {r["file"]: r["count"] for r in got} == {1: 3, 2: 2}


def test_split_covers_once_and_keeps_strata(spark):
    rows = spark.range(1000).select(
        F.lit("t").alias("task"), F.col("id").alias("subject_id"), (F.col("id") % 3 == 0).cast("string").alias("y")
    )
    whole = tasks.stratified_split(rows, ["task", "y"], ["subject_id"])
    sliced = tasks.stratified_split(rows, ["task", "y"], ["subject_id"], max_group_rows=50, slices=6)
    a = {r["subject_id"]: r["split"] for r in whole.collect()}
    assert a == {r["subject_id"]: r["split"] for r in sliced.collect()} and len(a) == 1000
    n = {(r["y"], r["split"]): r["count"] for r in whole.groupBy("y", "split").count().collect()}
    assert n[("true", "train")] == int(334 * 0.8) and n[("false", "train")] == int(666 * 0.8)


def test_unseen_test_label_has_no_index(spark):
    df = spark.createDataFrame(
        [("t", "a", "train"), ("t", "b", "val"), ("t", "c", "test")], "task string, y string, split string"
    )
    got = tasks.index_labels(df, tasks.label_vocabulary(df)).collect()
    assert {r["y"]: r["idx"] for r in got} == {"a": 0, "b": 1, "c": None}


def test_balanced_sample(spark):
    rows = [("t", i, "1" if i < 3 else "0") for i in range(10)]
    df = spark.createDataFrame(rows, "task string, subject_id int, y string")
    got = tasks.balanced_users(df, [F.col("subject_id")]).collect()
    assert sorted(r["subject_id"] for r in got) == [0, 1, 2, 3, 4, 5]


def test_metric_never_becomes_a_group(spark):
    long = spark.createDataFrame(
        [("m", "t", "auroc", "all", 0.9), ("m", "t", "auroc", "men", 0.8)],
        "model string, task string, metric string, grp string, value double",
    )
    wide = report.results_wide(long)
    assert wide.columns == ["model", "task", "metric", *report.GROUPS]
    assert {(r["grp"], r["value"]) for r in report.results_long(wide).collect()} == {("all", 0.9), ("men", 0.8)}


def test_last_result_wins(spark):
    df = spark.createDataFrame([("t", 1, 0.1), ("t", 3, 0.3), ("t", 2, 0.2)], "task string, run int, value double")
    assert report.latest(df, ["task"], ["run"]).first()["value"] == 0.3


def test_entity_lengths_come_from_the_phrases(spark):
    df = spark.createDataFrame([(1, "acute fever of the left lower leg".split())], "id int, tokens array<string>")
    gaz = spark.createDataFrame(
        [("fever", "T184", "C1"), ("of the left lower leg", "T047", "C2")], "phrase string, tui string, cui string"
    )
    got = entities.annotate_text(df, gaz, "id").first()
    assert got["anno_text"] == "acute [T184] [C1] [T047] [C2]"
    none = entities.annotate_text(df, gaz.limit(0), "id").first()
    assert (none["n_entities"], none["anno_text"]) == (0, "acute fever of the left lower leg")


def test_entities_longest_from_left(spark):
    text = "acute heart failure of heart failure and heart rate"
    df = spark.createDataFrame([(1, text.split()), (2, ["none"])], "id int, tokens array<string>")
    gaz = spark.createDataFrame(
        [("heart failure", "T047", "C1"), ("acute heart", "T047", "C2"), ("acute heart failure", "T046", "C3"),
         ("heart rate", "T201", "C4"), ("heart failure", "T184", "C9")],
        "phrase string, tui string, cui string",
    )
    got = {r["id"]: (r["n_entities"], r["anno_text"]) for r in entities.annotate_text(df, gaz, "id", [2, 3]).collect()}
    assert got[1] == (2, "[T046] [C3] of [T047] [C1] and heart rate")
    assert got[2] == (0, "none")
    ids = entities.entity_ids(entities.link_entities(df, gaz, "id", [2, 3]))
    assert {r["entity_id"] for r in ids.collect()} == {"[T046]", "[C3]", "[T047]", "[C1]"}


def plain_links(tokens, phrases):
    """Longest phrase at each place, from left to right."""
    out, at = [], 0
    while at < len(tokens):
        fits = [p for p in phrases if tokens[at : at + len(p.split(" "))] == p.split(" ")]
        if fits:
            best = max(fits, key=lambda p: len(p.split(" ")))
            out.append((at, best))
            at += len(best.split(" "))
        else:
            at += 1
    return out


@pytest.mark.parametrize("trie_phrases", [500_000, 7])
def test_trie_walk_equals_a_plain_walk(spark, trie_phrases):
    rng = random.Random(4)
    words = "a b c d e f g".split()
    phrases = {" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(40)}
    gaz = spark.createDataFrame([(p, "T047", f"C{i}") for i, p in enumerate(sorted(phrases))], "phrase string, tui string, cui string")
    meaning = {p: f"[T047] [C{i}]" for i, p in enumerate(sorted(phrases))}
    notes = [(i, rng.choices([*words, "x", "y", "é"], k=rng.randint(0, 60)), f"n{i}") for i in range(120)]
    notes += [(200, None, "null"), (201, [], "empty"), (202, ["a"] * 20_000, "long"), (203, ["a", ""], "blank")]
    df = spark.createDataFrame(notes, "id int, tokens array<string>, spans string").repartition(3)
    links = entities.link_entities(df, gaz, "id", trie_phrases=trie_phrases).collect()
    got = {}
    for r in links:
        got.setdefault(r["id"], []).append((r["start"], r["phrase"]))
        assert r["len"] == len(r["phrase"].split(" "))
    texts = {r["id"]: r for r in entities.annotate_text(df.withColumnRenamed("spans", "more"), gaz, "id", trie_phrases=trie_phrases).collect()}
    for i, tokens, more in notes:
        want = plain_links(tokens or [], phrases)
        assert sorted(got.get(i, [])) == want
        new, at = [], 0
        for start, p in want:
            new += [*tokens[at:start], meaning[p]]
            at = start + len(p.split(" "))
        new += (tokens or [])[at:]
        assert texts[i]["n_entities"] == len(want) and texts[i]["more"] == more
        assert texts[i]["anno_text"] == (None if tokens is None else " ".join(new))


def test_raw_and_annotated(spark):
    df = spark.createDataFrame([(1, "my fever")], "id int, text string").withColumn("tokens", F.split("text", " "))
    gaz = spark.createDataFrame([("fever", "T184", "C1")], "phrase string, tui string, cui string")
    assert [r["text"] for r in entities.raw_and_annotated(df, gaz, "id").collect()] == ["my fever", "my [T184] [C1]"]


def test_audit_from_bitmaps(spark):
    rows = [("A", "train", 1)] * 500 + [("A", "test", 1), ("A", "train", 2), ("B", "test", 3), ("B", "test", None)]
    df = spark.createDataFrame(rows, "task string, split string, subject_id bigint")
    one, two = ([(i,) for i in ids] for ids in ((1, 2, 2, 9), (1, 3, 9, None)))
    members = [spark.createDataFrame(x, "subject_id bigint") for x in (one, two)]
    got = {(r["task"], r["split"]): (r["n_before"], r["n_after"]) for r in cohort.membership_audit(df, members).collect()}
    assert got == {("A", "train"): (501, 500), ("A", "test"): (1, 1), ("B", "test"): (2, 0)}
