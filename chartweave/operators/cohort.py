"""Patients, cohorts and per-subject documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartweave.functions import labels as L
from chartweave.functions import text as X
from chartweave.functions.hashing import keyed_hash
from chartweave.operators.distribution import MAX_GROUP_ROWS, ranked, top_k

# Note categories kept for the downstream tasks (the first ends in a space).
TASK_CATEGORIES = ("Physician ", "Nursing", "Nursing/other")
# The longest run of notes joined into one output string.
NOTES_PER_PART = 256


def patient_admissions(patients: DataFrame, admissions: DataFrame) -> DataFrame:
    """Patients with each of their admissions, and both ethnicity labels."""
    joined = patients.select("subject_id", "gender").join(
        admissions.select("subject_id", "admission_id", "insurance", "ethnicity"), "subject_id"
    )
    raw = F.col("ethnicity")
    return joined.select(
        "subject_id",
        "gender",
        "admission_id",
        "insurance",
        L.map_label(raw, L.ETHNICITY_MULTI).alias("ethnicity"),
        L.map_label(raw, L.ETHNICITY_BINARY).alias("ethnicity_binary"),
    )


def dedup_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the one with the smallest ``order``; combined map-side."""
    rest = [c for c in df.columns if c != key]
    return (
        df.groupBy(key)
        .agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row"))
        .select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])
    )


def demographics(patients: DataFrame, admissions: DataFrame) -> DataFrame:
    """One row per patient: labels of the first admission."""
    rows = dedup_first(patient_admissions(patients, admissions), "subject_id", "admission_id")
    return rows.select("subject_id", "gender", "insurance", "ethnicity", "ethnicity_binary")


def keep_subjects(df: DataFrame, ids: DataFrame, key: str = "subject_id") -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def subject_ids(*tables: DataFrame, key: str = "subject_id") -> DataFrame:
    """Distinct ids over several tables."""
    out = tables[0].select(key)
    for t in tables[1:]:
        out = out.unionByName(t.select(key))
    return out.distinct()


def cohort_ids(
    task_tables: Sequence[DataFrame], demo: DataFrame, filtered_notes: DataFrame
) -> DataFrame:
    """Subjects of any task that also have demographics and filtered notes."""
    with_demo = keep_subjects(subject_ids(*task_tables), demo)
    return keep_subjects(with_demo, filtered_notes)


def clean_notes(notes: DataFrame, text: str = "text") -> DataFrame:
    return notes.withColumn(text, X.clean(F.col(text)))


def filter_category(notes: DataFrame, categories: Sequence[str] = TASK_CATEGORIES) -> DataFrame:
    return notes.filter(F.col("category").isin(*categories))


def join_in_order(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    text: str = "text",
    separator: str = X.NOTE_MARK,
    per_part: int = NOTES_PER_PART,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Join the texts of each group in order: ``(*group, part, n_notes, text)``.

    A group longer than ``per_part`` rows continues in parts 1, 2, ..., so no row
    of the result holds an unbounded text; the parts in order are the whole text.
    """
    placed = ranked(df, group, order, name="_pos", max_group_rows=max_group_rows)
    part = F.floor((F.col("_pos") - 1) / per_part).cast("bigint")
    return (
        placed.withColumn("part", part)
        .groupBy(*group, "part")
        .agg(
            F.count(F.lit(1)).alias("n_notes"),
            F.sort_array(F.collect_list(F.struct("_pos", F.col(text).alias("_t")))).alias("_all"),
        )
        .select(*group, "part", "n_notes", F.array_join("_all._t", separator).alias("text"))
    )


def subject_documents(notes: DataFrame, **kw) -> DataFrame:
    """Notes of a subject joined newest first; notes without a time come last."""
    order = [F.col("charttime").desc_nulls_last(), F.col("note_id").desc()]
    return join_in_order(notes, ["subject_id"], order, **kw)


def mini_documents(documents: DataFrame, k: int = 200) -> DataFrame:
    """Documents of the first ``k`` subjects."""
    first = documents.select("subject_id").distinct().orderBy("subject_id").limit(k)
    return keep_subjects(documents, first)


def cap_docs_per_user(notes: DataFrame, k: int, order: Sequence[Column]) -> DataFrame:
    return top_k(notes, ["subject_id"], order, k, ["subject_id", "note_id"])


def min_docs_per_user(notes: DataFrame, least: int) -> DataFrame:
    """Notes of the subjects that have at least ``least`` notes."""
    enough = (
        notes.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    )
    return keep_subjects(notes, enough)


def coverage(rows: DataFrame, ids: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows before and after keeping the given subjects, per ``by``."""
    marked = rows.join(
        ids.select("subject_id").distinct().withColumn("_in", F.lit(True)), "subject_id", "left"
    )
    return marked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_before"), F.count_if("_in").alias("n_after")
    )


def membership_audit(rows: DataFrame, members: Sequence[DataFrame], by: Sequence[str] = ("task", "split")) -> DataFrame:
    """``(*by, n_before, n_after)``: rows, and the rows whose subject is in all of ``members``.

    Each table is read once: it sets a bit of its subjects, rows and bits meet by subject, and all
    counts come from the bitmaps.  What meets has a row per subject and group, however many rows
    a subject has.
    """
    cells = rows.select("subject_id", *by, F.lit(1).alias("_row"), F.lit(0).alias("_bit"))
    for i, table in enumerate(members):
        none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in by]
        cells = cells.unionByName(table.select("subject_id", *none, F.lit(0).alias("_row"), F.lit(1 << i).alias("_bit")))
    counted = cells.groupBy("subject_id", *by).agg(F.sum("_row").alias("n"), F.bit_or("_bit").alias("bits"))
    subjects = counted.groupBy("subject_id").agg(
        F.bit_or("bits").alias("bits"), F.collect_list(F.when(F.col("n") > 0, F.struct(*by, "n"))).alias("cells")
    )
    inside = F.col("subject_id").isNotNull() & (F.col("bits") == (1 << len(members)) - 1)
    return (
        subjects.select(inside.alias("_in"), F.inline("cells"))
        .groupBy(*by)
        .agg(F.sum("n").alias("n_before"), F.sum(F.when(F.col("_in"), F.col("n")).otherwise(0)).alias("n_after"))
    )


def explode_sentences(cleaned_notes: DataFrame, keep_raw: bool = False) -> DataFrame:
    """``(subject_id, note_id, sent_seq, text)`` from cleaned notes."""
    out = cleaned_notes.select(
        "subject_id",
        "note_id",
        F.posexplode(X.cleaned_sentences(F.col("text"))).alias("sent_seq", "text"),
    )
    if keep_raw:
        return out
    return out.withColumn("text", F.trim("text")).filter(F.col("text") != "")


def note_holdout(notes: DataFrame, share: float, seed: int, **kw) -> DataFrame:
    """Per subject, the first ``floor(n * share)`` notes of a seeded permutation
    go to ``val`` and the rest to ``train``.  Adds ``perm`` and ``split``."""
    hashed = notes.withColumn("_h", keyed_hash(seed, "subject_id", "note_id"))
    perm = ranked(hashed, ["subject_id"], [F.col("_h"), F.col("note_id")], name="perm", **kw)
    sizes = notes.groupBy("subject_id").agg(F.count(F.lit(1)).alias("_n"))
    val = F.col("perm") <= F.floor(F.col("_n") * F.lit(share))
    return (
        perm.join(sizes, "subject_id")
        .withColumn("split", F.when(val, "val").otherwise("train"))
        .drop("_h", "_n")
    )


def holdout_documents(notes: DataFrame, share: float = 0.2, seed: int = 123, **kw) -> DataFrame:
    """Joined training and validation documents in permuted order."""
    held = note_holdout(notes, share, seed, **kw)
    return join_in_order(held, ["subject_id", "split"], [F.col("perm")], **kw)
