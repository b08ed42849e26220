"""Patients, cohorts, documents per subject, tasks and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as I
from checks.registry import query
from checks.text_queries import _binary, _multi
from chartweave.operators import cohort, tasks

JOINED = f"""(SELECT p.subject_id, gender, admission_id, insurance,
    {_multi('ethnicity')} AS ethnicity, {_binary('ethnicity')} AS ethnicity_binary
    FROM {I.PATIENTS} p JOIN {I.ADMISSIONS} a ON p.subject_id = a.subject_id)"""
DEMO = f"""(SELECT subject_id, gender, insurance, ethnicity, ethnicity_binary FROM {JOINED}
    QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY admission_id) = 1)"""
NARROW = f"""(SELECT CAST(split_part(stay, '_', 1) AS BIGINT) AS subject_id, y_true AS y, split
    FROM {I.STAYS})"""
FILTERED = f"(SELECT * FROM {I.CLEAN_NOTES} WHERE category IN ({I.CATEGORY_LIST}))"
COHORT = f"""(SELECT DISTINCT subject_id FROM (
      SELECT subject_id FROM {NARROW} UNION ALL SELECT subject_id FROM {I.LABELS}) t
    WHERE subject_id IN (SELECT subject_id FROM {DEMO})
      AND subject_id IN (SELECT subject_id FROM {FILTERED}))"""
DEMO_IDS = f"""(SELECT DISTINCT subject_id FROM (
      SELECT subject_id FROM {NARROW} UNION ALL SELECT subject_id FROM {I.LABELS}) t
    WHERE subject_id IN (SELECT subject_id FROM {DEMO}))"""


def demo(spark, sf):
    return cohort.demographics(I.patients(spark, sf), I.admissions(spark, sf))


def narrow(spark, sf):
    return tasks.narrow_labels(I.stays(spark, sf), keep=["split"])


def filtered(spark, sf):
    return cohort.clean_notes(cohort.filter_category(I.notes(spark, sf), I.CATEGORIES))


def ids(spark, sf):
    return cohort.cohort_ids(
        [narrow(spark, sf), I.wide_labels(spark, sf)], demo(spark, sf), filtered(spark, sf)
    )


def demo_ids(spark, sf):
    every = cohort.subject_ids(narrow(spark, sf), I.wide_labels(spark, sf))
    return cohort.keep_subjects(every, demo(spark, sf))


def documents_sql(source: str) -> str:
    return f"""
    SELECT subject_id, CAST((pos - 1) // 256 AS BIGINT) AS part, count(*) AS n_notes,
           string_agg(text, ' [EOD] ' ORDER BY pos) AS text
    FROM (SELECT *, row_number() OVER (PARTITION BY subject_id
              ORDER BY charttime DESC NULLS LAST, note_id DESC) AS pos FROM {source} s)
    GROUP BY subject_id, (pos - 1) // 256"""


@query("task_labels", f"SELECT CAST(split_part(stay, '_', 1) AS BIGINT) AS subject_id, y_true AS y FROM {I.STAYS}")
def task_labels(spark, sf):
    return tasks.narrow_labels(I.stays(spark, sf))


@query("patient_admissions", f"SELECT * FROM {JOINED}")
def patient_admissions(spark, sf):
    return cohort.patient_admissions(I.patients(spark, sf), I.admissions(spark, sf))


@query("dedup_subject", f"SELECT * FROM {DEMO}")
def dedup_subject(spark, sf):
    return demo(spark, sf)


@query("cohort_ids", f"SELECT * FROM {COHORT}")
def cohort_ids(spark, sf):
    return ids(spark, sf)


@query(
    "cohort_notes",
    f"""SELECT subject_id, note_id, category FROM {I.NOTES}
    WHERE subject_id IN (SELECT subject_id FROM {DEMO_IDS})""",
)
def cohort_notes(spark, sf):
    kept = cohort.keep_subjects(I.notes(spark, sf), demo_ids(spark, sf))
    return kept.select("subject_id", "note_id", "category")


@query("subject_documents", documents_sql(I.NOTES))
def subject_documents(spark, sf):
    return cohort.subject_documents(I.notes(spark, sf))


@query("notes_all", documents_sql(I.CLEAN_NOTES))
def notes_all(spark, sf):
    return cohort.subject_documents(cohort.clean_notes(I.notes(spark, sf)))


@query(
    "notes_cohort",
    documents_sql(f"(SELECT * FROM {I.CLEAN_NOTES} WHERE subject_id IN (SELECT * FROM {DEMO_IDS}))"),
)
def notes_cohort(spark, sf):
    kept = cohort.keep_subjects(I.notes(spark, sf), demo_ids(spark, sf))
    return cohort.subject_documents(cohort.clean_notes(kept))


NOTES_FILTERED = documents_sql(
    f"(SELECT * FROM {FILTERED} WHERE subject_id IN (SELECT * FROM {DEMO_IDS}))"
)


@query("notes_filtered", NOTES_FILTERED)
def notes_filtered(spark, sf):
    kept = cohort.keep_subjects(filtered(spark, sf), demo_ids(spark, sf))
    return cohort.subject_documents(kept)


@query(
    "mini_notes",
    f"""WITH d AS ({NOTES_FILTERED})
    SELECT * FROM d WHERE subject_id IN
      (SELECT DISTINCT subject_id FROM d ORDER BY subject_id LIMIT 200)""",
)
def mini_notes(spark, sf):
    return cohort.mini_documents(notes_filtered(spark, sf))


@query(
    "cohort_audit",
    f"""SELECT task, split, count(*) AS n_before,
        count(*) FILTER (subject_id IN (SELECT subject_id FROM {COHORT})) AS n_after
    FROM (SELECT 'IHM' AS task, split, subject_id FROM {NARROW}
          UNION ALL SELECT 'PHENO', 'train', subject_id FROM {I.LABELS}) t
    GROUP BY task, split""",
)
def cohort_audit(spark, sf):
    rows = narrow(spark, sf).select(F.lit("IHM").alias("task"), "split", "subject_id").unionByName(
        I.wide_labels(spark, sf).select(
            F.lit("PHENO").alias("task"), F.lit("train").alias("split"), "subject_id"
        )
    )
    notes = cohort.filter_category(I.notes(spark, sf), I.CATEGORIES)
    return cohort.membership_audit(rows, [I.patients(spark, sf), I.admissions(spark, sf), notes])


@query(
    "feature_coverage",
    """SELECT lang, count(*) AS n_before, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS n_after
    FROM documents GROUP BY lang""",
)
def feature_coverage(spark, sf):
    rows = I.documents(spark, sf).select(F.col("doc_id").alias("subject_id"), "lang")
    return cohort.coverage(rows, I.wide_labels(spark, sf), ["lang"])


TASK_ROWS = """(SELECT 'quality' AS task, doc_id AS subject_id, CAST(quality AS VARCHAR) AS y FROM labels
    UNION ALL SELECT 'toxic', doc_id, CAST(toxic AS VARCHAR) FROM labels)"""


def task_rows(spark, sf):
    return tasks.unpivot_tasks(I.wide_labels(spark, sf), ["subject_id"], ["quality", "toxic"]).select(
        "task", "subject_id", "y"
    )


@query("unpivot_tasks", f"SELECT * FROM {TASK_ROWS}")
def unpivot_tasks(spark, sf):
    return task_rows(spark, sf)


@query(
    "task_demographics",
    f"""SELECT t.subject_id, task, y, gender, insurance, ethnicity, ethnicity_binary
    FROM {TASK_ROWS} t JOIN {DEMO} d ON t.subject_id = d.subject_id""",
)
def task_demographics(spark, sf):
    return tasks.task_demographics(task_rows(spark, sf), demo(spark, sf))


@query(
    "demographic_tasks",
    f"""SELECT subject_id, task, y FROM
    (SELECT l.subject_id, unnest(['gender', 'ethnicity', 'ethnicity_binary']) AS task,
            unnest([gender, ethnicity, ethnicity_binary]) AS y
     FROM {I.LABELS} l JOIN {DEMO} d ON l.subject_id = d.subject_id)""",
)
def demographic_tasks(spark, sf):
    rows = tasks.task_demographics(I.wide_labels(spark, sf), demo(spark, sf))
    return tasks.unpivot_tasks(rows, ["subject_id"], ["gender", "ethnicity", "ethnicity_binary"])


NAMES = "(SELECT p_name AS name, min(p_partkey) AS pos FROM part GROUP BY p_name)"


def names(spark, sf):
    return I.table(spark, sf, "part").groupBy(F.col("p_name").alias("name")).agg(
        F.min("p_partkey").alias("pos")
    )


ABBREVIATED = rf"""(SELECT pos, name, CASE WHEN n = 1 THEN i ELSE i || '-' || n END AS abv FROM (
      SELECT pos, name, i, row_number() OVER (PARTITION BY i ORDER BY pos) AS n FROM (
        SELECT pos, name, regexp_replace(array_to_string(list_transform(list_filter(
            regexp_split_to_array(upper(name), '\s+'), lambda w: w <> ''), lambda w: left(w, 1)), ''),
            '\W+', '', 'g') AS i FROM {NAMES})))"""


@query("task_abbreviation", f"SELECT * FROM {ABBREVIATED}")
def task_abbreviation(spark, sf):
    return tasks.task_abbreviations(names(spark, sf))


@query(
    "task_catalogue",
    f"""SELECT 'mini-' || split_part(line, ',', 1) AS dataset, split_part(line, ',', 2) AS name
    FROM (SELECT abv || ',' || name AS line FROM {ABBREVIATED})""",
)
def task_catalogue(spark, sf):
    lines = task_abbreviation(spark, sf).select(F.concat_ws(",", "abv", "name").alias("value"))
    return tasks.task_catalogue(lines, mini=True)


@query(
    "task_manifest_slices",
    f"""SELECT name, line, CAST((line - 1) // (total // 2 + 1) + 1 AS BIGINT) AS file
    FROM (SELECT name, row_number() OVER (ORDER BY pos) AS line, count(*) OVER () AS total
          FROM {NAMES})""",
)
def task_manifest_slices(spark, sf):
    return tasks.manifest_slices(names(spark, sf), 2, [F.col("pos")]).select("name", "line", "file")


SPLIT = f"""(SELECT task, subject_id, y,
      CASE WHEN row_number() OVER (PARTITION BY task, y
                 ORDER BY md5('1|' || task || '|' || y || '|' || subject_id), subject_id)
             <= floor(count(*) OVER (PARTITION BY task, y) * CAST(0.8 AS DOUBLE))
           THEN 'train' ELSE 'val' END AS split
    FROM {TASK_ROWS})"""


def split_rows(spark, sf):
    return tasks.stratified_split(task_rows(spark, sf), ["task", "y"], ["subject_id"])


@query("stratified_split", f"SELECT * FROM {SPLIT}")
def stratified_split(spark, sf):
    return split_rows(spark, sf).select("task", "subject_id", "y", "split")


@query(
    "split_by_subject",
    f"""SELECT task, subject_id, y,
      CASE WHEN left(md5('1|' || subject_id), 8) < 'cccccccc' THEN 'train' ELSE 'val' END AS split
    FROM {TASK_ROWS}""",
)
def split_by_subject(spark, sf):
    return tasks.stratified_split(
        task_rows(spark, sf), ["task", "y"], ["subject_id"], by_subject="subject_id"
    )


@query(
    "mini_split",
    f"""SELECT task, subject_id, y, split, CAST(line AS INTEGER) AS line FROM (
      SELECT *, row_number() OVER (PARTITION BY task, split ORDER BY subject_id) AS line FROM {SPLIT})
    WHERE line <= 1000""",
)
def mini_split(spark, sf):
    return tasks.mini_split(split_rows(spark, sf), [F.col("subject_id")], ["subject_id"]).select(
        "task", "subject_id", "y", "split", "line"
    )


@query(
    "class_balance",
    f"""SELECT task, arg_min(y, (n, y)) AS minority, min(n) AS min_count, count(*) AS n_classes
    FROM (SELECT task, y, count(*) AS n FROM {TASK_ROWS} GROUP BY task, y) GROUP BY task""",
)
def class_balance(spark, sf):
    return tasks.class_balance(task_rows(spark, sf))


@query(
    "balanced_users",
    f"""WITH c AS (SELECT task, y, count(*) AS n FROM {TASK_ROWS} GROUP BY task, y),
    m AS (SELECT task, arg_min(y, (n, y)) AS minority, min(n) AS min_count FROM c GROUP BY task),
    r AS (SELECT t.*, y = minority AS small, min_count,
            row_number() OVER (PARTITION BY t.task, y = minority ORDER BY subject_id) AS rn
          FROM {TASK_ROWS} t JOIN m ON t.task = m.task)
    SELECT task, subject_id, y FROM r WHERE small OR rn <= min_count""",
)
def balanced_users(spark, sf):
    return tasks.balanced_users(task_rows(spark, sf), [F.col("subject_id")])


@query(
    "label_index",
    """WITH d AS (SELECT 'lang' AS task, doc_id AS subject_id, lang AS y,
        CASE WHEN source IN ('src0', 'src1') THEN 'test' WHEN source = 'src2' THEN 'val' ELSE 'train' END AS split
        FROM documents),
    v AS (SELECT task, y, row_number() OVER (PARTITION BY task ORDER BY y) - 1 AS idx
          FROM (SELECT DISTINCT task, y FROM d WHERE split IN ('train', 'val')))
    SELECT d.task, subject_id, d.y, split, idx FROM d LEFT JOIN v ON d.task = v.task AND d.y = v.y""",
)
def label_index(spark, sf):
    split = (
        F.when(F.col("source").isin("src0", "src1"), "test")
        .when(F.col("source") == "src2", "val")
        .otherwise("train")
    )
    rows = I.documents(spark, sf).select(
        F.lit("lang").alias("task"), F.col("doc_id").alias("subject_id"), F.col("lang").alias("y"), split.alias("split")
    )
    return tasks.index_labels(rows, tasks.label_vocabulary(rows)).select(
        "task", "subject_id", "y", "split", "idx"
    )


@query(
    "subgroup_filter",
    f"""SELECT grp, count(*) AS n FROM (
      SELECT unnest(['all', CASE gender WHEN 'M' THEN 'men' WHEN 'F' THEN 'women' END,
        CASE ethnicity WHEN 'WHITE' THEN 'white' WHEN 'BLACK' THEN 'black' WHEN 'ASIAN' THEN 'asian'
             WHEN 'HISPANIC' THEN 'hispanic' END]) AS grp FROM {DEMO})
    WHERE grp IS NOT NULL GROUP BY grp""",
)
def subgroup_filter(spark, sf):
    rows = tasks.with_subgroups(demo(spark, sf), tasks.SUBGROUPS)
    return rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))


HOLDOUT = f"""(SELECT *, CASE WHEN perm <= floor(n * CAST(0.2 AS DOUBLE)) THEN 'val' ELSE 'train' END AS split
    FROM (SELECT *, count(*) OVER (PARTITION BY subject_id) AS n,
        row_number() OVER (PARTITION BY subject_id
            ORDER BY md5('123|' || subject_id || '|' || note_id), note_id) AS perm FROM {I.NOTES}))"""


@query(
    "note_holdout",
    f"""SELECT subject_id, split, CAST((pos - 1) // 256 AS BIGINT) AS part, count(*) AS n_notes,
        string_agg(text, ' [EOD] ' ORDER BY pos) AS text
    FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, split ORDER BY perm) AS pos FROM {HOLDOUT})
    GROUP BY subject_id, split, (pos - 1) // 256""",
)
def note_holdout(spark, sf):
    return cohort.holdout_documents(I.notes(spark, sf))


@query(
    "cap_docs_per_user",
    f"""SELECT subject_id, note_id, CAST(rank AS INTEGER) AS rank FROM (
      SELECT subject_id, note_id, row_number() OVER (PARTITION BY subject_id ORDER BY note_id) AS rank
      FROM {I.NOTES}) WHERE rank <= 10""",
)
def cap_docs_per_user(spark, sf):
    return cohort.cap_docs_per_user(I.notes(spark, sf), 10, [F.col("note_id")]).select(
        "subject_id", "note_id", "rank"
    )


@query(
    "min_docs_user",
    f"""SELECT subject_id, note_id, category FROM {I.NOTES}
    WHERE subject_id IN (SELECT subject_id FROM {I.NOTES} GROUP BY subject_id HAVING count(*) >= 5)""",
)
def min_docs_user(spark, sf):
    return cohort.min_docs_per_user(I.notes(spark, sf), 5).select("subject_id", "note_id", "category")
