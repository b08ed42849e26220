"""Identifiers, labels and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as I
from checks.registry import query
from chartweave.functions import labels as L
from chartweave.functions import text as X
from chartweave.operators import cohort, vocab


@query(
    "stay_subject_id",
    f"""SELECT stay, CAST(split_part(stay, '_', 1) AS BIGINT) AS subject_id FROM {I.STAYS}""",
)
def stay_subject_id(spark, sf):
    return I.stays(spark, sf).select("stay", L.subject_of_stay(F.col("stay")).alias("subject_id"))


@query(
    "numeric_coercion",
    "SELECT c_name, CAST(split_part(c_name, '#', 2) AS BIGINT) AS subject_id FROM customer",
)
def numeric_coercion(spark, sf):
    digits = F.element_at(F.split("c_name", "#"), 2)
    return I.table(spark, sf, "customer").select("c_name", digits.cast("bigint").alias("subject_id"))


def _multi(x):
    return (
        f"CASE WHEN contains({x}, 'ASIAN') THEN 'ASIAN' WHEN contains({x}, 'AFRICAN') THEN 'BLACK' "
        f"WHEN contains({x}, 'HISPANIC') THEN 'HISPANIC' WHEN contains({x}, 'WHITE') THEN 'WHITE' "
        "ELSE 'OTHER' END"
    )


def _binary(x):
    minority = " OR ".join(f"contains({x}, '{w}')" for w in ("ASIAN", "AFRICAN", "HISPANIC", "NATIVE"))
    return f"CASE WHEN {minority} THEN 'NON-WHITE' WHEN contains({x}, 'WHITE') THEN 'WHITE' ELSE 'OTHER' END"


@query(
    "ethnicity_multi",
    f"SELECT admission_id, {_multi('ethnicity')} AS ethnicity FROM {I.ADMISSIONS}",
)
def ethnicity_multi(spark, sf):
    label = L.map_label(F.col("ethnicity"), L.ETHNICITY_MULTI)
    return I.admissions(spark, sf).select("admission_id", label.alias("ethnicity"))


@query(
    "ethnicity_binary",
    f"SELECT admission_id, {_binary('ethnicity')} AS ethnicity_binary FROM {I.ADMISSIONS}",
)
def ethnicity_binary(spark, sf):
    label = L.map_label(F.col("ethnicity"), L.ETHNICITY_BINARY)
    return I.admissions(spark, sf).select("admission_id", label.alias("ethnicity_binary"))


@query("normalise_text", f"SELECT doc_id, {I.sql_normalise('text')} AS text FROM documents")
def normalise_text(spark, sf):
    return I.documents(spark, sf).select("doc_id", X.normalise(F.col("text")).alias("text"))


@query(
    "tokenise_words",
    f"SELECT doc_id, array_to_string({I.sql_tokens('text')}, ' ') AS text FROM documents",
)
def tokenise_words(spark, sf):
    return I.documents(spark, sf).select("doc_id", X.tokenise(F.col("text")).alias("text"))


@query("squeeze_whitespace", f"SELECT doc_id, {I.sql_squeeze('text')} AS text FROM documents")
def squeeze_whitespace(spark, sf):
    return I.documents(spark, sf).select("doc_id", X.squeeze(F.col("text")).alias("text"))


@query(
    "split_sentences",
    f"""SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, array_to_string(s, '|') AS text
    FROM (SELECT doc_id, string_split({I.sql_breaks('text')}, chr(1)) AS s FROM documents)""",
)
def split_sentences(spark, sf):
    out = I.documents(spark, sf).select("doc_id", X.sentences(F.col("text")).alias("s"))
    return out.select(
        "doc_id",
        F.size("s").cast("bigint").alias("n_sentences"),
        F.array_join("s", "|").alias("text"),
    )


@query("clean_notes", f"SELECT subject_id, note_id, text FROM {I.CLEAN_NOTES}")
def clean_notes(spark, sf):
    return cohort.clean_notes(I.notes(spark, sf)).select("subject_id", "note_id", "text")


@query("clean_documents", f"SELECT doc_id, text FROM {I.CLEAN_DOCS}")
def clean_documents(spark, sf):
    return I.clean_documents(spark, sf)


@query(
    "filter_category",
    f"""SELECT subject_id, note_id, category, text FROM {I.NOTES}
    WHERE category IN ({I.CATEGORY_LIST})""",
)
def filter_category(spark, sf):
    out = cohort.filter_category(I.notes(spark, sf), I.CATEGORIES)
    return out.select("subject_id", "note_id", "category", "text")


@query(
    "explode_sentences",
    rf"""SELECT subject_id, note_id, CAST(pos - 1 AS INTEGER) AS sent_seq, trim(s) AS text
    FROM (SELECT subject_id, note_id, unnest(string_split(text, ' [EOS] ')) AS s,
                 generate_subscripts(string_split(text, ' [EOS] '), 1) AS pos
          FROM {I.CLEAN_NOTES})
    WHERE trim(s) <> ''""",
)
def explode_sentences(spark, sf):
    return cohort.explode_sentences(cohort.clean_notes(I.notes(spark, sf)))


# ---- tokens by rules, learned sentence breaks -----------------------------------------

_RULES = "|".join(X.WORD_RULES).replace("'", "''")
_NEGATED, _CLITIC = (r.replace("'", "''") for r in (X.NEGATED, X.CLITIC))


@query(
    "word_tokens",
    rf"""SELECT doc_id, array_to_string(regexp_extract_all(regexp_replace(regexp_replace(lower(text), '{_NEGATED}', '\1 \2', 'g'),
      '{_CLITIC}', '\1 \2', 'g'), '{_RULES}'), ' ') AS tokens FROM documents""",
)
def word_tokens(spark, sf):
    tokens = X.word_tokens(F.lower("text"))
    return I.documents(spark, sf).select("doc_id", F.array_join(tokens, " ").alias("tokens"))


# Turns and documents speak of doctors and doses, so that abbreviations can be learned.
_NOTES = """(SELECT conv_id AS id, turn, 'seen by dr. ' || text || ' dose b.i.d. as needed' AS text FROM conversations)"""
ABBREVIATIONS = rf"""(WITH w AS (SELECT regexp_replace(unnest(regexp_split_to_array(lower(text), '\s+')),
        '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}.]+$', '', 'g') AS w FROM {_NOTES}),
    c AS (SELECT regexp_replace(w, '\.$', '') AS type, CAST(sum(CASE WHEN ends_with(w, '.') THEN 1 ELSE 0 END) AS BIGINT) AS n_stop,
        CAST(sum(CASE WHEN ends_with(w, '.') THEN 0 ELSE 1 END) AS BIGINT) AS n_bare FROM w WHERE w <> '' GROUP BY 1),
    k AS (SELECT * FROM c WHERE regexp_matches(type, '\p{{L}}')),
    p AS (SELECT CAST(sum(n_stop) AS DOUBLE) / sum(n_stop + n_bare) AS p FROM k),
    s AS (SELECT type, n_stop, n_bare, length(type) - length(replace(type, '.', '')) AS inside, p FROM k, p),
    f AS (SELECT type, n_stop, n_bare, 2 * (n_stop * ln(CAST({vocab.STOP_SHARE} AS DOUBLE)) + n_bare * ln(CAST({1 - vocab.STOP_SHARE!r} AS DOUBLE))
          - n_stop * ln(p) - n_bare * ln(1 - p)) * exp(-CAST(length(type) - inside AS DOUBLE)) * (inside + 1)
          * pow(CAST(length(type) - inside AS DOUBLE), -CAST(n_bare AS DOUBLE)) AS score FROM s)
    SELECT * FROM f WHERE score >= {vocab.ABBREVIATION_SCORE})"""


def doctor_notes(spark, sf):
    text = F.concat(F.lit("seen by dr. "), "text", F.lit(" dose b.i.d. as needed"))
    return I.table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), "turn", text.alias("text"))


@query("abbreviations", f"SELECT type, n_stop, n_bare, round(score, 6) AS score FROM {ABBREVIATIONS}")
def abbreviations(spark, sf):
    return vocab.abbreviations(doctor_notes(spark, sf)).withColumn("score", F.round("score", 6))


@query(
    "learned_sentences",
    rf"""WITH a AS MATERIALIZED (SELECT list(type) AS known FROM (SELECT type FROM {ABBREVIATIONS} ORDER BY score DESC, type LIMIT 1000)),
    t AS (SELECT id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM {_NOTES}),
    m AS (SELECT id, turn, array_to_string(list_transform(w, lambda x: x || CASE WHEN regexp_matches(x, '[!?]$') OR (ends_with(x, '.')
        AND NOT list_contains(coalesce(known, []), lower(regexp_replace(x, '^[^\p{{L}}\p{{N}}]+|\.$', '', 'g')))) THEN chr(1) ELSE ' ' END), '') AS j
      FROM t, a)
    SELECT id, turn, CAST(len(s) AS INTEGER) AS n_sentences, array_to_string(s, ' [EOS] ') AS text
    FROM (SELECT id, turn, list_filter(list_transform(string_split(j, chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM m)""",
)
def learned_sentences(spark, sf):
    notes = doctor_notes(spark, sf)
    known = vocab.abbreviation_list(vocab.abbreviations(notes))
    out = notes.select("id", "turn", X.learned_sentences(F.col("text"), known).alias("s"))
    return out.select("id", "turn", F.size("s").alias("n_sentences"), F.array_join("s", " [EOS] ").alias("text"))
