"""Entities, word types, packed sequences and masks over conversations and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as I
from checks.registry import query
from chartweave.functions import text as X
from chartweave.functions.hashing import hash_int
from chartweave.operators import cohort, entities, mlm, vocab
from chartweave.operators.entities import ENTITY_TYPES
from chartweave.session import cut_lineage

SIZES = (1, 2, 3, 4)
# One-word phrases of the phrase table are the longer words.
LONG_WORD = 8
ALL_TYPES = (*ENTITY_TYPES, "T001", "T002", "T003")
LENGTH, MIN_LENGTH, PREDS, WORDS = 64, 20, 10, 2000

# ---- entities: the phrases of the benchmark table, typed by hash -------------------

TYPE_LIST = ", ".join(f"'{t}'" for t in ALL_TYPES)
ALLOWED = ", ".join(f"'{t}'" for t in ENTITY_TYPES)


def _runs(source: str, key: str) -> str:
    """SQL of ``(key, start, k, phrase)``: long words and runs of 2, 3 and 4 tokens of a clean text."""
    return f"""(SELECT * FROM (SELECT {key}, start, unnest([1, 2, 3, 4]) AS k,
          unnest([CASE WHEN length(a) >= {LONG_WORD} THEN a END, a || ' ' || b, a || ' ' || b || ' ' || c, a || ' ' || b || ' ' || c || ' ' || d]) AS phrase
        FROM (SELECT {key}, pos - 1 AS start, token AS a, lead(token, 1) OVER w AS b,
                lead(token, 2) OVER w AS c, lead(token, 3) OVER w AS d
              FROM (SELECT {key}, unnest(string_split(text, ' ')) AS token,
                      generate_subscripts(string_split(text, ' '), 1) AS pos FROM {source})
              WINDOW w AS (PARTITION BY {key} ORDER BY pos)))
      WHERE phrase IS NOT NULL)"""


GAZETTEER = f"""(SELECT DISTINCT phrase,
      list_extract([{TYPE_LIST}], CAST(CAST('0x' || left(md5(phrase), 8) AS UBIGINT) % {len(ALL_TYPES)} AS INTEGER) + 1) AS tui,
      'C' || substr(md5(phrase), 9, 7) AS cui
    FROM {_runs(f"(SELECT item_id, {I.sql_clean('text')} AS text FROM benchmark)", "item_id")})"""
FOUND = f"""(SELECT doc_id, start, arg_max(s.phrase, k) AS phrase, max(k) AS len, arg_max(tui, k) AS tui, arg_max(cui, k) AS cui
    FROM {_runs(I.CLEAN_DOCS, "doc_id")} s
    JOIN (SELECT * FROM {GAZETTEER} WHERE tui IN ({ALLOWED})) g ON g.phrase = s.phrase
    GROUP BY doc_id, start)"""
# Fold over the spans of a document by start: keep one that starts at or after the
# stop of the last kept.
LINKS_CTE = f"""found AS MATERIALIZED (SELECT * FROM {FOUND}),
    kept AS (SELECT doc_id, unnest(list_reduce(list([[start, start + len]] ORDER BY start),
        lambda a, x: CASE WHEN x[1][1] >= a[-1][2] THEN list_concat(a, x) ELSE a END)) AS p
      FROM found GROUP BY doc_id),
    links AS (SELECT f.* FROM found f JOIN kept k ON f.doc_id = k.doc_id AND f.start = k.p[1])"""
ANNOTATED = f"""WITH {LINKS_CTE},
    toks AS (SELECT doc_id, unnest(string_split(text, ' ')) AS token,
               generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM {I.CLEAN_DOCS}),
    cover AS (SELECT doc_id, start, tui, cui, unnest(range(start, start + len)) AS pos FROM links)
    SELECT t.doc_id, CAST(count(*) FILTER (c.pos = c.start) AS INTEGER) AS n_entities,
      string_agg(CASE WHEN c.pos IS NULL THEN token WHEN c.pos = c.start THEN '[' || tui || '] [' || cui || ']' END,
                 ' ' ORDER BY t.pos) AS anno_text
    FROM toks t LEFT JOIN cover c ON c.doc_id = t.doc_id AND c.pos = t.pos GROUP BY t.doc_id"""


def token_docs(spark, sf):
    return I.clean_documents(spark, sf).select("doc_id", F.split("text", " ").alias("tokens"))


def gazetteer(spark, sf):
    items = I.table(spark, sf, "benchmark").select(F.split(X.clean(F.col("text")), " ").alias("t"))

    def runs_of(k):
        starts = F.slice("t", 1, F.greatest(F.size("t") - k + 1, F.lit(0)))
        return F.transform(starts, lambda _, i: F.array_join(F.slice("t", i + 1, k), " "))

    runs = [runs_of(k) for k in SIZES]
    runs[0] = F.filter(runs[0], lambda w: F.length(w) >= LONG_WORD)
    phrases = items.select(F.explode(F.concat(*runs)).alias("phrase")).distinct()
    kinds = F.array(*[F.lit(t) for t in ALL_TYPES])
    at = F.pmod(hash_int(F.md5("phrase"), 1), F.lit(len(ALL_TYPES))).cast("int")
    cui = F.concat(F.lit("C"), F.substring(F.md5("phrase"), 9, 7))
    return phrases.select("phrase", F.get(kinds, at).alias("tui"), cui.alias("cui"))


@query(
    "link_entities",
    f"""WITH {LINKS_CTE}
    SELECT doc_id, CAST(start AS INTEGER) AS start, CAST(len AS INTEGER) AS len, phrase, tui, cui FROM links""",
)
def link_entities(spark, sf):
    return entities.link_entities(token_docs(spark, sf), gazetteer(spark, sf), "doc_id")


@query(
    "entity_ids",
    f"""WITH {LINKS_CTE}
    SELECT DISTINCT '[' || tui || ']' AS entity_id FROM links
    UNION SELECT DISTINCT '[' || cui || ']' FROM links""",
)
def entity_ids(spark, sf):
    return entities.entity_ids(link_entities(spark, sf))


@query("annotate_text", ANNOTATED)
def annotate_text(spark, sf):
    return entities.annotate_text(token_docs(spark, sf), gazetteer(spark, sf), "doc_id")


@query(
    "training_text",
    f"""SELECT doc_id, text FROM {I.CLEAN_DOCS}
    UNION ALL SELECT doc_id, anno_text FROM ({ANNOTATED})""",
)
def training_text(spark, sf):
    notes = I.clean_documents(spark, sf).withColumn("tokens", F.split("text", " "))
    return entities.raw_and_annotated(notes, gazetteer(spark, sf), "doc_id")


# ---- vocabularies -------------------------------------------------------------------

_TYPE = r"'[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+'"
TYPES = f"""(SELECT token, count(*) AS n FROM
    (SELECT unnest(regexp_extract_all(text, {_TYPE})) AS token FROM {I.CLEAN_DOCS}) GROUP BY token)"""


@query("word_types", f"SELECT token, n FROM {TYPES}")
def word_types(spark, sf):
    return vocab.word_types(I.clean_documents(spark, sf))


LETTERS = f"""(SELECT token, n, i, CASE WHEN i > 1 THEN '##' ELSE '' END || substr(token, i, 1) AS p FROM
    (SELECT token, n, unnest(range(1, length(token) + 1)) AS i FROM {TYPES}))"""
# Of a run of equal pieces every second neighbour pair counts, as merges from the left do not overlap.
PAIR_CTE = f"""placed AS MATERIALIZED (SELECT *, lead(p) OVER w AS q, i - row_number() OVER (PARTITION BY token, p ORDER BY i) AS run
      FROM {LETTERS} WINDOW w AS (PARTITION BY token ORDER BY i)),
    counted AS (SELECT p AS a, q AS b, CAST(sum(n) AS BIGINT) AS n FROM
      (SELECT *, row_number() OVER (PARTITION BY token, p, run ORDER BY i) AS k FROM placed) WHERE q IS NOT NULL AND (p <> q OR k % 2 = 1)
      GROUP BY p, q)"""


@query("subword_pair_counts", f"WITH {PAIR_CTE} SELECT a, b, n FROM counted")
def subword_pair_counts(spark, sf):
    return vocab.pair_counts(vocab.letter_pieces(word_types(spark, sf)))


@query(
    "subword_merge_step",
    f"""WITH {PAIR_CTE}, best AS (SELECT a, b FROM counted ORDER BY n DESC, a, b LIMIT 1),
    joined AS (SELECT token, any_value(n) AS n, ' ' || string_agg(p, '  ' ORDER BY i) || ' ' AS t FROM placed GROUP BY token)
    SELECT token, n, trim(replace(replace(t, ' ' || a || '  ' || b || ' ', ' ' || a || ltrim(b, '#') || ' '), '  ', ' ')) AS pieces
    FROM joined, best""",
)
def subword_merge_step(spark, sf):
    """The types after the commonest pair of pieces has been merged."""
    pieces = cut_lineage(vocab.letter_pieces(word_types(spark, sf)))
    a, b, _ = vocab.pair_counts(pieces).orderBy(F.col("n").desc(), "a", "b").first()
    out = vocab.merged(pieces, [{(a, b)}])
    return out.select("token", "n", F.array_join("pieces", " ").alias("pieces"))


def units(spark, sf):
    return vocab.subword_vocab(word_types(spark, sf), size=1500)


@query("subword_vocab")
def subword_vocab(spark, sf):
    return spark.createDataFrame(list(enumerate(units(spark, sf))), "id bigint, unit string")


@query("subword_encode")
def subword_encode(spark, sf):
    pieces = vocab.subword_encode(F.split("text", " "), units(spark, sf))
    return I.clean_documents(spark, sf).select("doc_id", pieces.alias("p")).select(
        "doc_id", F.size("p").alias("n_pieces"), F.array_join("p", " ").alias("pieces")
    )


# Units that SQL can name: all letters, and the commonest beginnings and inner runs of word types.
RUN_UNITS = 1000
_CUTS = f"""(SELECT CASE WHEN s > 1 THEN '##' ELSE '' END || substr(token, s, k) AS unit, k, n FROM
    (SELECT token, n, s, unnest(range(1, least(4, length(token) - s + 1) + 1)) AS k FROM
      (SELECT token, n, unnest(range(1, length(token) + 1)) AS s FROM {TYPES}
       WHERE length(token) <= {vocab.MAX_WORD_CHARS})))"""
_SPECIAL_ROWS = " UNION ALL ".join(f"SELECT {i} AS id, '{u}' AS unit" for i, u in enumerate(vocab.SPECIALS))
RUNS_CTE = f"""cuts AS MATERIALIZED (SELECT unit, max(k) AS k, sum(n) AS n FROM {_CUTS} GROUP BY unit),
    units AS MATERIALIZED (SELECT row_number() OVER (ORDER BY k > 1, n DESC, unit) + {len(vocab.SPECIALS) - 1} AS id, unit FROM
      (SELECT * FROM cuts WHERE k = 1 UNION ALL (SELECT * FROM cuts WHERE k > 1 ORDER BY n DESC, unit LIMIT {RUN_UNITS}))
      UNION ALL {_SPECIAL_ROWS}),
    words AS MATERIALIZED (SELECT doc_id, unnest(string_split(text, ' ')) AS token,
      generate_subscripts(string_split(text, ' '), 1) AS at_word FROM {I.CLEAN_DOCS}),
    kinds AS (SELECT DISTINCT token FROM words WHERE token <> ''),
    best AS MATERIALIZED (SELECT token, s, max(k) AS k FROM (
      SELECT token, s, k, CASE WHEN s > 1 THEN '##' ELSE '' END || substr(token, s, k) AS unit FROM
        (SELECT token, s, unnest(range(1, length(token) - s + 2)) AS k FROM
          (SELECT token, unnest(range(1, length(token) + 1)) AS s FROM kinds WHERE length(token) <= {vocab.MAX_WORD_CHARS})))
      JOIN units USING (unit) GROUP BY token, s),
    walk AS (SELECT token, 1 AS s, '' AS pieces FROM kinds
      UNION ALL SELECT w.token, CAST(w.s + b.k AS INTEGER),
        w.pieces || ' ' || CASE WHEN b.s > 1 THEN '##' ELSE '' END || substr(w.token, b.s, b.k)
      FROM walk w JOIN best b ON b.token = w.token AND b.s = w.s),
    cut AS (SELECT k.token, coalesce(max(ltrim(pieces, ' ')) FILTER (s = length(k.token) + 1), '[UNK]') AS pieces
      FROM kinds k LEFT JOIN walk w ON w.token = k.token GROUP BY k.token)"""


def run_units(spark, docs):
    """``(id, unit)``: special tokens, all letters, then the commonest longer runs."""
    n = F.length("token")
    types = vocab.word_types(docs).filter(n <= vocab.MAX_WORD_CHARS)
    starts = types.select("token", "n", F.explode(F.sequence(F.lit(1), n)).alias("s"))
    cuts = starts.select("token", "n", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(4), n - F.col("s") + 1))).alias("k"))
    mark = F.when(F.col("s") > 1, "##").otherwise("")
    unit = F.concat(mark, F.substring(F.col("token"), F.col("s"), F.col("k"))).alias("unit")
    found = cuts.select(unit, "k", "n").groupBy("unit").agg(F.max("k").alias("k"), F.sum("n").alias("n"))
    found = cut_lineage(found)
    longer = found.filter("k > 1").orderBy(F.col("n").desc(), "unit").limit(RUN_UNITS)
    order = [F.col("k") > 1, F.col("n").desc(), F.col("unit")]
    rows = found.filter("k = 1").unionByName(longer).orderBy(*order).select("unit").collect()
    return vocab.unit_table(spark, [*vocab.SPECIALS, *(r["unit"] for r in rows)])


@query(
    "subword_segments",
    f"""WITH RECURSIVE {RUNS_CTE},
    each AS (SELECT w.doc_id, at_word, unnest(string_split(c.pieces, ' ')) AS piece,
        generate_subscripts(string_split(c.pieces, ' '), 1) AS i FROM words w JOIN cut c ON c.token = w.token)
    SELECT doc_id, count(*) AS n_pieces, string_agg(piece, ' ' ORDER BY at_word, i) AS pieces,
      string_agg(CAST(id AS VARCHAR), ' ' ORDER BY at_word, i) AS ids
    FROM each JOIN units ON unit = piece GROUP BY doc_id""",
)
def subword_segments(spark, sf):
    """Whole documents in units; the texts are cleaned once, for the units and for the cut."""
    docs = cut_lineage(I.clean_documents(spark, sf))
    words = F.array_remove(F.split("text", " "), "")
    out = vocab.subword_rows(docs, "doc_id", words, run_units(spark, docs)).filter(F.size("ids") > 0)
    return out.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_pieces"),
        F.array_join("pieces", " ").alias("pieces"),
        F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"),
    )


# ---- sequences ----------------------------------------------------------------------

SENTENCES = rf"""(SELECT subject_id, text, len(string_split(text, ' ')) + 1 AS len,
      row_number() OVER (PARTITION BY subject_id ORDER BY charttime DESC, note_id DESC, sent_seq) - 1 AS pos
    FROM (SELECT subject_id, note_id, charttime, trim(s) AS text, p AS sent_seq FROM (
            SELECT subject_id, note_id, charttime, unnest(string_split(text, ' [EOS] ')) AS s,
                   generate_subscripts(string_split(text, ' [EOS] '), 1) AS p FROM {I.CLEAN_NOTES}))
    WHERE text <> '')"""
PACK_CTE = f"""sent AS MATERIALIZED (SELECT * FROM {SENTENCES}),
    walk AS (SELECT subject_id, pos, len, 1 + len AS c, CAST(-1 AS BIGINT) AS start, 1 + len >= {LENGTH} AS cut
        FROM sent WHERE pos = 0
      UNION ALL
      SELECT s.subject_id, s.pos, s.len, CASE WHEN w.cut THEN 1 + w.len ELSE w.c END + s.len,
        CASE WHEN w.cut THEN w.pos ELSE w.start END,
        CASE WHEN w.cut THEN 1 + w.len ELSE w.c END + s.len >= {LENGTH}
      FROM walk w JOIN sent s ON s.subject_id = w.subject_id AND s.pos = w.pos + 1),
    members AS (SELECT subject_id, start, pos, cut AS closes FROM walk
      UNION ALL SELECT subject_id, pos, pos, false FROM walk WHERE cut),
    joined AS (SELECT m.subject_id, start, max(m.pos) AS last, NOT bool_or(closes) AS is_tail,
        string_split('[CLS] ' || string_agg(text || ' [SEP]', ' ' ORDER BY m.pos), ' ') AS t
      FROM members m JOIN sent s ON s.subject_id = m.subject_id AND s.pos = m.pos GROUP BY m.subject_id, start),
    every AS (SELECT subject_id, start, last, is_tail,
        CASE WHEN is_tail THEN t ELSE list_append(t[1:{LENGTH - 2}], '[SEP]') END AS tokens FROM joined),
    packed AS (SELECT *, len(tokens) AS n_tokens FROM every WHERE NOT is_tail OR len(tokens) >= {MIN_LENGTH})"""
PICKS_CTE = f"""{PACK_CTE},
    toks AS (SELECT subject_id, start, n_tokens, unnest(tokens) AS token,
        generate_subscripts(tokens, 1) - 1 AS i FROM packed),
    cand AS (SELECT *, row_number() OVER (PARTITION BY subject_id, start
          ORDER BY md5('1|' || subject_id || '|' || start || '|' || i), i) AS rn FROM toks
        WHERE token NOT IN ('[CLS]', '[SEP]', 'TIME', 'DATE', 'DOCTOR') AND regexp_full_match(token, '\\p{{L}}+')),
    picks AS (SELECT subject_id, start, i, token AS label, md5('1-action|' || subject_id || '|' || start || '|' || i) AS h
        FROM cand WHERE rn <= least({PREDS}, greatest(1, CAST(round(n_tokens * CAST(0.2 AS DOUBLE)) AS BIGINT))))"""
PICKED = "SELECT subject_id, start, string_agg(i, ' ' ORDER BY i) AS masked_indices, string_agg(label, ' ' ORDER BY i) AS labels FROM picks GROUP BY subject_id, start"
VOCABULARY = f"""(SELECT token, row_number() OVER (ORDER BY n DESC, token) - 1 AS id FROM
    (SELECT unnest(string_split(text, ' ')) AS token, count(*) AS n FROM sent GROUP BY token)
    ORDER BY n DESC, token LIMIT {WORDS})"""
MASKED_CTE = f"""{PICKS_CTE},
    words AS MATERIALIZED (SELECT * FROM {VOCABULARY}),
    acts AS (SELECT p.*, CASE WHEN substr(h, 1, 8) < 'cccccccd' THEN '[MASK]' WHEN substr(h, 9, 8) < '80000000' THEN label
        ELSE w.token END AS new
      FROM picks p LEFT JOIN words w
        ON w.id = CAST(CAST('0x' || substr(h, 17, 8) AS UBIGINT) % (SELECT count(*) FROM words) AS BIGINT)),
    masked AS (SELECT t.subject_id, t.start, t.i, coalesce(a.new, t.token) AS token, a.label
      FROM toks t LEFT JOIN acts a ON a.subject_id = t.subject_id AND a.start = t.start AND a.i = t.i)"""


def sentences(spark, sf):
    cleaned = cohort.clean_notes(I.notes(spark, sf))
    split = cohort.explode_sentences(cleaned)
    order = [F.col("note_id").desc(), F.col("sent_seq")]
    return mlm.number_sentences(split, order).withColumn("tokens", F.split("text", " "))


def packed(spark, sf):
    return mlm.pack_sequences(sentences(spark, sf), LENGTH, MIN_LENGTH)


def picked(spark, sf):
    return mlm.mask_positions(packed(spark, sf), max_preds=PREDS)


def words(spark, sf):
    split = cohort.explode_sentences(cohort.clean_notes(I.notes(spark, sf)))
    counts = vocab.token_counts(split, F.split("text", " "))
    return vocab.head_of_vocab(vocab.token_vocab(counts, WORDS), WORDS)


@query(
    "pack_sequences",
    f"""WITH RECURSIVE {PACK_CTE}
    SELECT subject_id, start, last, is_tail, CAST(n_tokens AS INTEGER) AS n_tokens,
      array_to_string(tokens, ' ') AS text FROM packed""",
)
def pack_sequences(spark, sf):
    return packed(spark, sf).select(
        "subject_id", "start", "last", "is_tail", "n_tokens", F.array_join("tokens", " ").alias("text")
    )


@query(
    "tail_audit",
    f"""WITH RECURSIVE {PACK_CTE}
    SELECT count(*) FILTER (NOT is_tail) AS n_closed,
      count(*) FILTER (is_tail AND len(tokens) >= {MIN_LENGTH}) AS n_tails_kept,
      count(*) FILTER (is_tail AND len(tokens) < {MIN_LENGTH}) AS n_tails_skipped,
      CAST(coalesce(sum(len(tokens)) FILTER (is_tail AND len(tokens) < {MIN_LENGTH}), 0) AS BIGINT) AS tokens_skipped
    FROM every""",
)
def tail_audit(spark, sf):
    return mlm.tail_audit(mlm.all_sequences(sentences(spark, sf), LENGTH), MIN_LENGTH)


@query("mask_positions", f"WITH RECURSIVE {PICKS_CTE} {PICKED}")
def mask_positions(spark, sf):
    out = picked(spark, sf).filter(F.size("picks") > 0)
    return out.select(
        "subject_id",
        "start",
        F.array_join(F.col("picks.index").cast("array<string>"), " ").alias("masked_indices"),
        F.array_join("picks.label", " ").alias("labels"),
    )


# Words of more than six letters in two pieces, so that sequences hold pieces.
_PIECES = r"""array_to_string(list_transform(string_split(text, ' '), lambda t: CASE WHEN length(t) > 6
    THEN t[1:4] || ' ##' || t[5:] ELSE t END), ' ')"""
PIECE_SENTENCES = f"""(SELECT subject_id, pieces AS text, len(string_split(pieces, ' ')) + 1 AS len, pos
    FROM (SELECT subject_id, pos, {_PIECES} AS pieces FROM {SENTENCES}))"""
WORD_PICKS_CTE = f"""{PACK_CTE.replace(SENTENCES, PIECE_SENTENCES)},
    toks AS (SELECT subject_id, start, n_tokens, unnest(tokens) AS token,
        generate_subscripts(tokens, 1) - 1 AS i FROM packed),
    placed AS (SELECT *, sum(CASE WHEN starts_with(token, '##') THEN 0 ELSE 1 END)
        OVER (PARTITION BY subject_id, start ORDER BY i) AS w FROM toks),
    each AS (SELECT subject_id, start, w, min(i) AS head, count(*) AS size, max(n_tokens) AS n_tokens,
        bool_and(CASE WHEN starts_with(token, '##') THEN regexp_full_match(token, '##\\p{{L}}+')
          ELSE token NOT IN ('[CLS]', '[SEP]', 'TIME', 'DATE', 'DOCTOR') AND regexp_full_match(token, '\\p{{L}}+') END) AS fit
      FROM placed GROUP BY subject_id, start, w),
    drawn AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY subject_id, start
          ORDER BY md5('1|' || subject_id || '|' || start || '|' || head), head) AS rn,
        least({PREDS}, greatest(1, CAST(round_even(n_tokens * CAST(0.2 AS DOUBLE), 0) AS BIGINT))) AS budget
      FROM each WHERE fit),
    taken AS (SELECT subject_id, start, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS head, CAST(0 AS BIGINT) AS size
        FROM packed
      UNION ALL SELECT d.subject_id, d.start, d.rn, CASE WHEN t.used + d.size <= budget THEN t.used + d.size ELSE t.used END,
        d.head, CASE WHEN t.used + d.size <= budget THEN d.size ELSE 0 END
      FROM taken t JOIN drawn d ON d.subject_id = t.subject_id AND d.start = t.start AND d.rn = t.rn + 1),
    picks AS (SELECT t.subject_id, t.start, t.i, t.token AS label FROM taken p JOIN toks t ON t.subject_id = p.subject_id
        AND t.start = p.start AND t.i >= p.head AND t.i < p.head + p.size)"""


@query("mask_whole_words", f"WITH RECURSIVE {WORD_PICKS_CTE} {PICKED}")
def mask_whole_words(spark, sf):
    cut = F.transform(
        "tokens", lambda t: F.when(F.length(t) > 6, F.array(F.substring(t, 1, 4), F.concat(F.lit("##"), F.substring(t, 5, 1000)))).otherwise(F.array(t))
    )
    pieces = sentences(spark, sf).withColumn("tokens", F.flatten(cut))
    out = mlm.mask_positions(mlm.pack_sequences(pieces, LENGTH, MIN_LENGTH), max_preds=PREDS, whole_word=True)
    return out.filter(F.size("picks") > 0).select(
        "subject_id",
        "start",
        F.array_join(F.col("picks.index").cast("array<string>"), " ").alias("masked_indices"),
        F.array_join("picks.label", " ").alias("labels"),
    )


@query(
    "mask_tokens",
    f"""WITH RECURSIVE {MASKED_CTE}
    SELECT subject_id, start, string_agg(token, ' ' ORDER BY i) AS masked_tokens,
      coalesce(string_agg(label, ' ' ORDER BY i) FILTER (label IS NOT NULL), '') AS labels
    FROM masked GROUP BY subject_id, start""",
)
def mask_tokens(spark, sf):
    out = mlm.mask_tokens(picked(spark, sf), words(spark, sf))
    return out.select(
        "subject_id",
        "start",
        F.array_join("masked_tokens", " ").alias("masked_tokens"),
        F.array_join("masked_token_labels", " ").alias("labels"),
    )


_UNITS = f"""units AS (SELECT token, id + 5 AS id FROM words UNION ALL
    SELECT unnest(['[PAD]', '[MASK]', '[UNK]', '[CLS]', '[SEP]']), unnest([0, 1, 2, 3, 4]))"""
_PAD = "list_transform(range(greatest(0, {n} - len({x}))), lambda z: CAST({v} AS BIGINT))"


@query(
    "mlm_features",
    f"""WITH RECURSIVE {MASKED_CTE}, {_UNITS},
    coded AS (SELECT m.subject_id, m.start, m.i, CAST(coalesce(u.id, 2) AS BIGINT) AS id, m.label, CAST(coalesce(l.id, 2) AS BIGINT) AS lid
      FROM masked m LEFT JOIN units u ON u.token = m.token LEFT JOIN units l ON l.token = m.label WHERE m.i < {LENGTH}),
    rows AS (SELECT subject_id, start, list(id ORDER BY i) AS a,
        coalesce(list(lid ORDER BY i) FILTER (label IS NOT NULL), []) AS b,
        coalesce(list(CAST(i AS BIGINT) ORDER BY i) FILTER (label IS NOT NULL), []) AS c
      FROM coded GROUP BY subject_id, start)
    SELECT subject_id, start,
      array_to_string(list_concat(a, {_PAD.format(n=LENGTH, x='a', v=0)}), ' ') AS token_ids,
      array_to_string(list_concat(b, {_PAD.format(n=PREDS, x='b', v=0)}), ' ') AS label_ids,
      array_to_string(list_concat(list_transform(a, lambda z: CAST(0 AS BIGINT)), {_PAD.format(n=LENGTH, x='a', v=1)}), ' ') AS mask,
      array_to_string(list_concat(c, {_PAD.format(n=PREDS, x='c', v=0)}), ' ') AS indices
    FROM rows""",
)
def mlm_features(spark, sf):
    vocabulary = words(spark, sf)
    masked = mlm.mask_tokens(picked(spark, sf), vocabulary)
    out = mlm.mlm_features(masked, [*vocab.SPECIALS, *vocabulary], LENGTH, PREDS)
    arrays = ["token_ids", "label_ids", "mask", "indices"]
    return out.select(
        "subject_id",
        "start",
        *[F.array_join(F.col(a).cast("array<string>"), " ").alias(a) for a in arrays],
    )
