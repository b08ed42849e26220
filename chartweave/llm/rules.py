"""Text quality rules: one threshold table, compiled into one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

# Common short words of four languages.
STOP_WORDS = (
    "the of and to in is that it for was on are as with his they at be this have from or by not "
    "de la le et les des que en un une pour dans est sur au du ce il qui par pas "
    "der die und den von zu das mit sich auf für ist im dem nicht ein als auch es an "
    "el los se las por con su al lo como más pero sus no una y a"
).split()


@dataclass(frozen=True)
class Rule:
    """``low * base <= 100 * measure <= high * base``; a bound may be absent, and ``base`` 1."""

    measure: str
    base: str
    low: int | None = None
    high: int | None = None


RULES = (
    Rule("word_chars", "n_words", low=150, high=1500),
    Rule("n_symbols", "n_words", high=20),
    Rule("n_marks", "n_words", high=50),
    Rule("n_stop_words", "1", low=100),
    Rule("n_dup_lines", "n_lines", high=40),
)
MIN_WORDS = 20
MAX_REPEATED = 30


def _repeated(halves: Column) -> Column:
    """Words covered by windows that stand more than once, from hashes of half windows.

    No window repeats where no half window does, which settles most texts."""
    hashes = _doubled(halves, WINDOW // 2)
    marked = F.transform(hashes, lambda x, i: F.struct(x.alias("x"), i.alias("i")))

    def covered(s: Column) -> Column:
        same = F.filter(
            s,
            lambda e, i: (F.get(s, i - 1)["x"] == e["x"]) | (F.get(s, i + 1)["x"] == e["x"]),
        )
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(
            F.sort_array(F.transform(same, lambda e: e["i"])),
            start,
            lambda acc, p: F.struct(
                (p + WINDOW).alias("end"),
                (acc["n"] + WINDOW - F.greatest(acc["end"] - p, F.lit(0))).alias("n"),
            ),
            lambda acc: acc["n"],
        )

    # A one-element array binds the sorted windows, so they are made once for all uses.
    slow = F.element_at(F.transform(F.array(F.sort_array(marked)), covered), 1)
    return F.when(F.size(F.array_distinct(halves)) == F.size(halves), F.lit(0)).otherwise(slow)


def _doubled(hashes: Column, width: int) -> Column:
    """Hashes of windows of ``2 * width`` words from those of ``width``."""
    more = F.greatest(F.size(hashes) - width, F.lit(0))
    later = F.slice(hashes, width + 1, F.greatest(more, F.lit(1)))
    return F.zip_with(F.slice(hashes, 1, more), F.slice(later, 1, more), lambda a, b: F.xxhash64(a, b))


def _count_of(chars: str) -> Column:
    """How often any of some ASCII characters stands in ``_t``."""
    gone = [F.octet_length("_t") - F.octet_length(F.replace(F.col("_t"), F.lit(c), F.lit(""))) for c in chars]
    return sum(gone[1:], gone[0]).cast("long")


def measured(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Counts of each whole text; a null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = docs.select(
        F.col(id_col).alias("doc_id"), text.alias("_t"), F.array_remove(F.split(text, SPACES), "").alias("_w")
    )
    n = F.size("_w")
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    wide = parts.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        _count_of(SYMBOLS).alias("n_symbols"),
        _count_of("!?").alias("n_marks"),
        F.size(F.array_intersect("_w", stop)).cast("long").alias("n_stop_words"),
        lines.alias("_l"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    # Hashes of windows of 2 and 4 words, each from two of half its width.
    for width in (1, 2):
        wide = wide.withColumn("_h", _doubled(F.col("_h"), width))
    return wide.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_marks",
        "n_stop_words",
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("_h")).cast("long").alias("n_repeat_words"),
    )


def verdict(rules=RULES) -> Column:
    ok = F.lit(True)
    for r in rules:
        scaled = 100 * F.col(r.measure)
        if r.low is not None:
            ok = ok & (scaled >= r.low * F.expr(r.base))
        if r.high is not None:
            ok = ok & (scaled <= r.high * F.expr(r.base))
    return ok


def judged(docs: DataFrame, rules=RULES, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Measures of each row of ``docs``, ``base_failed`` and ``kept``.

    A null, empty or blank text has no words, so it fails.  Every row gives one row, repeated
    ones too; a null id stays null; other columns are not looked at.
    """
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return (
        measured(docs, text_col, id_col)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & verdict(rules))
    )


def _sql() -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    bounds = []
    for r in RULES:
        if r.low is not None:
            bounds.append(f"100 * {r.measure} >= {r.low} * {r.base}")
        if r.high is not None:
            bounds.append(f"100 * {r.measure} <= {r.high} * {r.base}")
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM t),
g AS (SELECT r, i, array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ') AS g
      FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w WHERE len(w) >= {WINDOW})),
f AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
c AS (SELECT r, sum(least({WINDOW}, coalesce(nx - i, {WINDOW}))) AS n
      FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nx FROM f) GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             length(regexp_replace(t, '[^!?]', '', 'g'))::BIGINT AS n_marks,
             len(list_intersect(list_distinct(w), [{stop}]))::BIGINT AS n_stop_words,
             len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
             coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN c USING (r)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND {' AND '.join(bounds)} AS kept FROM b"""


SQL = _sql()
