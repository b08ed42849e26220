"""How quality filters interact: what each removes alone, in any order, and its Shapley share.

Every document gets a bit mask of the filters that it fails, so a table of (part, mask) counts
holds all that any order of the filters can do.  From it the removals of all 32 coalitions of
five filters are tabulated; what an order's k-th filter removes is the difference between two
coalitions.  Shapley shares are the weighted least squares fit of coalition removals by one
number per filter, constrained to sum to the removal of all filters.  The normal equations have
the same matrix for every part, so they are solved once, in rationals, for a unit removal of
each coalition; the solutions are the weights that turn removals into shares.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from fractions import Fraction
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def shapley_weights(n: int) -> list[list[Fraction]]:
    """For each of ``n`` filters, the weight of each of the ``2 ** n`` coalition removals.

    Minimises ``sum w(|S|) (v(S) - sum of shares in S) ** 2`` over the coalitions that are
    neither empty nor whole, with ``w(s) = (n - 1) / (C(n, s) s (n - s))``, subject to the
    shares' sum being ``v`` of the whole.  The last row of the system is that constraint, its
    last column the multiplier's.
    """
    whole = (1 << n) - 1
    if n == 1:
        return [[Fraction(0), Fraction(1)]]
    inner = {s: Fraction(n - 1, math.comb(n, k) * k * (n - k)) for s in range(1, whole) for k in [s.bit_count()]}
    rows = []
    for i in range(n):
        left = [sum((w for s, w in inner.items() if s >> i & 1 and s >> j & 1), Fraction(0)) for j in range(n)]
        right = [inner[s] if s in inner and s >> i & 1 else Fraction(0) for s in range(whole + 1)]
        rows.append([*left, Fraction(1), *right])
    rows.append([*[Fraction(1)] * n, Fraction(0), *[Fraction(s == whole) for s in range(whole + 1)]])
    for c in range(n + 1):
        pivot = next(r for r in range(c, n + 1) if rows[r][c])
        rows[c], rows[pivot] = rows[pivot], rows[c]
        rows[c] = [x / rows[c][c] for x in rows[c]]
        for r in range(n + 1):
            if r != c and rows[r][c]:
                rows[r] = [x - rows[r][c] * y for x, y in zip(rows[r], rows[c])]
    return [row[n + 1 :] for row in rows[:n]]


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions on one text: few words, few distinct words, many capitals, symbols."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * capitals > 5 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def _mask(flags: list[Column]) -> Column:
    return sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(flags)), F.lit(0)).cast("int")


def failures(
    docs: DataFrame,
    labels: DataFrame,
    filters: Mapping[str, Column],
    text: Column,
    copies: bool = True,
    id_col: str = "doc_id",
    part_col: str = "source",
) -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents per part by the filters they fail, bit i being
    the i-th of ``filters``; with ``copies`` one more filter follows, failed by a text that a
    smaller id has too, anywhere in the table.

    A null part is the empty string.  A null id never fails the copies filter, makes nothing
    else fail it and has no label.  Rows that repeat an id count each; of such rows with one
    text none makes another fail.  Labels that repeat an id count once, 1 if any row says so.

    Texts are digested where they are read, so only ids, digests and masks move.  Copies are
    summed before they meet: what is joined has a row per text and part, however many copies.
    """
    ident = F.col(id_col)
    digest = F.sha2(text, 256) if copies else F.lit("")
    # A salt spreads null ids, which no label matches.
    salt = F.when(ident.isNull(), F.pmod(F.xxhash64(digest), F.lit(1 << 20))).otherwise(F.lit(0))
    marked = docs.select(
        ident.alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        _mask(list(filters.values())).alias("mask"),
        digest.alias("digest"),
        salt.cast("long").alias("salt"),
    )
    known = labels.groupBy(F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("salt")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    told = marked.join(known, ["id", "salt"], "left")
    group = ["digest", "part", "mask", "good", "toxic"]
    cells = told.groupBy("id", *group).agg(F.count(F.lit(1)).alias("n"))
    cells = cells.groupBy(*group).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("id").isNotNull(), F.col("n")).otherwise(0)).alias("named"),
        F.min("id").alias("least"),
        F.min_by("n", "id").alias("at_least"),
    )
    if copies:
        first = cells.groupBy("digest").agg(F.min("least").alias("first"))
        late = F.col("named") - F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
        cells = cells.join(first, "digest").withColumn("late", F.coalesce(late, F.lit(0)))
        bit = 1 << len(filters)
        both = F.array(
            F.struct(F.col("mask").alias("mask"), (F.col("n") - F.col("late")).alias("n")),
            F.struct((F.col("mask") + bit).alias("mask"), F.col("late").alias("n")),
        )
        cells = cells.select("part", "good", "toxic", F.explode(both).alias("e")).select(
            "part", "good", "toxic", "e.mask", "e.n"
        )
    count = lambda flag: F.sum(F.when(F.coalesce(F.col(flag), F.lit(False)), F.col("n")).otherwise(0))
    return cells.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), count("good").alias("good"), count("toxic").alias("toxic")
    )


def audit(counts: DataFrame, names: str) -> DataFrame:
    """One row per part, order of the filters ``names`` (a letter each) and step; see the module.

    ``kept`` after the step, ``removed`` here, ``redundant`` failing the step's filter but removed
    earlier, ``unique_fails`` failing no other filter, ``good_lost`` and ``toxic_lost`` among the
    removed, ``shapley`` the filter's share times the number of orders, an integer.  An empty
    table of counts gives no rows.
    """
    n, whole = len(names), (1 << len(names)) - 1
    cells = counts.groupBy("part").agg(
        F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"), F.sum("n").alias("total")
    )

    def removal(field: str) -> Column:
        """Removals of all coalitions: documents with a failed filter among the coalition's."""
        return F.transform(
            F.sequence(F.lit(0), F.lit(whole)),
            lambda s: F.aggregate(
                "cells",
                F.lit(0).cast("long"),
                lambda acc, c: acc + F.when(c["mask"].bitwiseAND(s) != 0, c[field]).otherwise(F.lit(0)),
            ),
        )

    orders = ["".join(p) for p in permutations(names)]
    weights = [[int(w * math.factorial(n)) for w in row] for row in shapley_weights(n)]
    table = F.array(*[F.array(*[F.lit(w).cast("long") for w in row]) for row in weights])
    place = F.create_map(*[F.lit(x) for i, letter in enumerate(names) for x in (letter, i + 1)])
    powers = F.array(*[F.lit(1 << i) for i in range(n)])
    bit = lambda letter: F.element_at(powers, place[letter])
    steps = (
        cells.select(
            "part", "total", *[removal(f).alias(f) for f in ("n", "good", "toxic")]
        )
        .withColumn("shares", F.transform(table, lambda row: F.aggregate(
            F.zip_with(row, "n", lambda w, v: w * v), F.lit(0).cast("long"), lambda acc, x: acc + x)))
        .withColumn("filter_order", F.explode(F.array(*[F.lit(o) for o in orders])))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
        .withColumn("own", bit(F.substring("filter_order", F.col("step"), F.lit(1))))
        .withColumn(
            "before",
            F.aggregate(
                F.slice(F.split("filter_order", ""), F.lit(1), F.col("step") - 1),
                F.lit(0),
                lambda acc, x: acc.bitwiseOR(bit(x)),
            ),
        )
    )
    at = lambda field, s: F.element_at(field, s + 1)
    after = F.col("before").bitwiseOR(F.col("own"))
    removed = at("n", after) - at("n", F.col("before"))
    return steps.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - at("n", after)).alias("kept"),
        removed.alias("removed"),
        (at("n", F.col("own")) - removed).alias("redundant"),
        (at("n", F.lit(whole)) - at("n", F.lit(whole) - F.col("own"))).alias("unique_fails"),
        (at("good", after) - at("good", F.col("before"))).alias("good_lost"),
        (at("toxic", after) - at("toxic", F.col("before"))).alias("toxic_lost"),
        F.element_at("shares", place[F.substring("filter_order", F.col("step"), F.lit(1))]).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to D and of copies, E, over ``docs (doc_id, text, source)``; a null
    text is empty, other columns are not looked at."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return audit(failures(docs, labels, text_filters(text), text), "ABCDE")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
             max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
f AS (SELECT doc_id, part, t, CASE WHEN len(w) < 50 THEN 1 ELSE 0 END
        + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
        + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END AS m FROM w),
g AS (SELECT doc_id, part, m + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS m FROM f),
c AS (SELECT part, m, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
      FROM g LEFT JOIN l USING (doc_id) GROUP BY part, m),
s AS (SELECT part, s, sum(CASE WHEN m & s <> 0 THEN n ELSE 0 END) AS n, sum(CASE WHEN m & s <> 0 THEN good ELSE 0 END) AS good,
             sum(CASE WHEN m & s <> 0 THEN toxic ELSE 0 END) AS toxic, sum(n) AS total
      FROM c, (SELECT unnest(range(32)) AS s) GROUP BY part, s),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
      FROM x a, x b, x c, x d, x e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND a.b | b.b | c.b | d.b | e.b = 31),
p AS (SELECT filter_order, k AS step, bits[k] AS own, coalesce(list_sum(bits[1:k - 1]), 0)::INT AS before
      FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
r AS (SELECT a.part, filter_order, step, own, a.total - b.n AS kept, b.n - a.n AS removed, u.n - (b.n - a.n) AS redundant,
             z.n - y.n AS unique_fails, b.good - a.good AS good_lost, b.toxic - a.toxic AS toxic_lost
      FROM p JOIN s a ON a.s = p.before JOIN s b ON b.part = a.part AND b.s = p.before + p.own
      JOIN s u ON u.part = a.part AND u.s = p.own JOIN s z ON z.part = a.part AND z.s = 31
      JOIN s y ON y.part = a.part AND y.s = 31 - p.own)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r"""
