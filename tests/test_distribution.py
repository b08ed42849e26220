import random

from pyspark.sql import functions as F

from chartweave.operators import distribution as D


def skewed(spark, n=600):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.6 else f"g{rng.randrange(20)}", i, rng.randrange(9)) for i in range(n)]
    rows += [(None, 1000 + i, 1) for i in range(30)]
    return rows, spark.createDataFrame(rows, "g string, k int, v int").repartition(5)


def expected(rows):
    groups = {}
    for g, k, v in rows:
        groups.setdefault(g, []).append((k, v))
    out = {}
    for g, items in groups.items():
        total = 0
        for pos, (k, v) in enumerate(sorted(items, reverse=True), 1):
            total += v
            out[(g, k)] = (pos, total)
    return out


def check(spark, **kw):
    rows, df = skewed(spark)
    sums = {"pos": F.lit(1), "total": F.col("v")}
    got = D.running_totals(df, ["g"], [F.col("k").desc()], sums, **kw).collect()
    assert {(r["g"], r["k"]): (r["pos"], r["total"]) for r in got} == expected(rows)
    assert len(got) == len(rows)


def test_window_path(spark):
    check(spark)


def test_sliced_path_gives_the_same_rows(spark):
    check(spark, max_group_rows=10, slices=7)


def test_rank_without_groups(spark):
    df = spark.range(0, 500, 1, 6).select((F.col("id") * 7 % 500).alias("x"))
    got = D.ranked(df, [], [F.col("x")], max_group_rows=50, slices=9).collect()
    assert all(r["rank"] == r["x"] + 1 for r in got) and len(got) == 500


def test_top_k_keeps_the_first_of_a_hot_group(spark):
    rows, df = skewed(spark)
    got = D.top_k(df, ["g"], [F.col("k")], 4, ["g", "k"], salts=8).collect()
    want = {}
    for g, k, _ in sorted(rows, key=lambda r: r[1]):
        want.setdefault(g, [])
        if len(want[g]) < 4:
            want[g].append(k)
    assert {(r["g"], r["k"], r["rank"]) for r in got} == {
        (g, k, i) for g, ks in want.items() for i, k in enumerate(ks, 1)
    }
