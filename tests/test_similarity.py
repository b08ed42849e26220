import numpy as np
import pytest

from chartweave.operators import similarity as S


def make(spark, n, dims=5, seed=1, copies=0):
    rng = np.random.default_rng(seed)
    vec = np.round(rng.normal(size=(n, dims)), 2)
    if copies:
        vec[-copies:] = vec[0]
    y = rng.integers(0, 2, size=n)
    rows = [("t", int(i), str(int(y[i])), [float(v) for v in vec[i]]) for i in range(n)]
    return vec, y, spark.createDataFrame(rows, "task string, user bigint, y string, vec array<double>")


def scores(vec):
    u = vec / np.linalg.norm(vec, axis=1, keepdims=True)
    return np.rint(u @ u.T * 1_000_000).astype(int)


def curve(s, relevant):
    """Reference curve: vertices, then linear interpolation, last value on jumps."""
    p, n = relevant.sum(), (~relevant).sum()
    fpr, tpr = [0.0], [0.0]
    for t in sorted(set(s), reverse=True):
        fpr.append((s[~relevant] >= t).sum() / n)
        tpr.append((s[relevant] >= t).sum() / p)
    return np.interp(np.linspace(0, 1, 100), fpr, tpr)


@pytest.mark.parametrize("block_rows, group_rows, copies", [(1000, 1000, 0), (7, 7, 0), (9, 20, 8)])
def test_user_roc_against_brute_force(spark, block_rows, group_rows, copies):
    vec, y, users = make(spark, 40, copies=copies)
    s = scores(vec)
    got = S.user_roc(users, block_rows, group_rows).collect()
    assert len(got) == 40 * 100
    by_user = {}
    for r in got:
        by_user.setdefault(r["user"], {})[r["k"]] = r["tpr"]
    for i in range(40):
        want = curve(s[i], y == y[i])
        have = np.array([by_user[i][k] for k in range(100)])
        assert np.allclose(have, want, atol=1e-9), i


def test_mean_curve_ends(spark):
    _, y, users = make(spark, 30, seed=4)
    means = S.mean_roc(S.user_roc(users, 8))
    rows = {(r["y"], r["k"]): r for r in means.collect()}
    for label in ("0", "1"):
        assert rows[(label, 0)]["tpr"] == 0 and rows[(label, 99)]["tpr"] == 1
        assert rows[(label, 50)]["n_users"] == (y == int(label)).sum()
    auc = {r["y"]: r["auc"] for r in S.mean_roc_auc(means).collect()}
    x = np.linspace(0, 1, 100)
    for label in ("0", "1"):
        tpr = np.array([rows[(label, k)]["tpr"] for k in range(100)])
        assert auc[label] == pytest.approx(np.trapezoid(tpr, x))


def ranked(s, i, k):
    return sorted((j for j in range(len(s)) if j != i), key=lambda j: (-s[i, j], j))[:k]


@pytest.mark.parametrize("block_rows, group_rows, pivots", [(1000, 1000, 9), (6, 12, 4), (3, 3, 256), (4, 1, 1)])
def test_neighbours_against_brute_force(spark, block_rows, group_rows, pivots):
    vec, _, users = make(spark, 60, seed=2, copies=5)
    s = scores(vec)
    found = S.neighbour_topk(users, 4, block_rows, group_rows, pivots).collect()
    got = {(r["user"], r["rank"]): (r["neighbour"], round(r["score"] * 1e6)) for r in found}
    assert len(found) == len(got) == 60 * 4
    for i in range(60):
        assert [got[(i, r)] for r in range(1, 5)] == [(j, s[i, j]) for j in ranked(s, i, 4)]


def test_neighbours_of_zero_vectors_and_few_users(spark):
    vec = [[1.0, 0.0], [-1.0, 0.0], [0.0, 0.0], [0.0, 0.0]]
    users = spark.createDataFrame([("t", i, "0", v) for i, v in enumerate(vec)], "task string, user bigint, y string, vec array<double>")
    got = {(r["user"], r["rank"]): (r["neighbour"], r["score"]) for r in S.neighbour_topk(users, 9, 1, 1).collect()}
    assert got == {
        (0, 1): (2, 0.0), (0, 2): (3, 0.0), (0, 3): (1, -1.0), (1, 1): (2, 0.0), (1, 2): (3, 0.0), (1, 3): (0, -1.0),
        (2, 1): (0, 0.0), (2, 2): (1, 0.0), (2, 3): (3, 0.0), (3, 1): (0, 0.0), (3, 2): (1, 0.0), (3, 3): (2, 0.0),
    }
    assert S.neighbour_topk(users.limit(0), 3).count() == 0 and S.user_roc(users.limit(0)).count() == 0


def clustered(spark, clusters, each, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, 12))
    vec = np.repeat(centres, each, axis=0) + 0.02 * rng.normal(size=(clusters * each, 12))
    rows = [("t", i, "0", [float(x) for x in v]) for i, v in enumerate(vec)]
    return vec, spark.createDataFrame(rows, "task string, user bigint, y string, vec array<double>")


def test_blocks_that_cannot_win_do_not_meet(spark):
    """Rows of the exchange grow with the blocks, not with their square."""
    vec, users = clustered(spark, 24, 30)
    packed = S.cut_lineage(S._neighbourhoods(users, 10, 20, 64))
    blocks = packed.count()
    kinds = {r["kind"]: r["count"] for r in S.facing_blocks(packed, 3).groupBy("kind").count().collect()}
    groups = packed.select("group").distinct().count()
    assert blocks >= 60 and groups >= 24 and kinds[0] == blocks
    assert kinds.get(1, 0) < 0.15 * blocks * groups
    s = scores(vec)
    got = {(r["user"], r["rank"]): r["neighbour"] for r in S.neighbour_topk(users, 3, 10, 20, 64).collect()}
    for i in range(0, 720, 7):
        assert [got[(i, r)] for r in range(1, 4)] == ranked(s, i, 3)


def test_neighbour_rows_leave_a_task_once(spark):
    """No list of candidates is ranked after the search: only the k best of a user leave it."""
    _, users = clustered(spark, 6, 20)
    plan = S.neighbour_topk(users, 2, 5, 10, 8)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_small_groups_share_their_candidates(spark):
    """A block is copied for each core, however many small groups there are."""
    _, _, users = make(spark, 600, dims=24, seed=8)
    packed = S.cut_lineage(S._neighbourhoods(users, 4, 8, 16, cores=3))
    blocks = packed.count()
    kinds = {r["kind"]: r["count"] for r in S.facing_blocks(packed, 5).groupBy("kind").count().collect()}
    assert blocks >= 100 and kinds[0] == blocks and kinds[1] <= 2 * blocks


def test_small_groups_of_curves_share_their_candidates(spark):
    _, _, users = make(spark, 600, seed=8)
    packed = S.cut_lineage(S._curve_blocks(users, 4, 8, cores=3))
    blocks = packed.count()
    kinds = {r["kind"]: r["count"] for r in S.passing_blocks(packed).groupBy("kind").count().collect()}
    assert blocks >= 100 and kinds[0] == blocks and all(kinds[i] <= 3 * blocks for i in (1, 2, 3))


def test_counts_of_a_curve_do_not_grow_with_the_candidates():
    from types import SimpleNamespace

    rng = np.random.default_rng(3)
    sizes = []
    for n in (1_500, 30_000):
        vec, y = rng.normal(size=(n, 6)), np.array([str(v) for v in rng.integers(0, 2, n)], object)
        held = S._Counts([SimpleNamespace(ids=np.arange(20), ys=y[:20], flat=vec[:20].ravel())])
        for turn in (1, 2, 3):
            for at in range(0, n, 500):
                held.meet(turn, y[at : at + 500], S._unit(vec[at : at + 500].ravel(), 500))
        held.finish()
        sizes.append(sum(level.n.size for level in held.levels))
        s = np.rint(S._unit(vec[:20].ravel(), 20) @ S._unit(vec.ravel(), n).T * 1_000_000).astype(int)
        for i, _, tpr in list(held.curves())[:3] if n < 2_000 else []:
            assert np.allclose(tpr, curve(s[i], y == y[i]), atol=1e-9)
    assert max(sizes) <= 20 * (S.BINS + 2 * 99 * S.MIDDLE)


def tasks_with_users(out):
    from pyspark.sql import functions as F

    parts = out.select(F.spark_partition_id().alias("p"), "user").distinct().groupBy("p").count().collect()
    return sorted(r["count"] for r in parts)


def test_each_core_searches_a_few_groups(spark):
    """A task for each of twelve groups of twenty users on four cores; hashes of their keys would collide."""
    _, users = clustered(spark, 24, 10)
    assert spark.sparkContext.defaultParallelism == 4
    assert len(tasks_with_users(S.neighbour_topk(users, 2, 10, 10, 8))) == 12


def test_neighbours_that_single_precision_cannot_tell_apart(spark):
    rng = np.random.default_rng(9)
    vec = rng.normal(size=(1, 16)) + np.repeat([1e-3, 2e-4], 40)[:, None] * rng.normal(size=(80, 16))
    rows = [("t", i, "0", [float(x) for x in v]) for i, v in enumerate(vec)]
    users = spark.createDataFrame(rows, "task string, user bigint, y string, vec array<double>")
    s = scores(vec)
    assert len(np.unique(s)) < 200
    for block_rows, group_rows in ((1000, 1000), (6, 12)):
        found = S.neighbour_topk(users, 5, block_rows, group_rows, 4).collect()
        got = {(r["user"], r["rank"]): r["neighbour"] for r in found}
        assert all([got[(i, r)] for r in range(1, 6)] == ranked(s, i, 5) for i in range(80))


def test_curves_of_held_and_of_passing_candidates_are_the_same(spark):
    """Three labels in two tasks, equal vectors, and a task of one label, which has no curve."""
    from pyspark.sql import functions as F

    vec, _, users = make(spark, 60, seed=6, copies=9)
    users = users.withColumn("y", (F.col("user") % 3).cast("string"))
    more = users.filter("user >= 20").withColumn("task", F.lit("u"))
    users = users.unionByName(more).unionByName(users.filter("y = '1'").withColumn("task", F.lit("v")))
    s = scores(vec)
    for held_bytes in (1 << 20, 0):
        got = {}
        for r in S.user_roc(users, 7, 14, held_bytes).collect():
            got.setdefault((r["task"], r["user"], r["y"]), {})[r["k"]] = r["tpr"]
        assert set(got) == {(t, i, str(i % 3)) for t in "tu" for i in range(20 * (t == "u"), 60)}
        for (task, i, _), tprs in got.items():
            there = np.arange(20 * (task == "u"), 60)
            want = curve(s[i, there], there % 3 == i % 3)
            assert np.allclose([tprs[k] for k in range(100)], want, atol=1e-9)


def test_groups_of_curves_have_a_task_each(spark):
    """Four groups on four cores; hashes of their keys would collide."""
    _, _, users = make(spark, 240, seed=8)
    assert len(tasks_with_users(S.user_roc(users, 10, 10))) == 4


def test_held_candidates_are_copied_once(spark):
    _, _, users = make(spark, 600, seed=8)
    packed = S.cut_lineage(S._curve_blocks(users, 4, 8, cores=3))
    blocks, groups = packed.count(), packed.select("group").distinct().count()
    assert S.passing_blocks(packed, 1).filter("kind > 0").count() == blocks * groups
