import numpy as np
import pytest

from chartweave.operators import features, probe, registry
from chartweave.operators.encoders import hash_encoder

SCHEMA = "task string, split string, subject_id bigint, y string, vec array<double>"


def made(spark, tasks, n=150, dims=4, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for t, classes in tasks.items():
        centre = rng.normal(size=(classes, dims))
        for i in range(n):
            y = int(rng.integers(classes))
            vec = centre[y] + rng.normal(size=dims) * [1, 1, 30, 0.01]
            rows.append((t, "train" if i % 3 else "test", i, f"c{y}", vec.tolist()))
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def objective(x, hit, w):
    """Penalised mean logistic loss and its gradient."""
    z = x @ w[:-1] + w[-1]
    loss = np.mean(np.logaddexp(0, z) - hit * z) + 0.5 * probe.PENALTY * (w[:-1] ** 2).sum()
    r = (1 / (1 + np.exp(-z)) - hit) / len(x)
    return loss, np.append(x.T @ r + probe.PENALTY * w[:-1], r.sum())


def sparse(df):
    from pyspark.sql import functions as F

    ids = F.sequence(F.lit(0), F.size("vec") - 1)
    return df.select("task", "split", "subject_id", "y", ids.alias("ids"), F.col("vec").alias("weights"))


@pytest.mark.parametrize("form", ["dense", "sparse"])
def test_every_problem_is_solved(spark, form):
    rows, df = made(spark, {"two": 2, "three": 3, "one": 1})
    _, fit = probe.fitted(df if form == "dense" else sparse(df), {"two": "c1", "three": "c0", "one": "c0"})
    assert fit.problems == [("two", 1), ("three", 0), ("three", 1), ("three", 2)]
    for (task, label), w in zip(fit.problems, fit.weights):
        x = np.array([r[4] for r in rows if r[0] == task and r[1] == "train"])
        hit = np.array([float(r[3] == f"c{label}") for r in rows if r[0] == task and r[1] == "train"])
        loss, grad = objective(x, hit, w)
        assert np.abs(grad).max() < 1e-2
        rng = np.random.default_rng(1)
        assert all(objective(x, hit, w + 1e-2 * rng.normal(size=len(w)))[0] >= loss - 1e-5 for _ in range(50))
    assert all(fit.converged(t) for t in ("two", "three", "one"))


def test_scores_are_probabilities_of_the_positive_label(spark):
    rows, df = made(spark, {"three": 3, "two": 2}, seed=3)
    got = probe.probe(df, "m", {"three": "c1", "two": "c0"}).collect()
    assert len(got) == 2 * 50
    _, fit = probe.fitted(df, {"three": "c1", "two": "c0"})
    vec = {(r[0], r[2]): np.array(r[4]) for r in rows}
    for r in got:
        at = [k for k, (t, _) in enumerate(fit.problems) if t == r["task"]]
        p = 1 / (1 + np.exp(-(fit.weights[at, :-1] @ vec[r["task"], r["subject_id"]] + fit.weights[at, -1])))
        p = np.array([1 - p[0], p[0]]) if r["task"] == "two" else p / p.sum()
        assert r["score"] == pytest.approx(p[1 if r["task"] == "three" else 0])
        assert r["yhat"] == f"c{p.argmax()}"
    with pytest.raises(ValueError):
        probe.probe(df, "m", {"two": "c7"})


def test_jobs_do_not_grow_with_the_tasks(spark):
    """The passes over the rows are those of the slowest problem."""
    _, one = made(spark, {"t0": 2})
    many = {f"t{i}": 2 for i in range(6)}
    _, six = made(spark, many)
    alone = [probe.fitted(six.filter(f"task = '{t}'"), {t: "c1"})[1].passes for t in many]
    together = probe.fitted(six, {t: "c1" for t in many})[1].passes
    assert together < 2 * max(alone) and together < sum(alone) / 2


def test_sparse_features_by_name(spark):
    from pyspark.sql import functions as F

    texts = [(1, "a b a"), (2, "b c"), (3, "z"), (4, "")]
    docs = spark.createDataFrame(texts, "doc bigint, text string").select("doc", F.split("text", " ").alias("tokens"))
    vocabulary = spark.createDataFrame([(0, "b"), (1, "a"), (2, "c")], "id bigint, token string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0])], "token string, vec array<double>")
    inputs = {"vocabulary": vocabulary, "vectors": vectors, "make_encoder": hash_encoder(4)}
    got = {r["doc"]: (r["ids"], r["weights"]) for r in registry.build("BOW-FREQ", docs, "doc", **inputs).collect()}
    assert got == {1: ([0, 1], [1.0, 2.0]), 2: ([0, 2], [1.0, 1.0])}
    got = {r["doc"]: r["weights"] for r in registry.build("BOW-BIN", docs, "doc", **inputs).collect()}
    assert got == {1: [1.0, 1.0], 2: [1.0, 1.0]}
    assert {r["doc"]: r["vec"] for r in registry.build("BOE-SUM", docs, "doc", **inputs).collect()} == {1: [2.0, 2.0], 2: [0.0, 2.0]}
    users = spark.createDataFrame([(1, [5.0])], "doc bigint, vec array<double>")
    assert registry.build("U2V", docs, "doc", vectors=users).count() == 4
    for name in registry.encoders.FEATURES:
        assert registry.build(name, docs.filter("doc < 3"), "doc", **inputs).count() == 2
    with pytest.raises(NotImplementedError):
        registry.build("TFIDF", docs, "doc", **inputs)


def test_parts_of_a_subject_are_pooled_and_missing_ones_counted(spark):
    parts = spark.createDataFrame(
        [(1, [0, 2], [1.0, 3.0]), (1, [2], [1.0]), (2, None, None)], "subject_id bigint, ids array<int>, weights array<double>"
    )
    rows = spark.createDataFrame([("t", "train", i, "y") for i in (1, 2, 3)], "task string, split string, subject_id bigint, y string")
    (got,) = features.feature_rows(rows, parts).collect()
    assert (got["ids"], got["weights"]) == ([0, 2], [0.5, 2.0])
    (line,) = features.feature_coverage(rows, parts).collect()
    assert (line["n_rows"], line["n_kept"]) == (3, 1)


def test_minimise_steps_every_row_by_itself():
    scale = np.array([[1.0, 10.0], [1000.0, 0.1], [1.0, 1.0]])
    goal = np.array([[3.0, -2.0], [0.5, 7.0], [0.0, 0.0]])
    value = lambda x: ((scale * (x - goal) ** 2).sum(1), 2 * scale * (x - goal))
    x, norm, calls = probe.minimise(value, np.zeros((3, 2)), 1e-8)
    assert np.allclose(x, goal, atol=1e-6) and (norm <= 1e-8).all() and calls < 60


def test_packed_rows_are_the_rows():
    rng = np.random.default_rng(2)
    sizes, y = np.array([3, 0, 2]), np.array([1, -1, 0])
    for ids, w in (([0, 7, 2, 1, 7], [1.0, 255.0, 3.0, 2.0, 1.0]), ([0, 70_000, 2, 1, 7], [0.1, 1e300, -3.0, np.nan, 1.0])):
        rows = probe._Rows(3, 70_001, None, sizes, np.array(ids, np.int32), np.array(w))
        pack = probe._pack(0, y, rows, sizes)
        got, labels = probe._unpacked(pack, 70_001)
        assert labels.tolist() == y.tolist() and got.ids.tolist() == ids and got.row.tolist() == [0, 0, 0, 2, 2]
        assert np.array_equal(got.w, w, equal_nan=True)
    assert len(probe._pack(0, y, probe._Rows(3, 8, None, sizes, np.array([0, 7, 2, 1, 7]), np.ones(5)), sizes)["w"]) == 5
    x = rng.normal(size=(3, 4))
    assert np.array_equal(probe._unpacked(probe._pack(0, y, probe._Rows(3, 4, x), sizes), 4)[0].x, x)


def test_hard_problems_remember_more_steps():
    """Axes of unlike curvature that the scale does not see: a short memory takes more than 500 passes."""
    rng = np.random.default_rng(0)
    q, _ = np.linalg.qr(rng.normal(size=(120, 120)))
    h = (q * np.logspace(0, -5, 120)) @ q.T
    goal = q.sum(1)
    value = lambda x: (0.5 * np.einsum("ij,jk,ik->i", x - goal, h, x - goal), (x - goal) @ h)
    _, norm, calls = probe.minimise(value, np.zeros((1, 120)), 1e-5, 400)
    assert norm.max() <= 1e-5 and calls < 400


def test_every_core_reads_training_rows(spark, monkeypatch):
    """However few partitions the rows come in; packs of three rows."""
    rows, df = made(spark, {"two": 2}, n=90)
    df, parts, summed = df.coalesce(1), [], probe._summed
    monkeypatch.setattr(probe, "_summed", lambda r, n, *rest: parts.append(n) or summed(r, n, *rest))
    monkeypatch.setattr(probe, "PACK_NUMBERS", 12)
    _, fit = probe.fitted(df, {"two": "c1"})
    assert fit.converged("two") and parts[0] == 1 and parts[-1] == 4
    x, y = (np.array(v) for v in zip(*((r[4], r[3] == "c1") for r in rows if r[1] == "train")))
    assert np.abs(objective(x, y, fit.weights[0])[1]).max() < 1e-2
