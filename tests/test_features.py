import numpy as np
import pytest

from chartweave.operators import features

DIMS = 768


def made(spark, dims):
    rng = np.random.default_rng(2)
    vec = {f"t{i}": rng.normal(size=dims) for i in range(40)}
    terms = [(int(d), f"t{rng.integers(50)}x"[:-1], int(rng.integers(1, 9))) for d in range(90) for _ in range(int(rng.integers(0, 30)))]
    counts = {}
    for d, t, n in terms:
        counts[d, t] = n
    # A token in every document, one that only few have a vector for, and a document of one term.
    counts |= {(d, "t0"): 5 for d in range(90)} | {(500, "t1"): 3, (501, "unknown"): 2}
    rows = spark.createDataFrame([(d, t, n) for (d, t), n in counts.items()], "doc bigint, token string, n bigint")
    vectors = spark.createDataFrame([(t, v.tolist()) for t, v in vec.items()], "token string, vec array<double>")
    return counts, vec, rows.repartition(5), vectors


@pytest.mark.parametrize("dims, blocks, block_bytes", [(3, None, 64 << 20), (3, 1, 64 << 20), (3, 7, 64 << 20), (3, 1, 100), (DIMS, 3, 64 << 20)])
def test_sums_of_vectors(spark, dims, blocks, block_bytes):
    counts, vec, terms, vectors = made(spark, dims)
    for job, weight, mean in (
        (features.boe_sum, lambda n: n, False), (features.boe_bin, lambda n: 1, False), (features.user_embedding_mean, lambda n: n, True),
    ):
        want = {}
        for (d, t), n in counts.items():
            if t in vec:
                total, s = want.get(d, (0, 0.0))
                want[d] = (total + n, s + weight(n) * vec[t])
        got = {r["doc"]: r for r in job(terms, vectors, "doc", blocks=blocks, block_bytes=block_bytes).collect()}
        assert set(got) == set(want)
        for d, (total, s) in want.items():
            assert got[d]["n_tokens"] == total
            assert np.allclose(got[d]["vec"], s / total if mean else s)


def test_no_documents_or_no_vectors(spark):
    _, _, terms, vectors = made(spark, 3)
    assert features.boe_sum(terms.limit(0), vectors, "doc").count() == 0
    assert features.boe_sum(terms, vectors.limit(0), "doc", 3).count() == 0


def test_terms_travel_without_vectors(spark):
    """Vectors meet terms in the tasks: no row of the exchanges pairs a term with a vector."""
    _, _, terms, vectors = made(spark, 3)
    plan = features.boe_sum(terms, vectors, "doc", blocks=2)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" in plan


def test_bags_of_a_small_vocabulary_are_counted_in_place(spark):
    from pyspark.sql import functions as F

    docs = [(1, ["a", "b", "a", "z"]), (1, ["a", None, "c"]), (2, ["z"]), (3, []), (4, None), (5, ["c", "b", "b"])]
    df = spark.createDataFrame(docs, "doc bigint, w array<string>").repartition(3)
    table = spark.createDataFrame([(0, "b"), (1, "a"), (7, "c")], "id bigint, token string")
    for binary, want in ((False, {1: ([0, 1, 7], [1, 3, 1]), 5: ([0, 7], [2, 1])}), (True, {1: ([0, 1, 7], [1, 1, 1]), 5: ([0, 7], [1, 1])})):
        out = features.sparse_bags(df, "doc", F.col("w"), table, binary)
        assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
        assert {r["doc"]: (r["ids"], r["weights"]) for r in out.collect()} == want


def test_sparse_parts_are_pooled_without_a_row_per_cell_of_single_ones(spark):
    rows = [(1, [0, 4], [2.0, 1.0]), (1, [4], [3.0]), (2, [5], [1.0]), (3, None, None)]
    parts = spark.createDataFrame(rows, "doc bigint, ids array<int>, weights array<double>")
    out = features.pool_sparse(parts, "doc")
    got = {r["doc"]: (r["ids"], r["weights"]) for r in out.collect()}
    assert got == {1: ([0, 4], [1.0, 2.0]), 2: ([5], [1.0])}
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_the_check_encoder_remembers_a_bounded_number_of_tokens():
    from chartweave.operators import encoders

    encoder = encoders.hash_encoder()()
    encoder([" ".join(f"t{i}" for i in range(encoders.MEMO_TOKENS + 10))])
    memo = next(c.cell_contents for f in encoder.__closure__ for c in f.cell_contents.__closure__ if isinstance(c.cell_contents, dict))
    assert len(memo) <= encoders.MEMO_TOKENS
    texts = ["x" * 600_000, "y" * 600_000, "a", "b", "c"]
    assert [(p.start, p.stop) for p in encoders._calls(texts, 2)] == [(0, 1), (1, 3), (3, 5)]


def test_tokens_that_share_vectors_travel_as_rows(spark):
    """Lists of terms, a matrix beside the tokens, repeated keys: the same sums, and no join."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    docs = [(int(d), [f"t{i}" for i in rng.integers(60, size=int(rng.integers(0, 50)))] + [None, "gone"]) for d in [*range(40), 3, 3, 7]]
    docs += [(90, []), (91, None), (92, [f"t{i % 60}" for i in range(3000)])]
    matrix = rng.normal(size=(9, 5))
    df = spark.createDataFrame(docs, "doc bigint, w array<string>").repartition(4)
    places = spark.createDataFrame([(f"t{i}", i % 10) for i in range(60)], "token string, row bigint")
    table = spark.createDataFrame([*enumerate(matrix.tolist()), (9, None), (None, [0.0] * 5)], "row bigint, vec array<double>")
    bags = {}
    for d, w in docs:
        for t in w or []:
            if t and t != "gone" and int(t[1:]) % 10 < 9:
                bags.setdefault(d, []).append(t)
    sums = {d: sum(matrix[int(t[1:]) % 10] for t in w) for d, w in bags.items()}
    once = {d: sum(matrix[int(t[1:]) % 10] for t in set(w)) for d, w in bags.items()}
    for job, whole, want in (
        (features.boe_sum, False, sums), (features.boe_bin, True, once),
        (features.user_embedding_mean, False, {d: v / len(bags[d]) for d, v in sums.items()}),
    ):
        lists = features.bow_lists(df, "doc", F.col("w"), whole)
        for blocks in (1, 3):
            out = job(lists, places, "doc", matrix=table, blocks=blocks)
            assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
            got = {r["doc"]: r for r in out.collect()}
            assert set(got) == set(want)
            for d, v in want.items():
                assert got[d]["n_tokens"] == len(bags[d]) and np.allclose(got[d]["vec"], v)


def test_whole_lists_count_a_token_of_repeated_keys_once(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, ["a", "b", "a"]), (1, ["a", None, "c"]), (2, ["z"]), (3, []), (4, None)], "doc bigint, w array<string>").repartition(3)
    got = [(r["doc"], sorted(zip(r["tokens"], r["ns"]))) for r in features.bow_lists(df, "doc", F.col("w")).collect()]
    assert sorted(got) == [(1, [("a", 3), ("b", 1), ("c", 1)]), (2, [("z", 1)])]
