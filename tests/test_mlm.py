import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartweave.operators import mlm, vocab


def plain(sentences, max_len, min_len):
    """Sequential packing of one subject: list of token lists."""
    out, running = [], ["[CLS]"]
    for s in sentences:
        piece = s + ["[SEP]"]
        running = running + piece
        if len(running) >= max_len:
            out.append(running[: max_len - 2] + ["[SEP]"])
            running = ["[CLS]"] + piece
    if len(running) >= min_len:
        out.append(running)
    return out


def frame(spark, subjects):
    rows = [(i, p, s) for i, ss in enumerate(subjects) for p, s in enumerate(ss)]
    return spark.createDataFrame(rows, "subject_id bigint, pos bigint, tokens array<string>")


def test_fixture_case(spark):
    df = frame(spark, [[["a"] * 5, ["b"] * 4]])
    rows = mlm.all_sequences(df, 8).orderBy("start").collect()
    assert [r["n_tokens"] for r in rows] == [7, 6]
    assert rows[0]["tokens"] == ["[CLS]"] + ["a"] * 5 + ["[SEP]"] and not rows[0]["is_tail"]
    assert [r["n_tokens"] for r in mlm.pack_sequences(df, 8, 20).collect()] == [7]


@pytest.mark.parametrize("block_rows", [50_000, 16])
def test_packing_against_a_plain_loop(spark, block_rows):
    rng = random.Random(9)
    subjects = [
        [[f"w{rng.randrange(50)}" for _ in range(rng.choice([1, 2, 3, 5, 30]))] for _ in range(n)]
        for n in (1, 3, 40, 200)
    ]
    got = {}
    for r in mlm.pack_sequences(frame(spark, subjects), 16, 5, block_rows).collect():
        got.setdefault(r["subject_id"], []).append((r["start"], r["tokens"]))
    for i, ss in enumerate(subjects):
        assert [t for _, t in sorted(got.get(i, []))] == plain(ss, 16, 5)


def sequences(spark, tokens):
    return spark.createDataFrame([(1, -1, tokens)], "subject_id bigint, start bigint, tokens array<string>")


@pytest.mark.parametrize("n, p, want", [(12, 0.2, 2), (25, 0.1, 2), (3, 0.1, 1), (200, 0.9, 50)])
def test_number_of_picks(spark, n, p, want):
    got = mlm.mask_positions(sequences(spark, ["word"] * n), p, 50).first()
    assert len(got["picks"]) == want


def test_only_plain_words_are_picked(spark):
    tokens = ["[CLS]", "##ing", "[C01]", "NUM", "TIME", "DATE", "DOCTOR", "a1", ".", "été", "[SEP]"]
    got = mlm.mask_positions(sequences(spark, tokens), 1.0).first()["picks"]
    assert [x["label"] for x in got] == ["NUM", "été"]


def test_mask_actions_and_arrays(spark):
    words = [f"w{i}" for i in range(50)]
    tokens = ["[CLS]"] + [f"{chr(97 + i % 26)}x" for i in range(998)] + ["[SEP]"]
    picked = mlm.mask_positions(sequences(spark, tokens), 0.8, 10_000)
    row = mlm.mask_tokens(picked, words).first()
    at = dict(zip(row["masked_indices"], row["masked_token_labels"]))
    new = row["masked_tokens"]
    assert len(at) == 800 and all(tokens[i] == w for i, w in at.items())
    assert all(new[i] == t for i, t in enumerate(tokens) if i not in at)
    masked = sum(new[i] == "[MASK]" for i in at) / 800
    kept = sum(new[i] == at[i] for i in at) / 800
    assert 0.75 < masked < 0.85 and 0.06 < kept < 0.14


def test_features_pad_and_cut(spark):
    df = spark.createDataFrame(
        [(1, 0, ["[CLS]", "[MASK]", "b", "[SEP]"], [1], ["a"]), (1, 1, ["a"] * 9, [0, 7], ["b", "a"])],
        "subject_id bigint, start bigint, masked_tokens array<string>, masked_indices array<int>, masked_token_labels array<string>",
    )
    units = [*vocab.SPECIALS, "a", "b"]
    short, long = mlm.mlm_features(df, units, 6, 3).orderBy("start").collect()
    assert short["token_ids"] == [3, 1, 6, 4, 0, 0] and short["mask"] == [0, 0, 0, 0, 1, 1]
    assert short["label_ids"] == [5, 0, 0] and short["indices"] == [1, 0, 0]
    assert long["token_ids"] == [5] * 6 and long["mask"] == [0] * 6
    assert long["label_ids"] == [6, 0, 0] and long["indices"] == [0, 0, 0]


def test_equal_pieces_merge_without_overlap(spark):
    types = spark.createDataFrame([("xaaaa", 3), ("yaaaa", 2), ("zaa", 1)], "token string, n bigint")
    pieces = F.array(*[F.lit(p) for p in ("x", "##a", "##a", "##a", "##a", "##a")])
    got = spark.range(1).select(vocab._pairs(pieces).alias("p")).first()["p"]
    assert [tuple(p) for p in got] == [("x", "##a"), ("##a", "##a"), ("##a", "##a")]
    units = vocab.subword_vocab(types, 11, merges_per_round=1)
    assert units[5:] == ["##a", "x", "y", "z", "##aa", "##aaaa"]


def test_frequent_letters_are_kept(spark):
    letters = [(chr(0x61 + i), 1) for i in range(25)] + [("z", 1000)]
    types = spark.createDataFrame(letters, "token string, n bigint")
    units = vocab.subword_vocab(types, 12)
    assert len(units) == 12 and units[5] == "z"


def test_subwords(spark):
    types = spark.createDataFrame(
        [("low", 5), ("lower", 2), ("newest", 6), ("widest", 3)], "token string, n bigint"
    )
    units = vocab.subword_vocab(types, 40, ["[T047]"], merges_per_round=3)
    assert units[:6] == [*vocab.SPECIALS, "[T047]"] and len(units) == len(set(units)) <= 40
    assert "##est" in units and "low" in units
    got = spark.createDataFrame([(["newest", "[SEP]", "lowest", "qqq"],)], "w array<string>").select(
        vocab.subword_encode(F.col("w"), units).alias("p"),
    ).first()
    assert "".join(x.removeprefix("##") for x in got["p"]) == "newest[SEP]lowest[UNK]"


def test_words_are_cut_once_and_joined_back(spark):
    rng = random.Random(6)
    units = [*vocab.SPECIALS, *"abc", "##a", "##b", "##c", "ab", "abc", "##bc", "##cab", "é", "##é"]
    words = ["".join(rng.choices("abcé", k=rng.randint(1, 9))) for _ in range(60)] + ["q", "aq", "[SEP]", "[MASK]", "a" * 101, "a" * 100]
    docs = [(i, rng.choices(words, k=rng.randint(0, 40))) for i in range(30)] + [(99, None), (98, []), (97, words)]
    df = spark.createDataFrame(docs, "id int, w array<string>").repartition(3)
    table = vocab.unit_table(spark, units)
    got = {r["id"]: r for r in vocab.subword_rows(df, "id", F.col("w"), table).collect()}
    assert len(got) == len(docs)
    for i, w in docs:
        want = [p for x in w or [] for p in ([x] if x in vocab.SPECIALS else vocab._longest_units(x, set(units)))]
        assert got[i]["pieces"] == want and got[i]["ids"] == [units.index(p) for p in want]


@pytest.mark.parametrize("shift", [0, 40_000])
def test_documents_travel_to_their_words_as_lists(spark, shift):
    """Also with places and ids beyond short numbers, and with rows that repeat a key."""
    rng = random.Random(7)
    units = [*vocab.SPECIALS, *"abc", "##a", "##b", "##c", "ab", "##bc"]
    words = ["".join(rng.choices("abc", k=rng.randint(1, 6))) for _ in range(40)] + ["q", None]
    docs = [(i, rng.choices(words, k=rng.randint(0, 90))) for i in range(25)] + [(None, ["ab", "c"]), (50, []), (51, None), (52, [None])]
    docs += [(60, ["abc", "b", "q"]), (60, ["a", None, "cab", "c"]), (70, words * 1000)]
    table = vocab.unit_table(spark, units).withColumn("id", F.when(F.col("id") < 5, F.col("id")).otherwise(F.col("id") + shift))
    number = {u: i + shift * (i >= 5) for i, u in enumerate(units)}
    df = spark.createDataFrame(docs, "id int, w array<string>").repartition(3)
    out = vocab.subword_rows(df, "id", F.col("w"), table)
    assert "struct(at," not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["id"]: r for r in out.collect()}
    cut = lambda w: [w] if w in vocab.SPECIALS else vocab._longest_units(w, set(units))
    want = {}
    for i, w in docs:
        want.setdefault(i, []).extend((at, [number[p] for p in cut(x)]) for at, x in enumerate(w or []) if x is not None)
    named = {i: u for u, i in number.items()}
    assert set(got) == set(want)
    for i, placed in want.items():
        ids = [x for _, part in sorted(placed) for x in part]
        assert got[i]["ids"] == ids and got[i]["pieces"] == [named[x] for x in ids]


def test_numbers_travel_as_short_ones():
    lengths = np.array([2, 0, 3, 1])
    values = np.array([0, 32767, 5, 32768, 9_000_000, 1])
    low, more = vocab._narrow(lengths, values)
    assert low.type.value_type == "int16" and more.value_lengths().to_pylist() == [0, 0, 3, 0]
    got = vocab._wide(low, more)
    assert got[0].tolist() == lengths.tolist() and got[1].tolist() == values.tolist()


def test_features_hold_ids_and_no_python(spark):
    masked = spark.createDataFrame(
        [(1, -1, ["[CLS]", "x", "y", "z"], [1, 3], ["x", "q"])],
        "subject_id bigint, start bigint, masked_tokens array<string>, masked_indices array<int>, masked_token_labels array<string>",
    )
    out = mlm.mlm_features(masked, [*vocab.SPECIALS, "x", "y"], 3, 2)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    r = out.first()
    assert (r["token_ids"], r["label_ids"], r["mask"], r["indices"]) == ([3, 5, 6], [5, 0], [0, 0, 0], [1, 0])


def test_whole_words_are_masked_together(spark):
    tokens = "[CLS] pl ##ay ##ing DATE run ##1 cat se ##e x9 dog [SEP]".split()
    words = {1: [1, 2, 3], 7: [7], 8: [8, 9], 11: [11]}
    full = mlm.mask_positions(sequences(spark, tokens), 0.9, 50, whole_word=True).first()["picks"]
    assert [p["index"] for p in full] == [1, 2, 3, 7, 8, 9, 11] and full[1]["label"] == "##ay"
    for seed in range(12):
        got = [p["index"] for p in mlm.mask_positions(sequences(spark, tokens), 0.2, 50, seed, True).first()["picks"]]
        taken = [h for h in words if h in got]
        assert sorted(i for h in taken for i in words[h]) == got and 2 <= len(got) <= 3
    few = mlm.mask_positions(sequences(spark, ["pl", "##ay", "##ing"]), 0.1, 50, whole_word=True).first()
    assert few["picks"] == []


def plain_units(types, size):
    """One merge at a time: the commonest pair, ties by name."""
    table = [(n, [c if i == 0 else "##" + c for i, c in enumerate(t)]) for t, n in types]
    letters = {}
    for n, p in table:
        for x in p:
            letters[x] = letters.get(x, 0) + n
    units = [*vocab.SPECIALS]
    units += sorted(letters, key=lambda x: (-letters[x], x))[: max(0, size - len(units))]
    while len(units) < size:
        counts = {}
        for n, p in table:
            i = 0
            while i + 1 < len(p):
                if not (i and p[i - 1] == p[i] == p[i + 1] and used):
                    counts[p[i], p[i + 1]] = counts.get((p[i], p[i + 1]), 0) + n
                    used = p[i] == p[i + 1]
                else:
                    used = False
                i += 1
        if not counts:
            break
        a, b = min(counts, key=lambda k: (-counts[k], *k))
        unit = a + b.removeprefix("##")
        if unit not in units:
            units.append(unit)
        for _, p in table:
            i = 0
            while i + 1 < len(p):
                if (p[i], p[i + 1]) == (a, b):
                    p[i : i + 2] = [unit]
                i += 1
    return units


@pytest.mark.parametrize("window", [1, 50])
def test_exact_units_equal_one_merge_at_a_time(spark, window):
    rng = random.Random(2)
    types = [("".join(rng.choices("abcd", [5, 4, 2, 1], k=rng.randint(1, 8))), rng.choice([1, 2, 5, 5, 9])) for _ in range(60)]
    types = list(dict(types).items()) + [("aaaaaa", 4), ("ababab", 4)]
    df = spark.createDataFrame(types, "token string, n bigint")
    assert vocab.subword_vocab(df, 60, merges_per_round=window, exact=True) == plain_units(types, 60)


def test_exact_units_of_documents(spark):
    from checks import QUERIES

    types = QUERIES["word_types"](spark, "/root/testdata/sf0.001").cache()
    rows = [(r["token"], r["n"]) for r in types.collect()]
    size = len({c for t, _ in rows for c in t}) * 2 + 60
    assert vocab.subword_vocab(types, size, exact=True) == plain_units(rows, size)


def test_words_are_drawn_once_for_each_sequence(spark):
    """Neither a filter on the picks nor the places of words makes the list of tokens again."""
    made = sequences(spark, "[CLS] pl ##ay cat [SEP]".split()).withColumn("tokens", F.concat("tokens", F.array(F.lit("marked"))))
    out = mlm.mask_positions(made, whole_word=True).filter(F.size("picks") > 0).select("picks.index", "picks.label")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("marked") == 1 and plan.count("##") <= 3


def test_pieces_are_remembered_for_a_bounded_number_of_words():
    import pyarrow as pa

    memo = {}
    encode = vocab._piece_encoder([*vocab.SPECIALS, "a", "##1"], memo)
    words = [[f"w{i}" for i in range(at, at + 400)] for at in range(0, vocab.MEMO_WORDS + 800, 400)]
    got = encode(pa.array([["a1", "[SEP]"], [], *words])).to_pylist()
    assert got[:2] == [["a", "##1", "[SEP]"], []] and got[2] == ["[UNK]"] * 400
    assert len(got) == len(words) + 2 and len(memo) <= vocab.MEMO_WORDS


def test_notes_are_walked_a_bounded_number_of_tokens_at_a_time():
    import pyarrow as pa

    from chartweave.operators import entities

    n = entities.WALK_TOKENS // 4
    batch = pa.RecordBatch.from_pydict({"tokens": pa.array([["x"] * n] * 9 + [None, []] + [["x"] * (6 * n)] + [["y"]])})
    parts = list(entities._bounded([batch]))
    sizes = [sum(len(t or []) for t in p.column("tokens").to_pylist()) for p in parts]
    assert sum(p.num_rows for p in parts) == batch.num_rows and sizes == [4 * n, 4 * n, n, 6 * n, 1]


def test_words_are_cut_where_they_stand(spark):
    """Distinct keys: nothing is shuffled; an empty word, and letters that look like a mark, too."""
    units = [*vocab.SPECIALS, *"ab#", "##a", "##b", "###", "##ab", "[SEP]x"]
    df = spark.createDataFrame([(1, ["ab", "", "##a", "[SEP]", "[SEP]x", "bab", "c"]), (2, [None, "a"])], "id int, w array<string>")
    out = vocab.subword_rows(df, "id", F.col("w"), vocab.unit_table(spark, units))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["id"]: (r["pieces"], r["ids"]) for r in out.collect()}
    unk = "[UNK]"
    assert got[1][0] == ["a", "##b", unk, "##a", "[SEP]", "[SEP]x", "b", "##ab", unk] and got[2][0] == ["a"]
    assert all(ids == [units.index(p) for p in pieces] for pieces, ids in got.values())
