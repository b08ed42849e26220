import random

import pytest
from pyspark.sql import functions as F

from chartweave.functions import labels as L
from chartweave.functions import text as X


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "raw, multi, binary",
    [
        ("ASIAN - AFRICAN", "ASIAN", "NON-WHITE"),
        ("BLACK/CAPE VERDEAN", "OTHER", "OTHER"),
        ("WHITE", "WHITE", "WHITE"),
        ("NATIVE HAWAIIAN", "OTHER", "NON-WHITE"),
        ("WHITE HISPANIC", "HISPANIC", "NON-WHITE"),
        ("white", "OTHER", "OTHER"),
    ],
)
def test_label_rules_are_ordered(spark, raw, multi, binary):
    assert one(spark, lambda c: L.map_label(c, L.ETHNICITY_MULTI), raw) == multi
    assert one(spark, lambda c: L.map_label(c, L.ETHNICITY_BINARY), raw) == binary


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Seen [**2101-10-20**] at 10:30", "seen DATE at TIME"),
        ("10:30:15", "TIME:NUM"),
        ("a\nb\tc", "a b c"),
        ("Dr [**Doctor Last Name 12**] and [**Doctor Last Name **]", "dr DOCTOR and DOCTOR"),
        ("[**1-2**]", "DATE"),
    ],
)
def test_normalise(spark, raw, want):
    assert one(spark, X.normalise, raw) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("One. Two!  Three?\nFour", "one . [EOS] two ! [EOS] three ? [EOS] four"),
        ("Ends here.  \n", "ends here ."),
        ("v1.2 is 3.4", "vNUM . NUM is NUM . NUM"),
        ("", ""),
    ],
)
def test_clean(spark, raw, want):
    assert one(spark, X.clean, raw) == want


def test_clean_equals_sentence_by_sentence(spark):
    raw = "Été: 3 pm.  Ok?\n\nNext [**2-3**] line!\tx_y, z."
    per_sentence = spark.createDataFrame([(raw,)], "x string").select(
        F.explode(X.sentences(F.col("x"))).alias("s")
    ).select(X.tokenise(X.normalise(F.col("s"))).alias("t"))
    joined = " [EOS] ".join(r["t"] for r in per_sentence.collect())
    assert one(spark, X.clean, raw) == joined


def test_stay_without_underscore_raises(spark):
    assert one(spark, L.subject_of_stay, "12_episode1") == 12
    with pytest.raises(Exception, match="no '_' in stay id"):
        one(spark, L.subject_of_stay, "12")


def test_chunks(spark):
    got = spark.range(1).select(
        X.chunks(F.array(*[F.lit(i) for i in range(5)]), 2).alias("c"),
        X.chunks(F.array().cast("array<int>"), 2).alias("e"),
    ).first()
    assert got["c"] == [[0, 1], [2, 3], [4]]
    assert got["e"] == []


@pytest.mark.parametrize(
    "text, want",
    [
        ("he doesn't take 1.5 mg", "he does n't take 1.5 mg"),
        ("b.i.d. dosing... stop.", "b.i.d. dosing ... stop ."),
        ("patient's won't i'll", "patient 's wo n't i 'll"),
        ("10:30 on 2101-10-20, (ok)", "10:30 on 2101 - 10 - 20 , ( ok )"),
        ("'quoted' rock'n'roll", "' quoted ' rock ' n ' roll"),
        ("", ""),
    ],
)
def test_word_tokens_by_rules(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(F.array_join(X.word_tokens(F.col("t")), " ")).first()[0] == want


def test_abbreviations_are_learned_and_close_no_sentence(spark):
    from chartweave.operators import vocab

    rng = random.Random(1)
    plain = "patient was seen and then sent home after some rest without pain".split()
    texts = []
    for i in range(60):
        words = rng.sample(plain, 6)
        texts.append((i, f"Seen by Dr. Smith today b.i.d. doses {' '.join(words)}. {' '.join(rng.sample(plain, 4))}!"))
    df = spark.createDataFrame(texts, "id int, text string")
    found = vocab.abbreviations(df)
    got = {r["type"]: r for r in found.collect()}
    assert set(got) == {"dr", "b.i.d"} and got["dr"]["n_stop"] == 60 and got["dr"]["n_bare"] == 0
    known = vocab.abbreviation_list(found)
    one = spark.createDataFrame([("Dr. Smith came. He (b.i.d.  dose) left!\nGood",), ("",)], "t string")
    rows = [r[0] for r in one.select(X.learned_sentences(F.col("t"), known)).collect()]
    assert rows == [["Dr. Smith came.", "He (b.i.d. dose) left!", "Good"], []]
    assert vocab.abbreviations(df.limit(0)).count() == 0
