"""Masked-language-model instances: packed sequences, masks and id arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartweave.functions.hashing import hash_int, keyed_hash
from chartweave.operators.distribution import ranked
from chartweave.operators.vocab import unit_table

# Default shape of an instance.
MAX_SEQ_LEN = 512
MIN_SEQ_LEN = 20
MAX_PREDS = 50
MASK_PROB = 0.2
# Tokens that are never masked.
NEVER_MASKED = ("[CLS]", "[SEP]", "TIME", "DATE", "DOCTOR")
# The first eight hex digits of 80 % and of one half.
EIGHTY = "cccccccd"
HALF = "80000000"
# Sentences of a subject that are walked in one piece.
BLOCK = 50_000


def training_text(raw: DataFrame, annotated: DataFrame | None = None) -> DataFrame:
    """Text for vocabulary building: the raw notes, and the annotated ones if given."""
    if annotated is None:
        return raw
    return raw.unionByName(annotated)


def number_sentences(sentences: DataFrame, order: list[Column], **kw) -> DataFrame:
    """Adds ``pos``, the 0-based place of a sentence in its subject."""
    placed = ranked(sentences, ["subject_id"], order, name="pos", **kw)
    return placed.withColumn("pos", F.col("pos") - 1)


def _exits(max_len: int):
    """For every possible running length before a block: the length after it and the
    last cut inside it.  Lengths above ``max_len`` all cut at the next sentence."""

    def exits(lens: pd.Series) -> pd.DataFrame:
        rows = []
        for block in lens:
            state = np.arange(1, max_len + 1)
            last = np.full(max_len, -1)
            for i, n in enumerate(np.asarray(block).tolist()):
                state += n
                hit = state >= max_len
                state[hit] = min(1 + n, max_len)
                last[hit] = i
            rows.append((state, last))
        return pd.DataFrame(rows, columns=["state", "last"])

    return F.pandas_udf(exits, "state array<int>, last array<int>")


def _entries(block_rows: int):
    """Running length and last cut before each block of a subject, in block order."""

    def entries(blocks: pd.Series) -> pd.Series:
        out = []
        for subject in blocks:
            state, start, rows = 1, -1, []
            for m in subject:
                rows.append({"block": m["block"], "state": state, "start": start})
                hit = int(m["e"]["last"][state - 1])
                start = m["block"] * block_rows + hit if hit >= 0 else start
                state = int(m["e"]["state"][state - 1])
            out.append(rows)
        return pd.Series(out)

    return F.pandas_udf(entries, "array<struct<block:bigint,state:int,start:bigint>>")


def _walk(max_len: int):
    """Start of the running sequence and cut flag per sentence of a block."""

    def walk(lens: pd.Series, first: pd.Series, state: pd.Series, start: pd.Series) -> pd.Series:
        out = []
        for block, at, length, begin in zip(lens, first, state, start):
            rows = []
            for i, n in enumerate(np.asarray(block).tolist(), int(at)):
                length += n
                cut = length >= max_len
                rows.append({"pos": i, "start": begin, "cut": bool(cut)})
                if cut:
                    length, begin = 1 + n, i
            out.append(rows)
        return pd.Series(out)

    return F.pandas_udf(walk, "array<struct<pos:bigint,start:bigint,cut:boolean>>")


def sequence_members(lengths: DataFrame, max_len: int, block_rows: int = BLOCK) -> DataFrame:
    """``(subject_id, start, pos, closes)`` from ``(subject_id, pos, len)``.

    A sequence is named by the sentence it carries over (-1 for the first).  The
    running length is sequential, so a long subject is walked in blocks: first every
    block maps each possible entry length to its exit, then the short chain of
    blocks fixes the real entries, then all blocks are walked at once.
    """
    if block_rows < max_len:
        raise ValueError("a block must be able to hold a whole sequence")
    blocks = (
        lengths.groupBy("subject_id", F.floor(F.col("pos") / block_rows).cast("bigint").alias("block"))
        .agg(F.sort_array(F.collect_list(F.struct("pos", "len"))).alias("s"))
        .select("subject_id", "block", F.col("s.len").alias("lens"))
    )
    long_ones = lengths.filter(F.col("pos") >= block_rows).select("subject_id").distinct()
    entries = (
        blocks.join(long_ones, "subject_id", "left_semi")
        .select("subject_id", "block", _exits(max_len)("lens").alias("e"))
        .groupBy("subject_id")
        .agg(F.sort_array(F.collect_list(F.struct("block", "e"))).alias("chain"))
        .select("subject_id", F.explode(_entries(block_rows)("chain")).alias("x"))
        .select("subject_id", "x.*")
    )
    walked = blocks.join(entries, ["subject_id", "block"], "left").select(
        "subject_id",
        F.explode(
            _walk(max_len)(
                "lens",
                F.col("block") * block_rows,
                F.coalesce("state", F.lit(1)),
                F.coalesce("start", F.lit(-1)).cast("bigint"),
            )
        ).alias("w"),
    )
    pos, start, cut = F.col("w.pos"), F.col("w.start"), F.col("w.cut")
    ends = F.struct(start.alias("start"), cut.alias("closes"))
    carried = F.struct(pos.alias("start"), F.lit(False).alias("closes"))
    return walked.select(
        "subject_id", pos.alias("pos"), F.explode(F.when(cut, F.array(ends, carried)).otherwise(F.array(ends))).alias("m")
    ).select("subject_id", "m.start", "pos", "m.closes")


def all_sequences(
    sentences: DataFrame, max_len: int = MAX_SEQ_LEN, block_rows: int = BLOCK
) -> DataFrame:
    """``(subject_id, start, last, is_tail, n_tokens, tokens)`` from
    ``(subject_id, pos, tokens)``, short tails included.

    Lengths alone decide the cuts; the tokens join in afterwards on
    ``(subject_id, pos)``, which spreads evenly.
    """
    lengths = sentences.select(
        "subject_id", "pos", (F.size("tokens") + 1).cast("int").alias("len")
    )
    members = sequence_members(lengths, max_len, block_rows)
    gathered = (
        members.join(sentences.select("subject_id", "pos", "tokens"), ["subject_id", "pos"])
        .groupBy("subject_id", "start")
        .agg(
            F.max("pos").alias("last"),
            (~F.max("closes")).alias("is_tail"),
            F.sort_array(F.collect_list(F.struct("pos", "tokens"))).alias("s"),
        )
    )
    sep = F.array(F.lit("[SEP]"))
    body = F.flatten(F.transform("s.tokens", lambda t: F.concat(t, sep)))
    whole = F.concat(F.array(F.lit("[CLS]")), body)
    tokens = F.when(F.col("is_tail"), whole).otherwise(
        F.concat(F.slice(whole, 1, max_len - 2), sep)
    )
    return gathered.select("subject_id", "start", "last", "is_tail", tokens.alias("tokens")).select(
        "subject_id", "start", "last", "is_tail", F.size("tokens").alias("n_tokens"), "tokens"
    )


def pack_sequences(
    sentences: DataFrame,
    max_len: int = MAX_SEQ_LEN,
    min_len: int = MIN_SEQ_LEN,
    block_rows: int = BLOCK,
) -> DataFrame:
    """Sequences without the tails shorter than ``min_len``."""
    out = all_sequences(sentences, max_len, block_rows)
    return out.filter(~F.col("is_tail") | (F.col("n_tokens") >= min_len))


def tail_audit(sequences: DataFrame, min_len: int = MIN_SEQ_LEN) -> DataFrame:
    """Counts of closed sequences, kept tails and skipped tails."""
    tail, short = F.col("is_tail"), F.col("n_tokens") < min_len
    return sequences.agg(
        F.count_if(~tail).alias("n_closed"),
        F.count_if(tail & ~short).alias("n_tails_kept"),
        F.count_if(tail & short).alias("n_tails_skipped"),
        F.coalesce(F.sum(F.when(tail & short, F.col("n_tokens"))), F.lit(0))
        .cast("bigint")
        .alias("tokens_skipped"),
    )


def _maskable(token: Column) -> Column:
    """Letters only, which also leaves out continuation pieces."""
    return ~token.isin(*NEVER_MASKED) & token.rlike(r"^\p{L}+$")


def mask_positions(
    sequences: DataFrame,
    prob: float = MASK_PROB,
    max_preds: int = MAX_PREDS,
    seed: int = 1,
    whole_word: bool = False,
) -> DataFrame:
    """Adds ``picks``: the masked places of each sequence with their labels, sorted by
    place.  Works inside the row: no shuffle, and no row per token.

    With ``whole_word`` the pieces of a word are masked together: words are drawn one by one, and
    one that has more pieces than the budget has left is passed over.
    """
    n = F.bround(F.size("tokens") * F.lit(prob)).cast("int")
    count = F.least(F.lit(max_preds), F.greatest(F.lit(1), n))
    if whole_word:
        # An array of one, exploded: the optimizer neither repeats the draw in a later filter nor makes
        # the tokens anew inside it.
        kept = [F.col(c) for c in sequences.columns if c != "picks"]
        return sequences.select(*kept, F.explode(F.array(_word_picks(count, seed))).alias("picks"))
    places = F.transform(
        "tokens",
        lambda t, i: F.when(
            _maskable(t),
            F.struct(
                keyed_hash(seed, F.col("subject_id"), F.col("start"), i).alias("h"),
                i.alias("index"),
                t.alias("label"),
            ),
        ),
    )
    first = F.slice(F.array_sort(F.array_compact(places)), F.lit(1), count)
    by_place = F.array_sort(
        F.transform(
            first, lambda x: F.struct(x["index"].alias("index"), x["label"].alias("label"))
        )
    )
    return sequences.withColumn("picks", by_place)


def _word_picks(budget: Column, seed: int) -> Column:
    """Masked places of whole words.  A word is a piece and the ``##`` pieces after it, all of letters;
    drawn words are taken in order while the sum of their pieces stays within the budget."""
    first = F.array_compact(F.transform("tokens", lambda t, i: F.when(~t.startswith("##"), i)))
    # A word ends where the next begins; side by side, so no list is made again for each word.
    ends = F.concat(F.slice(first, F.lit(2), F.size("tokens")), F.array(F.size("tokens")))
    words = F.zip_with(first, ends, lambda head, end: F.struct(head.alias("at"), (end - head).alias("size")))

    def candidate(w):
        rest = F.slice("tokens", w["at"] + 2, F.greatest(w["size"] - 1, F.lit(0)))
        return _maskable(F.get("tokens", w["at"])) & F.forall(rest, lambda t: t.rlike(r"^##\p{L}+$"))

    def hashed(w):
        return F.struct(keyed_hash(seed, F.col("subject_id"), F.col("start"), w["at"]).alias("h"), w["at"].alias("at"), w["size"].alias("size"))

    drawn = F.array_sort(F.transform(F.filter(words, candidate), hashed))
    none = F.struct(F.lit(0).alias("sum"), F.array().cast("array<struct<at:int,size:int>>").alias("words"))

    def take(acc, w):
        more = F.struct(
            (acc["sum"] + w["size"]).alias("sum"),
            F.concat(acc["words"], F.array(F.struct(w["at"].alias("at"), w["size"].alias("size")))).alias("words"),
        )
        return F.when(acc["sum"] + w["size"] <= budget, more).otherwise(acc)

    words = F.aggregate(drawn, none, take, lambda acc: acc["words"])
    places = F.flatten(F.transform(words, lambda w: F.sequence(w["at"], w["at"] + w["size"] - 1)))
    return F.array_sort(F.transform(places, lambda i: F.struct(i.alias("index"), F.get("tokens", i).alias("label"))))


def mask_tokens(picked: DataFrame, words: list[str], seed: int = 1) -> DataFrame:
    """Adds ``masked_tokens, masked_indices, masked_token_labels``: of the picked
    places 80 % become ``[MASK]``, 10 % stay, 10 % become a random word.

    ``words`` is the bounded vocabulary; it enters the plan as one constant array.
    """
    vocabulary = F.split(F.lit("\u0001".join(words)), "\u0001")

    def replacement(x):
        h = keyed_hash(f"{seed}-action", F.col("subject_id"), F.col("start"), x["index"])
        draw = F.substring(h, 1, 8)
        again = F.substring(h, 9, 8)
        word = F.element_at(
            vocabulary, (F.pmod(hash_int(h, 17), F.lit(len(words))) + 1).cast("int")
        )
        return F.when(draw < EIGHTY, "[MASK]").when(again < HALF, x["label"]).otherwise(word)

    changes = F.map_from_entries(
        F.transform("picks", lambda x: F.struct(x["index"], replacement(x)))
    )
    return (
        picked.withColumn("_c", changes)
        .withColumn(
            "masked_tokens",
            F.transform("tokens", lambda t, i: F.coalesce(F.try_element_at("_c", i), t)),
        )
        .withColumn("masked_indices", F.col("picks.index"))
        .withColumn("masked_token_labels", F.col("picks.label"))
        .drop("_c", "picks")
    )


def mlm_features(
    masked: DataFrame,
    units: list[str],
    max_len: int = MAX_SEQ_LEN,
    max_preds: int = MAX_PREDS,
) -> DataFrame:
    """Fixed-width arrays per sequence: ``token_ids, label_ids, mask, indices``.

    Tokens beyond ``max_len`` and the picks among them are cut; the mask is 1 on
    padding.
    """

    def padded(items: Column, width: int) -> Column:
        short = F.greatest(F.lit(0), F.lit(width) - F.size(items))
        return F.concat(items, F.array_repeat(F.lit(0), short))

    kept = F.filter("masked_indices", lambda i: i < max_len)
    # Tokens, labels and places of a sequence as one list; ids join in by token.
    cells = F.concat(
        F.transform(F.slice("masked_tokens", 1, max_len), lambda t, i: _cell(0, i, t, 0)),
        F.transform(F.slice("masked_token_labels", F.lit(1), F.size(kept)), lambda t, i: _cell(1, i, t, 0)),
        F.transform(kept, lambda x, i: _cell(2, i, F.lit(None).cast("string"), x)),
    )
    known = F.broadcast(unit_table(masked.sparkSession, units).withColumnRenamed("unit", "token"))
    unknown = units.index("[UNK]") if "[UNK]" in units else 0
    coded = masked.select("subject_id", "start", F.inline(cells)).join(known, "token", "left")
    value = F.when(F.col("kind") == 2, F.col("value")).otherwise(F.coalesce("id", F.lit(unknown))).alias("v")
    rows = coded.select("subject_id", "start", "kind", "at", value).groupBy("subject_id", "start").agg(
        F.sort_array(F.collect_list(F.struct("kind", "at", "v"))).alias("c")
    )
    of = lambda kind: F.transform(F.filter("c", lambda x: x["kind"] == kind), lambda x: x["v"])
    split = rows.select("subject_id", "start", of(0).alias("_t"), of(1).alias("_l"), of(2).alias("_i"))
    used = F.size("_t")
    return split.select(
        "subject_id",
        "start",
        padded(F.col("_t"), max_len).alias("token_ids"),
        padded(F.col("_l"), max_preds).alias("label_ids"),
        F.concat(
            F.array_repeat(F.lit(0), used), F.array_repeat(F.lit(1), F.lit(max_len) - used)
        ).alias("mask"),
        padded(F.col("_i"), max_preds).alias("indices"),
    )


def _cell(kind: int, at: Column, token: Column, value) -> Column:
    number = (F.lit(value) if isinstance(value, int) else value).cast("int")
    return F.struct(F.lit(kind).alias("kind"), at.alias("at"), token.alias("token"), number.alias("value"))
