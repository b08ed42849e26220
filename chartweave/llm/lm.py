"""Scoring texts with a word bigram model, as a weighted backoff automaton.

Every word of the training texts is a state, and the root stands for no history.  An arc of
state ``h`` for a seen pair ``h w`` weighs log10 of

    SHARE * c(h w) / c(h) + (1 - SHARE) * p(w),

any other word takes the failure arc to the root, which weighs log10(1 - SHARE), and then the
root's arc, log10 p(w), with

    p(w) = (c(w) - DISCOUNT) / N,   p(unknown word) = DISCOUNT * V / N.

Both levels sum to one over the V known words and the unknown one.  A text starts in the
state of the end token.  Counts are spread over buckets by key; a batch of documents asks for
those of its own words and pairs, which are the part of the automaton its texts can reach.
At order two the state after a word is the word itself, so no table of states is built and none is
carried: the walk is evaluated as look-ups of each token's and each pair's count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartweave.llm import batches as B
from chartweave.llm import kernels

SHARE = 0.15
DISCOUNT = 0.3
#: Keys of words are odd, keys of pairs even.
ODD = np.uint64(1)
END = kernels.mix(np.array([7], np.uint64)) | ODD
PAIR = np.uint64(0xD6E8FEB86659FD93)

ASKED = {"key": np.uint64, "n": np.uint32}
TOLD = {"n": np.uint32, "known": np.int64}
SCORED = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text, modulo 5, is 1; a null id trains."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each token (each text's words, then an end), of the token before it, and the
    number of tokens of each text."""
    data, offsets = kernels.buffers(batch.column("text"))
    data = kernels.LOWER[data]
    starts, ends, first = kernels.words(data, offsets)
    h = np.insert(kernels.span_hashes(data, starts, ends) | ODD, first[1:], END[0])
    size = np.diff(first) + 1
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[:1] = END
    return h, before, size


def _pairs(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    return kernels.mix(before * PAIR ^ kernels.mix(h + PAIR)) & ~ODD


def _question(table: pa.Table) -> B.Question:
    """All words and pairs of a batch, with their counts in its training texts."""
    every, counted = [], []
    for _, part in B.rows_of(table):
        h, before, size = _tokens(part)
        trains = np.repeat(~np.asarray(part.column("held_out").to_numpy(zero_copy_only=False), bool), size)
        keys = np.concatenate([h, _pairs(before, h)])
        keys, at = np.unique(keys, return_inverse=True)
        every.append(keys)
        counted.append(np.bincount(at, np.tile(trains, 2), len(keys)).astype(np.int64))
    keys, at = np.unique(np.concatenate(every), return_inverse=True)
    n = np.bincount(at, np.concatenate(counted), len(keys)).astype(np.uint32)
    return {"key": keys, "n": n}


def _reply(questions: list[B.Question]) -> list[B.Question]:
    """Training counts of each key over all batches, in the order asked, and the number of
    distinct training words of the bucket."""
    keys, at = np.unique(np.concatenate([q["key"] for q in questions]), return_inverse=True)
    n = np.bincount(at, np.concatenate([q["n"] for q in questions]), len(keys)).astype(np.int64)
    known = np.array([np.count_nonzero((n > 0) & (keys & ODD == ODD))])
    out, from_ = [], 0
    for q in questions:
        own = n[at[from_ : from_ + len(q["key"])]]
        from_ += len(q["key"])
        out.append({"n": np.minimum(own, 2**32 - 1), "known": known})
    return out


def _walk(train_tokens: int):
    total = float(max(train_tokens, 1))

    def walk(table: pa.Table, told: pa.Table) -> pa.Table:
        t = B.gathered(told, TOLD) | {"key": _question(table)["key"]}
        known_types = int(t["known"].sum())
        unknown = np.log10(DISCOUNT * known_types / total) if known_types else 0.0
        parts = []
        for _, part in B.rows_of(table):
            h, before, size = _tokens(part)

            def count(keys):
                at, found = B.look_up(t["key"], keys)
                return np.where(found, t["n"][at] if len(t["key"]) else 0, 0).astype(np.float64)

            c, pair = count(h), count(_pairs(before, h))
            # c(h): the token before is a state if training texts have it.
            state = np.empty_like(c)
            state[1:] = c[:-1]
            first = np.cumsum(size) - size
            state[first] = count(END)[0]
            root = np.where(c > 0, (c - DISCOUNT) / total, 1.0)
            arc = np.where(pair > 0, SHARE * pair / np.maximum(state, 1), 0.0)
            weight = np.log10(np.where(state > 0, arc + (1 - SHARE) * root, root))
            weight += np.where(c > 0, 0.0, unknown)
            base = np.log10(c + 0.5) - np.log10(train_tokens + 0.5 * (known_types + 1))
            parts.append(
                pa.table(
                    {
                        "doc_id": part.column("doc_id"),
                        "held_out": part.column("held_out"),
                        "n_tokens": pa.array(size),
                        "n_known": pa.array(np.add.reduceat(c > 0, first, dtype=np.int64)),
                        "train_tokens": pa.array(np.full(len(size), train_tokens)),
                        "base_score": pa.array(np.add.reduceat(base, first)),
                        "score": pa.array(np.add.reduceat(weight, first)),
                    }
                )
            )
        return pa.concat_tables(parts)

    return walk


def score(docs: DataFrame, batch_bytes: int = B.BATCH_BYTES) -> DataFrame:
    """Scores of every row of ``docs (doc_id, text)``, learned from its rows not held out.

    A null or empty text is one end token.  Rows that repeat an id are scored each.  Without
    training rows every word is unknown and scores 0.  An empty table gives no rows.  Other
    columns are not looked at.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn(
        "held_out", held_out(F.col("doc_id"))
    )
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) + 1
    sums = rows.agg(
        F.sum(F.octet_length("text")).alias("size"), F.sum(F.when(~F.col("held_out"), words)).alias("n")
    ).first()
    n_batches = max(1, -(-(sums["size"] or 0) // batch_bytes))
    batch = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(n_batches)).cast("int")
    dealt = rows.withColumn("batch", batch)
    asked = B.ask(dealt, _question, ASKED, n_batches)
    told = B.answer(asked, ASKED, _reply, TOLD)
    return dealt.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(_walk(sums["n"] or 0), SCORED)
