"""Packing token pieces into fixed-length sequences by bin completion.

Which lengths go together depends only on how many pieces there are of each length, and
there are at most ``capacity`` lengths.  So the plan is made from that histogram: around the
largest length left, undominated fillings are enumerated by branch and bound, the best one is
used as often as the counts allow (which nearly uses up a length each time, so patterns are
about as few as lengths), and pieces then find their place by their rank within their length.
"""

from __future__ import annotations

import base64
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartweave.llm import kernels
from chartweave.session import cut_lineage

CAPACITY = 1024
END_ID = 2
#: Branches looked at for one filling, and rows of a length that one task numbers.
BRANCHES = 4000
LANES = 128

_PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"


def encoder(vocabulary: str):
    """Byte-level BPE over a file of ranks.  The added tokens of the tokenizer file of the same
    name, if there is one, are cut out first wherever they stand, as tokenizers does."""
    # Kept on the library: functions shipped by value bring new globals to every task.
    known = vars(tiktoken).setdefault("_by_path", {})
    if vocabulary not in known:
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        added = {}
        if os.path.exists(whole := os.path.splitext(vocabulary)[0] + ".json"):
            with open(whole, encoding="utf-8") as f:
                tokens = json.load(f)["added_tokens"]
            # Tokens that take white space along or stand between words only would need more.
            if any(t[k] for t in tokens for k in ("single_word", "lstrip", "rstrip", "normalized")):
                raise ValueError(f"added tokens of {whole} are not plain strings")
            added = {t["content"]: t["id"] for t in tokens}
        known[vocabulary] = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added
        )
    return known[vocabulary]


def default_vocabulary() -> str:
    """The ranks of the same vocabulary as ``byte_bpe_50k.json``; the ids are equal."""
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of each piece of ``n`` ids: the first takes what is left over."""
    first = n % capacity or capacity
    return [(0, min(first, n))] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, ids: bool = False) -> DataFrame:
    """Pieces of every row of ``docs``: its ids, then ``END_ID``, cut to ``capacity``.

    A null text counts as empty and gives one piece of one id.  ``row`` tells rows apart that
    repeat an id.  With ``ids`` the piece's ids come along.
    """
    path = vocabulary or default_vocabulary()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            for batch in kernels.slices(whole, "text", 4_000_000):
                out: list[list] = [[] for _ in range(7)]
                for doc, row, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "text"))):
                    own = np.array([*enc.encode(text or "", allowed_special="all"), END_ID], dtype="<u4")
                    raw = own.tobytes()
                    for k, (s, n) in enumerate(cut(len(own), capacity)):
                        part = raw[4 * s : 4 * (s + n)]
                        for column, v in zip(out, (doc, row, k, s, n, zlib.crc32(part), own[s : s + n])):
                            column.append(v)
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                names = ["doc_id", "row", "piece", "start", "length", "ids_crc32", "ids"]
                n = 7 if ids else 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(out[:n], kinds[:n])], names=names[:n]
                )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text"
    )
    return rows.mapInArrow(encode, _PIECES + (", ids array<int>" if ids else ""))


def completions(counts: np.ndarray, room: int, branches: int = BRANCHES) -> list[int]:
    """Lengths that fill ``room`` best, longest first, taken from ``counts`` (by length).

    Depth-first from the longest length that fits, each level going on downwards, so a filling is
    met once.  A branch is cut when all that is left of its lengths cannot waste less than the
    incumbent.  A filling in which a longer length would fit in place of one of its own wastes more
    than the one with it, so it never stays.  After ``branches`` steps the incumbent is returned;
    below that it is the best there is.
    """
    have = np.flatnonzero(counts)
    best: list[int] = []
    least = room + 1
    left = counts.copy()
    seen = 0

    def dive(room: int, top: int, own: list[int]) -> None:
        nonlocal best, least, seen
        if room < least:
            best, least = own.copy(), room
        if not room or least == 0 or seen > branches:
            return
        i = int(np.searchsorted(have, min(room, top), "right")) - 1
        # What the lengths up to each one hold in all.
        within = np.cumsum(have[: i + 1] * left[have[: i + 1]])
        while i >= 0 and least and seen <= branches:
            x = int(have[i])
            if room - int(within[i]) >= least:
                break
            if left[x]:
                seen += 1
                left[x] -= 1
                own.append(x)
                dive(room - x, x, own)
                own.pop()
                left[x] += 1
            i -= 1

    dive(room, room, [])
    return best


def completed(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths, how often) by bin completion around the largest length left."""
    left = counts.astype(np.int64).copy()
    out = []
    while left.any():
        top = int(np.flatnonzero(left)[-1])
        left[top] -= 1
        pattern = [top, *completions(left, capacity - top)]
        left[top] += 1
        need = np.bincount(pattern, minlength=len(left))
        used = np.flatnonzero(need)
        times = int((left[used] // need[used]).min())
        left -= need * times
        out.append((pattern, times))
    return out


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Patterns of best-fit decreasing: each filling takes the longest length that fits."""
    left = counts.astype(np.int64).copy()
    out = []
    while left.any():
        room, pattern = capacity, []
        own = left.copy()
        while True:
            at = np.flatnonzero(own[: room + 1])
            if not len(at):
                break
            x = int(at[-1])
            k = int(min(own[x], room // x))
            pattern += [x] * k
            own[x] -= k
            room -= x * k
        need = np.bincount(pattern, minlength=len(left))
        used = np.flatnonzero(need)
        times = int((left[used] // need[used]).min())
        left -= need * times
        out.append((pattern, times))
    return out


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """The better of both; ``counts[n]`` pieces have length ``n`` (1 to ``capacity``)."""
    both = [completed(counts, capacity), best_fit(counts, capacity)]
    return min(both, key=lambda p: sum(t for _, t in p))


def places(patterns: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """For each pattern and length: the ranks it takes and where they go.

    Ranks ``rank .. rank + each * times - 1`` of ``length`` go to sequences from ``first`` on,
    ``each`` to a sequence, one after another from ``offset``.
    """
    rows, taken, first = [], {}, 0
    for pattern, times in patterns:
        offset = 0
        for length in sorted(set(pattern), reverse=True):
            each = pattern.count(length)
            rank = taken.get(length, 0)
            rows.append((length, rank, each, first, offset))
            taken[length] = rank + each * times
            offset += length * each
        first += times
    rows.sort()
    names = ("length", "rank", "each", "first", "offset")
    return {n: np.array([r[i] for r in rows], np.int64) for i, n in enumerate(names)}


def packed(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut_pieces`` with ``sequence_id`` and ``offset``.  An empty table gives no rows."""
    spark = cut_pieces.sparkSession
    # Written once: the texts are not encoded again, and ranks rest on the very same rows.
    p = cut_lineage(cut_pieces)
    lane = F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(LANES)).cast("int")
    p = p.withColumn("lane", lane)
    lanes = p.groupBy("length", "lane").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in lanes.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row for each length
        counts[r["length"]] = r["n"]
    table = spark.sparkContext.broadcast(places(plan(counts, capacity)))
    before = Window.partitionBy("length").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    based = lanes.select("length", "lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "lane").orderBy("doc_id", "row", "piece")
    ranked = p.withColumn("own", F.row_number().over(inside) - 1).join(based, ["length", "lane"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("own")).drop("base", "own", "lane")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        wide = np.int64(1) << 44
        keys = t["length"] * wide + t["rank"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            i = np.searchsorted(keys, length * wide + rank, "right") - 1
            k = rank - t["rank"][i]
            columns = [batch.column(c) for c in batch.schema.names if c != "rank"]
            sequence = t["first"][i] + k // t["each"][i]
            offset = t["offset"][i] + k % t["each"][i] * length
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence), pa.array(offset)],
                names=[*(c for c in batch.schema.names if c != "rank"), "sequence_id", "offset"],
            )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.drop("rank").schema.fields)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Pieces of all ``docs`` with their places; other columns are not looked at.  A null id
    stays null; rows that repeat an id are packed each."""
    return packed(pieces(docs, capacity, vocabulary), capacity).drop("row")
