"""Questions from batches of documents to tables spread by key, and the answers back.

Documents are dealt to batches of bounded bytes.  A batch asks each bucket of the key space
one question (a block of sorted keys with what belongs to them), a bucket answers all
batches' questions at once, and the answers come back to the batch's documents.  Keys travel
as arrays inside a few binary cells, once for each batch however often they stand in it, so a
key in every document costs one entry for each batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chartweave.llm import kernels

BATCH_BYTES = 12_000_000

Question = dict[str, np.ndarray]


def shuffled(column: np.ndarray) -> bytes:
    """Bytes of an array, all first bytes, then all second ones: equal bytes meet."""
    return np.ascontiguousarray(column.view(np.uint8).reshape(len(column), -1).T).tobytes() if len(column) else b""


def unshuffled(raw: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    if not raw:
        return np.zeros(0, kind)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return shuffled(np.diff(keys, prepend=np.uint64(0))) if len(keys) else b""


def unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unshuffled(raw, np.uint64), dtype=np.uint64)


def by_bucket(keys: np.ndarray, buckets: int) -> list[slice]:
    """The run of each bucket in sorted keys: buckets are equal ranges of the key space."""
    width = -(-(1 << 64) // buckets)
    cuts = np.array([min(b * width, 2**64 - 1) for b in range(1, buckets)], np.uint64)
    at = [0, *np.searchsorted(keys, cuts).tolist(), len(keys)]
    return [slice(a, b) for a, b in zip(at[:-1], at[1:])]


def blocks_of(kinds: dict[str, type]) -> str:
    return "batch int, bucket int, " + ", ".join(f"`{n}` binary" for n in kinds)


def to_blocks(batch: int, columns: Question, kinds: dict[str, type], buckets: int) -> Iterator[dict]:
    """Rows for all buckets; ``columns["key"]`` is sorted and has uint64 keys."""
    for b, run in enumerate(by_bucket(columns["key"], buckets)):
        row = {"batch": batch, "bucket": b, "key": pack_keys(columns["key"][run])}
        yield row | {n: shuffled(columns[n][run].astype(k)) for n, k in kinds.items() if n != "key"}


def from_block(table: pa.Table, i: int, kinds: dict[str, type]) -> Question:
    out = {"key": unpack_keys(table.column("key")[i].as_py())} if "key" in kinds else {}
    return out | {n: unshuffled(table.column(n)[i].as_py(), k) for n, k in kinds.items() if n != "key"}


def to_table(rows: list[dict], kinds: dict[str, type]) -> pa.Table:
    fields = [("batch", pa.int32()), ("bucket", pa.int32()), *((n, pa.binary()) for n in kinds)]
    return pa.Table.from_pylist(rows, pa.schema(fields))


def ask(docs: DataFrame, question: Callable[[pa.Table], Question], kinds: dict[str, type], buckets: int) -> DataFrame:
    """Each batch's question: ``question`` maps a batch's documents to columns, sorted by key."""

    def fn(table: pa.Table) -> pa.Table:
        columns = question(table)
        return to_table(list(to_blocks(table.column("batch")[0].as_py(), columns, kinds, buckets)), kinds)

    return docs.groupBy("batch").applyInArrow(fn, blocks_of(kinds))


def answer(
    questions: DataFrame,
    asked: dict[str, type],
    reply: Callable[[list[Question]], list[Question]],
    kinds: dict[str, type],
) -> DataFrame:
    """Each bucket's answers: ``reply`` maps the questions of all batches, ordered by batch, to
    their answers.  These may leave out keys, or have no keys and follow the order of those
    asked, which a batch can make again.  A column may have any length, such as one figure of
    the whole bucket; every batch gets a row from every bucket."""

    def fn(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("batch").to_numpy(), kind="stable").tolist()
        replies = reply([from_block(table, i, asked) for i in order])
        rows = []
        for i, r in zip(order, replies):
            row = {n: table.column(n)[i].as_py() for n in ("batch", "bucket")}
            row |= {"key": pack_keys(r["key"])} if "key" in kinds else {}
            rows.append(row | {n: shuffled(r[n].astype(k)) for n, k in kinds.items() if n != "key"})
        return to_table(rows, kinds)

    return questions.groupBy("bucket").applyInArrow(fn, blocks_of(kinds))


def gathered(table: pa.Table, kinds: dict[str, type]) -> Question:
    """A batch's answers from all buckets as one set of columns, sorted by key."""
    order = np.argsort(table.column("bucket").to_numpy(), kind="stable").tolist() if table.num_rows else []
    parts = [from_block(table, i, kinds) for i in order]
    return {n: np.concatenate([p[n] for p in parts]) if parts else np.zeros(0, k) for n, k in kinds.items()}


def look_up(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted key in sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def rows_of(table: pa.Table, column: str = "text", most: int = 2_000_000) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of a batch's documents with the number of rows before each, the same slices
    whenever the batch is read: rows come in any order, and are sorted."""
    at = 0
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    for batch in table.combine_chunks().to_batches():
        for part in kernels.slices(batch, column, most):
            yield at, part
            at += part.num_rows
