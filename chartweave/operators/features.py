"""Document features: bag of words, bag of embeddings, user vectors, pooling."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartweave.session import cut_lineage

#: Vectors that a task holds.
BLOCK_BYTES = 64 << 20
#: Tokens of a vocabulary that every task may hold, and tokens of documents that one looks up at a time.
KNOWN_TOKENS = 500_000
SLICE_TOKENS = 200_000
#: Terms of a document that travel as one row, terms with their vectors that a task multiplies at a time,
#: tokens of a block that only look up their rows, and documents of a block's slice.
LIST_TERMS = 1000
SLICE_BYTES = 16 << 20
PLACE_TOKENS = 250_000
SLICE_DOCS = 50_000


def bow_freq(docs: DataFrame, key: str, items: Column) -> DataFrame:
    """Sparse rows ``(key, token, n)``.  A document's tokens start in one task, so
    the map-side combine leaves one row per document and token to shuffle."""
    return (
        docs.select(key, F.explode(items).alias("token"))
        .groupBy(key, "token")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def bow_lists(docs: DataFrame, key: str, items: Column, whole: bool = True) -> DataFrame:
    """``bow_freq`` as lists ``(key, tokens, ns)``: a document is counted in its task, without nulls.

    With ``whole`` rows that repeat a key are one document, with each token once; where keys do
    repeat, which a look at the keys tells, the lists are shuffled for it.  Without, each row has a list
    of its own, which is enough for sums."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, "items"):
            row, values = _rows_and_values(batch.column("items"))
            there = values.is_valid().to_numpy(zero_copy_only=False)
            coded = values.drop_null().dictionary_encode()
            width = max(1, len(coded.dictionary))
            code, n = np.unique(row[there] * width + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            of, ends = np.unique(code // width, return_index=True)
            ends = pa.array(np.append(ends, len(code)), pa.int32())
            tokens = coded.dictionary.take(pa.array(code % width))
            lists = [pa.ListArray.from_arrays(ends, tokens), pa.ListArray.from_arrays(ends, pa.array(n, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(of)), *lists], names=["key", "tokens", "ns"])

    kind = T.StructField("key", docs.schema[key].dataType)
    schema = T.StructType([kind, *T.StructType.fromDDL("tokens array<string>, ns array<bigint>").fields])
    lists = docs.select(F.col(key).alias("key"), items.alias("items")).mapInArrow(counted, schema).withColumnRenamed("key", key)
    if not whole or not docs.groupBy(key).count().filter("count > 1").limit(1).count():
        return lists
    met = lists.groupBy(key).agg(F.collect_list(F.struct("tokens", "ns")).alias("p"))
    one = met.filter(F.size("p") == 1).select(key, F.col("p")[0]["tokens"].alias("tokens"), F.col("p")[0]["ns"].alias("ns"))
    several = met.filter(F.size("p") > 1).select(key, F.explode("p").alias("x"))
    cells = several.select(key, F.inline(F.arrays_zip("x.tokens", "x.ns"))).toDF(key, "token", "n")
    added = cells.groupBy(key, "token").agg(F.sum("n").alias("n")).groupBy(key).agg(F.collect_list(F.struct("token", "n")).alias("c"))
    return one.unionByName(added.select(key, F.col("c.token").alias("tokens"), F.col("c.n").alias("ns")))


def bow_bin(docs: DataFrame, key: str, items: Column) -> DataFrame:
    return bow_freq(docs, key, items).select(key, "token", F.lit(1).cast("bigint").alias("n"))


def width(vectors: DataFrame, vec: str = "vec") -> int:
    """Length of the vectors, from one row."""
    row = vectors.select(F.size(vec).alias("d")).first()
    return row["d"] if row else 0


def token_embeddings(terms: DataFrame, vectors: DataFrame) -> DataFrame:
    """Terms with their vectors; tokens without one drop out."""
    return terms.join(vectors.select("token", "vec"), "token")


def boe_sum(terms: DataFrame, vectors: DataFrame, key: str, dims: int | None = None, **kw) -> DataFrame:
    """Sum of the vectors of all token occurrences.

    ``terms`` are rows ``(key, token, n)`` or lists ``(key, tokens, ns)``; ``vectors`` are ``(token, vec)``,
    or ``(token, row)`` beside a ``matrix (row, vec)``, where tokens share vectors.  ``docs`` is the number
    of documents, which otherwise is counted."""
    return _bag(terms, vectors, key, dims, **kw)


def boe_bin(terms: DataFrame, vectors: DataFrame, key: str, dims: int | None = None, **kw) -> DataFrame:
    """Sum of the vectors of the distinct tokens."""
    return _bag(terms, vectors, key, dims, distinct=True, **kw)


def user_embedding_mean(
    terms: DataFrame, vectors: DataFrame, key: str, dims: int | None = None, **kw
) -> DataFrame:
    """Mean vector of all known token occurrences of a user."""
    return _bag(terms, vectors, key, dims, mean=True, **kw)


class _Sums:
    """Sums of rows of equal, neighbouring keys, whose rows may come in several batches."""

    def __init__(self, kind: pa.DataType, dims: int):
        self.kind, self.dims = kind, dims
        self.key, self.n, self.vec = None, 0, np.zeros(dims)

    def add(self, keys: pa.Array, n: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(keys):
            return
        starts = np.concatenate([[0], np.flatnonzero(np.asarray(pc.not_equal(keys[1:], keys[:-1]))) + 1])
        ns, sums = np.add.reduceat(n, starts), np.add.reduceat(rows, starts, axis=0)
        first = keys[0].as_py()
        if self.n and self.key == first:
            ns[0] += self.n
            sums[0] += self.vec
        else:
            yield from self.rest()
        if len(starts) > 1:
            yield self._batch(keys.take(pa.array(starts[:-1])), ns[:-1], sums[:-1])
        self.key, self.n, self.vec = keys[int(starts[-1])].as_py(), int(ns[-1]), sums[-1].copy()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            yield self._batch(pa.array([self.key], self.kind), np.array([self.n]), self.vec[None, :])
        self.n = 0

    def _batch(self, keys, n, rows) -> pa.RecordBatch:
        ends = pa.array(np.arange(len(n) + 1) * self.dims, pa.int32())
        vec = pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(rows).ravel()))
        return pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64()), vec], names=["key", "n_tokens", "vec"])


def _runs(batch: pa.RecordBatch, *columns: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch in which ``columns`` do not change."""
    if not batch.num_rows:
        return
    values = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
    new = np.any([v[1:] != v[:-1] for v in values], axis=0)
    edges = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges[:-1], edges[1:]):
        yield batch.slice(a, b - a)


def _rows_and_values(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """All values of a list column, and the row of each."""
    return np.repeat(np.arange(len(lists)), pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)), lists.flatten()


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists cut by the block ``at`` of their tokens, in pieces of at most ``LIST_TERMS``."""
    for batch in _slices(batches, "tokens"):
        row, tokens = _rows_and_values(batch.column("tokens"))
        at = batch.column("at").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        code = at * batch.num_rows + row
        order = np.argsort(code, kind="stable")
        new = np.r_[True, code[order][1:] != code[order][:-1]][: len(order)]
        starts = np.flatnonzero(new)
        place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
        starts = np.flatnonzero(place % LIST_TERMS == 0)
        ends, order = pa.array(np.append(starts, len(order)), pa.int32()), pa.array(order)
        of = row[order][starts]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(at[order][starts].astype(np.int32)),
                batch.column("salt").take(pa.array(of)),
                pa.array(np.ones(len(of), np.int32)),
                batch.column("key").take(pa.array(of)),
                pa.ListArray.from_arrays(ends, tokens.take(order)),
                pa.ListArray.from_arrays(ends, batch.column("ns").flatten().take(order)),
            ],
            names=["block", "salt", "kind", "key", "tokens", "ns"],
        )


def _by_block(terms: DataFrame, key: str, blocks: int, salts: int) -> DataFrame:
    """``(block, salt, kind, key, tokens, ns)`` of lists, dealt in their tasks."""
    at = F.transform("tokens", lambda t: F.pmod(F.xxhash64(t), F.lit(blocks)).cast("int")).alias("at")
    salt = F.pmod(F.xxhash64(key, F.lit("salt")), F.lit(salts)).cast("int").alias("salt")
    ns = F.col("ns").cast("array<bigint>").alias("ns")
    fields = T.StructType.fromDDL("block int, salt int, kind int").fields
    lists = T.StructType.fromDDL("ns array<bigint>").fields
    kinds = [T.StructField("key", terms.schema[key].dataType), T.StructField("tokens", terms.schema["tokens"].dataType)]
    return terms.select(F.col(key).alias("key"), "tokens", ns, at, salt).mapInArrow(_dealt, T.StructType([*fields, *kinds, *lists]))


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of a block come first, with their rows, then lists of documents, whose tokens become rows."""
    at, tokens, rows, known = None, [], [], None
    for batch in batches:
        for run in _runs(batch, "block", "kind"):
            now = run.column("block")[0].as_py()
            if now != at:
                at, tokens, rows, known = now, [], [], None
            if run.column("kind")[0].as_py() == 0:
                tokens.append(run.column("tokens").flatten())
                rows.append(run.column("ns").flatten().to_numpy(zero_copy_only=False))
                continue
            if not tokens:  # no token in this block
                continue
            if known is None:
                known, place = pa.concat_arrays(tokens), np.concatenate(rows)
            row, asked = _rows_and_values(run.column("tokens"))
            found = pc.index_in(asked, known)
            there = found.is_valid()
            of, ends = np.unique(row[there.to_numpy(zero_copy_only=False)], return_index=True)
            found = place[found.drop_null().to_numpy(zero_copy_only=False)]
            ends = pa.array(np.append(ends, len(found)), pa.int32())
            ns = run.column("ns").flatten().filter(there)
            yield pa.RecordBatch.from_arrays(
                [run.column("key").take(pa.array(of)), pa.ListArray.from_arrays(ends, pa.array(found)), pa.ListArray.from_arrays(ends, ns)],
                names=["key", "tokens", "ns"],
            )


def _in_rows(terms: DataFrame, places: DataFrame, key: str) -> DataFrame:
    """Lists whose tokens are the rows that ``places (token, row)`` names; other tokens drop out.
    Tokens meet their rows in blocks of the vocabulary, and no vector travels here."""
    places = cut_lineage(places.select("token", F.col("row").cast("bigint").alias("row")).filter("row is not null"))
    blocks = max(int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-places.count() // PLACE_TOKENS))
    asked = _by_block(terms, key, blocks, 1).drop("salt")
    known = places.select(
        F.pmod(F.xxhash64("token"), F.lit(blocks)).cast("int").alias("block"),
        F.lit(0).alias("kind"),
        F.lit(None).cast(terms.schema[key].dataType).alias("key"),
        F.array("token").alias("tokens"),
        F.array("row").alias("ns"),
    )
    met = known.unionByName(asked).repartition(blocks, "block").sortWithinPartitions("block", "kind")
    kind = T.StructField("key", terms.schema[key].dataType)
    schema = T.StructType([kind, *T.StructType.fromDDL("tokens array<bigint>, ns array<bigint>").fields])
    return met.mapInArrow(_found, schema).withColumnRenamed("key", key)


def _products(dims: int, distinct: bool):
    """Vectors of a block of the vocabulary come first, then the lists of documents, by document:
    a sparse block times the block of the matrix."""
    most = max(1, SLICE_BYTES // (8 * max(1, dims)))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums, tokens, parts, matrix = None, None, [], [], None
        for batch in batches:
            for run in _runs(batch, "block", "salt", "kind"):
                now = (run.column("block")[0].as_py(), run.column("salt")[0].as_py())
                if now != at:
                    if sums is not None:
                        yield from sums.rest()
                    at, sums, tokens, parts, matrix = now, None, [], [], None
                if run.column("kind")[0].as_py() == 0:
                    tokens.append(run.column("tokens").flatten())
                    parts.append(run.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
                    continue
                if not tokens:  # no vector in this block
                    continue
                if matrix is None:
                    matrix, known = np.concatenate(parts), pa.concat_arrays(tokens)
                    sums = _Sums(run.column("key").type, dims)
                row, asked = _rows_and_values(run.column("tokens"))
                found = pc.index_in(asked, known)
                there = found.is_valid()
                row = row[there.to_numpy(zero_copy_only=False)]
                found = found.drop_null().to_numpy(zero_copy_only=False)
                n = run.column("ns").flatten().filter(there).to_numpy(zero_copy_only=False).astype(np.int64)
                for a in range(0, len(found), most):
                    b = a + most
                    rows = matrix[found[a:b]] if distinct else matrix[found[a:b]] * n[a:b, None]
                    yield from sums.add(run.column("key").take(pa.array(row[a:b])), n[a:b], rows)
        if sums is not None:
            yield from sums.rest()

    return multiply


def _added(dims: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            if batch.num_rows:
                sums = sums or _Sums(batch.column("key").type, dims)
                rows = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                yield from sums.add(batch.column("key"), batch.column("n_tokens").to_numpy(zero_copy_only=False).copy(), rows)
        if sums is not None:
            yield from sums.rest()

    return add


def _bag(terms, vectors, key, dims, distinct=False, mean=False, blocks=None, block_bytes=BLOCK_BYTES, matrix=None, docs=None):
    """Terms times vectors, block by block of the vocabulary.

    A block of the vocabulary (a range of the tokens' hashes, as many as fit ``block_bytes`` with
    their vectors) meets the terms of its tokens; a document's terms travel as lists of tokens and
    counts, one for each block, never with a vector.  With a ``matrix`` tokens are first replaced by
    its rows, and the blocks are those of the matrix, however many tokens there are.  A block is
    copied for as many slices of the documents as keep all tasks busy.  Documents with terms in
    several blocks add up one partial sum per block.  Without a number of ``blocks`` it is that of the
    fewest vectors moved, copies and partial sums together, which needs the number of ``docs``.
    """
    spark = terms.sparkSession
    if "tokens" not in terms.columns:
        terms = terms.select(key, F.array("token").alias("tokens"), F.array("n").alias("ns"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if blocks is None and docs is None:
        docs = terms.agg(F.approx_count_distinct(key)).first()[0]
    if docs:
        tasks = max(tasks, docs // SLICE_DOCS)
    if matrix is not None:
        terms, vectors = _in_rows(terms, vectors, key), matrix.select(F.col("row").cast("bigint").alias("token"), "vec")
    vectors = vectors.filter("vec is not null").select("token", F.col("vec").cast("array<double>").alias("vec"))
    vectors = cut_lineage(vectors)
    rows, widest = vectors.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    dims = dims or widest or 0
    if blocks is None:
        blocks = min(round(math.sqrt(tasks * rows / (docs or 1))), 4 * tasks)
    blocks = max(1, blocks, -(-rows * dims * 8 // block_bytes))
    salts = -(-tasks // blocks)
    kind = terms.schema[key].dataType
    known = vectors.select(
        F.pmod(F.xxhash64("token"), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
        F.lit(0).alias("kind"),
        F.lit(None).cast(kind).alias("key"),
        F.array("token").alias("tokens"),
        F.array().cast("array<bigint>").alias("ns"),
        "vec",
    )
    # Empty vectors, as null lists are slow to hand over.
    asked = _by_block(terms, key, blocks, salts).withColumn("vec", F.array().cast("array<double>"))
    met = (
        known.unionByName(asked)
        .repartition(blocks * salts, "block", "salt")
        .sortWithinPartitions("block", "salt", "kind", "key")
    )
    schema = T.StructType([T.StructField("key", kind), *T.StructType.fromDDL("n_tokens bigint, vec array<double>").fields])
    out = met.mapInArrow(_products(dims, distinct), schema)
    if blocks > 1:
        out = out.repartition("key").sortWithinPartitions("key").mapInArrow(_added(dims), schema)
    vec = F.transform("vec", lambda x: x / F.col("n_tokens")) if mean else F.col("vec")
    return out.select(F.col("key").alias(key), "n_tokens", vec.alias("vec"))


def user_vectors(ids: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Vector of each id; an id without one gets zeros."""
    zeros = F.array_repeat(F.lit(0.0), width(vectors))
    return ids.select(key).join(vectors.select(key, "vec"), key, "left").select(
        key, F.coalesce(F.col("vec").cast("array<double>"), zeros).alias("vec")
    )


def sparse_vectors(terms: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """``(key, ids, weights)`` of ``terms (key, token, n)`` over ``vocabulary (id, token)``: ids rise,
    so a row is a sparse vector, no longer than the vocabulary.  Documents without a known token
    have no row."""
    known = terms.join(vocabulary.select("id", "token"), "token")
    return _sparse(known.select(key, F.col("id").cast("int").alias("id"), F.col("n").cast("double").alias("weight")), key)


def sparse_bags(docs: DataFrame, key: str, items: Column, vocabulary: DataFrame, binary: bool = False) -> DataFrame:
    """``sparse_vectors`` of the counts of each document's ``items``, or of ones with ``binary``.

    A vocabulary of up to ``KNOWN_TOKENS`` travels to the documents, which are counted in place: only
    their known ids are shuffled, as arrays, and only because rows may repeat a key."""
    known = vocabulary.select("id", "token").limit(KNOWN_TOKENS + 1).toArrow()
    if known.num_rows > KNOWN_TOKENS or pc.count_distinct(known["token"], mode="all").as_py() < known.num_rows:
        return sparse_vectors((bow_bin if binary else bow_freq)(docs, key, items), vocabulary, key)
    known = known.filter(known["token"].is_valid()).combine_chunks()
    ids = known["id"].to_numpy().astype(np.int64)
    width = int(ids.max()) + 1 if len(ids) else 1
    shared = docs.sparkSession.sparkContext.broadcast((known["token"].combine_chunks(), ids))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, ids = shared.value
        for batch in _slices(batches, "items"):
            lists = batch.column("items")
            row = np.repeat(np.arange(batch.num_rows), pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False))
            at = pc.index_in(lists.flatten().cast(tokens.type), tokens)
            there = at.is_valid().to_numpy(zero_copy_only=False)
            code = row[there] * width + ids[at.drop_null().to_numpy(zero_copy_only=False)]
            code, n = np.unique(code, return_counts=True)
            of, ends = np.unique(code // width, return_index=True)
            ends = pa.array(np.append(ends, len(code)), pa.int32())
            weights = np.ones(len(n)) if binary else n.astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").take(pa.array(of)),
                    pa.ListArray.from_arrays(ends, pa.array((code % width).astype(np.int32))),
                    pa.ListArray.from_arrays(ends, pa.array(weights)),
                ],
                names=["key", "ids", "weights"],
            )

    kind = T.StructField("key", docs.schema[key].dataType)
    schema = T.StructType([kind, *T.StructType.fromDDL("ids array<int>, weights array<double>").fields])
    parts = docs.select(F.col(key).alias("key"), items.alias("items")).mapInArrow(counted, schema)
    whole = F.max("weight") if binary else F.sum("weight")
    return _merged_parts(parts.withColumnRenamed("key", key), key, whole)


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Slices of batches with at most ``SLICE_TOKENS`` items, of one row at least."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(batch.column(column).value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            end = max(first + 1, int(np.searchsorted(ends, before + SLICE_TOKENS, "right")))
            yield batch.slice(first, end - first)
            first = end


def _merged_parts(parts: DataFrame, key: str, weight: Column) -> DataFrame:
    """One sparse row per key: a single part as it is, several with ``weight`` of each id, an aggregate
    of its weights ``weight`` in ``n_parts`` parts."""
    met = parts.groupBy(key).agg(F.collect_list(F.struct("ids", "weights")).alias("p"))
    one = met.filter(F.size("p") == 1).select(key, F.col("p")[0]["ids"].alias("ids"), F.col("p")[0]["weights"].alias("weights"))
    several = met.filter(F.size("p") > 1).select(key, F.size("p").alias("n_parts"), F.explode("p").alias("x"))
    cells = several.select(key, "n_parts", F.inline(F.arrays_zip("x.ids", "x.weights"))).toDF(key, "n_parts", "id", "weight")
    return one.unionByName(_sparse(cells.groupBy(key, "id").agg(weight.alias("weight")), key))


def _sparse(rows: DataFrame, key: str) -> DataFrame:
    cells = F.sort_array(F.collect_list(F.struct("id", "weight"))).alias("c")
    return rows.groupBy(key).agg(cells).select(key, F.col("c.id").alias("ids"), F.col("c.weight").alias("weights"))


def feature_rows(rows: DataFrame, features: DataFrame, key: str = "subject_id") -> DataFrame:
    """Labelled rows with the features of their subject, dense (``vec``) or sparse (``ids``,
    ``weights``).  Several rows of a subject, such as the parts of a long text, are pooled by their
    mean; rows without a vector do not count."""
    if "vec" not in features.columns:
        return rows.join(pool_sparse(features, key), key)
    known = features.select(key, F.col("vec").cast("array<double>").alias("vec")).filter("vec is not null")
    return rows.join(pool_mean(known, key).select(key, "vec"), key)


def feature_coverage(rows: DataFrame, features: DataFrame, key: str = "subject_id") -> DataFrame:
    """``(task, split, n_rows, n_kept)``: labelled rows, and those whose subject has features; what
    ``feature_rows`` leaves out is the difference."""
    column = "vec" if "vec" in features.columns else "ids"
    known = features.filter(F.col(column).isNotNull()).select(key, F.lit(1).alias("_known")).distinct()
    return (
        rows.join(known, key, "left")
        .groupBy("task", "split")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count("_known").alias("n_kept"))
    )


def pool_sparse(parts: DataFrame, key: str) -> DataFrame:
    """Mean of the sparse part vectors of each document."""
    known = parts.filter("ids is not null").select(key, "ids", "weights")
    return _merged_parts(known, key, F.sum("weight") / F.first("n_parts"))


def pool_mean(parts: DataFrame, key: str) -> DataFrame:
    """Mean of the part vectors of each document."""
    return parts.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_parts"),
        vector_to_array(Summarizer.mean(array_to_vector("vec"))).alias("vec"),
    )


def pool_first(parts: DataFrame, key: str, part: str = "part") -> DataFrame:
    """Vector of the first part."""
    return parts.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_parts"), F.min_by("vec", part).alias("vec")
    )


def long_vectors(df: DataFrame, *keep: str, digits: int = 6) -> DataFrame:
    """One row per dimension, rounded."""
    return df.select(*keep, F.posexplode("vec").alias("dim", "_v")).select(
        *keep, "dim", F.round(F.col("_v").cast("double"), digits).alias("value")
    )
