"""Near-duplicate documents by a chosen-path set similarity join.

1. Each document becomes its set of word shingles; equal sets become one class.
2. Each class is put into ``TREES`` independent trees by pairs of minwise tokens: a path has two
   chosen tokens, and branching ends there.
3. Nodes are compared exhaustively on sketches; pairs that may be similar join their
   classes into candidate groups.
4. Each candidate group is compared exhaustively on its full sets.  Groups too large for
   a task go through the trees again, and their nodes are compared on full sets.
5. A node too large for a task, in 3 or 4, is dealt to blocks and every pair of blocks is
   compared, so no pair of a node is left out however many rows it has.
6. Components of the confirmed links give the classes of documents.

With similarity 0.8 a pair shares a first node of one tree with probability 0.64, so 12
trees miss five pairs in a million; a sketch of 128 tokens estimates 0.8 as under 0.62
about as rarely.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartweave.llm import kernels
from chartweave.llm.graph import components
from chartweave.session import cut_lineage

TOKENS = 128
TREES = 12
#: Sketch similarity from which two classes may be linked, as a margin below the threshold.
MARGIN = 0.18
#: Rows of a node, or shingles of a group, that one task takes.
NODE_ROWS = 50_000
GROUP_SHINGLES = 3_000_000
SEED = 20_011

_SKETCHED = "id long, n_shingles long, d1 long, d2 long, sketch binary, nodes array<long>"


def _constants():
    rng = np.random.default_rng(SEED)
    mult = rng.integers(0, 2**63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, TOKENS, dtype=np.uint64)
    pairs = np.array([rng.permutation(TOKENS)[:2] for _ in range(TREES)])
    return mult, add, pairs


def minwise(sets: list[np.ndarray]) -> np.ndarray:
    """``(len(sets), TOKENS)`` minwise hashes; an empty set has the largest value throughout."""
    mult, add, _ = _constants()
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.full((len(sets), TOKENS), np.uint64(2**64 - 1), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.concatenate([sets[i] for i in full])
        at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        for t in range(TOKENS):
            out[full, t] = np.minimum.reduceat((flat ^ add[t]) * mult[t], at)
    return out


def _sketcher(k: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, pairs = _constants()
        for whole in batches:
            for batch in kernels.slices(whole, "text", 1_000_000):
                sets = kernels.shingle_sets(*kernels.buffers(batch.column("text")), k)
                least = minwise(sets)
                low = kernels.mix(least)
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                digest = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                nodes = np.stack(
                    [
                        kernels.mix(kernels.mix(least[:, i] + np.uint64(t)) ^ least[:, j] * kernels.C3)
                        for t, (i, j) in enumerate(pairs)
                    ],
                    axis=1,
                ).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digest[:, 0]),
                        pa.array(digest[:, 1]),
                        kernels.binary_column(list((low & np.uint64(255)).astype(np.uint8))),
                        pa.array(list(nodes), pa.list_(pa.int64())),
                    ],
                    names=["id", "n_shingles", "d1", "d2", "sketch", "nodes"],
                )

    return sketch


def _unions(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component of each of ``n`` items, as its smallest item."""
    root = np.arange(n)

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return np.array([find(x) for x in range(n)], np.int64) if n else np.zeros(0, np.int64)


def _reach(sig: np.ndarray, least: int) -> np.ndarray:
    """Label of each row: rows in one label are joined by pairs with ``least`` equal tokens.

    Grows a group from a row by comparing it with all rows not reached yet.
    """
    label = np.full(len(sig), -1)
    left, rest = np.arange(len(sig)), np.ascontiguousarray(sig)
    while len(left):
        seed, left, rest = left[0], left[1:], rest[1:]
        label[seed] = seed
        todo = [seed]
        while todo and len(left):
            # Eight equal-flags to a lane; no byte of a sum of lanes exceeds TOKENS / 8.
            lanes = (rest == sig[todo.pop()]).view(np.uint64).sum(axis=1, dtype=np.uint64)
            near = (lanes * np.uint64(0x0101010101010101)) >> np.uint64(56) >= least
            if near.any():
                found, left, rest = left[near], left[~near], rest[~near]
                label[found] = seed
                todo.extend(found.tolist())
    return label


def tree_leaves(sig: np.ndarray, rng: np.random.Generator, share: float, most: int) -> list[np.ndarray]:
    """Rows of each leaf under a node: in every node each token that splits it is chosen with
    a rate that gives ``1 / share`` tokens on average, and rows go to a child for each chosen
    token and its value.  A node that no token splits stays whole, however large.

    Similar pairs may part here, so the query compares its nodes whole and does without."""
    leaves = []
    todo = [(np.arange(len(sig)), 0)]
    while todo:
        rows, depth = todo.pop()
        splits = np.flatnonzero((sig[rows] != sig[rows[0]]).any(axis=0))
        if len(rows) <= most or depth == 24 or not len(splits):
            if len(rows) > 1:
                leaves.append(rows)
            continue
        chosen = splits[rng.random(len(splits)) < 1 / (share * len(splits))]
        if not len(chosen):
            chosen = rng.choice(splits, 1)
        for c in chosen:
            order = rows[np.argsort(sig[rows, c], kind="stable")]
            parts = np.split(order, np.flatnonzero(np.diff(sig[order, c])) + 1)
            todo += [(x, depth + 1) for x in parts if len(x) > 1]
    return leaves


def _matching(similarity: float) -> int:
    s = max(0.0, similarity - MARGIN)
    return int(np.floor(TOKENS * (s + (1 - s) / 256)))


def _signatures(column) -> np.ndarray:
    data, _ = kernels.buffers(column)
    return data.reshape(-1, TOKENS)


def _runs(key: np.ndarray, then: np.ndarray) -> list[np.ndarray]:
    """Row numbers of each run of equal keys, ordered by ``then``."""
    order = np.lexsort((then, key))
    s = key[order]
    return np.split(order, np.flatnonzero(s[1:] != s[:-1]) + 1)


def _node_pairs(similarity: float):
    least = _matching(similarity)

    def compare(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        sig = _signatures(table.column("sketch"))
        out_a, out_b = [], []
        for rows in _runs(table.column("node").to_numpy(), ids):
            label = _reach(sig[rows], least)
            linked = np.flatnonzero(label != np.arange(len(rows)))
            out_a.append(ids[rows[label[linked]]])
            out_b.append(ids[rows[linked]])
        return pa.table(
            {
                "a": np.concatenate(out_a) if out_a else np.zeros(0, np.int64),
                "b": np.concatenate(out_b) if out_b else np.zeros(0, np.int64),
            }
        )

    return compare


def exact_links(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join every component of ``100 * intersection >= percent * union``.

    Grows a component from a set.  With the rarest shingles first, two similar sets share one
    among the first ``n - least intersection + 1`` of each, so only sets that do are counted:
    shingles of a template that all sets hold bring no pair together.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    begin = np.cumsum(sizes) - sizes
    _, value, often = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    order = np.lexsort((value, often[value], owner))
    head = sizes - -(-percent * sizes // 100) + 1
    heads = order[(np.arange(len(flat)) - np.repeat(begin, sizes)) < np.repeat(head, sizes)]
    by_value = heads[np.argsort(value[heads], kind="stable")]
    holders = owner[by_value]
    first = np.searchsorted(value[by_value], np.arange(len(often) + 1))
    taken = np.cumsum(np.minimum(head, sizes)) - np.minimum(head, sizes)
    held = np.zeros(len(often), bool)
    waiting = sizes > 0
    a, b = [], []
    for seed in range(n):
        if not waiting[seed]:
            continue
        waiting[seed] = False
        todo = [seed]
        while todo:
            x = todo.pop()
            own = value[heads[taken[x] : taken[x] + min(head[x], sizes[x])]]
            near = np.unique(holders[kernels.gather(first[own], first[own + 1] - first[own])])
            near = near[waiting[near]]
            if not len(near):
                continue
            mine = value[begin[x] : begin[x] + sizes[x]]
            held[mine] = True
            hits = held[value[kernels.gather(begin[near], sizes[near])]]
            held[mine] = False
            shared = np.add.reduceat(hits.astype(np.int64), np.cumsum(sizes[near]) - sizes[near])
            found = near[100 * shared >= percent * (sizes[x] + sizes[near] - shared)]
            waiting[found] = False
            a += [x] * len(found)
            b += found.tolist()
            todo += found.tolist()
    return np.array(a, np.int64), np.array(b, np.int64)


def _group_links(percent: int):
    def confirm(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        data, offsets = kernels.buffers(table.column("shingles"))
        hashes = data.view(np.uint64) if len(data) % 8 == 0 else np.frombuffer(data.tobytes(), np.uint64)
        offsets = offsets // 8
        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for rows in _runs(table.column("grp").to_numpy(), ids):
            a, b = exact_links([hashes[offsets[i] : offsets[i + 1]] for i in rows], percent)
            out_a.append(ids[rows[a]])
            out_b.append(ids[rows[b]])
        return pa.table({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})

    return confirm


def _set_maker(k: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in kernels.slices(whole, "text"):
                found = kernels.shingle_sets(*kernels.buffers(batch.column("text")), k)
                keep = [c for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in keep] + [kernels.binary_column(found)], names=[*keep, "shingles"]
                )

    return sets


def _block_pairs(places: DataFrame, most: int) -> DataFrame:
    """``(node, split, id)``: groups that hold every pair of classes that share a node of
    ``places (node, id, w)``.

    A node of weight up to ``most`` is one group.  A heavier one is dealt to blocks of half
    of that by a hash of the id, and each pair of blocks is a group."""
    total = F.sum("w")
    blocks = F.when(total <= most, 1).otherwise(F.ceil(2 * total / most)).cast("int")
    counts = places.groupBy("node").agg(F.count(F.lit(1)).alias("n"), blocks.alias("blocks")).filter("n > 1")
    block = F.pmod(F.xxhash64("id", "node"), F.col("blocks"))
    known = places.join(counts, "node").select("node", "id", "blocks", block.alias("block"))
    whole = known.filter("blocks = 1").select("node", F.lit(False).alias("split"), "id")
    pairs = known.filter("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other"))
    return whole.unionByName(
        pairs.filter("other <> block").select(pair.alias("node"), F.lit(True).alias("split"), "id")
    )


def near_duplicates(
    docs: DataFrame,
    shingle: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` for every row of ``docs``.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased.  A text with
    fewer words than ``shingle`` is one shingle; a null, empty or blank text has none and is
    linked with nothing.  Texts with equal sets are linked.  Rows that repeat an id are judged
    each by its own text.  Rows with a null id come back alone: null component, ``kept`` true.
    Other columns are not looked at.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    base = cut_lineage(rows.mapInArrow(_sketcher(shingle), _SKETCHED))
    named = base.filter("id is not null and n_shingles > 0")
    classes = named.groupBy("d1", "d2").agg(F.min("id").alias("rep"))
    reps = (
        named.join(classes.withColumnRenamed("rep", "id"), ["id", "d1", "d2"], "left_semi")
        .dropDuplicates(["id", "d1", "d2"])
        .select("id", "n_shingles", "sketch", "nodes")
    )
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def in_buckets(df, key, fn, schema):
        bucket = F.when(F.col("split"), F.col(key)).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets)))
        return df.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(fn, schema)

    reps = cut_lineage(reps)
    sketches = reps.select("id", "n_shingles", "sketch")
    nodes = reps.select("id", F.explode("nodes").alias("node"))
    shared = _block_pairs(nodes.withColumn("w", F.lit(1)), NODE_ROWS).join(sketches, "id")
    maybe = in_buckets(shared, "node", _node_pairs(percent / 100), "a long, b long")
    groups = components(maybe).select(F.col("node").alias("id"), F.col("component").alias("grp"))
    members = cut_lineage(groups.join(reps.select("id", "n_shingles"), "id"))
    large = members.groupBy("grp").agg(F.sum("n_shingles").alias("w")).filter(F.col("w") > GROUP_SHINGLES)
    placed = members.join(large, "grp", "left_anti").select("id", "grp", F.lit(False).alias("split"))
    if large.limit(1).count():
        # Groups beyond a task go through the trees again, by pairs of blocks a task can take.
        inside = nodes.join(members.join(large, "grp", "left_semi"), "id").select(
            F.xxhash64("grp", "node").alias("node"), "id", F.col("n_shingles").alias("w")
        )
        parts = _block_pairs(inside.distinct(), GROUP_SHINGLES)
        placed = placed.unionByName(parts.select("id", F.col("node").alias("grp"), "split"))
    placed = placed.groupBy("id").agg(F.collect_set(F.struct("grp", "split")).alias("grps"))
    sets = (
        rows.join(placed, "id")
        .select("id", "grps", "text")
        .mapInArrow(_set_maker(shingle), "id long, grps array<struct<grp: long, split: boolean>>, shingles binary")
        .select("id", F.inline("grps"), "shingles")
    )
    found = components(in_buckets(sets, "grp", _group_links(percent), "a long, b long"))
    final = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "d1", "d2", F.coalesce("component", "rep").alias("component")
    )
    alone = F.col("id").isNull() | (F.col("n_shingles") == 0)
    component = F.when(alone, F.col("id")).otherwise(F.col("component"))
    return base.select("id", "n_shingles", "d1", "d2").join(final, ["d1", "d2"], "left").select(
        F.col("id").alias(id_col),
        "n_shingles",
        component.alias("component_id"),
        (F.col("id").isNull() | (component == F.col("id"))).alias("kept"),
    )
