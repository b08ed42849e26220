"""The trie of conversation prefixes, peeled from the deepest turns to the root.

A node is a distinct sequence of first turns.  A turn's digest, salted with its place, is summed
along its conversation, so every prefix has a fingerprint of 128 bits that no task needs a whole
conversation for.  Conversations that end in the same node are counted before they move on.

The trie is then peeled.  Paths of fingerprints are dealt to tasks in their order, so the members
of a node lie side by side.  A task descends from its deepest turn: at each depth the conversations
that end there join the nodes that survived from below, equal fingerprints merge, a merged node is
complete, and with its last turn stripped it survives one depth higher as part of its parent.  Nodes on the
first and the last path of a task may go on in the next task; these two paths leave with what is
known of their nodes and are peeled in the next round, by far fewer tasks, until one task is left.
No row holds more than ``SEGMENT`` turns: longer conversations are peeled in bands of depths, the
deepest first, and what survives a band enters the one above.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartweave.functions.hashing import hash_int
from chartweave.operators.distribution import ranked, running_totals
from chartweave.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
#: Turns of a path that one row holds; more make another band.
SEGMENT = 128
#: Paths that one task peels in the rounds after the first; as many or fewer make the last round.
ROUND_PATHS = 2048
#: Bits of an id within a chunk of a node's ids, so a chunk has at most 1024 of them.
CHUNK_BITS = 10
NONE = np.iinfo(np.int64).max

STEP = "array<struct<a:bigint,b:bigint>>"
LOAD = ("words", "n", "c", "kids", "below", "leaves")
NODE = ("depth", "a", "b", "pa", "pb", *LOAD)
_fields = lambda names: ",".join(f"{x}:bigint" for x in names)
PEELED = f"path {STEP}, load array<struct<{_fields(LOAD)}>>, node struct<{_fields(NODE)}>"


def turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, at, said, words)``: turns numbered from 1 by ``turn``, null first, ties by digest;
    ``said`` is the digest of role and text.  Null roles and texts are empty, rows without a
    ``conv_id`` belong to no conversation and are left out, other columns are not looked at."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        "turn",
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("said"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"),
    )
    return ranked(narrow, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("said")], "at").drop("turn")


def rebuilt(said: DataFrame, group: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that share first turns: ``c`` becomes the first ``h = crc32(c) % heads`` turns
    of ``c - c % group``, as far as there are, and its own turns after its first ``h``.

    ``(conv_id, at, said, words)`` and ``(conv_id, n_turns)``, which has those without turns too.
    """
    said = cut_lineage(said)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("bigint")
    own = said.groupBy("conv_id").agg(F.max("at").alias("n"))
    convs = own.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    bases = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = cut_lineage(
        convs.join(bases, "base", "left").select(
            "conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns")
        )
    )
    tail = said.join(convs.select("conv_id", "h", "taken"), "conv_id").filter("at > h")
    first = said.filter((F.col("at") < heads) & (F.col("conv_id") % group == 0)).withColumnRenamed("conv_id", "base")
    head = first.join(convs.select("conv_id", "base", "taken"), "base").filter("at <= taken")
    rows = tail.select("conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("at"), "said", "words")
    return rows.unionByName(head.select("conv_id", "at", "said", "words")), convs.select("conv_id", "n_turns")


def fingerprints(said: DataFrame, longest: int) -> DataFrame:
    """``(conv_id, at, a, b, words)``: the fingerprint of the first ``at`` turns."""
    h = F.md5(F.concat_ws("|", "at", "said"))
    parts = said.select("conv_id", "at", "words", *[hash_int(h, 8 * i + 1).alias(f"h{i}") for i in range(4)])
    sums = {f"s{i}": F.col(f"h{i}") for i in range(4)}
    summed = running_totals(parts, ["conv_id"], [F.col("at")], sums, group_rows=longest)
    print_of = lambda salt: F.xxhash64(F.lit(salt), "at", *sums)
    return summed.select("conv_id", "at", print_of(1).alias("a"), print_of(2).alias("b"), "words")


def _column(names, arrays) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in arrays], list(names))


def _runs(batch: pa.RecordBatch):
    """Flat fingerprints and loads of a batch of sorted paths, and where each path begins."""
    path, load = (batch.column(batch.schema.get_field_index(c)) for c in ("path", "load"))
    flat = path.flatten()
    loads = load.flatten()
    a, b = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(2))
    offsets = np.concatenate([[0], np.cumsum(path.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    return a, b, {x: loads.field(i).to_numpy(zero_copy_only=False).copy() for i, x in enumerate(LOAD)}, offsets


def peel_batch(batch: pa.RecordBatch, base: int, last: bool) -> Iterator[tuple[dict, bool]]:
    """Nodes of sorted paths that begin at depth ``base``, and unless ``last`` the first and the
    last path with what is known of their nodes: ``(columns, is it a node)``."""
    a, b, v, offsets = _runs(batch)
    rows, sizes = batch.num_rows, np.diff(offsets)
    unit = np.repeat(np.arange(rows), sizes)
    depth = np.arange(len(a)) - offsets[unit]
    there = (unit > 0) & (depth < sizes[unit - 1])
    above = np.where(there, offsets[unit - 1] + depth, 0)
    fresh = ~(there & (a == a[above]) & (b == b[above]))
    order = np.argsort(depth, kind="stable")
    edges = np.searchsorted(depth[order], np.arange(int(sizes.max()) + 1))
    out = []
    for j in range(int(sizes.max()) - 1, -1, -1):
        at = order[edges[j] : edges[j + 1]]
        starts = np.flatnonzero(fresh[at])
        lead = at[starts]
        total = {x: np.add.reduceat(v[x][at], starts) for x in ("n", "kids", "below", "leaves")}
        total["c"] = np.minimum.reduceat(v["c"][at], starts)
        whole = np.ones(len(lead), bool)
        if not last:
            whole[0] = unit[lead[0]] != 0
            goes_on = unit[at[-1]] == rows - 1
            if goes_on:
                whole[-1] = False
            # What is known of an open node stays on the first path, or else on the last.
            keeps = {0: lead[0]} if unit[lead[0]] == 0 else {}
            if goes_on:
                if len(lead) - 1 not in keeps:
                    keeps[len(lead) - 1] = at[-1]
                elif at[-1] != lead[0]:
                    for x in ("n", "kids", "below", "leaves"):
                        v[x][at[-1]] = 0
                    v["c"][at[-1]] = NONE
            for g, k in keeps.items():
                for x in total:
                    v[x][k] = total[x][g]
        done = np.flatnonzero(whole)
        if not len(done):
            continue
        lead, t = lead[done], {x: y[done] for x, y in total.items()}
        t["leaves"] = np.where(t["kids"] == 0, 1, t["leaves"])
        words = v["words"][lead]
        up = lead - 1 if j else lead
        out.append((np.full(len(lead), base + j), a[lead], b[lead], a[up], b[up], words, t["n"], t["c"], t["kids"], t["below"], t["leaves"]))
        if j:
            v["n"][up] += t["n"]
            v["c"][up] = np.minimum(v["c"][up], t["c"])
            v["kids"][up] += 1
            v["below"][up] += t["below"] + (t["n"] - 1) * words
            v["leaves"][up] += t["leaves"]
    if out:
        yield dict(zip(NODE, (np.concatenate(x) for x in zip(*out)))), True
    if not last:
        open_units = [0, rows - 1] if rows > 1 else [0]
        pick = np.concatenate([np.arange(offsets[u], offsets[u + 1]) for u in open_units])
        ends = np.cumsum([0, *(sizes[u] for u in open_units)])
        yield {"offsets": ends, "a": a[pick], "b": b[pick], **{x: v[x][pick] for x in LOAD}}, False


def _peeler(base: int, last: bool):
    def peel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last round needs all paths at once; they are few.
        if last and (held := [b for b in batches if b.num_rows]):
            batches = pa.Table.from_batches(held).combine_chunks().to_batches()
        for batch in batches:
            if not batch.num_rows:
                continue
            for found, is_node in peel_batch(batch, base, last):
                step = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
                load = pa.list_(pa.struct([(x, pa.int64()) for x in LOAD]))
                node = pa.struct([(x, pa.int64()) for x in NODE])
                if is_node:
                    n = len(found["a"])
                    columns = [pa.nulls(n, step), pa.nulls(n, load), _column(NODE, [found[x] for x in NODE])]
                else:
                    ends = pa.array(found["offsets"], pa.int32())
                    n = len(ends) - 1
                    columns = [
                        pa.ListArray.from_arrays(ends, _column("ab", [found["a"], found["b"]])),
                        pa.ListArray.from_arrays(ends, _column(LOAD, [found[x] for x in LOAD])),
                        pa.nulls(n, node),
                    ]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "load", "node"])

    return peel


def peeled(paths: DataFrame, base: int, round_paths: int = ROUND_PATHS) -> DataFrame:
    """Nodes of ``paths (path, load)`` from depth ``base`` on, in rounds of ever fewer tasks."""
    nodes, paths = None, cut_lineage(paths)
    count, first = paths.count(), True
    while True:
        last = count <= round_paths
        if last:
            dealt = paths.coalesce(1)
        elif first:
            dealt = paths.repartitionByRange("path")
        else:
            dealt = paths.repartitionByRange(-(-count // round_paths), "path")
        out = cut_lineage(dealt.sortWithinPartitions("path").mapInArrow(_peeler(base, last), PEELED))
        done = out.filter("node is not null").select("node.*")
        nodes = done if nodes is None else nodes.unionByName(done)
        if last:
            return nodes
        paths = out.filter("node is null").select("path", "load")
        now = paths.count()
        # Two paths leave a task, so rounds end unless a task has only two; then one task ends them.
        round_paths = round_paths if now < count else max(round_paths, now)
        count, first = now, False


def _load(n, c, kids, below, leaves, words) -> Column:
    return F.struct(words.alias("words"), *[x.cast("bigint").alias(y) for x, y in zip((n, c, kids, below, leaves), LOAD[1:])])


def trie(said: DataFrame, convs: DataFrame, segment: int = SEGMENT, round_paths: int = ROUND_PATHS) -> DataFrame:
    """One row per node of the prefixes of ``said (conv_id, at, said, words)``, turns numbered from 1
    without gaps, and ``convs (conv_id, n_turns)``, which may have conversations without turns.

    ``conv_id``, the smallest member, ``depth``, ``parent_conv_id`` (root: null), ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.  No conversations, no nodes.
    """
    convs = cut_lineage(convs)
    longest = convs.agg(F.max("n_turns")).first()[0] or 0
    prefixes = cut_lineage(fingerprints(said, longest))
    zero = F.lit(0).cast("bigint")
    ends = cut_lineage(
        convs.withColumnRenamed("n_turns", "at")
        .join(prefixes, ["conv_id", "at"], "left")
        .select("conv_id", "at", F.coalesce("a", zero).alias("a"), F.coalesce("b", zero).alias("b"))
    )
    ended = cut_lineage(ends.groupBy("a", "b", "at").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("c")))
    root = F.struct(zero.alias("at"), zero.alias("a"), zero.alias("b"), zero.alias("words"))
    nodes = carried = None
    for base in range(max(0, longest - 1) // segment * segment, -1, -segment):
        low, high = base if base else -1, base + segment
        units = ended.filter((F.col("at") > low) & (F.col("at") <= high)).select(
            "n", "c", zero.alias("kids"), zero.alias("below"), zero.alias("leaves")
        )
        if carried is not None:
            units = units.unionByName(carried.select(*units.columns))
        own = prefixes.filter((F.col("at") >= base) & (F.col("at") <= high))
        # Rows of conversations that stand for no sequence are left before they are gathered.
        steps = own.join(units.select(F.col("c").alias("conv_id")), "conv_id", "left_semi").groupBy(
            F.col("conv_id").alias("c")
        ).agg(F.sort_array(F.collect_list(F.struct("at", "a", "b", "words"))).alias("s"))
        whole = F.coalesce("s", F.array().cast("array<struct<at:bigint,a:bigint,b:bigint,words:bigint>>"))
        rows = units.join(steps, "c", "left").withColumn("s", F.concat(F.array(root), whole) if not base else whole)
        loaded = F.transform(
            "s",
            lambda x, i: F.when(
                i == F.size("s") - 1, _load(*[F.col(y) for y in LOAD[1:]], x["words"])
            ).otherwise(_load(zero, F.lit(int(NONE)), zero, zero, zero, x["words"])),
        )
        path = F.transform("s", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b")))
        found = cut_lineage(peeled(rows.select(path.alias("path"), loaded.alias("load")), base, round_paths))
        carried = found.filter(F.col("depth") == base).select("n", "c", "kids", "below", "leaves") if base else None
        found = found.filter(F.col("depth") > base) if base else found
        nodes = found if nodes is None else nodes.unionByName(found)
    parents = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("c").alias("parent_conv_id"))
    parent = F.when(F.col("depth") > 0, F.col("parent_conv_id"))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return (
        nodes.join(parents, ["pa", "pb"], "left")
        .join(digests(ends), ["a", "b"], "left")
        .select(
            F.col("c").alias("conv_id"),
            "depth",
            parent.alias("parent_conv_id"),
            F.col("n").alias("n_convs"),
            F.col("kids").alias("n_children"),
            F.col("leaves").alias("n_leaves"),
            (F.col("below") + (F.col("n") - 1) * F.col("words")).alias("saved_tokens"),
            F.coalesce("sha", nothing).alias("ends_sha256"),
        )
    )


def digests(ends: DataFrame) -> DataFrame:
    """``(a, b, sha)``: SHA-256 of the comma-joined ids of the conversations that end in a node, in
    ascending order.  Ids are joined in chunks of close ids first; chunks run through the hash one by
    one, so a node with any number of ends is never held."""
    ids = F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string"))
    chunks = ends.groupBy("a", "b", F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(F.array_join(ids, ",").alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, out = None, None, []
        for batch in batches:
            for a, b, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                if (a, b) == key:
                    sha.update(b",")
                else:
                    if key is not None:
                        out.append((*key, sha.hexdigest()))
                    key, sha = (a, b), hashlib.sha256()
                sha.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["a", "b", "sha"])
                out = []
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, sha.hexdigest())], names=["a", "b", "sha"])

    return (
        chunks.select("a", "b", "chunk", "ids")
        .repartition("a", "b")
        .sortWithinPartitions("a", "b", "chunk")
        .mapInArrow(hashed, "a bigint, b bigint, sha string")
    )


def prefix_trie(conversations: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """The trie of the conversations rebuilt to share first turns; see ``rebuilt`` and ``trie``."""
    return trie(*rebuilt(turns(conversations), group, heads))


SQL = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, max(pos) AS n, xor(4294967295, list_reduce(
        list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
        lambda c, x: list_reduce(range(8)::BIGINT[], lambda r, i: xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384 ELSE 0 END),
                                 xor(c, x)), 4294967295::BIGINT)) % 4 AS h FROM t GROUP BY conv_id),
k AS (SELECT c.conv_id, c.h, least(c.h, coalesce(b.n, 0)) AS k, c.conv_id - c.conv_id % 20 AS base
      FROM n c LEFT JOIN n b ON b.conv_id = c.conv_id - c.conv_id % 20),
r AS (SELECT conv_id, pos - h + k AS pos, role, text FROM t JOIN k USING (conv_id) WHERE pos > h
      UNION ALL SELECT k.conv_id, t.pos, role, text FROM t JOIN k ON t.conv_id = base AND t.pos <= k),
s AS (SELECT conv_id, pos, text, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER
        (PARTITION BY conv_id ORDER BY pos) AS p FROM r
      UNION ALL SELECT conv_id, 0, '', '' FROM k),
d AS (SELECT p, pos, min(conv_id) AS c, count(*) AS n, len(regexp_extract_all(any_value(text), '[^\x20\x09-\x0D]+')) AS words
      FROM s GROUP BY p, pos),
u AS (SELECT x.c, x.pos, x.p, x.n, x.words, y.p AS up, y.c AS uc FROM d x
      LEFT JOIN s z ON z.conv_id = x.c AND z.pos = x.pos - 1 LEFT JOIN d y ON y.p = z.p AND y.pos = z.pos),
f AS (SELECT up AS p, pos - 1 AS pos, count(*) AS kids FROM u WHERE pos > 0 GROUP BY up, pos),
v AS (SELECT u.*, coalesce(kids, 0) AS kids FROM u LEFT JOIN f USING (p, pos)),
b AS (SELECT s.p, s.pos, sum(CASE WHEN v.kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((v.n - 1) * v.words) AS saved
      FROM v JOIN s ON s.conv_id = v.c AND s.pos <= v.pos GROUP BY s.p, s.pos),
e AS (SELECT p, pos, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM s
      JOIN (SELECT conv_id, max(pos) AS pos FROM s GROUP BY conv_id) USING (conv_id, pos) GROUP BY p, pos)
SELECT c AS conv_id, pos::BIGINT AS depth, uc AS parent_conv_id, n::BIGINT AS n_convs, kids::BIGINT AS n_children,
       leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM v JOIN b USING (p, pos) LEFT JOIN e USING (p, pos)"""
