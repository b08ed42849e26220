"""Exact removal of long passages that stand in an earlier document.

Positions are indexed sparsely: of the ``LONG - GRAM + 1`` grams of a ``LONG``-byte string the
one with the smallest hash is its anchor, so equal strings have equal anchors.  The strings
that share an anchor overlap and form its context.  A batch of documents sorts the suffixes
at its anchors (by a digest of the gram, then of the context, as only equality matters) and
sends each distinct one with its smallest document to the bucket of its gram.  There the
batches' suffix arrays enter a logarithmic index family: an array is a level of its own until
a level of equal size stands beside it, and the two merge.  All batches of a bucket are put in and
its levels merged before any batch is answered, so a batch is looked up in the whole index, not
scanned against the levels there before it; the smallest document decides, whatever the order.

A context known from an earlier document is removed whole.  Where a gram stands in several
contexts (the ends of a common passage), the strings of each context's first document are
compared one by one in the same way.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartweave.llm import batches as B
from chartweave.llm import kernels

LONG = 50
GRAM = 20
CHUNK = 200_000

ASKED = {"key": np.uint64, "ctx": np.uint32, "doc": np.int64}
TOLD = {"key": np.uint64, "ctx": np.uint32, "doc": np.int64, "several": np.uint8}
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
#: Added to the bucket numbers of the second round, to tell its answers apart.
SECOND = 1 << 30


def _grams(lanes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``GRAM`` bytes at each of ``n`` positions."""
    h = lanes[:n] * kernels.C1
    h ^= lanes[8 : n + 8] * kernels.C2
    h ^= h >> np.uint64(29)
    h += lanes[GRAM - 8 : n + GRAM - 8] * kernels.C3
    h ^= h >> np.uint64(32)
    h *= kernels.C2
    return h


def anchors(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of strings with one anchor: ``row``, first and last start (``lo``, ``hi``), the
    anchor's ``key`` and the context's digest ``ctx``."""
    padded = np.concatenate([data, np.zeros(LONG + 16, np.uint8)])
    lanes = np.ndarray((len(data) + LONG + 8,), "<u8", padded, strides=(1,))
    span = LONG - GRAM + 1
    out: dict[str, list] = {"row": [], "lo": [], "hi": [], "key": [], "ctx": []}
    ends = offsets[1:]
    for lo in range(0, len(data), CHUNK):
        n = min(CHUNK, len(data) - lo)
        grams = _grams(lanes[lo:], n + span - 1)
        low = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[:n], low[span - width : span - width + n])
        at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        row = np.searchsorted(ends, np.array([lo, lo + n - 1]), "right")
        cut = np.concatenate([[0], offsets[row[0] + 1 : row[1] + 1] - lo, [n]])
        rows = np.repeat(np.arange(row[0], row[1] + 1), np.diff(cut))
        fits = np.arange(lo, lo + n) + LONG <= ends[rows]
        first = np.zeros(n, bool)
        first[0] = True
        first[1:] = (at[1:] != at[:-1]) | (rows[1:] != rows[:-1])
        starts = np.flatnonzero(first & fits)
        if not len(starts):
            continue
        # A run ends before the next one starts, or where strings do not fit any more.
        next_first = np.append(np.flatnonzero(first), n)
        stop = next_first[np.searchsorted(next_first, starts, "right")]
        last = np.minimum(stop - 1, ends[rows[starts]] - LONG - lo)
        out["row"].append(rows[starts])
        out["lo"].append(starts + lo)
        out["hi"].append(last + lo)
        out["key"].append(kernels.mix(grams[at[starts]]))
        out["ctx"].append(_contexts(grams, starts, last, at[starts]))
    kinds = {"row": np.int64, "lo": np.int64, "hi": np.int64, "key": np.uint64, "ctx": np.uint32}
    return {c: np.concatenate(v) if v else np.zeros(0, kinds[c]) for c, v in out.items()}


def _contexts(grams: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Digest of the ``LONG`` to ``LONG + span - 1`` bytes of each run's strings and of the anchor's
    place in them, from the grams that cover the bytes."""
    end = hi + LONG - GRAM
    shape = ((hi - lo) * LONG + at - lo).astype(np.uint64)
    h = kernels.mix(grams[lo] + grams[lo + GRAM] * kernels.C1)
    h ^= grams[np.minimum(lo + 2 * GRAM, end)] * kernels.C3
    h += grams[end] * kernels.C2
    h += shape * kernels.C1
    return (kernels.mix(h) >> np.uint64(32)).astype(np.uint32)


def _string_hashes(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Hash of the ``LONG`` bytes from each start."""
    lanes = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    h = np.full(len(start), kernels.C1, np.uint64)
    for i, at in enumerate((*range(0, LONG - 8, 8), LONG - 8)):
        h += lanes[start + at] * (kernels.C2, kernels.C3)[i % 2]
        h ^= h >> np.uint64(29)
        h *= kernels.C1
        h ^= h >> np.uint64(32)
    return kernels.mix(h)


def _sorted(key: np.ndarray, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by key, then context, and where in it an entry is met first.  Keys are sorted alone;
    contexts only where entries of one key differ in them."""
    order = np.argsort(key)
    k, c = key[order], ctx[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    other = np.zeros(len(k), bool)
    other[1:] = ~new[1:] & (c[1:] != c[:-1])
    if other.any():
        run = np.cumsum(new) - 1
        mixed = np.zeros(run[-1] + 1, bool)
        mixed[run[other]] = True
        at = np.flatnonzero(mixed[run])
        order[at] = order[at][np.lexsort((c[at], run[at]))]
        c = ctx[order]
        new[1:] |= c[1:] != c[:-1]
    return order, np.flatnonzero(new)


def distinct(e: dict[str, np.ndarray], last: bool = False) -> dict[str, np.ndarray]:
    """Entries sorted by key and context, each once, with the smallest document, and with ``last``
    the largest one too."""
    order, first = _sorted(e["key"], e["ctx"])
    doc, kept = e["doc"][order], order[first]
    out = {"key": e["key"][kept], "ctx": e["ctx"][kept], "doc": np.minimum.reduceat(doc, first) if len(first) else doc}
    return out | {"last": np.maximum.reduceat(doc, first) if len(first) else doc} if last else out


def _joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {c: np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, k) for c, k in ASKED.items()}


class Family:
    """Sorted suffix arrays in levels of geometrically growing size."""

    def __init__(self):
        self.levels: list[tuple[int, dict[str, np.ndarray]]] = []

    def add(self, array: dict[str, np.ndarray]) -> None:
        level = (0, array)
        while self.levels and self.levels[-1][0] == level[0]:
            rank, older = self.levels.pop()
            level = (rank + 1, distinct(_joined([older, level[1]])))
        self.levels.append(level)

    def whole(self) -> dict[str, np.ndarray]:
        """All levels merged, the small ones first."""
        while len(self.levels) > 1:
            rank, newer = self.levels.pop()
            _, older = self.levels.pop()
            self.levels.append((rank, distinct(_joined([older, newer]))))
        return self.levels[0][1] if self.levels else {c: np.zeros(0, k) for c, k in ASKED.items()}


class _Places:
    """Places of entries in ``index``, which is sorted by key and context: by key where a key has one
    context, by a code of both where it has several."""

    def __init__(self, index: dict[str, np.ndarray]):
        self.key, self.ctx = index["key"], index["ctx"]
        same = self.key[1:] == self.key[:-1]
        self.several = np.zeros(len(self.key), bool)
        self.several[1:] |= same
        self.several[:-1] |= same
        self.at = np.flatnonzero(self.several)
        code = self._code(self.key[self.at], self.ctx[self.at])
        order = np.argsort(code)
        self.at, self.code = self.at[order], code[order]

    @staticmethod
    def _code(key: np.ndarray, ctx: np.ndarray) -> np.ndarray:
        return kernels.mix(key ^ ctx.astype(np.uint64) * kernels.C3)

    def of(self, e: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The place of each entry, and whether it is there."""
        at, known = B.look_up(self.key, e["key"])
        if not len(self.key):
            return at, known
        more = np.flatnonzero(known & self.several[at])
        known &= self.ctx[at] == e["ctx"]
        if len(more):
            found, known[more] = B.look_up(self.code, self._code(e["key"][more], e["ctx"][more]))
            at[more] = self.at[found]
        return at, known


def _reply(questions: list[B.Question]) -> list[B.Question]:
    """Of each batch's entries those that matter: known from an earlier document than the
    batch's first, or of a gram with several contexts; and those that later documents of the
    batch may repeat."""
    family = Family()
    for q in questions:
        family.add({c: q[c] for c in ASKED})
    index = family.whole()
    if not len(index["key"]):
        return [q | {"several": np.zeros(0, np.uint8)} for q in questions]
    places = _Places(index)
    several = places.several
    out = []
    for q in questions:
        at, _ = places.of(q)
        keep = several[at] | (index["doc"][at] < q["doc"]) | (q["again"] > 0)
        out.append(
            {
                "key": q["key"][keep],
                "ctx": q["ctx"][keep],
                "doc": index["doc"][at][keep],
                "several": several[at][keep].astype(np.uint8),
            }
        )
    return out


def _found(part: pa.RecordBatch) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    data, offsets = kernels.buffers(part.column("text"))
    e = anchors(data, offsets)
    e["doc"] = part.column("doc_id").to_numpy()[e["row"]]
    return e, data, offsets


SENT = ASKED | {"again": np.uint8}


def _suffixes(table: pa.Table) -> B.Question:
    """Distinct entries of a batch; ``again`` marks those of several of its documents."""
    e = distinct(_joined([_found(part)[0] for _, part in B.rows_of(table)]), last=True)
    return e | {"again": (e.pop("last") > e["doc"]).astype(np.uint8)}


def _strings(e: dict[str, np.ndarray], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the strings of the chosen runs, and their documents."""
    n = e["hi"][chosen] - e["lo"][chosen] + 1
    return kernels.gather(e["lo"][chosen], n), np.repeat(e["doc"][chosen], n)


def _looked_up(e: dict[str, np.ndarray], told: B.Question, places: _Places) -> tuple[np.ndarray, np.ndarray]:
    """Whether each run is known from an earlier document, and whether its strings are to be
    compared one by one."""
    at, known = places.of(e)
    first = told["doc"][at] if len(told["key"]) else e["doc"]
    several = told["several"][at] > 0 if len(told["key"]) else known
    earlier = known & (first < e["doc"])
    return earlier, known & ~earlier & several


class _Part:
    """Runs of some documents of a batch, and the strings to be compared one by one."""

    def __init__(self, part: pa.RecordBatch, answers: B.Question, places: _Places):
        self.e, self.data, self.offsets = _found(part)
        self.ids = part.column("doc_id")
        self.earlier, single = _looked_up(self.e, answers, places)
        self.start, self.doc = _strings(self.e, np.flatnonzero(single))
        self.h = _string_hashes(self.data, self.start)

    def strings(self) -> dict[str, np.ndarray]:
        return {"key": self.h, "ctx": np.zeros(len(self.h), np.uint32), "doc": self.doc}


def _parts(table: pa.Table, answers: B.Question) -> tuple[list[_Part], dict[str, np.ndarray]]:
    """A batch's parts, and its distinct strings with their smallest documents."""
    places = _Places(answers)
    parts = [_Part(part, answers, places) for _, part in B.rows_of(table)]
    return parts, distinct(_joined([p.strings() for p in parts]))


def _second(buckets: int):
    def ask(table: pa.Table, told: pa.Table) -> pa.Table:
        _, asked = _parts(table, B.gathered(told, TOLD))
        batch = table.column("batch")[0].as_py()
        return B.to_table(list(B.to_blocks(batch, asked, ASKED, buckets)), ASKED)

    return ask


def _second_reply(questions: list[B.Question]) -> list[B.Question]:
    """Whether each string starts in a document before the batch's first, in the order asked."""
    index = distinct(_joined(questions))
    out = []
    for q in questions:
        first = index["doc"][np.searchsorted(index["key"], q["key"])]
        none = {c: np.zeros(0, k) for c, k in ASKED.items()}
        out.append(none | {"several": (first < q["doc"]).astype(np.uint8)})
    return out


def _cut(table: pa.Table, told: pa.Table) -> pa.Table:
    second = told.column("bucket").to_numpy() >= SECOND
    runs = B.gathered(told.filter(pa.array(~second)), TOLD)
    before = B.gathered(told.filter(pa.array(second)), TOLD)["several"] > 0
    parts, asked = _parts(table, runs)
    columns: list[list] = [[] for _ in range(5)]
    for p in parts:
        e, data, offsets = p.e, p.data, p.offsets
        at = np.searchsorted(asked["key"], p.h)
        again = p.start[before[at] | (asked["doc"][at] < p.doc)]
        edge = np.zeros(len(data) + 1, np.int32)
        for lo, hi in ((e["lo"][p.earlier], e["hi"][p.earlier] + LONG), (again, again + LONG)):
            edge += np.bincount(lo, minlength=len(edge)).astype(np.int32)
            edge -= np.bincount(hi, minlength=len(edge)).astype(np.int32)
        gone = np.cumsum(edge[:-1]) > 0
        for doc_id, a, b in zip(p.ids.to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
            own = gone[a:b]
            kept = data[a:b][~own] if own.any() else data[a:b]
            spans = int(np.count_nonzero(own[1:] & ~own[:-1])) + int(own[:1].sum())
            values = (doc_id, b - a, int(own.sum()), spans, hashlib.sha256(kept.tobytes()).hexdigest())
            for c, v in zip(columns, values):
                c.append(v)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds)})


def deduplicate(docs: DataFrame, batch_bytes: int = B.BATCH_BYTES) -> DataFrame:
    """What is left of every row of ``docs (doc_id, text)`` after removing each byte covered by
    a 50-byte string that also starts in a row with a smaller ``doc_id``.

    A null text is empty.  Rows that repeat an id do not remove from each other.  Rows with a
    null id lose nothing and remove nothing.  Texts under 50 bytes stay as they are.  Other
    columns are not looked at.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    named = rows.filter("doc_id is not null")
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // batch_bytes))
    batch = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(n)).cast("int")
    dealt = named.withColumn("batch", batch)
    told = B.answer(B.ask(dealt, _suffixes, SENT, n), SENT, _reply, TOLD)
    strings = dealt.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(_second(n), B.blocks_of(ASKED))
    second = B.answer(strings, ASKED, _second_reply, TOLD).withColumn("bucket", F.col("bucket") + SECOND)
    both = told.unionByName(second)
    cut = dealt.groupBy("batch").cogroup(both.groupBy("batch")).applyInArrow(_cut, RESULT)
    zero = F.lit(0).cast("long")
    bare = rows.filter("doc_id is null").select(
        "doc_id", F.octet_length("text").cast("long"), zero, zero, F.sha2(F.col("text").cast("binary"), 256)
    )
    return cut.union(bare)
