"""Toxicity by the nearest labelled examples, with the examples as evidence.

Terms are whole words and the beginnings of words (4 to 8 bytes), as stems carry the sense in
some languages.  Terms are chosen on a bounded sample of labelled rows, by how much oftener they
stand in toxic examples; toxic examples that already have such terms no longer speak for others,
so the words that near copies share by chance do not enter.  A document is the TF-IDF vector of the
chosen terms, with document frequencies counted over all documents.

The examples form an inverted index in blocks of 64, with the largest weight of each term in each
block.  A query visits blocks in order of their bound, the sum of its weights times the blocks'
largest, and ends when no bound reaches the worst of the nearest found: the result is exact.  Each
neighbour votes with its cosine; a logistic curve, fitted on the votes that each example gets from
the others, turns votes into probabilities.  Documents without a chosen term have no neighbours and
get the share of toxic ones among such examples.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartweave.llm import kernels
from chartweave.session import cut_lineage

#: Labelled rows that examples are taken from (by smallest hash of id), and examples, at most.
LABELLED = 16384
SAMPLE = 8192
#: Terms considered and terms used, at most.
CANDIDATES = 2048
TERMS = 512
#: Toxic examples with a term, and standard deviations above chance, at least.
LEAST_TOXIC = 4
LEAST_Z = 4.0
#: So many of a toxic example's terms are chosen before it stops to speak for more.
COVER = 4
NEAREST = 15
EVIDENCE = 5
BLOCK = 64
#: Weight of the sample's toxic share in a vote.
PRIOR = 1.0
THRESHOLD = 0.3

PREFIXES = (4, 5, 6, 7, 8)
# Letters in lower case, every other character a space.
LETTERS = np.full(256, 0x20, np.uint8)
LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)
LETTERS[0x80:] = np.arange(0x80, 0x100)
WHOLE = np.uint64(0xA5A5A5A5A5A5A5A5)


def fold(id_col: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; a null id falls in fold 0."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4, F.lit(0))


def word_hashes(column: pa.Array):
    """Letters of a text column, starts, ends and hashes of its words, and the row of each."""
    data, offsets = kernels.buffers(column)
    data = LETTERS[data]
    starts, ends, first = kernels.words(data, offsets)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return data, starts, ends, kernels.span_hashes(data, starts, ends), rows


def term_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, whole: np.ndarray):
    """``(word, term)`` for all terms of words."""
    words, terms = [np.arange(len(starts))], [whole ^ WHOLE]
    for size in PREFIXES:
        longer = np.flatnonzero(ends - starts >= size)
        words.append(longer)
        terms.append(kernels.span_hashes(data, starts[longer], starts[longer] + size))
    return np.concatenate(words), np.concatenate(terms)


def sketches(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two min-wise hashes of the word pairs of each row; rows with fewer than two words agree."""
    _, _, _, h, rows = word_hashes(column)
    out = np.full((2, len(column)), np.uint64(2**64 - 1))
    if len(h) > 1:
        pair = kernels.shingle_hashes(h, 2)
        same = np.flatnonzero(rows[1:] == rows[:-1])
        for i, salt in enumerate((kernels.C2, kernels.C3)):
            np.minimum.at(out[i], rows[same], kernels.mix(pair[same] ^ salt))
    return out[0].view(np.int64), out[1].view(np.int64)


def vectors(column: pa.Array, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, term, count)`` of the terms of ``vocabulary``, sorted hashes, in each row."""
    data, starts, ends, h, rows = word_hashes(column)
    none = np.zeros(0, np.int64)
    if not len(h) or not len(vocabulary):
        return none, none, none
    _, at, back = np.unique(h, return_index=True, return_inverse=True)
    word, term = term_hashes(data, starts[at], ends[at], h[at])
    place = np.minimum(np.searchsorted(vocabulary, term), len(vocabulary) - 1)
    known = vocabulary[place] == term
    word, place = word[known], place[known]
    order = np.argsort(word, kind="stable")
    word, place = word[order], place[order]
    n_of = np.bincount(word, minlength=len(at))
    first = np.cumsum(n_of) - n_of
    hit = np.flatnonzero(n_of[back] > 0)
    many = n_of[back[hit]]
    got = place[kernels.gather(first[back[hit]], many)]
    code, count = np.unique(np.repeat(rows[hit], many) * len(vocabulary) + got, return_counts=True)
    return code // len(vocabulary), code % len(vocabulary), count


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in kernels.slices(whole, "text"):
            m1, m2 = sketches(b.column("text"))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("y"), b.column("key"), pa.array(m1), pa.array(m2)], names=["id", "y", "key", "m1", "m2"]
            )


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and toxic rows with each term."""
    for whole in batches:
        for b in kernels.slices(whole, "text"):
            data, starts, ends, h, rows = word_hashes(b.column("text"))
            toxic = b.column("y").to_numpy(zero_copy_only=False).astype(bool)
            order = np.lexsort((h, rows))
            new = np.ones(len(h), bool)
            new[1:] = (h[order][1:] != h[order][:-1]) | (rows[order][1:] != rows[order][:-1])
            once = order[new]
            word, term = term_hashes(data, starts[once], ends[once], h[once])
            row = rows[once][word]
            order = np.lexsort((row, term))
            term, row = term[order], row[order]
            new = np.ones(len(term), bool)
            new[1:] = (term[1:] != term[:-1]) | (row[1:] != row[:-1])
            found, back = np.unique(term[new], return_inverse=True)
            n = np.bincount(back, minlength=len(found))
            t = np.bincount(back, toxic[row[new]], len(found)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n), pa.array(t)], names=["term", "n", "toxic"])


def _lists(found, rows: int) -> list[pa.Array]:
    row, term, count = found
    ends = pa.array(np.searchsorted(row, np.arange(rows + 1)), pa.int32())
    return [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (term, count)]


def vectorised(rows: DataFrame, keep: list[str], vocabulary: np.ndarray) -> DataFrame:
    """``keep`` columns of ``rows`` with ``terms``, places in the vocabulary, and their ``counts``."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in kernels.slices(whole, "text"):
                lists = _lists(vectors(b.column("text"), shared.value), b.num_rows)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *lists], names=[*keep, "terms", "counts"])

    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep]
    return rows.select(*keep, "text").mapInArrow(made, ", ".join([*kinds, "terms array<int>", "counts array<int>"]))


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, labelled: int = LABELLED) -> DataFrame:
    """``(id, text, y)``: at most ``most`` labelled rows outside fold 2, one of each group of near
    copies.  Null labels and labels other than 0 and 1 are left out; of labels that repeat for an id
    the larger one counts."""
    chosen = (
        labels.select(F.col("doc_id").alias("id"), F.col("toxic").alias("y"))
        .filter((fold("id") != 2) & F.col("y").isin(0, 1) & F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.max("y").cast("int").alias("y"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(labelled)
    )
    own = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    # ``chosen`` and ``kept`` are bounded by the limits, so they are broadcast.
    known = own.join(F.broadcast(chosen), "id").withColumn("key", F.xxhash64("text"))
    marked = known.select("id", "y", "key", "text").mapInArrow(_sketched, "id bigint, y int, key bigint, m1 bigint, m2 bigint")
    pick = F.min(F.struct(F.xxhash64("id").alias("o"), "id", "key", "y", "m1", "m2")).alias("r")
    once = marked.groupBy("m1").agg(pick).select("r.*").groupBy("m2").agg(pick).select("r.*")
    kept = cut_lineage(once.orderBy("o", "id", "key").limit(most).select("id", "key", "y"))
    return own.join(F.broadcast(kept), "id").filter(F.xxhash64("text") == F.col("key")).dropDuplicates(["id", "key"]).select("id", "text", "y")


def covering(terms: list[np.ndarray], clean: np.ndarray, share: float, most: int = TERMS) -> np.ndarray:
    """Terms chosen one by one, each the one that stands furthest above chance in the toxic
    examples (``terms`` of each) that have fewer than ``COVER`` chosen terms; ``clean`` counts the
    other examples with a term."""
    docs = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
    flat = np.concatenate(terms) if terms else np.zeros(0, np.int64)
    order = np.argsort(flat, kind="stable")
    docs_of, ends = docs[order], np.searchsorted(flat[order], np.arange(len(clean) + 1))
    gain = np.bincount(flat, minlength=len(clean)).astype(np.int64)
    covered, free, chosen = np.zeros(len(terms), int), np.ones(len(clean), bool), []
    while len(chosen) < most and len(clean):
        n = gain + clean
        z = np.where(free & (gain >= LEAST_TOXIC), (gain - n * share) / np.sqrt(n * share * (1 - share) + 1e-9), 0)
        best = int(np.argmax(z))
        if z[best] < LEAST_Z:
            break
        chosen.append(best)
        free[best] = False
        for d in docs_of[ends[best] : ends[best + 1]]:
            covered[d] += 1
            if covered[d] == COVER:
                gain[terms[d]] -= 1
    return np.array(sorted(chosen), np.int64)


def _weights(terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vector."""
    w = (1 + np.log(counts)) * idf[terms]
    return w / np.sqrt((w * w).sum())


def built(rows: list[tuple[int, int, np.ndarray, np.ndarray]], idf: np.ndarray) -> dict:
    """Block-max index of examples ``(id, y, terms, counts)``, as plain arrays.

    Examples with the same heaviest term lie side by side, which keeps the blocks' bounds low.
    """
    full = [(r, _weights(r[2], r[3], idf)) for r in rows if len(r[2])]
    full.sort(key=lambda x: (int(x[0][2][np.argmax(x[1])]), x[0][0]))
    example = np.repeat(np.arange(len(full)), [len(w) for _, w in full])
    term = np.concatenate([r[2] for r, _ in full]) if full else np.zeros(0, np.int64)
    weight = np.concatenate([w for _, w in full]) if full else np.zeros(0)
    blocks = -(-len(full) // BLOCK)
    order = np.lexsort((example, term))
    example, term, weight = example[order], term[order], weight[order]
    cell = term * blocks + example // BLOCK
    top = np.zeros(len(idf) * blocks)
    np.maximum.at(top, cell, weight)
    empty = [r[1] for r in rows if not len(r[2])]
    share = (sum(r[1] for r in rows) + 0.5) / (len(rows) + 1) if rows else 0.0
    index = {
        "idf": idf,
        "ids": np.array([r[0] for r, _ in full], np.int64),
        "y": np.array([r[1] for r, _ in full], float),
        "example": example,
        "weight": weight,
        "at": np.searchsorted(cell, np.arange(len(idf) * blocks + 1)),
        "top": top.reshape(len(idf), blocks),
        "share": share,
        "empty": (sum(empty) + share) / (len(empty) + 1),
        "curve": (1.0, 0.0),
    }
    # Each example's vote by the others; the labels of examples without terms are one vote.
    votes = [vote(index, search(index, r[2], w, without=i)) for i, (r, w) in enumerate(full)]
    n = len(empty)
    votes += [(sum(empty) - y + share) / n for y in empty] if n else []
    index["curve"] = calibrated(np.array(votes), np.array([*index["y"], *empty], float))
    return index


def search(index: dict, terms: np.ndarray, weights: np.ndarray, k: int = NEAREST, without: int = -1):
    """``(example, cosine)`` of the ``k`` nearest examples that share a term, exactly; ties go to
    the smaller id."""
    blocks = index["top"].shape[1]
    if not len(terms) or not blocks:
        return []
    bound = weights @ index["top"][terms]
    best: list[tuple[float, int, int]] = []
    for b in np.argsort(-bound, kind="stable"):
        if bound[b] <= 0 or len(best) == k and bound[b] < best[-1][0] * -1 - 1e-9:
            break
        scores = np.zeros(BLOCK)
        for t, w in zip(terms.tolist(), weights.tolist()):
            a, z = index["at"][t * blocks + b], index["at"][t * blocks + b + 1]
            scores[index["example"][a:z] - b * BLOCK] += w * index["weight"][a:z]
        for i in np.flatnonzero(scores):
            e = int(b * BLOCK + i)
            if e != without:
                best.append((-float(scores[i]), int(index["ids"][e]), e))
        best = sorted(best)[:k]
    return [(e, -s) for s, _, e in best]


def vote(index: dict, near: list[tuple[int, float]]) -> float:
    """Share of toxic examples among the nearest, each weighing its cosine."""
    total = sum(s for _, s in near) + PRIOR
    return (sum(s * index["y"][e] for e, s in near) + PRIOR * index["share"]) / total


def calibrated(votes: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (0 or more) and offset of the logistic curve from the votes' log odds."""
    if len(np.unique(y)) < 2:
        return 1.0, 0.0
    x = _odds(votes)
    p = np.array([1.0, 0.0])
    columns = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(columns @ p, -30, 30)))
        slope = columns.T @ (q - y) + 0.1 * (p - [1.0, 0.0])
        bend = (columns * (q * (1 - q))[:, None]).T @ columns + 0.1 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        p = p - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(p[0], 0.0)), float(p[1])


def _odds(votes):
    v = np.clip(votes, 1e-6, 1 - 1e-6)
    return np.log(v / (1 - v))


def trained(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[np.ndarray, list]:
    """The vocabulary, and the examples as ``(id, y, terms, counts)``; all bounded by the limits."""
    rows = cut_lineage(sample(docs, labels, most))
    n, toxic = rows.agg(F.count(F.lit(1)), F.sum("y")).first()
    share = (toxic or 0) / n if n else 0.0
    z = (F.col("toxic") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share) + F.lit(1e-9))
    stats = (
        rows.mapInArrow(_counted, "term bigint, n bigint, toxic bigint")
        .groupBy("term")
        .agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
        .filter(F.col("toxic") >= LEAST_TOXIC)
        .withColumn("z", z)
        .filter(F.col("z") >= LEAST_Z)
        .orderBy(F.desc("z"), "term")
        .limit(CANDIDATES)
        .collect()
    )
    found = sorted((np.int64(r["term"]).view(np.uint64), r["n"] - r["toxic"]) for r in stats)
    candidates = np.array([t for t, _ in found], np.uint64)
    clean = np.array([c for _, c in found], np.int64)
    bad = vectorised(rows.filter("y = 1"), ["id"], candidates).collect() if found else []
    chosen = covering([np.array(r["terms"], np.int64) for r in bad], clean, share)
    vocabulary = candidates[chosen]
    examples = vectorised(rows, ["id", "y"], vocabulary).collect()
    return vocabulary, sorted(
        ((r["id"], r["y"], np.array(r["terms"], np.int64), np.array(r["counts"], np.int64)) for r in examples),
        key=lambda r: (r[0], r[1], r[2].tolist(), r[3].tolist()),
    )


def toxicity(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """``(doc_id, score, predicted, evidence)`` for every row of ``docs (doc_id, text)``.

    ``evidence`` has the ids and cosines of the nearest examples.  Null and empty texts are scored
    as documents without a chosen term; rows that repeat an id are scored each, null ids too;
    without labels every score is 0.  Texts are read whole and once for scoring; other columns are
    not looked at.
    """
    vocabulary, examples = trained(docs, labels, most)
    rows = cut_lineage(vectorised(docs.select("doc_id", "text"), ["doc_id"], vocabulary))
    n = rows.count()
    df = np.zeros(len(vocabulary))
    for r in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[r["t"]] = r["count"]
    shared = rows.sparkSession.sparkContext.broadcast(built(examples, np.log((1 + n) / (1 + df)) + 1))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known = shared.value, {}
        for b in batches:
            terms, counts = b.column("terms").to_pylist(), b.column("counts").to_pylist()
            out = []
            for t, c in zip(terms, counts):
                key = (tuple(t), tuple(c))
                if key not in known:
                    if len(known) > 50_000:
                        known.clear()
                    at = np.array(t, np.int64)
                    near = search(index, at, _weights(at, np.array(c, np.int64), index["idf"])) if t else []
                    v = vote(index, near) if t else index["empty"]
                    slope, offset = index["curve"]
                    score = float(1 / (1 + np.exp(-(slope * _odds(v) + offset)))) if index["share"] else 0.0
                    known[key] = score, [{"doc_id": int(index["ids"][e]), "cosine": s} for e, s in near[:EVIDENCE]]
                out.append(known[key])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array([s for s, _ in out], pa.float64()),
                    pa.array([int(s >= THRESHOLD) for s, _ in out], pa.int32()),
                    pa.array([e for _, e in out], pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64())]))),
                ],
                names=["doc_id", "score", "predicted", "evidence"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scored, f"doc_id {kind}, score double, predicted int, evidence array<struct<doc_id:bigint,cosine:double>>")
