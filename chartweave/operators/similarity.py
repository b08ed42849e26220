"""Nearest users and ROC curves of the user ranking, without a table of pairs.

Every user is ranked against every other one, so the arithmetic is quadratic; the
rows are not.  Users are packed into blocks of vectors, and blocks into groups that
fill a task's memory.  A task holds one group and candidate blocks stream past it, so
a block is copied once per group.  Groups that are much smaller than a task's memory are
held together, as many as leave every core a few, so copies follow memory and cores.
Groups are numbered and dealt to tasks by their number, as hashes of a few keys collide.

For neighbours the blocks are neighbourhoods: a user goes to the nearest of some pivot
users, and a block knows its centre and its radius on the sphere.  Two blocks cannot
hold a pair closer than their centres' angle less both radii.  Once each group has
searched itself, the block pairs whose bound is below the scores found already never
meet, and a task keeps running best lists, visits what is left by descending bound and
skips what has fallen behind since.  Products are taken in single precision first, and those that
their error leaves a place in a list again in double.  Only the best ``k`` of a user leave a task.

A ROC curve takes the scores of all candidates.  Where a task's candidates fit a worker's memory it
holds them: the scores of a few users are sorted, and counts at the grid points are places in the
order.  Beyond that, exact counts are needed only near the grid points, so candidates pass three
times: scores are counted in coarse bins first, then in middle bins of the few coarse ones where a
grid point falls, then singly in the few middle ones.  A user's counts are bounded by the grid,
however many candidates pass.

A score is the cosine rounded to six decimals and held as an integer in
millionths, about the precision of a float32 vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartweave.session import cut_lineage

SCALE = 1_000_000
COARSE = 1_000
GRID = 100
BLOCK_ROWS = 2_000
#: Users a task holds; of vectors, and for curves of vectors and score counts.
GROUP_ROWS = 64_000
CURVE_ROWS = 8_000
#: Vectors of a task's candidates that a worker holds for curves, and scores that it sorts at a time.
HELD_BYTES = 128 << 20
SORT_BYTES = 32 << 20
#: Groups that each core gets, so that the last ones do not keep the others waiting.
TURNS = 4
#: Users whose vectors are the pivots of neighbourhoods.
PIVOTS = 256
# Query rows multiplied at a time: bounds the score matrix held by a task.
STRIPE = 256
# Candidates that meet the lists of a group before these are brought up to date.
BATCH_ROWS = 8_000
# Pairs multiplied in double precision at a time.
SLICE = 100_000
# Scores are rounded, so a bound this close (in millionths) may still be reached.
MARGIN = 2


def _sized(users: DataFrame, by: list[str], rows: int) -> DataFrame:
    """``users`` with ``chunk``, a hash that deals each group of ``by`` to chunks of about
    ``rows`` users, however the ids are skewed, and ``chunks``, their number."""
    sizes = users.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("chunks"))
    return users.join(sizes, by).withColumn("chunk", F.pmod(F.xxhash64("user"), F.col("chunks")).cast("int"))


def _together(groups, users, limit: int, cores: int):
    """How many of a task's ``groups`` are held together: as many as leave each core one, and no more
    than ``limit`` users hold."""
    return F.ceil(groups / F.greatest(F.ceil(users / limit), F.least(groups, F.lit(cores)), F.lit(1)))


def _packed(placed: DataFrame) -> DataFrame:
    """``(task, block, group, groups, ids, ys, flat)``: the users of a block side by side."""
    keys = ["task", "block", "group", "groups"]
    members = F.sort_array(F.collect_list(F.struct("user", "y", "vec")))
    return placed.groupBy(*keys).agg(members.alias("m")).select(
        *keys, F.col("m.user").alias("ids"), F.col("m.y").alias("ys"), F.flatten("m.vec").alias("flat")
    )


def _narrowed(packed: DataFrame) -> DataFrame:
    """``packed``, written already, with vectors of floats where doubles say no more."""
    wider = F.exists("flat", lambda x: x.cast("float").cast("double") != x)
    return packed if packed.filter(wider).limit(1).count() else packed.withColumn("flat", F.col("flat").cast("array<float>"))


def _groups(packed: DataFrame) -> list:
    """``(task, group, groups)`` of all groups, a few numbers for the driver; ``packed`` is written already."""
    return packed.select("task", "group", "groups").distinct().orderBy("task", "group").collect()


def _dealt(rows: DataFrame, groups: list, *order: str) -> DataFrame:
    """Rows of the ``groups`` of tasks in order, the groups dealt to partitions one by one.  The number of
    partitions is fixed, as the bytes of a key say little about its arithmetic; never more than there are
    groups, as a Python worker for nothing costs its start."""
    spark = rows.sparkSession
    n = max(1, min(len(groups), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    numbers = [(r["task"], r["group"], i % n) for i, r in enumerate(groups)]
    numbered = spark.createDataFrame(numbers, "task string, group int, _part int")
    placed = rows.join(F.broadcast(numbered), ["task", "group"]).repartitionById(n, "_part")
    return placed.drop("_part").sortWithinPartitions("task", "group", *order)


def _unit(flat: np.ndarray, n: int) -> np.ndarray:
    m = np.asarray(flat, dtype=np.float64).reshape(n, -1)
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norm == 0, 1.0, norm)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.rint(a @ b.T * SCALE).astype(np.int64)


# ---- neighbours -----------------------------------------------------------------


def _neighbourhoods(users: DataFrame, block_rows: int, group_rows: int, pivots: int, cores: int | None = None) -> DataFrame:
    """Packed blocks of users that have the nearest pivot in common.  Pivots are at most
    ``pivots`` users by hash, a bounded number of vectors for the driver and each task.  With
    ``cores``, groups that are small for a task are held together."""
    rows = users.select("user", "vec").orderBy(F.xxhash64("user"), "user").limit(pivots).collect()
    if not rows:
        return _packed(users.withColumns({c: F.lit(0) for c in ("block", "group", "groups")}))
    centres = _unit(np.concatenate([r["vec"] for r in rows]), len(rows))
    # Neighbouring pivots get neighbouring numbers, so a group holds what lies together.
    way, left = [0], list(range(1, len(centres)))
    while left:
        way.append(left.pop(int(np.argmax(centres[left] @ centres[way[-1]]))))
    shared = users.sparkSession.sparkContext.broadcast(centres[way])

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                vectors = _unit(np.concatenate(pdf["vec"].to_numpy()), len(pdf))
                yield pdf.assign(cell=np.argmax(vectors @ shared.value.T, axis=1).astype(np.int32))

    celled = users.select("task", "user", "y", "vec").mapInPandas(
        nearest, "task string, user bigint, y string, vec array<double>, cell int"
    )
    celled = cut_lineage(celled)
    sizes = celled.groupBy("task", "cell").agg(F.count(F.lit(1)).alias("n"))
    inside, all_cells = Window.partitionBy("task").orderBy("cell"), Window.partitionBy("task")
    size = max(1, group_rows // block_rows)
    # Cells lie one after another, a user at a hashed place of its cell; a block is a run of places, so
    # large cells are split and small neighbours share a block.
    cells = sizes.select(
        "task",
        "cell",
        "n",
        (F.sum("n").over(inside) - F.col("n")).alias("first"),
        F.sum("n").over(all_cells).alias("all"),
        F.ceil(F.sum("n").over(all_cells) / (size * block_rows)).cast("int").alias("groups"),
    )
    per = _together(F.col("groups"), F.col("all"), GROUP_ROWS, cores) if cores else F.lit(1)
    cells = cells.withColumn("per", per).withColumn("groups", F.ceil(F.col("groups") / F.col("per")).cast("int"))
    place = F.col("first") + F.pmod(F.xxhash64("user"), F.col("n"))
    placed = celled.join(cells, ["task", "cell"]).withColumn("block", F.floor(place / block_rows).cast("int"))
    return _packed(placed.withColumn("group", F.floor(F.floor(F.col("block") / size) / F.col("per")).cast("int")))


class _Best:
    """The ``k`` best candidates so far of each row of a block: score descending, id ascending."""

    def __init__(self, n: int, k: int):
        self.k, self.rows = k, np.arange(n)
        self.score = np.full((n, k), -2 * SCALE, np.int64)
        self.id = np.full((n, k), -1, np.int64)

    def add(self, row: np.ndarray, score: np.ndarray, who: np.ndarray) -> None:
        """Offer candidates ``who`` with their scores to rows."""
        if not len(row):
            return
        touched = np.unique(row)
        filled, place = np.nonzero(self.id[touched] >= 0)
        filled = touched[filled]
        rows = np.concatenate([filled, row])
        score = np.concatenate([self.score[filled, place], score])
        who = np.concatenate([self.id[filled, place], who])
        order = np.lexsort((who, -score, rows))
        rows = rows[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = rank < self.k
        self.score[rows[keep], rank[keep]] = score[order][keep]
        self.id[rows[keep], rank[keep]] = who[order][keep]


def _summary(vectors: np.ndarray) -> tuple[np.ndarray, float, bool]:
    """Centre of unit vectors, the widest angle from it, and whether a vector is zero; a zero
    vector's scores are zero, wherever the others lie."""
    zero = ~vectors.any(axis=1)
    real = vectors[~zero]
    if not len(real):
        return np.zeros(vectors.shape[1]), 0.0, True
    centre = _unit(real.sum(axis=0), 1)[0]
    return centre, float(np.arccos(np.clip((real @ centre).min(), -1, 1))), bool(zero.any())


def _bounds(centres, angles, zeros, centre, angle, zero) -> np.ndarray:
    """Highest possible score of a block against each of some blocks."""
    apart = np.arccos(np.clip(centres @ centre, -1, 1)) - angles - angle
    bound = np.ceil(np.cos(np.clip(apart, 0, np.pi)) * SCALE).astype(np.int64) + MARGIN
    return np.where(zeros | zero, np.maximum(bound, MARGIN), bound)


class _Held:
    """The blocks of a group side by side, with the best lists of their users, found within the group
    first."""

    def __init__(self, rows: list, k: int):
        parts = [_unit(r.flat, len(r.ids)) for r in rows]
        self.blocks = [r.block for r in rows]
        self.table = [np.array(x) for x in zip(*map(_summary, parts))]
        self.edges = np.cumsum([0, *map(len, parts)])
        self.ids, self.vectors = np.concatenate([np.asarray(r.ids) for r in rows]), np.concatenate(parts)
        self.narrow, self.known = self.vectors.astype(np.float32), np.sort(self.ids)
        # Products of single precision are off by no more than this.
        self.off = (self.vectors.shape[1] + 8) * 2.0**-24
        self.best, self.near, self.n_near = _Best(len(self.ids), k), [], 0
        self.least = np.full(len(parts), -2 * SCALE)
        for at in range(0, len(self.ids), BATCH_ROWS):
            ids, vectors = self.ids[at : at + BATCH_ROWS], self.vectors[at : at + BATCH_ROWS]
            self._offer(ids, vectors, np.ones((len(parts), 1), bool), [len(ids)])
        self.least = self._worst()

    def _worst(self) -> np.ndarray:
        """The least score that a candidate needs to enter any list of a block."""
        return np.minimum.reduceat(self.best.score[:, -1], self.edges[:-1])

    def _offer(self, ids: np.ndarray, vectors: np.ndarray, wanted: np.ndarray, sizes: list[int]) -> None:
        """Multiply candidates, in blocks of ``sizes``, with the users of the blocks that want them."""
        narrow = np.ascontiguousarray(vectors.astype(np.float32).T)
        own = np.isin(ids, self.known)
        found = []
        for at in range(0, len(self.ids), STRIPE):
            end = min(at + STRIPE, len(self.ids))
            first, last = np.searchsorted(self.edges, at, "right") - 1, np.searchsorted(self.edges, end, "left")
            take = np.repeat(wanted[first:last].any(0), sizes)
            if not take.any():
                continue
            take = slice(None) if take.all() else np.flatnonzero(take)
            mine, of = narrow[:, take], np.arange(len(ids))[take]
            row, col = self._hits(at, end, ids[take], own[take], mine)
            found.append((row, of[col]))
        if found:
            row, col = (np.concatenate(x) for x in zip(*found))
            score = np.empty(len(row), np.int64)
            for a in range(0, len(row), SLICE):
                part = slice(a, a + SLICE)
                score[part] = np.rint(np.einsum("ij,ij->i", self.vectors[row[part]], vectors[col[part]]) * SCALE)
            self.best.add(row, score, ids[col])

    def _hits(self, at: int, end: int, ids: np.ndarray, own: np.ndarray, narrow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Users from ``at`` to ``end`` and candidates that may be among their best, by products of single
        precision.  A score is rounded, so it takes a millionth more."""
        k, least = self.best.k, self.best.score[at:end, -1]
        floor = np.where(least > -2 * SCALE, (least - 1) / SCALE - self.off, -2.0)
        row, col, odd = [], [], not np.isfinite(narrow).all()
        for first in range(0, narrow.shape[1], BLOCK_ROWS):
            part = slice(first, first + BLOCK_ROWS)
            near = self.narrow[at:end] @ narrow[:, part]
            if odd:
                near = np.nan_to_num(near, nan=-3.0)
            same = np.flatnonzero(own[part])
            if len(same):
                near[:, same] = np.where(self.ids[at:end, None] == ids[part][same], np.float32(-3), near[:, same])
            bare = np.flatnonzero(floor == -2.0)
            if len(bare) and near.shape[1] > k:
                # The k-th best of a first block says what an empty list can do without.
                kept = np.partition(near[bare], near.shape[1] - k, axis=1)[:, -k]
                floor[bare] = np.where(kept > -2, kept - 2 * self.off - 1 / SCALE, -2.0)
            hit = np.flatnonzero((near >= floor.astype(np.float32)[:, None]).ravel())
            row.append(at + hit // near.shape[1])
            col.append(first + hit % near.shape[1])
        return np.concatenate(row), np.concatenate(col)

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """A block of candidates; small ones are multiplied together."""
        bounds = _bounds(*self.table, *_summary(vectors))
        if (bounds >= self.least).any():
            self.near.append((ids, vectors, bounds))
            self.n_near += len(ids)
        if self.n_near >= BATCH_ROWS:
            self.finish()

    def finish(self) -> None:
        """Multiply what has been met."""
        if not self.near:
            return
        ids, vectors = (np.concatenate([x[i] for x in self.near]) for i in (0, 1))
        wanted = np.stack([b for _, _, b in self.near], 1) >= self.least[:, None]
        self._offer(ids, vectors, wanted, [len(x[0]) for x in self.near])
        self.near, self.n_near, self.least = [], 0, self._worst()


def _grouped(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """Rows one by one with their key, from batches in key order."""
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            yield (r.task, r.group), r


def _block_summaries(packed: DataFrame, k: int, groups: list) -> DataFrame:
    """Centre, angle and least useful score of each block, after a search within its group."""

    def of_group(key, rows):
        held = _Held(rows, k)
        centre, angle, zero = held.table
        return pd.DataFrame(
            {
                "task": key[0], "group": key[1], "block": held.blocks, "centre": list(centre), "angle": angle, "zero": zero,
                "least": held.least,
            }
        )

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []
        for now, r in _grouped(batches):
            if now != key and held:
                yield of_group(key, held)
                held = []
            key = now
            held.append(r)
        if held:
            yield of_group(key, held)

    return _dealt(packed, groups, "block").mapInPandas(
        summed, "task string, group int, block int, centre array<double>, angle double, zero boolean, least bigint"
    )


def _facing(packed: DataFrame, summaries: DataFrame, numbered: list) -> DataFrame:
    """``(task, group, block, bound)``: the blocks of other groups that a group has to see.

    Summaries, not vectors, go to every group; a task holds its own blocks' and lets the others pass."""
    groups = packed.select("task", "groups").distinct()
    others = summaries.join(groups, "task").withColumnRenamed("group", "home")
    everywhere = others.select("*", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"))
    kinds = everywhere.withColumn("kind", (F.col("home") != F.col("group")).cast("int"))

    def needed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, own, table, out = None, [], None, []
        for now, r in _grouped(batches):
            if now != key:
                key, own, table = now, [], None
            if r.kind == 0:
                own.append(r)
                continue
            if not own:  # hashing left all chunks of this group empty
                continue
            if table is None:
                table = [np.array(x) for x in zip(*((r.centre, r.angle, r.zero, r.least) for r in own))]
            bounds = _bounds(*table[:3], r.centre, r.angle, r.zero)
            wanted = bounds[bounds >= table[3]]
            if len(wanted):
                out.append({"task": r.task, "group": r.group, "block": r.block, "bound": int(wanted.max())})
            if len(out) >= 10_000:
                yield pd.DataFrame(out)
                out = []
        if out:
            yield pd.DataFrame(out)

    return _dealt(kinds, numbered, "kind", "block").mapInPandas(needed, "task string, group int, block int, bound bigint")


def facing_blocks(packed: DataFrame, k: int) -> DataFrame:
    """Rows that meet in the search: a group's own blocks (``kind`` 0), then the blocks of other
    groups (``kind`` 1) that may hold a better neighbour of one of its users, the best bound first.
    ``packed`` is read several times, so it comes from a checkpoint."""
    body = ["ids", "flat"]
    query = packed.select("task", "group", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("bound"), "block", *body)
    several = [g for g in _groups(packed) if g["groups"] > 1]
    if not several:  # a group alone sees all of its task already
        return query
    many = packed.filter("groups > 1")
    pairs = _facing(many, cut_lineage(_block_summaries(many, k, several)), several)
    candidates = pairs.join(many.select("task", "block", *body), ["task", "block"]).select(
        "task", "group", F.lit(1).alias("kind"), (-F.col("bound")).alias("bound"), "block", *body
    )
    return query.unionByName(candidates)


def neighbour_topk(
    users: DataFrame,
    k: int,
    block_rows: int = BLOCK_ROWS,
    group_rows: int = BLOCK_ROWS,
    pivots: int = PIVOTS,
) -> DataFrame:
    """``(task, user, rank, neighbour, score)``: the k most similar other users, exactly; ties go
    to the smaller user.  A zero vector has similarity 0 to all.  Groups of ``group_rows`` users are
    held together up to ``GROUP_ROWS``, as long as each core has ``TURNS``."""
    cores = TURNS * users.sparkSession.sparkContext.defaultParallelism
    packed = _narrowed(cut_lineage(_neighbourhoods(users, block_rows, group_rows, pivots, cores)))

    def found(key, held):
        held.finish()
        b = held.best
        row, rank = np.nonzero(b.id >= 0)
        yield pd.DataFrame(
            {"task": key[0], "user": held.ids[row], "rank": rank + 1, "neighbour": b.id[row, rank], "score_ppm": b.score[row, rank]}
        )

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rows, held = None, [], None
        for now, r in _grouped(batches):
            if now != key:
                if rows or held:
                    yield from found(key, held or _Held(rows, k))
                key, rows, held = now, [], None
            if r.kind == 0:
                rows.append(r)
                continue
            if held is None and not rows:
                continue
            if held is None:
                held, rows = _Held(rows, k), []
            held.meet(np.asarray(r.ids), _unit(r.flat, len(r.ids)))
        if rows or held:
            yield from found(key, held or _Held(rows, k))

    near = _dealt(facing_blocks(packed, k), _groups(packed), "kind", "bound", "block").mapInPandas(
        search, "task string, user bigint, rank int, neighbour bigint, score_ppm bigint"
    )
    return near.select("task", "user", "rank", "neighbour", (F.col("score_ppm") / SCALE).alias("score"))


# ---- ROC curves -----------------------------------------------------------------

LOW = -SCALE // COARSE - 2
BINS = -2 * LOW
#: Scores in a middle bin, and middle bins in a coarse one.
MIDDLE = 32
MIDDLES = -(-COARSE // MIDDLE)


def _wanted(fp: np.ndarray, tp: np.ndarray, cfp: np.ndarray, all_fp: np.ndarray) -> np.ndarray:
    """Bins that a grid point falls in; without relevant candidates a bin's curve is flat.  ``cfp``
    are a user's other candidates in a bin and above it, ``all_fp`` all of them."""
    last = GRID - 1
    with np.errstate(divide="ignore", invalid="ignore"):
        first = (last * (cfp - fp) + all_fp - 1) // all_fp
        end = (last * cfp + all_fp - 1) // all_fp - 1
    return (fp > 0) & (tp > 0) & (all_fp > 0) & (first <= end)


def _curve(score: np.ndarray, n: np.ndarray, tp: np.ndarray) -> np.ndarray | None:
    """True-positive rates at the grid's false-positive rates, from counts by falling score;
    integers throughout, so no grid point is lost to rounding."""
    order = np.argsort(-score, kind="stable")
    n, tp = n[order], tp[order]
    fp = n - tp
    ctp, cfp = np.cumsum(tp), np.cumsum(fp)
    if not len(n) or not cfp[-1]:
        return None
    last, steps = GRID - 1, np.flatnonzero(fp)
    k = np.arange(last)
    at = steps[np.searchsorted(last * cfp[steps], k * cfp[-1], side="right")]
    along = (k * cfp[-1] - last * (cfp[at] - fp[at])) / (last * fp[at])
    return np.concatenate([((ctp[at] - tp[at]) + tp[at] * along) / ctp[-1], [1.0]])


class _Level:
    """Counts of candidates and of relevant ones in the bins of some score ranges, ``width`` scores in
    a bin.  A range is of the user ``who``, begins at the score ``low`` and has ``above`` of the user's
    ``all_fp`` other candidates above it; ranges lie in the order of users."""

    def __init__(self, bins: int, width: int, who: np.ndarray, low: np.ndarray):
        self.width, self.who, self.low = width, who, low
        self.n, self.tp = (np.zeros((len(who), bins), np.int32) for _ in range(2))
        self.above = self.all_fp = np.zeros(len(who), np.int64)

    def count(self, ranges: slice, at: np.ndarray, same: np.ndarray) -> None:
        """Candidates at the bins ``at``, numbered from the first of ``ranges``; ``same`` marks relevant ones."""
        shape = self.n[ranges].shape
        size = shape[0] * shape[1]
        self.n[ranges] += np.bincount(at, minlength=size).reshape(shape).astype(np.int32)
        self.tp[ranges] += np.bincount(at[same], minlength=size).reshape(shape).astype(np.int32)

    def refined(self, bins: int, width: int) -> _Level:
        """A range for each wanted bin, whose place here then holds -1 less the range's number."""
        out, number = [], 0
        for at in range(0, len(self.who), STRIPE):
            part = slice(at, at + STRIPE)
            n, tp = self.n[part], self.tp[part]
            fp = n - tp
            cfp = self.above[part][:, None] + np.cumsum(fp[:, ::-1], axis=1)[:, ::-1]
            all_fp = self.all_fp[part][:, None] if self.all_fp.any() else cfp[:, :1]
            row, col = np.nonzero(_wanted(fp, tp, cfp, all_fp))
            out.append((self.who[part][row], self.low[part][row] + col * self.width, (cfp - fp)[row, col], all_fp[row, 0]))
            n[row, col] = -1 - (number + np.arange(len(row)))
            number += len(row)
        who, low, above, all_fp = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4
        level = _Level(bins, width, who, low)
        level.above, level.all_fp = above, all_fp
        return level

    def ranges(self, first: int, end: int) -> slice:
        """Ranges of the users from ``first`` to ``end``."""
        return slice(*np.searchsorted(self.who, [first, end]))


class _Counts:
    """Score counts of the users of a group: in coarse bins in the first pass, in middle ones in the
    second, of single scores in the third.  At most ``GRID`` bins of a user are refined at a time."""

    def __init__(self, rows: list):
        self.ids, self.ys = (np.concatenate([np.asarray(x) for x in y]) for y in zip(*((r.ids, r.ys) for r in rows)))
        self.vectors = np.concatenate([_unit(r.flat, len(r.ids)) for r in rows])
        self.numbers: dict = {}
        self.kinds = self._numbered(self.ys)
        users = np.arange(len(self.ids))
        self.levels = [_Level(BINS, COARSE, users, np.full(len(users), LOW * COARSE))]
        self.met, self.n_met = [], 0

    def _numbered(self, ys: np.ndarray) -> np.ndarray:
        """Labels as numbers, which compare faster."""
        return np.array([self.numbers.setdefault(y, len(self.numbers)) for y in ys], np.int32)

    def meet(self, turn: int, ys: np.ndarray, vectors: np.ndarray) -> None:
        """A block of candidates in their pass number ``turn``; small blocks are multiplied together."""
        while turn > len(self.levels):
            self.finish()
            self.levels.append(self.levels[-1].refined(*((MIDDLES, MIDDLE), (MIDDLE, 1))[len(self.levels) - 1]))
        self.met.append((self._numbered(ys), vectors))
        self.n_met += len(ys)
        if self.n_met >= BLOCK_ROWS:
            self.finish()

    def finish(self) -> None:
        """Count what has been met."""
        if not self.met:
            return
        kinds, vectors = (np.concatenate(x) for x in zip(*self.met))
        self.met, self.n_met = [], 0
        now = self.levels[-1]
        for at in range(0, len(self.ids), STRIPE):
            part = slice(at, at + STRIPE)
            s = (_scores(self.vectors[part], vectors) - LOW * COARSE).astype(np.uint32)
            same = self.kinds[part][:, None] == kinds[None, :]
            coarse = s // np.uint32(COARSE)
            place = (np.arange(len(s)) * BINS)[:, None] + coarse
            if len(self.levels) == 1:
                now.count(part, place.ravel(), same.ravel())
                continue
            number = self.levels[0].n[part].ravel()[place]
            hit = number < 0
            number, same, rest = -1 - number[hit].astype(np.int64), same[hit], (s - coarse * np.uint32(COARSE))[hit]
            ranges, bins = now.ranges(at, at + STRIPE), rest // MIDDLE
            if len(self.levels) == 3:
                number = self.levels[1].n[number, bins]
                hit = number < 0
                number, same, bins = -1 - number[hit].astype(np.int64), same[hit], rest[hit] % MIDDLE
            now.count(ranges, (number - ranges.start) * now.n.shape[1] + bins, same)

    def curves(self) -> Iterator[tuple]:
        for first in range(0, len(self.ids), STRIPE):
            cells = []
            for level in self.levels:
                part = level.ranges(first, first + STRIPE)
                n, tp = level.n[part], level.tp[part]
                row, col = np.nonzero(n > 0)
                cells.append((level.who[part][row], level.low[part][row] + col * level.width, n[row, col], tp[row, col]))
            who, score, n, tp = (np.concatenate(x) for x in zip(*cells))
            order = np.argsort(who, kind="stable")
            score, n, tp = score[order], n[order].astype(np.int64), tp[order].astype(np.int64)
            edge = np.searchsorted(who[order], np.arange(first, first + STRIPE + 1))
            for i in range(first, min(first + STRIPE, len(self.ids))):
                own = slice(edge[i - first], edge[i - first + 1])
                tpr = _curve(score[own], n[own], tp[own])
                if tpr is not None:
                    yield self.ids[i], self.ys[i], tpr


class _Candidates:
    """All candidates of a task, those of a label side by side, to whom the users of a group turn."""

    def __init__(self, rows: list):
        ys = np.concatenate([np.asarray(r.ys, object) for r in rows])
        names = {y: i for i, y in enumerate(dict.fromkeys(ys))}
        kinds = np.array([names[y] for y in ys], np.int64)
        order = np.argsort(kinds, kind="stable")
        self.names, self.edges = names, np.searchsorted(kinds[order], np.arange(len(names) + 1))
        at, place = 0, np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.columns = np.empty((len(rows[0].flat) // max(1, len(rows[0].ids)), len(order)))
        for r in rows:
            # Scores fall from the left once they are sorted.
            self.columns[:, place[at : at + len(r.ids)]] = _unit(r.flat, len(r.ids)).T * -SCALE
            at += len(r.ids)

    def curves(self, rows: list) -> Iterator[tuple]:
        """``(id, y, tpr)`` of the users of ``rows``; without other candidates a user has no curve."""
        ids, ys = (np.concatenate([np.asarray(x, kind) for x in y]) for y, kind in zip(zip(*((r.ids, r.ys) for r in rows)), (None, object)))
        vectors = np.concatenate([_unit(r.flat, len(r.ids)) for r in rows])
        kinds = np.array([self.names[y] for y in ys])
        stripe = max(1, min(STRIPE, SORT_BYTES // (4 * max(1, self.edges[-1]))))
        for kind in np.unique(kinds):
            mine = np.flatnonzero(kinds == kind)
            first, end = self.edges[kind], self.edges[kind + 1]
            if end - first == self.edges[-1]:
                continue
            for at in range(0, len(mine), stripe):
                part = mine[at : at + stripe]
                tprs = self._rates(vectors[part], first, end)
                yield from zip(ids[part], ys[part], tprs)

    def _sorted(self, vectors: np.ndarray, *ranges: tuple[int, int]) -> np.ndarray:
        """Scores of the candidates in some ranges, each user's in order."""
        out, done = np.empty((len(vectors), sum(b - a for a, b in ranges)), np.int32), 0
        for a, b in ranges:
            for at in range(a, b, BLOCK_ROWS):
                s = vectors @ self.columns[:, at : min(b, at + BLOCK_ROWS)]
                out[:, done : done + s.shape[1]] = np.rint(s, out=s)
                done += s.shape[1]
        out.sort(axis=1)
        return out

    def _rates(self, vectors: np.ndarray, first: int, end: int) -> np.ndarray:
        """True-positive rates at the grid's false-positive rates; integers until the end, so no grid
        point is lost to rounding."""
        relevant = self._sorted(vectors, (first, end))
        others = self._sorted(vectors, (0, first), (end, self.edges[-1]))
        n, last, k = others.shape[1], GRID - 1, np.arange(GRID - 1)
        out = np.ones((len(vectors), GRID))
        for row, (tp, fp) in enumerate(zip(relevant, others)):
            score = fp[k * n // last]  # of the step that the grid point falls in
            above, until = np.searchsorted(fp, score, "left"), np.searchsorted(fp, score, "right")
            better, reached = np.searchsorted(tp, score, "left"), np.searchsorted(tp, score, "right")
            along = (k * n - last * above) / (last * (until - above))
            out[row, :-1] = (better + (reached - better) * along) / len(tp)
        return out


def _curve_blocks(users: DataFrame, block_rows: int, group_rows: int, cores: int) -> DataFrame:
    """Packed blocks of users by hash, in groups held together as far as ``CURVE_ROWS`` and ``cores`` say."""
    size = max(1, group_rows // block_rows)
    placed = _sized(users, ["task"], block_rows).withColumnRenamed("chunk", "block")
    groups = F.ceil(F.col("chunks") / size)
    per = _together(groups, F.col("chunks") * block_rows, CURVE_ROWS, cores)
    placed = placed.withColumn("group", F.floor(F.floor(F.col("block") / size) / per).cast("int"))
    return _packed(placed.withColumn("groups", F.ceil(groups / per).cast("int")))


def _fewer_groups(packed: DataFrame, cores: int) -> DataFrame:
    """Neighbouring groups together, as far as each core has ``TURNS`` of all tasks' groups."""
    per = max(1, len(_groups(packed)) // (TURNS * cores))
    group, groups = F.floor(F.col("group") / per).cast("int"), F.ceil(F.col("groups") / per).cast("int")
    return packed.withColumns({"group": group, "groups": groups})


def passing_blocks(packed: DataFrame, turns: int = 3) -> DataFrame:
    """Rows that meet for the curves: a group's own blocks (``kind`` 0), then all blocks of its task in
    each of some passes (``kind`` 1, 2, 3)."""
    body = ["block", "ids", "ys", "flat"]
    query = packed.select("task", "group", F.lit(0).alias("kind"), *body)
    passes = F.explode(F.array(*map(F.lit, range(1, turns + 1)))).alias("kind")
    candidates = packed.select("task", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), *body)
    return query.unionByName(candidates.select("task", "group", passes, *body))


def user_roc(
    users: DataFrame, block_rows: int = BLOCK_ROWS, group_rows: int = CURVE_ROWS, held_bytes: int = HELD_BYTES
) -> DataFrame:
    """``(task, user, y, k, fpr, tpr)``: each user's ROC curve at fpr = k/99.

    A user's candidates are all users of the task, the user included; relevant are
    those with the same label.  Users whose task has no other label have no curve.
    Where the vectors of every task fit ``held_bytes``, a block is copied once for each group;
    else three times, once for each pass.  Groups of ``group_rows`` users are held together
    up to ``CURVE_ROWS``, as long as each core has one; held candidates need no counts, so their groups
    may be larger, as long as each core has ``TURNS``.
    """
    cores = users.sparkSession.sparkContext.defaultParallelism
    packed = _narrowed(cut_lineage(_curve_blocks(users, block_rows, group_rows, cores)))
    largest = packed.groupBy("task").agg(F.sum(8 * F.size("flat")).alias("n")).agg(F.max("n")).first()[0] or 0
    held = largest <= held_bytes
    if held:
        packed = _fewer_groups(packed, cores)

    def curves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rows, others = None, [], []
        for now, r in _grouped(batches):
            if now != key:
                yield from _curve_rows(key, _curves_of(rows, others))
                key, rows, others = now, [], [] if held else None
            if r.kind == 0:
                rows.append(r)
            elif not rows:  # hashing left all chunks of this group empty
                continue
            elif held:
                others.append(r)
            else:
                others = others or _Counts(rows)
                others.meet(r.kind, np.asarray(r.ys), _unit(r.flat, len(r.ids)))
        yield from _curve_rows(key, _curves_of(rows, others))

    return (
        _dealt(passing_blocks(packed, 1 if held else 3), _groups(packed), "kind", "block")
        .mapInPandas(curves, "task string, user bigint, y string, tprs array<double>")
        .select("task", "user", "y", F.posexplode("tprs").alias("k", "tpr"))
        .select("task", "user", "y", F.col("k").cast("bigint").alias("k"), (F.col("k") / (GRID - 1)).alias("fpr"), "tpr")
    )


def _curves_of(rows: list, others: list | _Counts | None) -> Iterator[tuple]:
    """Curves of the users of ``rows``, from the blocks of all candidates or the counts of them."""
    if isinstance(others, _Counts):
        others.finish()
        yield from others.curves()
    elif rows and others:
        yield from _Candidates(others).curves(rows)


def _curve_rows(key, curves: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    while found := list(islice(curves, BLOCK_ROWS)):
        ids, ys, tprs = zip(*found)
        yield pd.DataFrame({"task": key[0], "user": ids, "y": np.array(ys, object), "tprs": list(tprs)})


def mean_roc(curves: DataFrame) -> DataFrame:
    """Mean curve per task and label; starts at 0 and ends at 1."""
    k = F.col("k")
    return (
        curves.groupBy("task", "y", "k")
        .agg(F.avg("tpr").alias("_m"), F.count(F.lit(1)).alias("n_users"))
        .select(
            "task",
            "y",
            "k",
            "n_users",
            (k / (GRID - 1)).alias("fpr"),
            F.when(k == 0, 0.0).when(k == GRID - 1, 1.0).otherwise(F.col("_m")).alias("tpr"),
        )
    )


def mean_roc_auc(means: DataFrame) -> DataFrame:
    """Trapezoid area under each mean curve: inner points count once, ends half."""
    k = F.col("k")
    ends = (k == 0) | (k == GRID - 1)
    return means.groupBy("task", "y").agg(
        (F.sum(F.when(ends, F.col("tpr") / 2).otherwise(F.col("tpr"))) / (GRID - 1)).alias("auc")
    )


def one_vs_rest(users: DataFrame, label: str, labels: list) -> DataFrame:
    """Binary task per class: ``(task, user, y, vec)`` with every user in every task."""
    return users.select(
        F.explode(F.array(*[F.lit(str(v)) for v in labels])).alias("task"),
        "user",
        F.col(label).cast("string").alias("_l"),
        "vec",
    ).select(
        "task", "user", F.when(F.col("_l") == F.col("task"), "1").otherwise("0").alias("y"), "vec"
    )
