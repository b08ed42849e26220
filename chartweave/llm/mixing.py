"""Mixing sources to target weights, block by block.

The words of each source, document after document, are cut into blocks of ``BLOCK`` words.
The mix is a run of output shards; each draws how many of its slots go to each source, with
expectations in the targets' proportion.  The draw is stratified (one random offset for each
shard), as independent draws would miss the targets of small sources by several per cent.
A source's slots are numbered over all shards; slot ``g`` of pass ``g div blocks`` takes the
block that this pass's pseudorandom permutation of the source's blocks gives for
``g mod blocks``, and blocks are joined by that index.  No block is taken more than twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 64
SHARD_SLOTS = 1024
SHARD_RUN = 256
#: Parts of a source that are numbered side by side, so that one source may hold most rows.
LANES = 256
WORD = r"[^\x20\x09-\x0D]+"
#: Fixed primes above any number of blocks; each pass of a source uses one of them.
PRIMES = (2305843009213693951, 2305843009213693921, 2305843009213693907, 2305843009213693723)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _targets(sources: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """``source_size`` and ``target`` of each source, one row for each.

    With sources ordered by capacity over weight, those before some place are full and the
    rest share what is left by weight.  One row for each source, so the windows stay small.
    """
    names = Window.orderBy(F.col("source").isNull(), F.col("source"))
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    full = F.col("source_size") * cap / F.col("weight")
    order = Window.orderBy(full, "rank")
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = sources.withColumn("rank", F.row_number().over(names)).withColumn("weight", pick)
    left = F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * cap
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    s = s.withColumn("level", left / weight_left).withColumn("is_full", full <= F.col("level"))
    # Behind the first source that is not full the level only falls.
    level = F.max(F.when(~F.col("is_full"), F.col("level"))).over(every)
    target = F.when(F.col("is_full"), F.col("source_size") * F.lit(float(cap))).otherwise(F.col("weight") * level)
    return s.select("source", "rank", "source_size", target.alias("target"))


def numbered(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``docs`` with ``size``, the lane and the words before each row in its lane."""
    lane = F.pmod(F.xxhash64("doc_id", "size"), F.lit(LANES)).cast("int")
    order = Window.partitionBy("source", "lane").orderBy("doc_id", "size", *keep)
    run = order.rowsBetween(Window.unboundedPreceding, -1)
    return docs.withColumn("lane", lane).withColumn("before", F.coalesce(F.sum("size").over(run), F.lit(0)))


def plan(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: int = 2, block: int = BLOCK, seed: int = 1):
    """Targets, where each lane starts, and how often each block is taken.

    ``docs`` has ``doc_id``, ``source`` and ``size``.  Returns ``lanes (source, lane, base,
    rank, source_size, target)`` and ``taken (rank, block, times)``.
    """
    lane = F.pmod(F.xxhash64("doc_id", "size"), F.lit(LANES)).cast("int").alias("lane")
    lanes = docs.groupBy("source", lane).agg(F.sum("size").alias("lane_size"))
    totals = lanes.groupBy("source").agg(F.sum("lane_size").alias("source_size"))
    targets = _targets(totals, weights, share, cap)
    run = Window.partitionBy("source").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    based = lanes.withColumn("base", F.coalesce(F.sum("lane_size").over(run), F.lit(0)))
    same = based["source"].eqNullSafe(targets["source"])
    lanes = based.join(targets, same).select(
        based["source"], "lane", "base", "rank", "source_size", "target"
    )
    # Slots of a source: its target in blocks of the average fill of its blocks.
    blocks = F.ceil(F.col("source_size") / block)
    slots = F.when(F.col("source_size") > 0, F.col("target") * blocks / F.col("source_size")).otherwise(0.0)
    s = targets.select("rank", blocks.cast("long").alias("blocks"), slots.alias("slots"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    s = s.select(
        "rank",
        "blocks",
        F.sum("slots").over(every).alias("all"),
        F.sum("slots").over(upto).alias("hi"),
        (F.sum("slots").over(upto) - F.col("slots")).alias("lo"),
    )
    shards = F.ceil(F.col("all") / SHARD_SLOTS).cast("long")
    per = F.col("all") / F.greatest(shards, F.lit(1))
    # Every source meets every shard: a row holds the shard's draw from the source.
    drawn = s.filter("blocks > 0 and hi > lo").select(
        "rank", "blocks", (F.col("hi") / F.col("all")).alias("hi"), (F.col("lo") / F.col("all")).alias("lo"),
        per.alias("per"), shards.alias("shards"),
        F.explode(F.sequence(F.lit(0).cast("long"), shards - 1, F.lit(SHARD_RUN).cast("long"))).alias("run"),
    )
    # Runs of shards are dealt out before they become rows.
    last = F.least(F.col("run") + SHARD_RUN, F.col("shards")) - 1
    drawn = drawn.repartition("rank", "run").withColumn("shard", F.explode(F.sequence("run", last)))
    u = F.pmod(F.xxhash64(F.lit(seed), "shard"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = drawn.withColumn(
        "n", (F.floor(F.col("hi") * F.col("per") + u) - F.floor(F.col("lo") * F.col("per") + u)).cast("long")
    )
    first = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    drawn = drawn.withColumn("from", F.coalesce(F.sum("n").over(first), F.lit(0))).filter("n > 0")
    slot = drawn.select(
        "rank", "blocks", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("n") - 1)).alias("g")
    ).filter(F.col("g") < cap * F.col("blocks"))
    turn = F.floor(F.col("g") / F.col("blocks")).cast("long")
    draw = F.xxhash64(F.lit(seed), "rank", turn)
    prime = F.element_at(F.array(*[F.lit(p) for p in PRIMES]), (F.pmod(draw, F.lit(len(PRIMES))) + 1).cast("int"))
    step = F.pmod(prime, F.col("blocks")).cast("decimal(19,0)")
    shift = F.pmod(draw, F.col("blocks"))
    at = F.pmod(F.pmod(F.col("g"), F.col("blocks")).cast("decimal(19,0)") * step + shift, F.col("blocks").cast("decimal(38,0)"))
    taken = slot.select("rank", at.cast("long").alias("block")).groupBy("rank", "block").agg(
        F.count(F.lit(1)).alias("times")
    )
    return lanes, taken


def _pieces(rows: DataFrame, block: int) -> DataFrame:
    """One row for each run of words of a document inside one block."""
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    return rows.filter("size > 0").select(
        "rank", "start", "size", F.explode(F.sequence(first, last)).alias("block")
    ).select(
        "rank",
        "start",
        "block",
        (F.greatest(F.col("block") * block, F.col("start")) - F.col("start")).alias("from_word"),
        (F.least((F.col("block") + 1) * block, F.col("start") + F.col("size")) - F.col("start")).alias("to_word"),
    )


def mix(docs: DataFrame, keep: list[str] = (), block: int = BLOCK, **options) -> DataFrame:
    """Rows of ``docs (doc_id, source, text)`` with ``size``, ``source_size``, ``target``,
    ``taken`` and ``parts``: the word ranges the mix takes with the times it takes them.

    Columns in ``keep`` are carried along.  A null text has no words; a null source is a source
    of its own, ordered last.  Rows without words take part with nothing taken.  Repeated rows
    are rows of their own.  An empty table gives no rows.
    """
    keep = list(keep)
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *keep)
    # Blocks and parts grow with the words, so they are merged and never broadcast.
    lanes, taken = plan(sized.select("doc_id", "source", "size"), block=block, **options)
    n = numbered(sized, keep)
    here = n["source"].eqNullSafe(lanes["source"]) & (n["lane"] == lanes["lane"])
    placed = n.join(lanes, here).select(
        n["doc_id"], n["source"], "size", *keep, "rank", (F.col("base") + F.col("before")).alias("start"), "source_size", "target"
    )
    parts = (
        _pieces(placed.select("rank", "start", "size"), block)
        .join(taken.hint("merge"), ["rank", "block"])
        .groupBy("rank", "start")
        .agg(
            F.sum((F.col("to_word") - F.col("from_word")) * F.col("times")).alias("taken"),
            F.sort_array(F.collect_list(F.struct("from_word", "to_word", "times"))).alias("parts"),
        )
        .withColumnRenamed("rank", "r")
        .withColumnRenamed("start", "s")
    )
    mine = (F.col("rank") == F.col("r")) & (F.col("start") == F.col("s")) & (F.col("size") > 0)
    return placed.join(parts.hint("merge"), mine, "left").select(
        "doc_id",
        "source",
        *keep,
        "size",
        "source_size",
        F.col("target").cast("double").alias("target"),
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        "parts",
    )


def mixed_documents(docs: DataFrame, block: int = BLOCK, **options) -> DataFrame:
    """``docs`` with each text replaced by the words the mix takes from it: those taken at
    least once, in order, then those taken twice.  A document the mix takes nothing from goes;
    ``n_chars`` follows the text.  White space before a word stays with it."""
    # Other columns travel in one struct, so none of their names meets one of the plan's.
    others = [F.col(c) for c in docs.columns if c not in ("doc_id", "source", "text")]
    rest = F.struct(*others) if others else F.lit(None)
    boxed = docs.select("doc_id", "source", "text", rest.alias("boxed"))
    mixed = mix(boxed, keep=["text", "boxed"], block=block, **options).filter("taken > 0")
    w = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    rows = mixed.select("doc_id", "source", "text", "boxed", "parts", w.alias("_w"))

    def pass_of(k: int) -> Column:
        chosen = F.filter("parts", lambda p: p["times"] >= k)
        return F.flatten(
            F.transform(chosen, lambda p: F.slice("_w", (p["from_word"] + 1).cast("int"), (p["to_word"] - p["from_word"]).cast("int")))
        )

    text = F.concat_ws("\n", *[F.nullif(F.trim(F.array_join(pass_of(k), "")), F.lit("")) for k in (1, 2)])
    out = rows.select("doc_id", "source", "boxed", text.alias("text"))
    own = {c: F.col(c) for c in ("doc_id", "source", "text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[own.get(c, F.col("boxed")[c]).alias(c) for c in docs.columns])
