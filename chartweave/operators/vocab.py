"""Vocabularies: tokens with counts, word types, and subword units."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartweave.operators.distribution import ranked
from chartweave.operators.features import SLICE_TOKENS, _slices
from chartweave.session import cut_lineage

# Special tokens in id order; padding is id 0.
SPECIALS = ("[PAD]", "[MASK]", "[UNK]", "[CLS]", "[SEP]")
# Default sizes.
VOCAB_SIZE = 20_000
MAX_WORD_CHARS = 100
# Merge rounds replayed on the type table before it is written anew.
ROUNDS_PER_WRITE = 8
#: Words that a task remembers the pieces of.
MEMO_WORDS = 50_000
#: Words that a task remembers the ids of.
CUT_WORDS = 250_000
#: Numbers from here on take a second short number to travel.
SHORT = 1 << 15
#: Documents whose words are cut at a time.
SLICE_ROWS = 64

WORD_TYPE = r"[\p{L}\p{N}_]++|[^\p{L}\p{N}_\s]++"


def token_counts(docs: DataFrame, items: Column) -> DataFrame:
    return docs.select(F.explode(items).alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("n")
    )


def word_types(texts: DataFrame, text: str = "text") -> DataFrame:
    """Runs of word characters or of punctuation, with counts."""
    return token_counts(texts, F.regexp_extract_all(F.col(text), F.lit(WORD_TYPE), F.lit(0)))


def token_vocab(counts: DataFrame, size: int | None = None, **kw) -> DataFrame:
    """``(id, token, n)`` by falling count, then token.  A size keeps the head."""
    order = [F.col("n").desc(), F.col("token")]
    if size is None:
        placed = ranked(counts, [], order, name="_r", **kw)
    else:
        # At most ``size`` rows are left when they are numbered in one task.
        placed = counts.orderBy(*order).limit(size).withColumn(
            "_r", F.row_number().over(Window.orderBy(*order))
        )
    return placed.select((F.col("_r") - 1).cast("bigint").alias("id"), "token", "n")


def frequent(counts: DataFrame, least: int) -> DataFrame:
    return counts.filter(F.col("n") >= least)


def head_of_vocab(vocab: DataFrame, size: int) -> list[str]:
    """Tokens in id order; ``size`` bounds what reaches the driver."""
    return [r["token"] for r in vocab.orderBy("id").limit(size).select("token").collect()]


def _pairs(pieces: Column) -> Column:
    """Neighbouring pieces; a run of ``m`` equal pieces holds ``m div 2`` pairs, as it merges
    from the left without overlap."""
    none = F.array().cast("array<struct<a:string,b:string>>")
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(False).alias("used"), none.alias("out"))

    def step(acc, p):
        same = F.coalesce(acc["last"] == p, F.lit(False))
        free = acc["last"].isNotNull() & ~(same & acc["used"])
        pair = F.array(F.struct(acc["last"].alias("a"), p.alias("b")))
        return F.struct(
            p.alias("last"),
            (free & same).alias("used"),
            F.when(free, F.concat(acc["out"], pair)).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(pieces, start, step, lambda acc: acc["out"])


def _merge(rounds: Sequence[set[tuple[str, str]]]) -> Callable[[pd.Series], pd.Series]:
    def join_pieces(pieces: Iterable[str]) -> list[str]:
        for merges in rounds:
            out: list[str] = []
            for p in pieces:
                if out and (out[-1], p) in merges:
                    out[-1] += p.removeprefix("##")
                else:
                    out.append(p)
            pieces = out
        return list(pieces)

    def merged(column: pd.Series) -> pd.Series:
        return column.map(join_pieces)

    return merged


def letter_pieces(types: DataFrame) -> DataFrame:
    """``(token, n, pieces)``: each type as its letters, inner ones marked."""
    marked = F.transform(F.split("token", ""), lambda c, i: F.when(i == 0, c).otherwise(F.concat(F.lit("##"), c)))
    return types.select("token", "n", marked.alias("pieces"))


def pair_counts(pieces: DataFrame) -> DataFrame:
    """``(a, b, n)``: how often two pieces stand side by side in the corpus, from the types."""
    pairs = pieces.select("n", F.explode(_pairs(F.col("pieces"))).alias("x"))
    return pairs.groupBy("x.a", "x.b").agg(F.sum("n").alias("n"))


def merged(pieces: DataFrame, rounds: Sequence[set[tuple[str, str]]]) -> DataFrame:
    """``pieces`` after rounds of merges; the merges of a round do not touch each other."""
    step = F.pandas_udf(_merge(rounds), "array<string>")
    return pieces.withColumn("pieces", step("pieces"))


def _exact_batch(counted, seen: set[str], room: int, whole: bool) -> list[tuple[str, str]]:
    """The pairs that a loop of one merge at a time would merge next, in its order.

    ``counted`` are pairs by falling count, then by name; ``whole`` says that these are all.  A merge
    of ``a b`` takes from pairs that end in ``a`` or begin with ``b``, and a pair with the new unit
    counts at most what one of those did.  So a pair is the next one as long as none of those
    touched, wherever it stands, has as high a count.  A unit that is there already, or that two
    merges make, would add to counts, so it ends the batch.
    """
    chosen: list[tuple[str, str]] = []
    lefts: set[str] = set()
    rights: set[str] = set()
    fresh: set[str] = set()
    touched = lambda a, b: a in rights or b in lefts
    if not whole and counted:
        # More pairs of the last count may follow, unless all that is known has that count.
        known = [r for r in counted if r[2] > counted[-1][2]]
        counted = known or counted[:1]
    for i, (a, b, n) in enumerate(counted):
        unit = a + b.removeprefix("##")
        ties = [r for r in counted[i:] if r[2] == n] if chosen else []
        if any(touched(x, y) for x, y, _ in ties) or unit in fresh:
            break
        if unit not in seen and len(fresh) == room:
            break
        chosen.append((a, b))
        lefts.add(a)
        rights.add(b)
        if unit in seen:
            break
        fresh.add(unit)
    return chosen


def subword_vocab(
    types: DataFrame,
    size: int = VOCAB_SIZE,
    entity_ids: Sequence[str] = (),
    merges_per_round: int = 200,
    exact: bool = False,
) -> list[str]:
    """Subword units grown from characters over the word-type table.

    A round counts neighbouring pieces over the types (not over the corpus) and
    merges the most frequent pairs of which none ends where another begins, so no
    merge of the round changes the count of another.  With ``exact`` a round ends where a
    loop of one merge at a time might go another way, so the units are that loop's; it takes more
    rounds.  Only the chosen pairs reach the driver.  The list is in id order.  The most frequent
    letters come first, as many as the size has room for beside the special tokens.
    """
    table = cut_lineage(letter_pieces(types).select("n", "pieces"))
    units = [*SPECIALS, *entity_ids]
    letters = (
        table.select("n", F.explode("pieces").alias("p"))
        .groupBy("p")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.col("n").desc(), "p")
        .limit(max(0, size - len(units)))
    )
    units += [r["p"] for r in letters.collect()]
    seen = set(units)
    pending: list[set[tuple[str, str]]] = []
    while len(units) < size:
        current = table
        if pending:
            current = merged(table, pending)
        if len(pending) == ROUNDS_PER_WRITE:
            current = table = cut_lineage(current)
            pending = []
        window = 4 * merges_per_round
        counted = pair_counts(current).orderBy(F.col("n").desc(), "a", "b").limit(window).select("a", "b", "n")
        if exact:
            rows = [tuple(r) for r in counted.collect()]
            batch = _exact_batch(rows, seen, size - len(units), len(rows) < window)
            if not batch:
                break
            fresh = [u for u in (a + b.removeprefix("##") for a, b in batch) if u not in seen]
            seen |= set(fresh)
            units += fresh
            pending = [*pending, set(batch)]
            continue
        chosen: set[tuple[str, str]] = set()
        lefts: set[str] = set()
        rights: set[str] = set()
        fresh: list[str] = []
        for a, b, _ in counted.collect():
            clash = a in rights or b in lefts
            if clash or len(chosen) == merges_per_round:
                continue
            unit = a + b.removeprefix("##")
            if unit not in seen and len(units) + len(fresh) == size:
                break
            chosen.add((a, b))
            lefts.add(a)
            rights.add(b)
            if unit not in seen:
                seen.add(unit)
                fresh.append(unit)
        if not chosen:
            break
        units += fresh
        pending = [*pending, chosen]
    return units


def _longest_units(word: str, units: set[str]) -> list[str]:
    if len(word) > MAX_WORD_CHARS:
        return ["[UNK]"]
    out, at = [], 0
    while at < len(word):
        mark = "##" if at else ""
        end = next((e for e in range(len(word), at, -1) if mark + word[at:e] in units), None)
        if end is None:
            return ["[UNK]"]
        out.append(mark + word[at:end])
        at = end
    return out


def _piece_encoder(units: Sequence[str], memo: dict[str, list[str]]) -> Callable[[pa.Array], pa.Array]:
    known = set(units)
    whole = set(SPECIALS)

    def one(items):
        out: list[str] = []
        for w in items:
            got = memo.get(w)
            if got is None:
                got = [w] if w in whole else _longest_units(w, known)
                if len(memo) >= MEMO_WORDS:
                    memo.clear()
                memo[w] = got
            out.extend(got)
        return out

    def encode(column: pa.Array) -> pa.Array:
        kind = pa.list_(pa.string())
        # Words become Python strings for a few documents at a time.
        parts = [
            pa.array([one(items) for items in column.slice(at, SLICE_ROWS).to_pylist()], kind)
            for at in range(0, len(column), SLICE_ROWS)
        ]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return encode


def subword_encode(words: Column, units: Sequence[str]) -> Column:
    """Greedy longest-match pieces of an array of words.

    Narrow on purpose: the vocabulary is bounded and travels with the task, each
    task remembers the words it has met lately, and no token is shuffled.
    """
    return F.arrow_udf(_piece_encoder(units, {}), "array<string>")(words)


def unit_table(spark: SparkSession, units: Sequence[str]) -> DataFrame:
    """``(id, unit)`` of a vocabulary in id order; bounded by its size, so it may be broadcast."""
    whole = F.split(F.lit("\u0001".join(units)), "\u0001")
    return spark.range(1).select(F.posexplode(whole).alias("id", "unit"))


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values of a list column of numbers."""
    return lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)


def _listed(lengths: np.ndarray, values, kind=np.int32) -> pa.ListArray:
    ends = pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32))
    return pa.ListArray.from_arrays(ends, values if isinstance(values, pa.Array) else pa.array(values.astype(kind)))


def _narrow(lengths: np.ndarray, values: np.ndarray) -> tuple[pa.ListArray, pa.ListArray]:
    """Numbers as two lists of short ones, the second empty where all of a list are below ``SHORT``."""
    of_list = np.repeat(np.arange(len(lengths)), lengths)
    more = np.bincount(of_list, values >= SHORT, len(lengths)) > 0
    return _listed(lengths, values % SHORT, np.int16), _listed(lengths * more, values[more[of_list]] // SHORT, np.int16)


def _wide(low: pa.Array, more: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values of what ``_narrow`` made."""
    lengths, values = _flat(low)
    above, high = _flat(more)
    values = values.astype(np.int64)
    values[np.repeat(above > 0, lengths)] += high.astype(np.int64) * SHORT
    return lengths, values


def _runs_of(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``starts[i] .. starts[i] + lengths[i] - 1``, one run after another."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


def _cutter(units: dict[str, int]) -> Callable[[str], tuple[int, ...]]:
    """The ids of the units that a word is cut into, the longest first.  A word with a place where no
    unit fits, or of more than ``MAX_WORD_CHARS`` characters, is ``[UNK]``; special tokens are units of
    their own."""
    unknown = (SPECIALS.index("[UNK]"),)
    whole = {u: (units[u],) if u in units else unknown for u in SPECIALS}
    inner = {u[2:]: i for u, i in units.items() if u.startswith("##")}
    first_most, most = (max(map(len, x), default=0) for x in (units, inner))

    def cut(word: str) -> tuple[int, ...]:
        if word in whole:
            return whole[word]
        n, at, known, longest, out = len(word), 0, units, first_most, []
        if not 0 < n <= MAX_WORD_CHARS:
            return unknown
        while at < n:
            for end in range(min(n, at + longest), at, -1):
                found = known.get(word[at:end])
                if found is not None:
                    break
            else:
                return unknown
            out.append(found)
            at, known, longest = end, inner, most
        return tuple(out)

    return cut


def _cut_rows(units: pa.Table, in_order: bool):
    """Words of documents as ids, each distinct word of a slice cut once.  With ``in_order`` a row becomes
    its ids and their units; else its words travel, with their places, to other rows of its key."""
    by_id = {c: units[c].combine_chunks() for c in ("id", "unit")}

    def cut_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, memo = _cutter(dict(zip(units["unit"].to_pylist(), units["id"].to_pylist()))), {}
        for batch in _slices(batches, "words"):
            n, words = batch.num_rows, batch.column("words").flatten()
            sizes = pc.fill_null(batch.column("words").value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            there = words.is_valid().to_numpy(zero_copy_only=False)
            row, place = np.repeat(np.arange(n), sizes)[there], _runs_of(np.zeros(n, np.int64), sizes)[there]
            coded = words.drop_null().dictionary_encode()
            if len(memo) >= CUT_WORDS:
                memo.clear()
            known = []
            for word in coded.dictionary.to_pylist():
                found = memo.get(word)
                if found is None:
                    found = memo[word] = cut(word)
                known.append(found)
            length = np.fromiter(map(len, known), np.int64, len(known))
            ids = np.fromiter(chain.from_iterable(known), np.int32, int(length.sum()))
            code = coded.indices.to_numpy(zero_copy_only=False)
            ids, length = ids[_runs_of((np.cumsum(length) - length)[code], length[code])], length[code]
            if in_order:
                ids, sizes = pa.array(ids), np.bincount(row, length, n).astype(np.int64)
                pieces = by_id["unit"].take(pc.index_in(ids, by_id["id"]))
                columns = [batch.column("key"), _listed(sizes, ids), _listed(sizes, pieces)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "ids", "pieces"])
                continue
            words_in = np.bincount(row, minlength=n)
            columns = [
                batch.column("key"),
                _listed(words_in, np.ones(len(row))),
                *_narrow(words_in, place),
                _listed(words_in, length, np.int8),
                *_narrow(np.bincount(row, length, n).astype(np.int64), ids),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "counts", "places", "more_places", "lengths", "ids", "more_ids"])

    return cut_all


def _worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of batches with at most ``SLICE_TOKENS`` words, of one row at least."""
    for batch in batches:
        lists = batch.column("p")
        of_list = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
        words = lists.flatten().flatten()[1].value_lengths().to_numpy(zero_copy_only=False)
        ends, first = np.cumsum(np.bincount(of_list, words, batch.num_rows)), 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            end = max(first + 1, int(np.searchsorted(ends, before + SLICE_TOKENS, "right")))
            yield batch.slice(first, end - first)
            first = end


def _in_order(units: dict[str, pa.Array]):
    """The ids of each document in the order of its words, and their units."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _worded(batches):
            lists = batch.column("p")
            counts, places, more_places, lengths, ids, more_ids = lists.flatten().flatten()
            of_list = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            words, count = _flat(counts)
            word_row, length, ids = np.repeat(of_list, words), _flat(lengths)[1].astype(np.int64), _wide(ids, more_ids)[1]
            start = np.cumsum(length) - length
            word, place = np.repeat(np.arange(len(count)), count), _wide(places, more_places)[1]
            row = word_row[word]
            order = np.lexsort((place, row))
            if ((row[order][1:] == row[order][:-1]) & (place[order][1:] == place[order][:-1])).any():
                # Rows that repeat a key: words of one place follow their ids.
                cut = [ids[a : a + n].tolist() for a, n in zip(start.tolist(), length.tolist())]
                rank = np.empty(len(cut), np.int64)
                rank[sorted(range(len(cut)), key=cut.__getitem__)] = np.arange(len(cut))
                order = np.lexsort((rank[word], place, row))
            word = word[order]
            ids = pa.array(ids[_runs_of(start[word], length[word])].astype(np.int32))
            sizes = np.bincount(row, length[np.repeat(np.arange(len(count)), count)], batch.num_rows).astype(np.int64)
            pieces = units["unit"].take(pc.index_in(ids, units["id"]))
            yield pa.RecordBatch.from_arrays([batch.column("key"), _listed(sizes, ids), _listed(sizes, pieces)], names=["key", "ids", "pieces"])

    return put


def subword_rows(docs: DataFrame, key: str, words: Column, units: DataFrame) -> DataFrame:
    """``(key, ids, pieces)`` of documents, their words cut into ``units (id, unit)``, which begin with the
    special tokens.  A document without words has empty arrays; rows that repeat a key are one document,
    word by word.

    Narrow, as most distinct words are rare: the units are bounded and travel with the task, which cuts
    each distinct word of a slice once.  Only where keys do repeat, which a look at the keys tells, the
    rows are shuffled, as lists of numbers; pieces are the units of the ids, put in last."""
    kind = T.StructField("key", docs.schema[key].dataType)
    named = units.select(F.col("id").cast("int").alias("id"), "unit").toArrow().combine_chunks()
    out = T.StructType([kind, *T.StructType.fromDDL("ids array<int>, pieces array<string>").fields])
    asked = docs.select(F.col(key).alias("key"), words.alias("words"))
    if not docs.groupBy(key).count().filter("count > 1").limit(1).count():
        return asked.mapInArrow(_cut_rows(named, True), out).withColumnRenamed("key", key)
    lists = "counts array<int>, places array<smallint>, more_places array<smallint>"
    cells = "lengths array<tinyint>, ids array<smallint>, more_ids array<smallint>"
    numbers = T.StructType.fromDDL(f"{lists}, {cells}").fields
    cut = asked.mapInArrow(_cut_rows(named, False), T.StructType([kind, *numbers]))
    whole = cut.groupBy("key").agg(F.collect_list(F.struct(*(f.name for f in numbers))).alias("p"))
    by_id = {c: named[c].combine_chunks() for c in ("id", "unit")}
    return whole.mapInArrow(_in_order(by_id), out).withColumnRenamed("key", key)


#: Score from which a type counts as an abbreviation, and the share of its uses that a stop follows.
ABBREVIATION_SCORE = 0.3
STOP_SHARE = 0.99


def abbreviations(texts: DataFrame, text: str = "text") -> DataFrame:
    """``(type, n_stop, n_bare, score)`` of the types that mostly stand before a full stop and are
    short: how much likelier that is of an abbreviation than by chance, less for every letter and
    every use without a stop, more for stops inside.  All counts are aggregates over the texts; only
    two totals reach the driver."""
    words = texts.select(F.explode(F.split(F.lower(F.col(text)), r"\s+")).alias("w")).select(
        F.regexp_replace("w", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}.]+$", "").alias("w")
    )
    typed = words.filter(F.col("w") != "").select(
        F.regexp_replace("w", r"\.$", "").alias("type"), F.col("w").endswith(".").cast("bigint").alias("stop")
    )
    counts = typed.filter(F.col("type").rlike(r"\p{L}")).groupBy("type").agg(
        F.sum("stop").alias("n_stop"), F.sum(1 - F.col("stop")).alias("n_bare")
    )
    counts = cut_lineage(counts)
    stops, total = counts.agg(F.sum("n_stop"), F.sum(F.col("n_stop") + F.col("n_bare"))).first()
    if not stops or stops == total:
        return counts.limit(0).withColumn("score", F.lit(0.0))
    chance = F.lit(stops / total)
    by_chance = F.col("n_stop") * F.log(chance) + F.col("n_bare") * F.log(1 - chance)
    by_rule = F.col("n_stop") * F.log(F.lit(STOP_SHARE)) + F.col("n_bare") * F.log(F.lit(1 - STOP_SHARE))
    inside = F.length("type") - F.length(F.replace("type", F.lit("."), F.lit("")))
    letters = (F.length("type") - inside).cast("double")
    score = 2 * (by_rule - by_chance) * F.exp(-letters) * (inside + 1) * F.pow(letters, -F.col("n_bare").cast("double"))
    return counts.withColumn("score", score).filter(F.col("score") >= ABBREVIATION_SCORE)


def abbreviation_list(found: DataFrame, most: int = 1000) -> Column:
    """The best-scored abbreviations as a constant array; ``most`` bounds what the driver holds."""
    rows = found.orderBy(F.col("score").desc(), "type").limit(most).select("type").collect()
    return F.split(F.lit("\u0001".join(r["type"] for r in rows)), "\u0001")
