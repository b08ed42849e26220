"""Entity linking against a phrase table, and annotation of the text.

Phrases become a trie of token ids.  Every place of a note is a walker at the root; walkers step
down by their next token, all together, and the few whose first token begins a phrase go on.  The
longest phrase at each place is known when the last walker stops.  Spans stay beside their note: no
run of tokens becomes a row, and the notes are read once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartweave.session import cut_lineage

# Semantic types that are linked.
ENTITY_TYPES = ("T047", "T048", "T184", "T034", "T058", "T060", "T195", "T121", "T046")
#: Phrases in one trie, which every task holds.  A larger table is dealt to several, and the notes
#: walk each.
TRIE_PHRASES = 500_000
#: Tokens of notes that a walk takes at a time.
WALK_TOKENS = 200_000

SPAN = "struct<start:int,len:int,phrase:string,tui:string,cui:string>"
_SPAN = pa.struct([("start", pa.int32()), ("len", pa.int32()), *[(c, pa.string()) for c in ("phrase", "tui", "cui")]])


def phrase_table(gazetteer: DataFrame, types: Sequence[str] = ENTITY_TYPES) -> DataFrame:
    """Allowed phrases, one meaning each (the smallest type and concept)."""
    best = F.min(F.struct("tui", "cui"))
    return (
        gazetteer.filter(F.col("tui").isin(*types))
        .groupBy("phrase")
        .agg(best.alias("e"))
        .select("phrase", "e.tui", "e.cui")
    )


def phrase_trie(phrases: pa.Table) -> dict:
    """Trie of the token ids of ``phrases (phrase, tui, cui)``: an edge is ``node * tokens + token``
    and leads to a node; ``ends`` has the phrase that ends in a node, or -1."""
    phrases = phrases.combine_chunks()
    split = pc.split_pattern(phrases["phrase"].combine_chunks(), " ")
    sizes = split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = split.flatten()
    tokens = pc.unique(flat)
    ids = pc.index_in(flat, tokens).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.cumsum(sizes) - sizes
    node = np.zeros(len(sizes), np.int64)
    edges, nodes, ends = [np.zeros(0, np.int64)], 1, [np.full(1, -1)]
    for d in range(int(sizes.max()) if len(sizes) else 0):
        on = np.flatnonzero(sizes > d)
        key, child = np.unique(node[on] * len(tokens) + ids[first[on] + d], return_inverse=True)
        node[on] = nodes + child
        end = np.full(len(key), -1)
        last = on[sizes[on] == d + 1]
        end[node[last] - nodes] = last
        edges.append(key)
        ends.append(end)
        nodes += len(key)
    # Nodes are numbered level by level in the order of their edges.
    key = np.concatenate(edges)
    order = np.argsort(key, kind="stable")
    return {
        "tokens": tokens, "edges": key[order], "to": order + 1, "ends": np.concatenate(ends), "phrases": phrases, "sizes": sizes,
    }


def _step(trie: dict, node: np.ndarray, token: np.ndarray) -> np.ndarray:
    """The node that each walker's token leads to, or -1."""
    key = node * len(trie["tokens"]) + token
    at = np.minimum(np.searchsorted(trie["edges"], key), len(trie["edges"]) - 1)
    return np.where((token >= 0) & (trie["edges"][at] == key), trie["to"][at], -1)


def longest_matches(trie: dict, flat: pa.Array, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(place, phrase)``: the longest phrase that begins at each place of ``flat``, the tokens of
    notes of these ``sizes``, where there is one."""
    none = np.zeros(0, np.int64)
    if not len(trie["edges"]) or not len(flat):
        return none, none
    ids = pc.fill_null(pc.index_in(flat, trie["tokens"]), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    stop = np.repeat(np.cumsum(sizes), sizes)
    found = np.full(len(ids), -1, np.int64)
    place, node = np.arange(len(ids)), np.zeros(len(ids), np.int64)
    depth = 0
    while len(place):
        node = _step(trie, node, ids[place + depth])
        place, node = place[node >= 0], node[node >= 0]
        end = trie["ends"][node]
        found[place[end >= 0]] = end[end >= 0]
        depth += 1
        inside = place + depth < stop[place]
        place, node = place[inside], node[inside]
    at = np.flatnonzero(found >= 0)
    return at, found[at]


def from_left(place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which spans are taken from left to right, none overlapping one taken before."""
    taken = np.ones(len(place), bool)
    end = place + size
    # Only spans that reach beyond the next one's start need a look.
    if len(place) and (end[:-1] > place[1:]).any():
        free = -1
        for i, (a, b) in enumerate(zip(place.tolist(), end.tolist())):
            if a >= free:
                free = b
            else:
                taken[i] = False
    return taken


def _tokens(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    sizes = pc.fill_null(column.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten(), sizes


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of batches with at most ``WALK_TOKENS`` tokens, of one note at least."""
    for batch in batches:
        ends = np.cumsum(_tokens(batch.column("tokens"))[1])
        first = 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            end = max(first + 1, int(np.searchsorted(ends, before + WALK_TOKENS, "right")))
            yield batch.slice(first, end - first)
            first = end


def _spans_column(rows: int, note, start, size, fields) -> pa.ListArray:
    ends = pa.array(np.searchsorted(note, np.arange(rows + 1)), pa.int32())
    spans = pa.StructArray.from_arrays(
        [pa.array(start, pa.int32()), pa.array(size, pa.int32()), *fields], fields=list(_SPAN)
    )
    return pa.ListArray.from_arrays(ends, spans)


def _annotated(flat: pa.Array, sizes: np.ndarray, place, size, tags: pa.Array, whole: pa.Array) -> pa.Array:
    """Texts of notes whose spans ``(place, size)`` are replaced by ``tags``."""
    covered = np.zeros(len(flat) + 1, np.int64)
    np.add.at(covered, place, 1)
    np.add.at(covered, place + size, -1)
    kept = np.cumsum(covered)[:-1] == 0
    source = np.arange(len(flat))
    source[place] = len(flat) + np.arange(len(place))
    kept[place] = True
    picked = pa.concat_arrays([flat, tags.cast(flat.type)]).take(pa.array(source[kept]))
    edge = np.concatenate([[0], np.cumsum(sizes)])
    ends = np.concatenate([[0], np.cumsum(kept)])[edge]
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), picked), " ")
    return pc.if_else(whole.is_valid(), text, pa.scalar(None, text.type))


def _matched(trie: dict, column: pa.Array, all_places: bool = False):
    """Spans of a batch of notes: note, place in the batch, place in the note, length, phrase; with
    ``all_places`` overlapping ones too."""
    flat, sizes = _tokens(column)
    place, phrase = longest_matches(trie, flat, sizes)
    size = trie["sizes"][phrase]
    if not all_places:
        # Phrases end with their note, so notes can be walked in one row.
        taken = from_left(place, size)
        place, phrase, size = place[taken], phrase[taken], size[taken]
    note = np.repeat(np.arange(len(sizes)), sizes)[place]
    start = place - (np.cumsum(sizes) - sizes)[note]
    return flat, sizes, note, place, start, size, phrase


def _fields(trie: dict, phrase: np.ndarray) -> list[pa.Array]:
    at = pa.array(phrase)
    return [trie["phrases"][c].combine_chunks().take(at) for c in ("phrase", "tui", "cui")]


def _tries(gazetteer: DataFrame, sizes: Sequence[int] | None, types: Sequence[str], most: int) -> list:
    """Broadcast tries that together hold the phrase table, each of a bounded number of phrases."""
    phrases = phrase_table(gazetteer, types)
    if sizes is not None:
        phrases = phrases.filter(F.size(F.split("phrase", " ")).isin(*sizes))
    phrases = cut_lineage(phrases)
    parts = max(1, -(-phrases.count() // most))
    part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
    sc = gazetteer.sparkSession.sparkContext
    return [sc.broadcast(phrase_trie(phrases.filter(part == i).orderBy("phrase").toArrow())) for i in range(parts)]


def _with_spans(notes: DataFrame, gazetteer, key: str, sizes, types, most: int, as_text: bool) -> DataFrame:
    """Columns of ``notes`` but the tokens, with ``spans``, or with ``n_entities`` and ``anno_text``."""
    keep = [c for c in notes.columns if c != "tokens"]
    kinds = [notes.schema[c] for c in keep]
    added = "n_entities int, anno_text string" if as_text else f"spans array<{SPAN}>"
    schema = T.StructType([*kinds, *T.StructType.fromDDL(added).fields])
    tries = _tries(gazetteer, sizes, types, most)
    if len(tries) > 1:
        return _over_tries(notes, tries, key, keep, as_text, schema)
    trie = tries[0]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _bounded(batches):
            column = batch.column("tokens")
            flat, sizes, note, place, start, size, phrase = _matched(trie.value, column)
            fields = _fields(trie.value, phrase)
            if as_text:
                tags = pc.binary_join_element_wise("[", fields[1], "] [", fields[2], "]", "")
                text = _annotated(flat, sizes, place, size, tags, column)
                made = [pa.array(np.bincount(note, minlength=batch.num_rows), pa.int32()), text]
            else:
                made = [_spans_column(batch.num_rows, note, start, size, fields)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *made], names=schema.names)

    return notes.select(*keep, "tokens").mapInArrow(link, schema)


def _over_tries(notes, tries, key, keep, as_text, schema) -> DataFrame:
    """Spans of a phrase table in several tries: the notes walk each, and a note's longest matches
    meet by ``key``, which names a note."""

    def places(trie):
        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _bounded(batches):
                _, _, note, _, start, size, phrase = _matched(trie.value, batch.column("tokens"), True)
                at = pa.array(note)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), pa.array(start, pa.int32()), pa.array(size, pa.int32()), *_fields(trie.value, phrase)],
                    names=[key, "start", "len", "phrase", "tui", "cui"],
                )

        return walk

    rest = "start int, len int, phrase string, tui string, cui string"
    found = None
    for trie in tries:
        one = notes.select(key, "tokens").mapInArrow(
            places(trie), T.StructType([notes.schema[key], *T.StructType.fromDDL(rest).fields])
        )
        found = one if found is None else found.unionByName(one)
    matches = F.struct("start", (-F.col("len")).alias("less"), "phrase", "tui", "cui")
    met = found.groupBy(key).agg(F.sort_array(F.collect_list(matches)).alias("m"))
    joined = notes.select(*keep, "tokens").join(met, key, "left").select(*keep, "tokens", "m")

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _bounded(batches):
            column, m = batch.column("tokens"), batch.column("m")
            flat, sizes = _tokens(column)
            counts = pc.fill_null(m.value_lengths(), 0).to_numpy(zero_copy_only=False)
            note, spans = np.repeat(np.arange(batch.num_rows), counts), m.flatten()
            start, less = (spans.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            place = start + (np.cumsum(sizes) - sizes)[note]
            taken = from_left(place, -less)
            note, start, place, size = note[taken], start[taken], place[taken], -less[taken]
            fields = [spans.field(i).filter(pa.array(taken)) for i in (2, 3, 4)]
            if as_text:
                tags = pc.binary_join_element_wise("[", fields[1], "] [", fields[2], "]", "")
                made = [
                    pa.array(np.bincount(note, minlength=batch.num_rows), pa.int32()),
                    _annotated(flat, sizes, place, size, tags, column),
                ]
            else:
                made = [_spans_column(batch.num_rows, note, start, size, fields)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *made], names=schema.names)

    return joined.mapInArrow(render, schema)


def linked_spans(
    notes: DataFrame,
    gazetteer: DataFrame,
    key: str,
    sizes: Sequence[int] | None = None,
    types: Sequence[str] = ENTITY_TYPES,
    trie_phrases: int = TRIE_PHRASES,
) -> DataFrame:
    """``notes`` without their ``tokens``, with ``spans``: those taken from left to right, the longest
    at each place, none overlapping.  ``sizes`` are the phrase lengths looked for, by default all
    that the phrase table holds.  A null or empty note has no spans."""
    return _with_spans(notes, gazetteer, key, sizes, types, trie_phrases, False)


def link_entities(
    notes: DataFrame, gazetteer: DataFrame, key: str, sizes: Sequence[int] | None = None, **kw
) -> DataFrame:
    """One row per linked span."""
    return linked_spans(notes.select(key, "tokens"), gazetteer, key, sizes, **kw).select(key, F.inline("spans"))


def entity_ids(links: DataFrame) -> DataFrame:
    """Distinct ``[type]`` and ``[concept]`` tokens."""
    ids = F.explode(F.array(*[F.concat(F.lit("["), c, F.lit("]")) for c in ("tui", "cui")]))
    return links.select("tui", "cui").distinct().select(ids.alias("entity_id")).distinct()


def annotate_text(
    notes: DataFrame,
    gazetteer: DataFrame,
    key: str,
    sizes: Sequence[int] | None = None,
    types: Sequence[str] = ENTITY_TYPES,
    trie_phrases: int = TRIE_PHRASES,
) -> DataFrame:
    """``notes`` without their ``tokens``, with ``n_entities`` and ``anno_text``, in which spans are
    replaced by their type and concept.  Other columns come along."""
    return _with_spans(notes, gazetteer, key, sizes, types, trie_phrases, True)


def raw_and_annotated(notes: DataFrame, gazetteer: DataFrame, key: str, **kw) -> DataFrame:
    """``(key, text)``: each note of ``notes (key, text, tokens)`` as it is and annotated, from one
    reading of the notes."""
    both = annotate_text(notes.select(key, "text", "tokens"), gazetteer, key, **kw)
    return both.select(key, F.explode(F.array("text", "anno_text")).alias("text"))
