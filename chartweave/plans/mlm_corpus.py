"""Notes to fixed-width training arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartweave.functions import text as X
from chartweave.operators import cohort, entities, mlm, vocab
from chartweave.session import cut_lineage


def annotated_notes(cleaned: DataFrame, gazetteer: DataFrame, sizes: Sequence[int] | None = None) -> DataFrame:
    """Notes with their entities replaced by type and concept."""
    keyed = cleaned.withColumn("_key", F.struct("subject_id", "note_id"))
    marked = keyed.withColumn("tokens", F.split("text", " ")).drop("text")
    anno = entities.annotate_text(marked, gazetteer, "_key", sizes)
    return anno.drop("_key", "n_entities").withColumnRenamed("anno_text", "text")


def build_units(texts: DataFrame, entity_ids: Sequence[str] = (), size: int = vocab.VOCAB_SIZE) -> list[str]:
    """Subword vocabulary of the given texts."""
    return vocab.subword_vocab(vocab.word_types(texts), size, entity_ids)


def instances(
    notes: DataFrame,
    units: Sequence[str],
    share: float = 0.2,
    seed: int = 123,
    max_len: int = mlm.MAX_SEQ_LEN,
    min_len: int = mlm.MIN_SEQ_LEN,
    max_preds: int = mlm.MAX_PREDS,
    prob: float = mlm.MASK_PROB,
) -> DataFrame:
    """``(split, subject_id, start, token_ids, label_ids, mask, indices)`` of cleaned
    notes: a share of each subject's notes is held out, sentences follow the permuted
    notes, and both splits run through the same steps."""
    held = cut_lineage(cohort.note_holdout(notes, share, seed))
    out = None
    for split in ("train", "val"):
        mine = held.filter(F.col("split") == split)
        sentences = mine.select(
            "subject_id", "perm", F.posexplode(X.cleaned_sentences(F.col("text"))).alias("sent_seq", "text")
        ).filter("text <> ''")
        numbered = mlm.number_sentences(sentences, [F.col("perm"), F.col("sent_seq")])
        pieces = vocab.subword_encode(F.split("text", " "), units)
        packed = mlm.pack_sequences(
            numbered.select("subject_id", "pos", pieces.alias("tokens")), max_len, min_len
        )
        picked = mlm.mask_positions(packed, prob, max_preds, seed)
        masked = mlm.mask_tokens(picked, list(units), seed)
        part = mlm.mlm_features(masked, list(units), max_len, max_preds).withColumn("split", F.lit(split))
        out = part if out is None else out.unionByName(part)
    return out
