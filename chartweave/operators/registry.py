"""Feature tables by name: what a probe needs to know is the name.

A table has one row per key, dense (``vec``) or sparse (``ids``, ``weights``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartweave.operators import encoders, features


def _bow(binary: bool):
    def build(docs: DataFrame, key: str, vocabulary: DataFrame, **_) -> DataFrame:
        return features.sparse_bags(docs, key, F.col("tokens"), vocabulary, binary)

    return build


def _boe(job):
    def build(docs: DataFrame, key: str, vectors: DataFrame, **_) -> DataFrame:
        return job(features.bow_freq(docs, key, F.col("tokens")), vectors, key).select(key, "vec")

    return build


def _encoded(name: str):
    def build(docs: DataFrame, key: str, make_encoder, **_) -> DataFrame:
        texts = docs.select(key, F.array_join("tokens", " ").alias("text"))
        return encoders.encode_features(texts, name, make_encoder, key).select(key, "vec")

    return build


# The names of feature sets.
BUILDERS: dict[str, Callable[..., DataFrame]] = {
    "BOW-BIN": _bow(True),
    "BOW-FREQ": _bow(False),
    "BOE-BIN": _boe(features.boe_bin),
    "BOE-SUM": _boe(features.boe_sum),
    "U2V": lambda docs, key, vectors, **_: features.user_vectors(docs, vectors, key),
    **{name: _encoded(name) for name in encoders.FEATURES},
}


def build(name: str, docs: DataFrame, key: str, **inputs) -> DataFrame:
    """The features called ``name`` of ``docs (key, tokens)``.

    Bags of words take ``vocabulary (id, token)``, bags of embeddings ``vectors (token, vec)``,
    user vectors ``vectors (key, vec)``, encodings ``make_encoder``; other inputs are ignored, so a
    job may pass all it has.  An unknown name raises.
    """
    if name not in BUILDERS:
        raise NotImplementedError(name)
    return BUILDERS[name](docs, key, **inputs)
