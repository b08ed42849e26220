"""Document encoding with an encoder the caller supplies.

``make_encoder`` is called once per task and returns a function from a list of
texts to one ``(tokens x dims)`` array per text; the first token's vector is the
classification vector.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartweave.functions.text import chunks
from chartweave.operators.features import pool_first, pool_mean

Encoder = Callable[[Sequence[str]], Sequence[np.ndarray]]

# Documents and chunks per encoder call.
BATCH = 64
MULTI_BATCH = 32
#: Characters of the documents of one call, unless a single one has more, and tokens that the check
#: encoder remembers: what a task holds does not grow with its documents.
CALL_CHARS = 1 << 20
MEMO_TOKENS = 20_000
# Feature names and the way they read the encoder output.
FEATURES = {
    "BERT-POOL": ("single", "mean"),
    "BERT-CLS": ("single", "cls"),
    "MULTI-BERT-POOL": ("multi", "mean"),
    "MULTI-BERT-CLS": ("multi", "cls"),
    "CLINICALBERT-POOL": ("single", "mean"),
    "CLINICALBERT-CLS": ("single", "cls"),
    "CLINICALMULTI-BERT-POOL": ("multi", "mean"),
    "CLINICALMULTI-BERT-CLS": ("multi", "cls"),
}


def _calls(texts: Sequence[str], batch: int) -> Iterator[slice]:
    """Slices of at most ``batch`` texts and ``CALL_CHARS`` characters, of one text at least."""
    first = chars = 0
    for i, n in enumerate(len(t) if t else 0 for t in texts):
        if i > first and (i - first == batch or chars + n > CALL_CHARS):
            yield slice(first, i)
            first, chars = i, 0
        chars += n
    if len(texts) > first:
        yield slice(first, len(texts))


def encode(
    docs: DataFrame,
    make_encoder: Callable[[], Encoder],
    keys: Sequence[str],
    text: str = "text",
    pooling: str = "mean",
    batch: int = BATCH,
) -> DataFrame:
    """``(*keys, vec)``; ``pooling`` is ``mean`` or ``cls``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make_encoder()
        for pdf in batches:
            for at in _calls(pdf[text], batch):
                part = pdf.iloc[at]
                states = encoder(part[text].tolist())
                vec = [s.mean(axis=0) if pooling == "mean" else s[0] for s in states]
                yield part[list(keys)].assign(vec=[v.astype(float).tolist() for v in vec])

    source = docs.select(*keys, text)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema if f.name in keys)
    return source.mapInPandas(run, f"{schema}, vec array<double>")


def encode_multi(
    docs: DataFrame,
    make_encoder: Callable[[], Encoder],
    key: str,
    text: str = "text",
    pooling: str = "mean",
    window: int = 128,
    max_parts: int | None = None,
) -> DataFrame:
    """Encode all token windows of a document, or the first ``max_parts``, and pool them."""
    windows = chunks(F.split(text, " "), window)
    if max_parts is not None:
        windows = F.slice(windows, 1, max_parts)
    parts = docs.select(key, F.posexplode(windows).alias("part", "_w")).select(
        key, "part", F.array_join("_w", " ").alias("text")
    )
    encoded = encode(parts, make_encoder, [key, "part"], "text", pooling, MULTI_BATCH)
    return pool_mean(encoded, key) if pooling == "mean" else pool_first(encoded, key)


def encode_features(docs: DataFrame, feature: str, make_encoder, key: str, text: str = "text") -> DataFrame:
    """Encode by feature name."""
    if feature not in FEATURES:
        raise NotImplementedError(feature)
    form, pooling = FEATURES[feature]
    if form == "multi":
        return encode_multi(docs, make_encoder, key, text, pooling)
    return encode(docs, make_encoder, [key], text, pooling)


def hash_encoder(dims: int = 8) -> Callable[[], Encoder]:
    """Encoder without weights for checks: a token's vector is the square roots of its
    md5 bytes."""

    def make() -> Encoder:
        memo: dict[str, np.ndarray] = {}

        def vector(token: str) -> np.ndarray:
            if token not in memo:
                if len(memo) >= MEMO_TOKENS:
                    memo.clear()
                digest = hashlib.md5(token.encode()).digest()[:dims]
                memo[token] = np.sqrt(np.frombuffer(digest, dtype=np.uint8).astype(float))
            return memo[token]

        return lambda texts: [np.stack([vector(t) for t in x.split(" ")]) for x in texts]

    return make
