"""Licence notices in texts, by a positional index of rare licence words.

Each notice is a short run of words with key phrases that must stand in it.  The index
holds, for every notice, the word of its key phrases with the highest inverse document
frequency in the corpus and its places; a text's own rarest words are not looked for.  A text looks
up its words in the index; each hit gives the place where the notice would start, and the key phrases must stand there in full.
Key phrases that name a licence settle its label, whatever the corpus; where others use the
same phrase, the notice's other words are compared at their relative places, weighted by
rarity.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases that settle a licence wherever they stand.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Notices in common use: label, words, key phrases.
NOTICES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", ("permission is hereby granted free of charge",)),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3", ("gnu lesser general public license", "version 3")),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ("gnu affero general public license", "version 3")),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", ("distribute this software for any purpose",)),
    ("epl-2", "under the terms of the eclipse public license v 2 0", ("eclipse public license",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc0", "creative commons zero public domain dedication", ("creative commons zero",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("all-rights-reserved", "all rights reserved", ("all rights reserved",)),
)
#: Key phrases that other licences or versions hold too, and the weighted share of their
#: notice's words that must match.
SHARED = {"permission is hereby granted free of charge", "mozilla public license", "eclipse public license"}
LEAST = 0.75


def words(text: Column) -> Column:
    # Other letters may be lowered too: they are letters of words before and after, and no
    # phrase holds them.
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BREAKS), "")


def document_counts(docs: DataFrame, text_col: str = "text") -> tuple[int, dict[str, int]]:
    """Number of texts, and of texts that hold each licence word: one pass, one row for each
    word of the notices."""
    vocabulary = sorted({w for _, notice, _ in NOTICES for w in notice.split()})
    known = F.array(*[F.lit(w) for w in vocabulary])
    held = F.array_intersect(words(F.col(text_col)), known)
    rows = docs.select(F.explode(F.concat(held, F.array(F.lit(""))))).groupBy("col").count().collect()
    counts = {r["col"]: r["count"] for r in rows}
    return counts.pop("", 0), counts


def _phrase_at(w: Column, start: Column, phrase: str) -> Column:
    parts = phrase.split()
    ok = F.lit(True)
    for k, p in enumerate(parts):
        ok = ok & (F.coalesce(F.get(w, start + k), F.lit("")) == p)
    return ok & (start >= 0)


def _starts(w: Column, hits: Column, word: str, place: int) -> Column:
    """Where a phrase would start if each hit of ``word`` is its word number ``place``."""
    return F.transform(F.filter(hits, lambda i: F.get(w, i) == word), lambda i: i - place)


def _holds(w: Column, phrase: str):
    return lambda start: _phrase_at(w, start, phrase)


def _notice_scores(
    w: Column, hits: Column, notice: str, keys: tuple[str, ...], weight: dict[str, float]
) -> tuple[Column, list[str]]:
    """Best weighted share of the notice's words over the places its anchor gives, 1 where its
    key phrases name the licence, and the anchor, a word that no place of the phrases lacks."""
    own = notice.split()
    rare = sorted(set(" ".join(keys).split()), key=lambda x: (-weight[x], own.index(x)))[:1]
    total = sum(weight[x] for x in own)
    starts = F.array_distinct(
        F.concat(
            *[
                _starts(w, hits, a, k)
                for a in rare
                for k in [j for j, x in enumerate(own) if x == a]
            ]
        )
    )

    def share(s: Column) -> Column:
        ok = F.lit(True)
        for key in keys:
            at = notice.split(key)[0].count(" ")
            ok = ok & _phrase_at(w, s + at, key)
        if not SHARED & set(keys):
            return F.when(ok, 1.0).otherwise(0.0)
        found = F.lit(0.0)
        for k, x in enumerate(own):
            found = found + F.when(F.coalesce(F.get(w, s + k), F.lit("")) == x, F.lit(weight[x])).otherwise(0.0)
        return F.when(ok, F.least(F.lit(1.0), found / F.lit(total))).otherwise(0.0)

    return F.coalesce(F.array_max(F.transform(starts, share)), F.lit(0.0)), rare


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: words, base places, labels and a score from 0 to 1.

    A null or empty text has no words, no labels (empty strings) and score 0.  Repeated rows
    give repeated rows; a null id stays null; other columns are not looked at.
    """
    n, counts = document_counts(docs, text_col)
    weight = {
        w: math.log((n + 1) / (counts.get(w, 0) + 0.5)) + 0.01 for _, notice, _ in NOTICES for w in notice.split()
    }
    least = min([0.0, *weight.values()])
    weight = {w: x - least + 0.01 for w, x in weight.items()}
    w, hits = F.col("_w"), F.col("_i")
    shares, index = [], {"mit", "apache", "cc"}
    for label, notice, keys in NOTICES:
        share, rare = _notice_scores(w, hits, notice, keys, weight)
        shares.append((label, share))
        index |= set(rare)
    known = F.array(*[F.lit(x) for x in sorted(index)])
    parts = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("_w"))
    none = F.array().cast("array<int>")
    places = F.filter(
        F.sequence(F.lit(0), F.size("_w") - 1), lambda i: F.get(w, i).isin(*sorted(index))
    )
    found = parts.select("doc_id", "_w", F.when(F.arrays_overlap("_w", known), places).otherwise(none).alias("_i"))
    lead = {"under the mit license": ("mit", 2), "apache license version 2": ("apache", 0), "cc by nc": ("cc", 0)}
    base = {
        label: F.filter(_starts(w, hits, *lead[p]), _holds(w, p))
        for p, label in BASE.items()
    }
    some = F.size("_i") > 0
    wide = found.select(
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        *[F.when(some, c).otherwise(none).alias(f"_b{i}") for i, c in enumerate(base.values())],
        *[F.when(some, c).otherwise(0.0).alias(f"_s{i}") for i, (_, c) in enumerate(shares)],
    )
    every = F.concat(*[F.col(f"_b{i}") for i in range(len(base))])
    from_base = [F.when(F.size(f"_b{i}") > 0, F.lit(label)) for i, label in enumerate(base)]
    from_notice = [F.when(F.col(f"_s{i}") >= LEAST, F.lit(label)) for i, (label, _) in enumerate(shares)]

    def joined(labels: list[Column]) -> Column:
        return F.array_join(F.sort_array(F.array_distinct(F.array_compact(F.array(*labels)))), ",")

    best = F.greatest(*[F.col(f"_s{i}") for i in range(len(shares))])
    return wide.select(
        "doc_id",
        "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        joined(from_base).alias("base_labels"),
        joined(from_base + from_notice).alias("labels"),
        F.when(F.size(every) > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )
