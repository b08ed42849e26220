"""Text normalisation, tokens and sentences as built-in expressions (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separators of the joined text format.
SENTENCE_MARK = " [EOS] "
NOTE_MARK = " [EOD] "

# Ordered literal replacements applied after digits became NUM.
PLACEHOLDERS = (
    ("[**doctor last name NUM**]", "DOCTOR"),
    ("[**doctor last name **]", "DOCTOR"),
    ("[**NUM-NUM**]", "DATE"),
    ("[**NUM-NUM-NUM**]", "DATE"),
    ("NUM:NUM", "TIME"),
)

TOKEN = r"[\p{L}\p{N}_]++|[^\p{L}\p{N}_\s]"
BLANKS = " \t\n\f\r"
SENTENCE_END = r"([.!?])\s+"
BREAK = "\u0001"


def normalise(text: Column) -> Column:
    """Lower case, one-line, digits to NUM, placeholders to DOCTOR/DATE/TIME."""
    out = F.regexp_replace(F.translate(F.lower(text), "\n\t", "  "), "[0-9]+", "NUM")
    for found, label in PLACEHOLDERS:
        out = F.replace(out, F.lit(found), F.lit(label))
    return out


def tokens(text: Column) -> Column:
    """Words and single punctuation marks."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def tokenise(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _mark_breaks(text: Column) -> Column:
    return F.regexp_replace(F.rtrim(text, F.lit(BLANKS)), SENTENCE_END, "$1" + BREAK)


def sentences(text: Column) -> Column:
    """Raw sentences; a sentence ends at ``.``, ``!`` or ``?`` before white space."""
    return F.split(_mark_breaks(text), BREAK)


def clean(text: Column) -> Column:
    """Sentence split, normalise, tokenise, and join by the sentence mark.

    The break character travels through the tokeniser as a token of its own, so
    the whole chain stays one generated expression instead of a lambda per sentence.
    Tokens hold no white space, so joining them leaves nothing to squeeze.
    """
    words = tokenise(normalise(_mark_breaks(text)))
    return F.replace(words, F.lit(f" {BREAK} "), F.lit(SENTENCE_MARK))


def cleaned_sentences(cleaned: Column) -> Column:
    return F.split(cleaned, r" \[EOS\] ")


def words_of(text: Column) -> Column:
    """White-space words of lower-cased text, without empties."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def chunks(items: Column, size: int) -> Column:
    """Consecutive pieces of at most ``size`` items."""
    starts = F.when(
        F.size(items) > 0, F.sequence(F.lit(1), F.size(items), F.lit(size))
    ).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.slice(items, s, F.lit(size)))


# ---- tokens by rules, sentence breaks with learned abbreviations ---------------------

# Contractions that are tokens of their own.
CLITICS = ("s", "re", "ve", "ll", "d", "m")
#: Tokens in the order they are tried: dots of an ellipsis, initials, numbers, contractions, words,
#: single other characters.
WORD_RULES = (
    r"\.{2,}",
    r"(?:\p{L}\.){2,}",
    r"\p{N}+(?:[.,:/]\p{N}+)*",
    r"n't",
    rf"'(?:{'|'.join(CLITICS)})\b",
    r"[\p{L}\p{N}_]+",
    r"[^\s]",
)
# Where a contraction is set off from its word.
NEGATED = r"(\p{L})(n't)\b"
CLITIC = rf"(\p{{L}})('(?:{'|'.join(CLITICS)}))\b"


def word_tokens(text: Column) -> Column:
    """Words, numbers, initials, contractions and punctuation of lower-case text: ``don't`` is
    ``do n't``, ``1.5`` and ``b.i.d.`` stay whole."""
    apart = F.regexp_replace(F.regexp_replace(text, NEGATED, "$1 $2"), CLITIC, "$1 $2")
    return F.regexp_extract_all(apart, F.lit("|".join(WORD_RULES)), F.lit(0))


def learned_sentences(text: Column, abbreviations: Column) -> Column:
    """Sentences of a text: a word that ends in ``!`` or ``?``, or in a full stop without being one of
    ``abbreviations`` (lower-case, without the stop), closes one.  White space becomes single spaces."""
    words = F.array_remove(F.split(text, r"\s+"), "")

    def closes(w: Column) -> Column:
        bare = F.lower(F.regexp_replace(w, r"^[^\p{L}\p{N}]+|\.$", ""))
        return w.rlike(r"[!?]$") | (w.rlike(r"\.$") & ~F.array_contains(abbreviations, bare))

    marked = F.transform(words, lambda w: F.when(closes(w), F.concat(w, F.lit(BREAK))).otherwise(F.concat(w, F.lit(" "))))
    return F.array_remove(F.transform(F.split(F.array_join(marked, ""), BREAK), lambda s: F.trim(s)), "")
