"""Text and token expressions, all evaluated in the JVM."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of word characters other than decimal digits.
WORD = r"([\p{L}\p{Nl}\p{No}_]+)"
MARKS = r"\p{Mn}+"
#: A word and its repetitions in a sorted list; possessive, so that long runs need no stack.
RUN = r"(?<![^ ])([^ ]+)(?: \1(?![^ ]))*+"


@lru_cache(maxsize=1)
def fold_table() -> tuple[str, str]:
    """Characters whose canonical decomposition loses its combining marks to one other character, and those characters."""
    src, dst = [], []
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        parts = unicodedata.normalize("NFD", c)
        if parts == c or unicodedata.category(c) == "Mn":
            continue
        base = unicodedata.normalize("NFC", "".join(x for x in parts if unicodedata.category(x) != "Mn"))
        if base != c and len(base) == 1:
            src.append(c)
            dst.append(base)
    return "".join(src), "".join(dst)


def deaccent(c: Column) -> Column:
    """Drop accents: combining marks go, composed letters become their base letter. Letters without a decomposition stay."""
    src, dst = fold_table()
    return F.translate(F.regexp_replace(c, MARKS, ""), src, dst)


def normalize(c: Column) -> Column:
    """Lower case, accents dropped. The costly step runs only on texts with more bytes than characters."""
    low = F.lower(c)
    return F.when(F.octet_length(low) > F.length(low), deaccent(low)).otherwise(low)


def tokenize(c: Column) -> Column:
    """T1: the terms of a text, in order. NULL text gives NULL, a text without letters an empty array."""
    return F.regexp_extract_all(normalize(c), F.lit(WORD), F.lit(1))


def token_count(c: Column) -> Column:
    """The number of T1 terms, without building them: folding case and composed letters moves no boundary."""
    return F.regexp_count(F.regexp_replace(c, MARKS, ""), F.lit(WORD)).cast("bigint")


def runs(words: Column) -> Column:
    """The different words of an array in order, each repeated (blank between) as often as it occurs: counting inside the row,
    so that nothing has to be shuffled for it. For words without blanks; `run_term` and `run_count` read a run."""
    return F.regexp_extract_all(F.array_join(F.sort_array(words), " "), F.lit(RUN), F.lit(0))


def run_term(run: Column) -> Column:
    return F.substring_index(run, " ", 1)


def run_count(run: Column, term: Column) -> Column:
    return ((F.octet_length(run) + 1) / (F.octet_length(term) + 1)).cast("bigint")


def terms_of(tokens: Column) -> Column:
    """T1 applied to every element of a token list: an element may yield no term or several; NULL elements yield none."""
    return tokenize(F.array_join(tokens, " "))


def char_ngrams(words: Column, n: int = 4) -> Column:
    """Character n-grams of each word padded as `%word$`. A word of at most `n` letters is kept whole; of a longer one
    the last two windows of the padded form are left out, so `$` never shows there."""
    size = F.lit(n)
    return F.flatten(
        F.transform(
            words,
            lambda w: F.when(F.length(w) <= n, F.array(F.concat(F.lit("%"), w, F.lit("$")))).otherwise(
                F.transform(
                    F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))),
                    lambda i: F.concat(F.lit("%"), w, F.lit("$")).substr(i, size),
                )
            ),
        )
    )


def title_stem(title: Column) -> Column:
    """The title up to its first `_`; the whole title where it has none."""
    return F.substring_index(title, "_", 1)


def clean_text(c: Column) -> Column:
    """Lower case, white space collapsed, then only letters, decimal digits and blanks kept (blanks may meet again)."""
    spaced = F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    return F.regexp_replace(spaced, r"[^\p{L}\p{Nd} ]", "")


def latin_words(c: Column) -> Column:
    """Letters and white space kept, small v and j written u and i *before* lower-casing, split into words."""
    kept = F.regexp_replace(c, r"[^\p{L}\s]", "")
    return F.filter(F.split(F.lower(F.translate(kept, "vj", "ui")), r"\s+"), lambda w: w != "")


def chunks(words: Column, size: int = 1000) -> Column:
    """Consecutive full chunks of `size` words; a shorter tail is dropped, a shorter list gives no chunk."""
    n = F.floor(F.size(words) / F.lit(size)).cast("int")
    return F.when(
        n >= 1, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.array_join(F.slice(words, k * size + 1, F.lit(size)), " "))
    ).otherwise(F.array().cast("array<string>"))
