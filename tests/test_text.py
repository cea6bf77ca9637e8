import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from calamus.functions import text as T


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("r")).first()["r"]


def reference_terms(text):
    low = unicodedata.normalize("NFD", text.lower())
    plain = unicodedata.normalize("NFC", "".join(c for c in low if unicodedata.category(c) != "Mn"))
    return re.findall(r"(?:(?!\d)\w)+", plain)


def test_tokenize_golden(spark):
    assert one(spark, "﻿Él n'a 2nd foo_bar 3", T.tokenize) == ["el", "n", "a", "nd", "foo_bar"]
    assert one(spark, "él", T.tokenize) == ["el"]
    assert one(spark, "", T.tokenize) == []
    assert one(spark, None, T.tokenize) is None


LETTERS = st.text(alphabet=st.characters(min_codepoint=32, max_codepoint=0x24F, blacklist_categories=("Cs",)) | st.sampled_from("αβγάέήώΐ́̈ "), max_size=40)


@settings(max_examples=20, deadline=None)
@given(st.lists(LETTERS, min_size=20, max_size=20))
def test_tokenize_property(spark, texts):
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.tokenize(F.col("t")).alias("r"), T.token_count(F.col("t")).alias("n")).collect()
    for r in got:
        if "Σ" not in texts[r["i"]]:
            assert r["r"] == reference_terms(texts[r["i"]])
        assert r["n"] == len(r["r"])


@pytest.mark.parametrize(("word", "grams"), [("abcd", ["%abcd$"]), ("abcde", ["%abc", "abcd"]), ("abcdef", ["%abc", "abcd", "bcde"])])
def test_char_ngrams(spark, word, grams):
    got = spark.createDataFrame([([word],)], "w array<string>").select(T.char_ngrams(F.col("w"), 4).alias("g")).first()["g"]
    assert got == grams


def test_clean_text_keeps_doubled_blanks(spark):
    assert one(spark, "Ab  - c9!", T.clean_text) == "ab  c9"


def test_latin_words_replace_before_lowering(spark):
    assert one(spark, "Vj, vivo 1x", T.latin_words) == ["vi", "uiuo", "x"]


def test_chunks_drop_the_tail(spark):
    words = [str(i) for i in range(7)]
    df = spark.createDataFrame([(words,), (words[:2],)], "w array<string>").select(T.chunks(F.col("w"), 3).alias("c"))
    assert [r["c"] for r in df.collect()] == [["0 1 2", "3 4 5"], []]


def test_title_stem(spark):
    assert one(spark, "a_b_c", T.title_stem) == "a"
    assert one(spark, "abc", T.title_stem) == "abc"
