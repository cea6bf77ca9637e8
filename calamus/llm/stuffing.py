"""Problem 9: keyword-stuffed and link-list pages, by rank-frequency curves of their passages."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calamus.functions.arrays import elements
from calamus.functions.numeric import let
from calamus.functions.text import normalize, run_count, run_term, runs
from calamus.session import broadcast_if_small, materialize

#: A word that is, or holds, an address; or markup around one.
ADDRESS = r"\S*(?:https?:|hxxps?:|www\.|\[\.\]|href=|\p{L}{2}\.\p{L}{2,})\S*|(?<!\S)<\S*"
HASHTAG = r"(?<!\S)#\S+"
CAPITALISED = r"(?<![\p{L}\p{M}])\p{Lu}\p{Ll}+(?![\p{L}\p{M}])"
BLANK = " \t\n\u000b\f\r"
#: Language codes that name no language (fixed values of ISO 639-2).
NO_LANGUAGE = ("", "und", "mis", "mul", "zxx")


def _language(c: str = "lang") -> Column:
    low = F.lower(F.trim(c))
    return F.when(~low.isin(*NO_LANGUAGE), low)


def _signs(text: Column) -> Column:
    """A text as it enters its curve: addresses and hashtags stand for one sign each, signs and digits go, so that spellings
    of one keyword that differ in these meet. Each costly step runs only on texts that hold what it looks for."""
    plain = normalize(text)
    plain = let(plain, lambda t: F.when(F.regexp_like(t, F.lit(r"\.\p{L}|://|\[\.\]|href=|<")), F.regexp_replace(t, ADDRESS, "§")).otherwise(t))
    plain = let(plain, lambda t: F.when(F.contains(t, F.lit("#")), F.regexp_replace(t, HASHTAG, "§")).otherwise(t))
    return F.btrim(F.regexp_replace(plain, r"[^\p{L}\s§]+", ""), F.lit(BLANK))


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 120) -> DataFrame:
    """(_id, passage, lang, n_words, runs, names): texts in passages of at most `size` words, cut at blank lines and evenly
    within longer blocks, each with its terms as runs (see `text.runs`) and its capitalised words. Every word is in
    one passage. Everything happens inside the row, so no text is shuffled; written once and read by all that follows."""
    whole = docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("_id"), _language().alias("lang"), F.split(F.col(text_col), r"(?:\r\n|\r(?!\n)|\n)[ \t\f]*(?:\r\n|\r|\n)\s*").alias("blocks")
    )
    blocks = elements(whole, ["_id", "lang"], "blocks", "block").select("_id", "lang", F.btrim("block", F.lit(BLANK)).alias("block"))
    counted = blocks.where("block <> ''").withColumn("n", F.regexp_count("block", F.lit(r"\S+")))
    each = F.ceil(F.col("n") / F.ceil(F.col("n") / F.lit(size))).cast("int")
    cut = F.when(F.col("n") <= size, F.array("block")).otherwise(F.regexp_extract_all("block", F.concat(F.lit(r"\S+(?:\s+\S+){0,"), (each - 1).cast("string"), F.lit("}+")), F.lit(0)))
    piece = elements(counted, ["_id", "lang"], cut, "text")
    terms = F.split(_signs(F.col("text")), r"\s+")
    out = piece.select(
        "_id", F.monotonically_increasing_id().alias("passage"), "lang", F.regexp_count("text", F.lit(r"\S+")).alias("n_words"), runs(terms).alias("runs"),
        F.regexp_extract_all("text", F.lit(CAPITALISED), F.lit(0)).alias("names"),
    )
    return materialize(out, "p9-passages")


def term_rows(parts: DataFrame, *keep: str) -> DataFrame:
    """(..., term, n): the terms of passages and how often each occurs there."""
    rows = elements(parts, list(keep), "runs", "run").select(*keep, run_term(F.col("run")).alias("term"), "run")
    return rows.select(*keep, "term", run_count(F.col("run"), F.col("term")).cast("int").alias("n"))


def vocabulary(parts: DataFrame) -> DataFrame:
    """(lang, term, held, n): passages and occurrences of every term by labelled language (NULL is one, too)."""
    return materialize(term_rows(parts, "lang").where("term <> '§'").groupBy("lang", "term").agg(F.count(F.lit(1)).alias("held"), F.sum("n").alias("n")), "p9-vocabulary")


def function_words(parts: DataFrame, vocab: DataFrame, per_language: int = 48, evidence: int = 30) -> DataFrame:
    """(term, language): the terms held by most passages of each language, for every language with at least `evidence`
    labelled passages, however many languages there are and however small their share."""
    known = parts.where("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("_of")).where(F.col("_of") >= evidence)
    top = Window.partitionBy("lang").orderBy(F.desc("held"), "term")
    ranked = vocab.join(broadcast_if_small(known), "lang").withColumn("r", F.row_number().over(top)).where(F.col("r") <= per_language)
    return materialize(ranked.select("term", F.col("lang").alias("language")), "p9-function-words")


def curves(parts: DataFrame, words: DataFrame, size: int = 120) -> DataFrame:
    """One row per passage: its length, the share of function words (of the language that fits best), and its
    rank-frequency curve: slope and residual of ln frequency over ln rank, and the height of its content terms (how often
    each occurs on average).

    Terms of equal frequency hold consecutive ranks, so a passage's terms are first counted per frequency (combined in
    the task that reads them); a window over these few rows gives the ranks, and sums of ln rank come from a table of at
    most 256 numbers. Function words come in by a join with their list, which is broadcast only if counted small."""
    rows = term_rows(parts, "passage")
    listed = words.groupBy("term").agg(F.sort_array(F.collect_list("language")).alias("languages"))  # a list per term, as long as there are languages
    rows = rows.join(broadcast_if_small(listed), "term", "left")
    content = F.col("languages").isNull() & (F.col("term") != "§")
    level = rows.groupBy("passage", "n").agg(F.count(F.lit(1)).cast("int").alias("v"), F.sum(content.cast("int")).cast("int").alias("vc"))
    down = Window.partitionBy("passage").orderBy(F.desc("n"))
    level = level.withColumn("hi", F.sum("v").over(down.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    one, two = [0.0], [0.0]
    for r in range(1, size + 2):
        one.append(one[-1] + math.log(r))
        two.append(two[-1] + math.log(r) ** 2)
    upto = lambda table, c: F.array(*map(F.lit, table))[F.least(c, F.lit(size + 1))]
    level = level.withColumn("lx", upto(one, F.col("hi")) - upto(one, F.col("hi") - F.col("v"))).withColumn("lxx", upto(two, F.col("hi")) - upto(two, F.col("hi") - F.col("v"))).withColumn("y", F.ln(F.col("n").cast("double")))
    y, v = F.col("y"), F.col("v")
    fitted = level.groupBy("passage").agg(
        F.sum(F.col("n") * v).alias("n"), F.sum(F.col("n") * F.col("vc")).alias("c"), F.sum("vc").alias("types"), F.sum(v).cast("double").alias("k"), F.sum("lx").alias("sx"), F.sum(y * v).alias("sy"),
        F.sum("lxx").alias("sxx"), F.sum(y * y * v).alias("syy"), F.sum(F.col("lx") * y).alias("sxy"),
    )
    # Least squares of ln frequency over ln rank.
    k = F.col("k")
    vx, vy, xy = (F.col(s) / k - F.col(a) * F.col(b) / (k * k) for s, a, b in (("sxx", "sx", "sx"), ("syy", "sy", "sy"), ("sxy", "sx", "sy")))
    fitted = fitted.withColumn("slope", F.when(vx > 1e-12, xy / vx).otherwise(F.lit(0.0))).withColumn("residual", F.sqrt(F.greatest(vy - F.col("slope") * xy, F.lit(0.0))))
    by = elements(rows.where("languages is not null"), ["passage", "n"], "languages", "language").groupBy("passage", "language").agg(F.sum("n").alias("f"))
    best = by.groupBy("passage").agg(F.max(F.struct(F.col("f"), F.col("language"))).alias("best"))
    height = F.when(F.col("types") > 0, F.ln(F.col("c") / F.col("types"))).otherwise(F.lit(0.0))
    return fitted.join(best, "passage", "left").select(
        "passage", "n", "c", F.col("best.language").alias("language"), (F.coalesce("best.f", F.lit(0)) / F.col("n")).alias("function"), "slope", "residual", height.alias("height"), F.ln(F.col("n") / F.col("k")).alias("whole_height")
    )


def compared(rows: DataFrame, words: DataFrame, drop: float = 4.0, evidence: float = 4.0, excess: float = 0.5, steep: float = 8.0) -> DataFrame:
    """Passages with `high` and `divergent`: in what their curve is not that of same-language prose of comparable length
    (powers of two).

    * divergent: function words are less than 1/`drop` of what is usual, and the Kullback-Leibler divergence from the
      usual share, times the length, is at least `evidence`. No verdict where the page's language is named and has
      no list of function words: nothing is known of its prose, and all its terms are compared in height;
    * high, by residual: content terms stand on average exp(`excess`) times as high as in such prose (refrains stay below);
    * high, by slope: `steep` times the usual deviation away from the usual slope, with half that residual.
    """
    rows = rows.withColumn("bin", F.floor(F.log2(F.col("n").cast("double"))).cast("int"))
    middle = lambda c, p=0.5: F.percentile_approx(c, p, 1000)
    usual = rows.where("language is not null").groupBy("language", "bin").agg(
        middle("function").alias("u_function"), middle("height").alias("u_height"), middle("slope").alias("u_slope"), ((middle("slope", 0.84) - middle("slope", 0.16)) / 2).alias("u_dev")
    )
    whole = rows.where("language is not null").groupBy("bin").agg(middle("function").alias("w_function"), middle("height").alias("w_height"), middle("whole_height").alias("w_whole"))
    known = words.select(F.col("language").alias("lang"), F.lit(True).alias("_known")).distinct()
    x = rows.join(broadcast_if_small(usual), ["language", "bin"], "left").join(broadcast_if_small(whole), ["bin"], "left").join(broadcast_if_small(known), "lang", "left")
    u = F.least(F.greatest(F.coalesce("u_function", "w_function", F.lit(0.3)), F.lit(0.05)), F.lit(0.95))
    f = F.col("function")
    kl = F.when(f > 0, f * F.ln(f / u)).otherwise(F.lit(0.0)) + F.when(f < 1, (1 - f) * F.ln((1 - f) / (1 - u))).otherwise(F.lit(0.0))
    foreign = F.col("lang").isNotNull() & F.col("_known").isNull()
    divergent = (f * drop < u) & (kl * F.col("n") >= evidence) & ~foreign
    above = F.when(foreign, F.col("whole_height") - F.coalesce("w_whole", F.lit(0.0))).otherwise(F.col("height") - F.coalesce("u_height", "w_height", F.lit(0.0)))
    high = (above >= excess) & (F.col("c") >= 6)
    sloped = (F.abs(F.col("slope") - F.col("u_slope")) >= steep * F.greatest(F.col("u_dev"), F.lit(0.01))) & (above >= excess / 2 + 0.15) & (F.col("c") >= 12)
    return x.withColumn("high", F.coalesce(high, F.lit(False)) | F.coalesce(sloped, F.lit(False))).withColumn("divergent", F.coalesce(divergent, F.lit(False)))


def name_terms(parts: DataFrame, vocab: DataFrame, share: float = 0.9, evidence: int = 3) -> DataFrame:
    """(term): words the collection writes with a capital in at least `share` of all places, `evidence` of them or more."""
    capital = elements(parts, [], "names", "name").select(normalize(F.col("name")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("capital"))
    each = vocab.groupBy("term").agg(F.sum("n").alias("n"))
    return capital.where(F.col("capital") >= evidence).join(each, "term").where(F.col("capital") >= share * F.col("n")).select("term")


def registers(parts: DataFrame, suspects: DataFrame, vocab: DataFrame, share: float = 0.4) -> DataFrame:
    """(passage): suspects (passage, high) of which at least `share` of all terms are names. A list of persons or places has no
    function words either, but it isn't keywords: what it lists is written with a capital wherever it occurs. If it is high, what
    is no name must differ from entry to entry as well (at least `share` different terms), or it repeats keywords between names."""
    terms = materialize(term_rows(parts.join(broadcast_if_small(suspects), "passage"), "passage", "high"), "p9-suspects")
    named = terms.join(name_terms(parts, vocab), "term", "left_semi").groupBy("passage").agg(F.sum("n").alias("names"), F.count(F.lit(1)).alias("name_types"))
    every = terms.groupBy("passage", "high").agg(F.sum("n").alias("of"), F.count(F.lit(1)).alias("types"))
    differs = F.col("types") - F.col("name_types") >= share * (F.col("of") - F.col("names"))
    return every.join(named, "passage").where((F.col("names") >= share * F.col("of")) & (~F.col("high") | differs)).select("passage")


def judged(parts: DataFrame, size: int = 120, **cuts: float) -> DataFrame:
    """(_id, passage, n_words, spam) of every passage: spam if its curve is too high or divergent, and it is no register of names."""
    vocab = vocabulary(parts)
    words = function_words(parts, vocab)
    facts = parts.select("_id", "passage", "lang", "n_words")
    rows = materialize(curves(parts, words, size).join(facts, "passage"), "p9-curves")
    verdicts = materialize(compared(rows, words, **cuts).select("_id", "passage", "n_words", "high", "divergent"), "p9-verdicts")
    lists = registers(parts, verdicts.where("divergent or high").select("passage", "high"), vocab).withColumn("_register", F.lit(True))
    out = verdicts.join(broadcast_if_small(lists), "passage", "left")
    out = out.select("_id", "passage", "n_words", ((F.col("high") | F.col("divergent")) & F.col("_register").isNull()).alias("spam"))
    mute = parts.where(F.size("runs") == 0).select("_id", "passage", "n_words", F.lit(False).alias("spam"))  # nothing but signs
    return out.unionByName(mute)


def spam_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = 0.5, **cuts: float) -> DataFrame:
    """(id, n_words, spam_words) of the pages of which more than `share` of the words belong to passages judged spam.

    Defined results: NULL and blank texts aren't pages; NULL languages are judged by the language that fits best, a
    language of too few passages to know its function words by the height of its curves only; ids that occur twice are
    judged on all their text; an empty table gives no row; other columns are ignored.
    """
    pages = judged(passages(docs, id_col, text_col), **cuts).groupBy(F.col("_id").alias(id_col)).agg(F.sum("n_words").alias("n_words"), F.sum(F.when(F.col("spam"), F.col("n_words")).otherwise(0)).alias("spam_words"))
    return pages.where(F.col("spam_words") > share * F.col("n_words"))
