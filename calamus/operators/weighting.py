"""Vector space models over (doc_id, term, tf): the weights, and the parsimonious language model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calamus.functions.arrays import elements
from calamus.functions.numeric import let, logaddexp
from calamus.operators.counting import vocabulary
from calamus.operators.pairing import crossed
from calamus.session import broadcast_if_small, materialize

MODELS = ("tf", "std", "tfidf", "plm", "bin")


def restrict(counts: DataFrame, vocab: DataFrame, whole: bool = False) -> DataFrame:
    """Counts of the vocabulary's terms with their cf and df. The vocabulary has at most as many rows as it was cut to; a
    `whole` one has no such bound and is broadcast only where it is counted small."""
    return counts.join(broadcast_if_small(vocab) if whole else F.broadcast(vocab), "term")


def unit_length(values: DataFrame) -> DataFrame:
    """Every document's vector scaled to length 1; a zero vector stays as it is."""
    square = F.sum(F.col("value") * F.col("value")).over(Window.partitionBy("doc_id"))
    return values.withColumn("value", F.when(square > 0, F.col("value") / F.sqrt(square)).otherwise(F.col("value")))


def tf(counts: DataFrame) -> DataFrame:
    return unit_length(counts.select("doc_id", "term", F.col("tf").cast("double").alias("value")))


def binary(counts: DataFrame) -> DataFrame:
    return unit_length(counts.select("doc_id", "term", F.lit(1.0).alias("value")))


def tfidf(counts: DataFrame, n_docs: int) -> DataFrame:
    """tf times ln((1 + N) / (1 + df)) + 1, to unit length."""
    idf = F.ln(F.lit(1.0 + n_docs) / (1 + F.col("df"))) + 1
    return unit_length(counts.select("doc_id", "term", (F.col("tf") * idf).alias("value")))


def std(counts: DataFrame, n_docs: int) -> DataFrame:
    """Unit-length frequencies divided by each term's population deviation over all documents, absent ones (zeros) included;
    a deviation of 0 divides by 1. Then to unit length again. Deviations are one row per vocabulary term, so broadcast."""
    x = tf(counts)
    n = F.lit(float(n_docs))
    var = F.greatest(F.sum(F.col("value") * F.col("value")) / n - F.pow(F.sum("value") / n, F.lit(2)), F.lit(0.0))
    dev = x.groupBy("term").agg(F.sqrt(var).alias("sd"))
    scaled = x.join(F.broadcast(dev), "term").select("doc_id", "term", (F.col("value") / F.when(F.col("sd") > 0, F.col("sd")).otherwise(F.lit(1.0))).alias("value"))
    return unit_length(scaled)


def background(vocab: DataFrame, weight: float) -> DataFrame:
    """(term, pc): the terms' shares of all vocabulary occurrences, times 1 - weight."""
    total = vocab.agg(F.sum("cf").alias("total"))
    return vocab.crossJoin(F.broadcast(total)).select("term", (F.col("cf") / F.col("total") * (1 - weight)).alias("pc"))


def _em(items: Column, start: Column, weight: float, iterations: int, eps: float | None) -> Column:
    """EM over one document as a fold in the JVM. An `eps` stops a document when no term differs by as much from the scaled
    estimate of its own iteration (which is seldom)."""

    def step(p: Column) -> Column:
        scaled = F.transform(p, lambda x: x * weight)

        def expected(q: Column) -> Column:
            e = F.zip_with(items, q, lambda it, x: it["tf"] * x / (it["pc"] + x))
            return let(e, lambda v: let(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), lambda s: F.transform(v, lambda x: x / s)))

        def judged(q: Column) -> Column:
            close = (lambda m: F.lit(False)) if eps is None else (lambda m: F.forall(F.zip_with(m, q, lambda a, b: F.abs(a - b)), lambda d: d < eps))
            return let(expected(q), lambda m: F.struct(m.alias("p"), close(m).alias("done")))

        return let(scaled, judged)

    first = F.struct(start.alias("p"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), first, lambda s, _: F.when(s["done"], s).otherwise(step(s["p"])))["p"]


def plm(counts: DataFrame, vocab: DataFrame, weight: float = 0.1, iterations: int = 50, eps: float | None = 0.01, dense: bool = False) -> DataFrame:
    """(doc_id, term, value): the parsimonious language model of each document against the corpus. `dense` starts from the
    document's own shares, always runs all iterations and takes a whole vocabulary; otherwise all terms start equal."""
    pc = background(vocab, weight)
    rows = counts.select("doc_id", "term", "tf").join(broadcast_if_small(pc) if dense else F.broadcast(pc), "term")
    item = F.struct("term", F.col("tf").cast("double").alias("tf"), "pc")
    docs = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    total = F.aggregate("items", F.lit(0.0), lambda a, x: a + x["tf"])
    start = F.transform("items", lambda x: x["tf"] / total) if dense else F.transform("items", lambda x: F.lit(1.0) / F.size("items"))
    fitted = docs.select("doc_id", F.arrays_zip(F.col("items.term").alias("term"), _em(F.col("items"), start, weight, iterations, None if dense else eps).alias("value")).alias("z"))
    return elements(fitted, ["doc_id"], "z", "z").select("doc_id", F.col("z.term").alias("term"), F.col("z.value").alias("value"))


def top_terms(model: DataFrame, k: int) -> DataFrame:
    """(doc_id, term, value, rank): the k most probable terms of each document, ties by term."""
    order = Window.partitionBy("doc_id").orderBy(F.desc(F.round("value", 9)), "term")
    return model.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def cross_entropy(queries: DataFrame, model: DataFrame, pc: DataFrame, weight: float = 0.1) -> DataFrame:
    """(q, doc_id, ce): minus the sum over the query's terms of its probability times logaddexp(pc, ln p + weight), p the
    document's; a term the document lacks counts with pc alone, also where it lacks them all: every query meets every document. Linear and logarithmic terms meet there."""
    q = queries.join(broadcast_if_small(pc), "term").select(F.col("doc_id").alias("q"), "term", F.col("value").alias("pq"), "pc")
    base = q.groupBy("q").agg(F.sum(F.col("pq") * F.col("pc")).alias("base"))
    more = F.col("pq") * (logaddexp(F.col("pc"), F.ln("value") + weight) - F.col("pc"))
    met = q.join(model.where("value > 0"), "term").groupBy("q", "doc_id").agg(F.sum(more).alias("more"))
    every = crossed(base, model.select("doc_id").distinct(), "q", "doc_id")
    return every.join(met, ["q", "doc_id"], "left").select("q", "doc_id", (-(F.col("base") + F.coalesce("more", F.lit(0.0)))).alias("ce"))


def rank_models(entropies: DataFrame) -> DataFrame:
    """Documents ranked for each query by ascending cross-entropy."""
    return entropies.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.round("ce", 9), "doc_id")))


def weigh(counts: DataFrame, model: str, n_features: int, n_docs: int, min_df: int = 2, vocab: DataFrame | None = None, **em) -> DataFrame:
    """(doc_id, term, value) by a model's name, over the `n_features` best terms (or a vocabulary already made), at unit length."""
    if model not in MODELS:
        raise ValueError(f"no such model: {model}")
    if vocab is None:
        vocab = materialize(vocabulary(counts, n_features, min_df, binary=model == "bin"), "vocabulary")
    kept = restrict(counts, vocab)
    if model == "tf":
        return tf(kept)
    if model == "bin":
        return binary(kept)
    if model == "tfidf":
        return tfidf(kept, n_docs)
    if model == "std":
        return std(kept, n_docs)
    return unit_length(plm(kept, vocab, **em))
