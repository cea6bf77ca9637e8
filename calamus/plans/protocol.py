"""Same-author testing: vectorise, pair, score, fit and predict."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calamus.operators import impostors as imp
from calamus.operators import weighting
from calamus.operators.counting import ngram_counts, term_counts, vocabulary
from calamus.operators.distances import METRICS, of_pairs
from calamus.operators.matrix import distance_table
from calamus.operators.pairing import against_all, balanced, drawn
from calamus.operators.scoring import scaled
from calamus.session import materialize


@dataclass(frozen=True)
class Config:
    """What a run depends on."""

    n_features: int = 1000
    random_prop: float = 0.5
    sample_features: bool = False
    sample_authors: bool = False
    metric: str = "cosine"
    model: str = "std"
    features: str = "words"
    n_dev_pairs: int | None = None
    n_test_pairs: int | None = None
    balanced_pairs: bool = False
    control_pairs: bool = True
    text_cutoff: int | None = None
    iterations: int = 10
    n_potential: int = 30
    n_actual: int | None = 10
    top_rank: int = 1
    eps: float = 0.01
    weight: float = 0.1
    em_iterations: int = 10
    ngram: int = 4
    seed: int = 1066

    def __post_init__(self) -> None:
        if self.features not in ("words", "chars"):
            raise NotImplementedError(f"features: {self.features}")
        if self.metric not in METRICS:
            raise ValueError(f"no such metric: {self.metric}")
        if self.balanced_pairs and None in (self.n_dev_pairs, self.n_test_pairs):
            raise ValueError("balanced pairs need their numbers")

    @property
    def bootstrap(self) -> imp.Bootstrap:
        return imp.Bootstrap(self.iterations, self.n_potential, self.n_actual, self.top_rank, self.n_features, self.random_prop, self.sample_authors, self.sample_features, False, self.seed)


class SameAuthor:
    """Documents are (doc_id, author, title, words, phase), phase dev or test; vectors are fitted on both together. Vectors are
    written to the shared folder once and used by every later step."""

    def __init__(self, config: Config | None = None, **options):
        self.config = config or Config(**options)
        self.docs: DataFrame | None = None
        self.dtm: DataFrame | None = None
        self.vocab: DataFrame | None = None

    def vectorize(self, docs: DataFrame) -> SameAuthor:
        c = self.config
        self.docs = docs if c.text_cutoff is None else docs.withColumn("words", F.slice("words", 1, c.text_cutoff))
        docs = self.docs
        counts = ngram_counts(docs, c.ngram) if c.features == "chars" else term_counts(docs)
        counts = materialize(counts, "counts")
        self.vocab = materialize(vocabulary(counts, c.n_features, 2, binary=c.model == "bin"), "vocabulary")
        em = {"weight": c.weight, "iterations": c.em_iterations, "eps": c.eps} if c.model == "plm" else {}
        self.dtm = materialize(weighting.weigh(counts, c.model, c.n_features, docs.count(), vocab=self.vocab, **em), "vectors")
        return self

    def phase(self, name: str) -> DataFrame:
        return self.docs.where(F.col("phase") == name)

    def pairs(self, phase: str) -> DataFrame:
        """A sample balanced by label, or of all ordered pairs; without a number, every ordered pair, whose number grows as the
        square of the documents."""
        c, docs = self.config, self.phase(phase)
        n = c.n_dev_pairs if phase == "dev" else c.n_test_pairs
        if c.balanced_pairs:
            return balanced(docs, n, c.control_pairs, c.seed)
        return against_all(docs, docs, c.control_pairs) if n is None else drawn(docs, n, c.control_pairs, c.seed)

    def distances(self, pairs: DataFrame) -> DataFrame:
        """Pairs with `dist`."""
        return of_pairs(pairs, self.dtm, self.config.metric).withColumnRenamed(self.config.metric, "dist")

    def terms(self) -> DataFrame:
        """(term, idx): vocabulary terms numbered in their order; at most n_features rows."""
        from pyspark.sql import Window

        return self.vocab.select("term", (F.row_number().over(Window.orderBy("term")) - 1).cast("bigint").alias("idx"))

    def sigmas(self, pairs: DataFrame, phase: str, filter_imposters: bool = False) -> DataFrame:
        """Impostor scores; the other phase is the background, a phase without another one its own."""
        from dataclasses import replace

        other = self.phase("test" if phase == "dev" else "dev")
        background = other if not other.isEmpty() else self.phase(phase)
        return imp.sigmas(pairs, background, self.dtm, self.terms(), self.config.metric, replace(self.config.bootstrap, filter_authors=filter_imposters))

    @property
    def samples(self) -> bool:
        return self.config.sample_authors or self.config.sample_features

    def fit(self, filter_imposters: bool = False) -> DataFrame:
        """(i, j, label, score) of the development pairs."""
        pairs = materialize(self.pairs("dev"), "pairs")
        if self.samples:
            return self.sigmas(pairs, "dev", filter_imposters)
        return scaled(self.distances(pairs)).select("i", "j", "label", "score")

    def predict(self, filter_imposters: bool = False) -> DataFrame:
        """(phase, i, j, label, score) of development and test pairs, plain distances scaled over both together."""
        pairs = {p: materialize(self.pairs(p), "pairs") for p in ("dev", "test")}
        if self.samples:
            both = [self.sigmas(x, p, filter_imposters).withColumn("phase", F.lit(p)) for p, x in pairs.items()]
            return both[0].unionByName(both[1]).select("phase", "i", "j", "label", "score")
        joint = [self.distances(x).withColumn("phase", F.lit(p)) for p, x in pairs.items()]
        return scaled(joint[0].unionByName(joint[1])).select("phase", "i", "j", "label", "score")

    def distance_table(self, pairs: DataFrame) -> DataFrame:
        return distance_table(self.distances(pairs).select("i", "j", F.col("dist").alias("d")), self.docs)
