"""Problem 3: train, validation and test splits that keep related records together."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calamus.functions.hashing import key
from calamus.functions.text import title_stem
from calamus.llm.records import once, running_sum
from calamus.session import broadcast_if_small, materialize

SHARES = (("train", 0.8), ("validation", 0.1), ("test", 0.1))


def author_key(author: Column) -> Column:
    """Trimmed, upper case; a blank author is no author."""
    name = F.upper(F.regexp_replace(author, r"^\s+|\s+$", ""))
    return F.when(name != "", name)


def _stem(title: Column) -> Column:
    return F.when(F.instr(title, "_") > 0, F.lower(title_stem(title)))


def author_stems(corpus: DataFrame) -> DataFrame:
    """Distinct (author, stem): what ties records. The stem is NULL where the title has no `_`."""
    return corpus.select(author_key(F.col("author")).alias("author"), _stem(F.col("title")).alias("stem")).where(F.col("author").isNotNull()).distinct()


def _contract(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges with both ends replaced by their roots, smaller end first, loops and repetitions gone."""
    up = roots.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    for end in ("a", "b"):
        edges = edges.join(up, F.col(end) == F.col("_n"), "left").withColumn(end, F.coalesce("_r", end)).drop("_n", "_r")
    return edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge (a, b) that is not its own root; the root is the least node of its component.

    Each round hooks every node to its least smaller neighbour, shortens the chains so made by pointer jumping, and
    contracts the edges, so that they shrink from round to round. Every state is a written table; nothing is collected.
    """
    state = None
    edges = materialize(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while not edges.isEmpty():
        hooks = materialize(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), "hooks")
        while True:
            above = hooks.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
            jumped = hooks.join(above, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("_moved"))
            jumped = materialize(jumped, "jumped")
            hooks = jumped.select("node", "root")
            if jumped.where("_moved").isEmpty():
                break
        if state is None:
            state = hooks
        else:
            above = hooks.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
            moved = state.join(above, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"))
            state = materialize(moved.unionByName(hooks), "state")
        edges = materialize(_contract(edges, hooks), "edges")
    return state if state is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _star(pairs: DataFrame) -> DataFrame:
    """Edges that tie the authors of a stem: its least author to each other one, so a stem costs as many as it has authors."""
    first = pairs.where(F.col("stem").isNotNull()).groupBy("stem").agg(F.min("author").alias("a"), F.max("author").alias("_z")).where(F.col("a") != F.col("_z"))
    return pairs.join(first, "stem").select("a", F.col("author").alias("b"))


def _rooted(df: DataFrame, column: str, roots: DataFrame) -> DataFrame:
    """`column` replaced by its root, where it has one."""
    up = roots.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    return df.join(up, F.col(column) == F.col("_n"), "left").withColumn(column, F.coalesce("_r", column)).drop("_n", "_r")


def author_components(corpus: DataFrame) -> DataFrame:
    """(author, component): authors that must share a label, each component named by its least author."""
    pairs = materialize(author_stems(corpus), "author-stems")
    each = pairs.select("author", F.col("author").alias("component")).distinct()
    return _rooted(each, "component", connected(_star(pairs)))


def tied_authors(components: DataFrame, salt: int = 8) -> DataFrame:
    """(author_1, author_2): every pair of different authors of a component, smaller string first. That form is asked for;
    components are shared out by a salt, so that one task needn't write all pairs of the largest."""
    shared = components.join(components.groupBy("component").count().where(F.col("count") > 1).select("component"), "component", "left_semi")
    shared = materialize(shared, "tied")
    left = shared.select("component", F.col("author").alias("author_1"), F.pmod(F.xxhash64("author"), F.lit(salt)).alias("_s"))
    right = shared.select("component", F.col("author").alias("author_2"), F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(salt)])).alias("_s"))
    return left.join(right, ["component", "_s"]).where(F.col("author_1") < F.col("author_2")).select("author_1", "author_2")


@dataclass(frozen=True)
class State:
    """What is kept from run to run. `members`: (kind, member, component, split, n), one row per author, title stem and record
    without author, with the records it stands for; `records`: (doc_id, component, split), the label of every record so far."""

    members: DataFrame
    records: DataFrame

    def save(self, path: str) -> None:
        """Both tables below a path that does not exist yet; one path per run, so that a failed run loses nothing."""
        self.members.write.parquet(f"{path}/members")
        self.records.write.parquet(f"{path}/records")

    @staticmethod
    def load(spark: SparkSession, path: str) -> State:
        return State(spark.read.parquet(f"{path}/members"), spark.read.parquet(f"{path}/records"))


MEMBERS, RECORDS = "kind string, member string, component string, split string, n bigint", "doc_id bigint, component string, split string"


def split_records(corpus: DataFrame, previous: State | None = None, shares=SHARES, large: float = 0.01, seed: str = "10") -> tuple[DataFrame, State]:
    """(doc_id, component, split) for every record of `corpus`, and the state to keep for the next run, which may bring new
    records only.

    A record known from an earlier run keeps its label. A new one is tied to what is known by its author and by its title's stem,
    both of which the state remembers. A component that holds one earlier split keeps it. New records of a component that
    joins different earlier splits are put into `quarantine`: no label would be true to all; what was labelled before
    stays. New components fill what each split lacks of all records, earlier ones included: those with more than `large` of all
    records (fewer than 1/large) one by one, largest first, where most is lacking; the rest along a hashed order cut at the
    remaining shares, by running sums per hash bucket. Records without an author are components of their own, named
    `record:` and the id, which no author (in upper case) can be.

    Defined results: repeated records count once; NULL authors and blank ones tie nothing; NULL titles tie by author only;
    an empty table gives no row and leaves the state as it was; other columns are ignored.
    """
    spark = corpus.sparkSession
    old = previous or State(spark.createDataFrame([], MEMBERS), spark.createDataFrame([], RECORDS))
    docs = once(corpus.select("doc_id", author_key(F.col("author")).alias("author"), _stem(F.col("title")).alias("stem")), "doc_id")
    docs = materialize(docs, "split-docs")
    fresh, known = docs, None
    if previous is not None:
        known = docs.select("doc_id").join(old.records, "doc_id")
        fresh = materialize(docs.join(old.records.select("doc_id"), "doc_id", "left_anti"), "split-new")
    with_author, alone = fresh.where(F.col("author").isNotNull()), fresh.where(F.col("author").isNull())
    authors = materialize(with_author.groupBy("author", "stem").agg(F.count(F.lit(1)).alias("n")), "split-authors")
    # Ties among the new records, and of these to the components that have an author or a stem of theirs.
    edges = _star(authors.select("author", "stem"))
    if previous is not None:
        for kind, column in (("author", "author"), ("stem", "stem")):
            met = old.members.where(F.col("kind") == kind).select(F.col("member").alias(column), F.col("component").alias("a"))
            edges = edges.unionByName(authors.join(met, column).select("a", F.col("author").alias("b")))
    roots = connected(edges)
    mine = materialize(_rooted(authors.withColumn("component", F.col("author")), "component", roots), "split-ties")
    none = F.lit(None).cast("string").alias("split")
    record = F.concat(F.lit("record:"), F.col("doc_id").cast("string"))
    new = mine.select(F.lit("author").alias("kind"), F.col("author").alias("member"), "component", none, "n")
    new = new.unionByName(mine.where("stem is not null").select(F.lit("stem").alias("kind"), F.col("stem").alias("member"), "component", none, F.lit(0).cast("bigint").alias("n")))
    new = new.unionByName(alone.select(F.lit("record").alias("kind"), F.col("doc_id").cast("string").alias("member"), record.alias("component"), none, F.lit(1).cast("bigint").alias("n")))
    both = _rooted(old.members, "component", roots).unionByName(new)
    members = materialize(both.groupBy("kind", "member").agg(F.min("component").alias("component"), F.max("split").alias("split"), F.sum("n").alias("n")), "split-members")
    touched = new.select("component").distinct()
    weights = members.join(touched, "component", "left_semi").groupBy("component").agg(F.sum("n").alias("n"), F.min("split").alias("_lo"), F.max("split").alias("_hi"))
    decided = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).when(F.col("_lo").isNotNull(), F.lit("quarantine"))
    weights = materialize(weights.select("component", "n", decided.alias("split")), "split-weights")
    # What each split holds: earlier records, and new ones whose component is decided. A handful of numbers.
    kept = mine.select("component", "n").join(weights.where("split is not null").select("component", "split"), "component")
    held = Counter()
    for counts in (old.records.groupBy("split").agg(F.count(F.lit(1)).alias("n")), kept.groupBy("split").agg(F.sum("n").alias("n"))):
        held.update({r["split"]: r["n"] for r in counts.collect()})
    open_ = weights.where("split is null")
    amount = open_.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("x")).first()["x"]
    total = sum(held.values()) + amount
    lack = {s: share * total - held[s] for s, share in shares}
    big = []
    for r in open_.where(F.col("n") > large * total).orderBy(F.desc("n"), "component").collect():
        split = max(lack, key=lack.get)
        lack[split] -= r["n"]
        amount -= r["n"]
        big.append((r["component"], split))
    rest = {s: max(x, 0.0) for s, x in lack.items()}
    whole = sum(rest.values()) or 1.0
    small = open_.where(F.col("n") <= large * total).drop("split").withColumn("_key", key(seed, F.col("component"))).withColumn("_bucket", F.substring("_key", 1, 3))
    place, at = F.col("_at") - F.col("n") / 2, float(amount)
    cuts = F.lit(shares[-1][0])
    for s, _ in reversed(shares[:-1]):
        at = sum(rest[x] for x, _ in shares[: [y for y, _ in shares].index(s) + 1]) / whole * amount
        cuts = F.when(place < at, F.lit(s)).otherwise(cuts)
    filled = running_sum(small, [], "_bucket", ["_key", "component"], "n", "_at").select("component", cuts.alias("split"))
    table = weights.where("split is not null").select("component", "split").unionByName(filled).unionByName(spark.createDataFrame(big, "component string, split string"))
    table = materialize(table, "component-splits")
    placed = mine.select("author", "component").distinct().join(table, "component")  # one row per author
    labels = with_author.join(broadcast_if_small(placed), "author").select("doc_id", "component", "split")
    labels = labels.unionByName(alone.select("doc_id", record.alias("component")).join(table, "component").select("doc_id", "component", "split"))
    labels = materialize(labels, "split-labels")
    later = members.join(table.withColumnRenamed("split", "_new"), "component", "left").select("kind", "member", "component", F.coalesce("split", "_new").alias("split"), "n")
    state = State(materialize(later, "split-state"), old.records.unionByName(labels) if previous is not None else labels)
    return (labels.unionByName(known.select("doc_id", "component", "split")) if known is not None else labels), state
