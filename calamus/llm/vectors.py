"""Problem 4: the most similar vectors of every vector, by randomly rotated one-bit codes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calamus.llm.records import once
from calamus.session import BROADCAST_ROWS, broadcast_if_small, materialize, small_enough


@dataclass(frozen=True)
class Index:
    """What is fitted: a random rotation and the cells' centres, both small and of a size set by parameters."""

    rotation: np.ndarray
    centres: np.ndarray
    turned: np.ndarray


def rotation(dims: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def fit(sample: np.ndarray, cells: int, seed: int = 7, rounds: int = 8) -> Index:
    """Centres by a few rounds of k-means on unit vectors of a bounded sample."""
    dims = sample.shape[1]
    rng = np.random.default_rng(seed)
    cells = max(1, min(cells, len(sample)))
    centres = sample[rng.choice(len(sample), cells, replace=False)] if len(sample) else np.zeros((1, dims), np.float32)
    for _ in range(rounds if cells > 1 else 0):
        own = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-6, sums / np.maximum(norm, 1e-6), centres).astype(np.float32)
    turn = rotation(dims, seed)
    # Cells are told apart by direction, codes are taken about the mean of a cell's members.
    if len(sample):
        own = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres = (sums / np.maximum(np.bincount(own, minlength=len(centres))[:, None], 1)).astype(np.float32)
    return Index(turn, centres, (centres @ turn).astype(np.float32))


def _order(index: Index, unit: np.ndarray) -> np.ndarray:
    """Closeness of vectors to centres: the dot product with the centre's direction."""
    norm = np.linalg.norm(index.centres, axis=1)
    return unit @ (index.centres / np.maximum(norm, 1e-6)[:, None]).T


def _unit(values, dims: int) -> np.ndarray:
    v = np.stack(values).astype(np.float64)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def usable(vectors: DataFrame, id_col: str, vec_col: str, dims: int) -> DataFrame:
    """(_id, _vec) with `dims` finite numbers, not all zero."""
    v = F.col(vec_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(1e18))) & F.exists(v, lambda x: F.abs(x) > F.lit(1e-18))
    return vectors.where(v.isNotNull() & (F.size(v) == dims)).where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).alias("_id"), v.alias("_vec"))


def _data_rows(index: Index, dims: int, carry: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            unit = _unit(f["_vec"], dims)
            cell = _order(index, unit).argmax(1)
            rest = unit @ index.rotation - index.turned[cell]
            radius = np.linalg.norm(rest, axis=1)
            aligned = np.abs(rest).sum(1) / np.sqrt(dims) / np.maximum(radius, 1e-9)
            bits = np.packbits(rest >= 0, axis=1)
            yield pd.DataFrame(
                {"cell": cell.astype(np.int32), "_id": f["_id"].to_numpy(), "code": [b.tobytes() for b in bits], "x": radius.astype(np.float32), "y": aligned.astype(np.float32),
                 "v": [u.tobytes() if carry else None for u in unit]}
            )

    return run


def _query_rows(index: Index, dims: int, margin: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            unit = _unit(f["_vec"], dims)
            close = _order(index, unit)
            who, cell = np.nonzero(close >= close.max(1, keepdims=True) - margin)
            turned = unit @ index.rotation
            step = np.maximum(np.abs(turned).max(1), 1e-9) / 7
            four = (np.rint(turned / step[:, None]) + 8).astype(np.uint8)
            packed = (four[:, ::2] << 4) | four[:, 1::2]
            ids = f["_id"].to_numpy()
            yield pd.DataFrame(
                {"cell": cell.astype(np.int32), "_id": ids[who], "code": [packed[i].tobytes() for i in who], "x": step[who].astype(np.float32), "y": np.float32(0),
                 "v": [None] * len(who)}
            )

    return run


ENTRY = "cell int, _id bigint, code binary, x float, y float, v binary"
FOUND = "q bigint, p bigint, sim float"


def _search(index: Index, dims: int, k: int, floor: float, width: float, rows: int):
    """A stream of blocks, each its data rows first and then its queries; only one block's data are held, queries pass by."""
    root = np.float32(np.sqrt(dims))

    def sides(h: pd.DataFrame) -> list:
        """A block's rows as factors: what a query's factors multiply to is the estimate plus, or less, its error bound.
        For a unit residual x of length r, code c and alignment y, <q, x> is estimated by <c, q> / y; its standard deviation
        is at most |q| e + s, e = sqrt((1 - y^2) / (y^2 (dims - 1))), s that of the query's rounding to four bits."""
        bits = np.unpackbits(np.frombuffer(b"".join(h["code"]), np.uint8).reshape(len(h), dims // 8), axis=1)
        r, y = h["x"].to_numpy()[:, None], np.maximum(h["y"].to_numpy()[:, None], 1e-6)
        signs = (bits.astype(np.float32) * 2 - 1) * (r / (root * y))
        spread = np.sqrt(np.maximum(1 - y * y, 0) / (y * y * (dims - 1)))
        high, low = (np.hstack([signs, 1 - r * r / 2, w * width * r * spread, w * width * r, np.ones_like(r)]).astype(np.float32).T.copy() for w in (1, -1))
        return [h["_id"].to_numpy(), high, low]

    def kth(rows_: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        """The k-th largest value of each row given sparsely; -9 where there are fewer."""
        out = np.full(n, -9, np.float32)
        order = np.lexsort((-values, rows_))
        r = rows_[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        out[r[place == k - 1]] = values[order][place == k - 1]
        return out

    def answer(cell: int, data: list, ask: pd.DataFrame) -> Iterator[pd.DataFrame]:
        ids, high, low = data
        for lo in range(0, len(ask), rows):
            part = ask.iloc[lo : lo + rows]
            packed = np.frombuffer(b"".join(part["code"]), np.uint8).reshape(len(part), dims // 2)
            q = np.empty((len(part), dims), np.float32)
            q[:, ::2] = packed >> 4
            q[:, 1::2] = packed & 15
            step = part["x"].to_numpy()[:, None]
            q = (q - 8) * step - index.turned[cell]
            far2 = (q * q).sum(1, keepdims=True)
            q = np.hstack([q, np.ones_like(step), np.sqrt(far2), step / np.float32(np.sqrt(12)), -far2 / 2]).astype(np.float32)
            mine = part["_id"].to_numpy()
            upper = q @ high
            a, b = np.nonzero(upper >= np.float32(floor))
            other = mine[a] != ids[b]
            a, b = a[other], b[other]
            if not len(a):
                continue
            # Nothing below the k-th best lower bound can be among the k best; with few candidates there is none.
            if np.bincount(a).max() > k:
                least = np.einsum("ij,ji->i", q[a], low[:, b])
                best = upper[a, b] >= kth(a, least, len(part))[a]
                a, b = a[best], b[best]
            yield pd.DataFrame({"q": mine[a], "p": ids[b], "sim": upper[a, b]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, data = None, [], None
        for f in frames:
            for (cell, block), part in f.groupby(["cell", "block"], sort=False):
                if at != (cell, block):
                    at, held, data = (cell, block), [], None
                mine = part[part["role"] == 0]
                if len(mine):
                    held.append(mine)
                ask = part[part["role"] == 1]
                if len(ask) and held:
                    if data is None:
                        data = sides(pd.concat(held))
                    yield from answer(cell, data, ask)

    return run


def probed_cells(index: Index, sample: np.ndarray, k: int, target: float, asked: int = 1000, spare: float = 0.5) -> np.ndarray:
    """(cells, m): for each cell, the cells its vectors ask, nearest first. m is the least number that holds `target` of the k
    nearest others of `asked` sample vectors. In the whole collection neighbours are nearer than in a sample of it, so they lie
    in cells at least as near, as a rule; the misses that are left are cut by `spare`."""
    unit = index.centres / np.maximum(np.linalg.norm(index.centres, axis=1, keepdims=True), 1e-6)
    order = np.argsort(-(unit @ unit.T), axis=1, kind="stable")
    n = len(order)
    if n == 1 or len(sample) <= k:
        return order
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(n), order.shape), axis=1)
    home = (sample @ unit.T).argmax(1)
    step = max(1, len(sample) // asked)
    q = np.arange(0, len(sample), step)
    ranks = []
    for lo in range(0, len(q), 256):
        part = q[lo : lo + 256]
        sims = sample[part] @ sample.T
        sims[np.arange(len(part)), part] = -9
        best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        ranks.append(place[home[part][:, None], home[best]].ravel())
    missed = (1 - target) * spare
    m = 1 + int(np.quantile(np.concatenate(ranks), 1 - missed, method="higher"))
    return order[:, : min(n, m)]


def _held(index: Index, dims: int, k: int, probes: np.ndarray, width: float, rows: int):
    """A stream of blocks, each its queries first and then the data of the cells that any of them asks, its own cells first.
    The queries are held with the k best found so far; data pass by in batches, and the k-th best of a query is what a
    row's upper bound has to reach. Data rows carry one bit per coordinate and two scalars, queries four bits."""
    root = np.float32(np.sqrt(dims))
    asks = np.zeros((len(index.centres), len(index.centres)), bool)
    np.put_along_axis(asks, probes, True, axis=1)

    def four_bits(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        turned = unit @ index.rotation
        step = np.maximum(np.abs(turned).max(1, keepdims=True), 1e-9) / 7
        return (np.rint(turned / step) * step).astype(np.float32), (step / np.sqrt(12)).astype(np.float32)

    class Block:
        def __init__(self, h: pd.DataFrame):
            h = h.sort_values("cell", kind="stable")
            self.cell, self.ids = h["cell"].to_numpy(), h["_id"].to_numpy()
            self.unit = np.frombuffer(b"".join(h["v"]), np.float32).reshape(len(h), dims)
            self.turned, self.off = four_bits(self.unit)
            self.best = np.full((len(h), k), -9, np.float32)
            self.who = np.full((len(h), k), np.iinfo(np.int64).max, np.int64)

        def meet(self, cell: int, h: pd.DataFrame) -> None:
            mine = np.flatnonzero(asks[self.cell, cell])
            if not len(mine):
                return
            ids = h["_id"].to_numpy()
            bits = np.unpackbits(np.frombuffer(b"".join(h["code"]), np.uint8).reshape(len(h), dims // 8), axis=1)
            whole = np.frombuffer(b"".join(h["v"]), np.float32).reshape(len(h), dims)
            r, y = h["x"].to_numpy()[:, None], np.maximum(h["y"].to_numpy()[:, None], 1e-6)
            spread = np.sqrt(np.maximum(1 - y * y, 0) / (y * y * (dims - 1)))
            signs = (bits.astype(np.float32) * 2 - 1) * (r / (root * y))
            high = np.hstack([signs, 1 - r * r / 2, width * r * spread, width * r, np.ones_like(r)]).astype(np.float32).T.copy()
            for lo in range(0, len(mine), rows):
                at = mine[lo : lo + rows]
                q = self.turned[at] - index.turned[cell]
                far2 = (q * q).sum(1, keepdims=True)
                upper = np.hstack([q, np.ones_like(far2), np.sqrt(far2), self.off[at], -far2 / 2]) @ high
                need = self.best[at, k - 1 : k]
                if len(ids) > 64 and need.min() < -1:
                    # Nothing is known of some queries yet: their most promising rows first.
                    line = upper.mean(1, keepdims=True) + 2.6 * upper.std(1, keepdims=True)
                    self.take(at, *np.nonzero((need < -1) & (upper >= line)), ids, whole)
                    need = self.best[at, k - 1 : k]
                self.take(at, *np.nonzero(upper >= need), ids, whole)

        def take(self, at: np.ndarray, a: np.ndarray, b: np.ndarray, ids: np.ndarray, whole: np.ndarray) -> None:
            mine = at[a]
            other = self.ids[mine] != ids[b]
            mine, b = mine[other], b[other]
            for lo in range(0, len(mine), 500_000):
                m, c = mine[lo : lo + 500_000], b[lo : lo + 500_000]
                exact = np.einsum("ij,ij->i", self.unit[m], whole[c])
                keep = exact >= self.best[m, k - 1]
                m, c, exact = m[keep], c[keep], exact[keep]
                if not len(m):
                    continue
                rows_, back = np.unique(m, return_inverse=True)
                row = np.concatenate([np.repeat(np.arange(len(rows_)), k), back])
                sim = np.concatenate([self.best[rows_].ravel(), exact])
                who = np.concatenate([self.who[rows_].ravel(), ids[c]])
                order = np.lexsort((who, -sim, row))
                row, sim, who = row[order], sim[order], who[order]
                again = np.r_[False, (row[1:] == row[:-1]) & (who[1:] == who[:-1]) & (sim[1:] == sim[:-1])] & (who != np.iinfo(np.int64).max)
                row, sim, who = row[~again], sim[~again], who[~again]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                first = place < k
                self.best[rows_[row[first]], place[first]] = sim[first]
                self.who[rows_[row[first]], place[first]] = who[first]

        def found(self) -> pd.DataFrame:
            a, b = np.nonzero(self.best > -8)
            return pd.DataFrame({"q": self.ids[a], "p": self.who[a, b], "sim": self.best[a, b]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, block = None, [], None
        for f in frames:
            for (number, role, cell), part in f.groupby(["block", "role", "cell"], sort=False):
                if at != number:
                    if block is not None:
                        yield block.found()
                    at, held, block = number, [], None
                if role == 0:
                    held.append(part)
                    continue
                if block is None and held:
                    block = Block(pd.concat(held))
                    held = []
                if block is not None:
                    block.meet(cell, part)
        if block is not None:
            yield block.found()

    return run


def _nearest_of_all(solo: DataFrame, index: Index, probes: np.ndarray, dims: int, k: int, width: float, block_rows: int) -> DataFrame:
    """(q, p, sim): cells are put into blocks of about `block_rows` queries, neighbours together; a block meets the data of every
    cell that one of its cells asks. A cell larger than a block is divided among several. One number per cell is collected."""
    data = materialize(solo.mapInPandas(_data_rows(index, dims, True), ENTRY), "p4-index")
    sizes = {r["cell"]: r["count"] for r in data.groupBy("cell").count().collect()}
    first, many, block, filled = {}, {}, 0, 0
    needs: dict[int, set[int]] = {}
    left = set(sizes)
    cell = min(left, default=None)
    while cell is not None:
        left.discard(cell)
        parts = -(-sizes[cell] // block_rows)
        if filled and (parts > 1 or filled + sizes[cell] > block_rows):
            block, filled = block + 1, 0
        first[cell], many[cell] = block, parts
        for x in range(block, block + parts):
            needs.setdefault(x, set()).update(int(c) for c in probes[cell])
        if parts > 1:
            block, filled = block + parts, 0
        else:
            filled += sizes[cell]
        cell = next((int(c) for c in probes[cell] if int(c) in left), min(left, default=None))
    spark = solo.sparkSession
    # At most as many rows as there are cells, times those a cell asks; both bounded by parameters.
    homes = spark.createDataFrame([(c, first[c], many[c]) for c in first], "cell int, first int, parts int")
    routes = spark.createDataFrame([(c, b, 2 - (first.get(c, -1) <= b < first.get(c, -1) + many.get(c, 0))) for b, cells in needs.items() for c in cells], "cell int, block int, role int")
    ask = data.join(broadcast_if_small(homes), "cell").withColumn("block", F.col("first") + F.pmod(F.xxhash64("_id"), F.col("parts")).cast("int"))
    ask = ask.select("block", F.lit(0).alias("role"), "cell", "_id", F.lit(None).cast("binary").alias("code"), "x", "y", "v")
    met = data.join(broadcast_if_small(routes), "cell").select("block", "role", "cell", "_id", "code", "x", "y", "v")
    rows = ask.unionByName(met).repartitionById(block + 1, F.col("block")).sortWithinPartitions("block", "role", "cell")
    return rows.mapInPandas(_held(index, dims, k, probes, width, 2048), FOUND)


def _copies(rows: DataFrame, k: int, salt: int = 32) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups of equal vectors: (_id, rep) of all members, (rep, _vec) of the representatives, and (rep, other, n) the first
    k + 1 members of each group of more than one. Ids are numbered per (group, salt) first, so no task sees a whole group."""
    marked = rows.withColumn("_h1", F.xxhash64("_vec")).withColumn("_h2", F.xxhash64(F.lit(1), "_vec")).withColumn("_s", F.pmod(F.xxhash64("_id"), F.lit(salt)))
    ids = materialize(marked.select("_id", "_h1", "_h2", "_s"), "p4-ids")
    key = ["_h1", "_h2"]
    groups = ids.groupBy(*key).agg(F.min("_id").alias("rep"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    groups = materialize(groups, "p4-groups")
    some = ids.join(groups, key)
    first = some.withColumn("_r", F.row_number().over(Window.partitionBy(*key, "_s").orderBy("_id"))).where(F.col("_r") <= k + 1)
    first = first.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy("_id"))).where(F.col("_r") <= k + 1)
    return some.select("_id", "rep"), groups, first.select("rep", F.col("_id").alias("other"))


def nearest(
    vectors: DataFrame, k: int = 5, floor: float | None = None, id_col: str = "vec_id", vec_col: str = "vec", dims: int = 64, sample_rows: int = 20_000,
    per_cell: int = 500, max_cells: int = 4096, margin: float = 0.16, target: float = 0.995, width: float = 2.5, block_rows: int | None = None, seed: int = 7,
) -> DataFrame:
    """(id, neighbour, rank, similarity): the `k` most similar other vectors of every usable vector by cosine, ties by id.
    With `floor`, only neighbours of at least that similarity (none of the k that reach it is then lost to the floor).

    * Fitted on about `sample_rows` vectors (chosen by a hash of the id, whatever the number of vectors): a random rotation and cells, one per `per_cell`
      vectors, at most `max_cells`. Every vector is indexed.
    * A vector is stored as one bit per rotated coordinate of its residual from the cell's centre, with two correction
      scalars: the residual's length and how well the code is aligned with it. Asked, its coordinates are rounded to four bits.
      With a floor it asks its best cell and those whose centre is at most `margin` less close. Without one, the nearest of
      a vector that resembles nothing may lie in many cells: as many are asked as hold `target` of the sample's neighbours.
    * From code and scalars a task estimates each inner product with an error bound (`width` standard deviations); a vector is
      reranked by its exact similarity only if its upper bound reaches the floor and the k-th best lower bound, or without a
      floor the k-th best exact similarity so far.
    * With a floor, a task holds a block of about `block_rows` vectors of a cell and queries pass by in batches; without, it holds
      that many queries of neighbouring cells and the vectors of all cells they ask pass by, so each is sent once a block. No
      cell, however full, is gathered. Equal vectors are represented by their least id and given their neighbours
      afterwards, k per member, so a group of copies costs its size, not its square.

    Defined results: NULL, all-zero vectors and those with other than `dims` numbers or with NULL, NaN or infinite ones take
    no part; repeated records count once; fewer than k others give fewer rows; an empty table gives none; other columns
    are ignored.
    """
    spark = vectors.sparkSession
    rows = usable(once(vectors.select(id_col, vec_col), id_col), id_col, vec_col, dims)
    copies, groups, first = _copies(rows, k)
    many = groups.count() > 0
    solo = rows.join(copies.where(F.col("_id") != F.col("rep")).select("_id"), "_id", "left_anti") if many else rows
    counted = solo.select("_id").count()
    sample = solo.where(F.pmod(F.xxhash64(F.lit(seed), "_id"), F.lit(max(counted, 1))) < sample_rows).select("_vec").toPandas()
    unit = _unit(sample["_vec"], dims) if len(sample) else np.zeros((0, dims), np.float32)
    index = fit(unit, min(max_cells, counted // per_cell) if counted > 4 * per_cell else 1, seed)
    if floor is None:
        probes = probed_cells(index, unit, k, target)
        exact = _nearest_of_all(solo, index, probes, dims, k, width, block_rows or 32_768).withColumn("sim", F.col("sim").cast("double"))
    else:
        block_rows = block_rows or 8192
        data = solo.mapInPandas(_data_rows(index, dims, False), ENTRY)
        ask = solo.mapInPandas(_query_rows(index, dims, margin), ENTRY)
        sizes = {r["cell"]: r["count"] for r in data.select("cell").groupBy("cell").count().collect()}
        blocks = F.array(*[F.lit(1 + sizes.get(c, 0) // block_rows) for c in range(len(index.centres))])
        data = data.withColumn("block", F.pmod(F.xxhash64("_id"), blocks[F.col("cell")]).cast("int")).withColumn("role", F.lit(0))
        ask = ask.withColumn("block", F.explode(F.sequence(F.lit(0), blocks[F.col("cell")] - 1))).withColumn("role", F.lit(1))
        entries = data.unionByName(ask).repartition("cell", "block").sortWithinPartitions("cell", "block", "role")
        hits = entries.mapInPandas(_search(index, dims, k, floor, width, 512), FOUND)
        # A pair may have been found from either side: it counts for both.
        pairs = materialize(hits.select(F.least("q", "p").alias("a"), F.greatest("q", "p").alias("b")).distinct(), "p4-candidates")
        exact = _rerank(pairs, solo, floor)
    if many:
        exact = _with_copies(exact, copies, groups, first, rows, k)
    best = Window.partitionBy("q").orderBy(F.desc("sim"), "p")
    return (
        exact.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select(F.col("q").alias(id_col), F.col("p").alias("neighbour"), "rank", F.round("sim", 6).alias("similarity"))
    )


def _cosine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        if len(f):
            u, v = np.stack(f["_u"]).astype(np.float64), np.stack(f["_v"]).astype(np.float64)
            sim = (u * v).sum(1) / np.sqrt((u * u).sum(1) * (v * v).sum(1))
            yield pd.DataFrame({"a": f["a"], "b": f["b"], "sim": sim})


def _rerank(pairs: DataFrame, rows: DataFrame, floor: float) -> DataFrame:
    """Exact cosines of candidate pairs, both ways. Only vectors in some pair are read into the joins."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct()
    wanted = rows.join(F.broadcast(named) if small_enough(named, BROADCAST_ROWS) else named, "_id", "left_semi")
    wanted = materialize(wanted, "p4-wanted")
    one = wanted.select(F.col("_id").alias("a"), F.col("_vec").alias("_u"))
    two = wanted.select(F.col("_id").alias("b"), F.col("_vec").alias("_v"))
    scored = materialize(pairs.join(one, "a").join(two, "b").select("a", "b", "_u", "_v").mapInPandas(_cosine, "a bigint, b bigint, sim double").where(F.col("sim") >= floor), "p4-pairs")
    return scored.select(F.col("a").alias("q"), F.col("b").alias("p"), "sim").unionByName(scored.select(F.col("b").alias("q"), F.col("a").alias("p"), "sim"))


def _with_copies(exact: DataFrame, copies: DataFrame, groups: DataFrame, first: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Neighbours found between representatives, given to every member and widened to the first members of the groups met.
    A member of a group of more than k needs only its own group."""
    best = Window.partitionBy("q").orderBy(F.desc("sim"), "p")
    top = exact.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r")
    wide = top.join(first.withColumnRenamed("rep", "p"), "p", "left").select("q", F.coalesce("other", "p").alias("p"), "sim")
    own = copies.join(first, "rep").where(F.col("_id") != F.col("other")).select(F.col("_id").alias("q"), F.col("other").alias("p"), F.lit(1.0).alias("sim"))
    single = wide.join(groups.select(F.col("rep").alias("q")), "q", "left_anti")
    few = groups.where(F.col("n") <= k).select("rep")
    members = copies.join(few, "rep", "left_semi").select(F.col("_id").alias("_m"), F.col("rep").alias("q"))
    given = wide.join(members, "q").select(F.col("_m").alias("q"), "p", "sim")
    return single.unionByName(given).unionByName(own)


def close_pairs(vectors: DataFrame, k: int = 5, floor: float = 0.9, **how) -> DataFrame:
    """(vec_id_1, vec_id_2), smaller id first: pairs of at least `floor` of which one is among the k most similar of the other."""
    found = nearest(vectors, k, floor, **how)
    return found.select(F.least("vec_id", "neighbour").alias("vec_id_1"), F.greatest("vec_id", "neighbour").alias("vec_id_2")).distinct()
