"""Approximate nearest neighbours by inner product: vantage-point trees over shards.

The largest inner product becomes the smallest Euclidean distance once every vector x gets
one more component sqrt(M^2 - |x|^2), M the largest norm of all, and every query a zero.
Vectors belong to the cell of their nearest vantage centre (about 2 sqrt(n) centres, fitted on
a bounded sample); cells are cut into shards of bounded size, and a task builds a shard's
vantage-point tree. A query first searches its nearest cells, enough of them to hold k
vectors, and then those cells, and in them those sides of the trees' spheres, that the
triangle inequality does not rule out: a ball of radius R around c is left out where
``factor`` times d(q, c) - R exceeds the distance of the k-th best so far. Factor one, which
holds unless another is given, leaves out only what cannot hold a nearer vector, so all of the
nearest are found, whatever the rows. A larger one leaves out more; what it misses depends on
the vectors. Where it is None, the largest of ``FACTORS`` is taken that still finds ``TARGET``
of the k nearest among ``TRIED`` vectors of the sample, which tells nothing about queries that
lie otherwise than the sample.

Equal vectors are one point of the index with its k + 1 smallest ids, all that can be among
any k nearest, so no number of copies makes a shard heavy and none of them is left out.
Products of candidates are computed row by row in double precision, so equal vectors have
equal scores wherever they lie; rougher products choose candidates, with a margin for their
rounding. Results are cut to k per query and shard before they are shuffled, and once more
by Spark's partial group limit.

Defined results
* vectors that are null, empty, all zero, or hold null or non-finite components take no
  part, nor do rows without id, nor vectors of another length than most have.
* repeated ids are one vector, the smallest in array order; a query never finds its own id.
* equal scores: the smaller id first. Fewer than k candidates: all of them.
* extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, bounded_batches

K = 20
SHARD_ROWS, LEAF = 4096, 32
#: Factors that are tried, the recall that they must reach, and the vectors and queries that they are tried on.
FACTORS, TARGET, TRIED, ASKED = (16.0, 12.0, 10.0, 9.0, 8.0, 7.0, 6.0, 5.0, 4.0, 3.0, 2.5, 2.0, 1.5, 1.25), 0.95, 2048, 128
#: Centres and the sample that they are fitted on, which reach the driver: at most 4,096 and 32,768 vectors.
MOST_CELLS, SAMPLE_ROWS, LLOYD_ROUNDS = 4096, 32_768, 5
#: Queries that meet a shard in one task.
QUERY_BLOCK = 200_000
#: What rounding may do to a distance, and to a product, as a share of the norms.
SLACK, ROUNDING = 4e-7, 1e-12


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(0, square))


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Vectors with the component that makes all of them as long as the longest."""
    return np.concatenate([x, np.sqrt(np.maximum(0, top * top - (x * x).sum(axis=1)))[:, None]], axis=1)


def fit_centres(sample: np.ndarray, n: int) -> np.ndarray:
    """Centres of n cells: the first vectors of the sample, moved to their cells' means."""
    centres = sample[:n].copy()
    for _ in range(LLOYD_ROUNDS):
        cell = np.concatenate([distances(sample[k : k + 4096], centres).argmin(axis=1) for k in range(0, len(sample), 4096)])
        number = np.bincount(cell, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, cell, sample)
        centres[number > 0] = total[number > 0] / number[number > 0, None]
    return centres


class Cells:
    """Centres with the radius and number of what lies in their cells, and where queries go."""

    def __init__(self, centres: np.ndarray, radius: np.ndarray, number: np.ndarray, top: float, shard_rows: int = SHARD_ROWS):
        self.centres, self.radius, self.number, self.top = centres, radius, number, top
        self.shards = -(-number // shard_rows)
        self.first = np.cumsum(self.shards) - self.shards

    def near(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Distances to all centres, and which cells are the nearest ones that hold more than k vectors together."""
        d = distances(np.concatenate([q, np.zeros((len(q), 1))], axis=1), self.centres)
        order = np.argsort(d, axis=1, kind="stable")
        before = np.cumsum(self.number[order], axis=1) - self.number[order]
        chosen = np.zeros(d.shape, bool)
        np.put_along_axis(chosen, order, before <= k, axis=1)
        return d, chosen & (self.number > 0)

    def far(self, q: np.ndarray, d: np.ndarray, kth: np.ndarray, factor: float) -> np.ndarray:
        """Cells that the triangle inequality, times factor, does not rule out for k-th best scores."""
        norm = np.sqrt((q * q).sum(axis=1))
        slack = SLACK * (norm + self.top)
        worst = np.sqrt(np.maximum(0, norm**2 + self.top**2 - 2 * kth)) + slack
        return (factor * (d - self.radius - slack[:, None]) <= worst[:, None]) & (self.number > 0)

    def shards_of(self, cells: np.ndarray) -> np.ndarray:
        return np.concatenate([np.arange(self.first[c], self.first[c] + self.shards[c]) for c in cells]) if len(cells) else np.zeros(0, np.int64)


class Tree:
    """A vantage-point tree; leaves hold up to LEAF vectors, inner nodes the radii of both sides."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, number: np.ndarray, top: float, leaf: int = LEAF):
        """ids: of all vectors one after the other, ``number`` of each."""
        self.x, self.ids, self.number, self.top, self.lifted = x, ids, number, top, lifted(x, top)
        self.first = np.cumsum(number) - number
        self.order = np.arange(len(x))
        self.compared = 0
        self.root = self._build(0, len(x), leaf)

    def _build(self, lo: int, hi: int, leaf: int):
        if hi - lo <= leaf:
            return (lo, hi)
        part = self.order[lo:hi]
        center = self.lifted[part].mean(axis=0)
        # The vector farthest from the middle spreads distances most.
        vantage = self.lifted[part[np.argmax(((self.lifted[part] - center) ** 2).sum(axis=1))]]
        d = distances(self.lifted[part], vantage[None])[:, 0]
        by = np.argsort(d, kind="stable")
        self.order[lo:hi] = part[by]
        mid = lo + (hi - lo) // 2
        inner, outer = d[by[mid - lo - 1]], d[by[mid - lo]]
        return (vantage, float(inner), float(outer), self._build(lo, mid, leaf), self._build(mid, hi, leaf))

    def search(self, q: np.ndarray, own: np.ndarray, k: int, factor: float, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the k best of each query that are as good as ``kth``; unfilled places are -inf."""
        self.q, self.own, self.factor, self.floor = q, own, factor, kth
        self.q_lifted = np.concatenate([q, np.zeros((len(q), 1))], axis=1)
        self.norm = np.sqrt((q * q).sum(axis=1))
        self.best = np.full((len(q), k), -np.inf)
        self.found = np.full((len(q), k), np.iinfo(np.int64).max)
        self._visit(self.root, np.arange(len(q)))
        return self.best, self.found

    def _least(self, active: np.ndarray) -> np.ndarray:
        """The score that a candidate needs."""
        return np.maximum(self.best[active, -1], self.floor[active])

    def _visit(self, node, active: np.ndarray) -> None:
        if not len(active):
            return
        if len(node) == 2:
            self._leaf(*node, active)
            return
        vantage, inner, outer, near, far = node
        d = distances(self.q_lifted[active], vantage[None])[:, 0]
        inside = d <= (inner + outer) / 2
        self._visit(near, active[inside])
        self._visit(far, active[~inside])
        slack = SLACK * (self.norm[active] + self.top)
        worst = np.sqrt(np.maximum(0, self.norm[active] ** 2 + self.top**2 - 2 * self._least(active))) + slack
        again = self.factor * (np.where(inside, outer - d, d - inner) - slack) <= worst
        self._visit(far, active[inside & again])
        self._visit(near, active[~inside & again])

    def _leaf(self, lo: int, hi: int, active: np.ndarray) -> None:
        members = self.order[lo:hi]
        self.compared += len(active) * len(members)
        margin = ROUNDING * self.norm[active] * self.top
        rough = self.q[active] @ self.x[members].T
        row, col = np.nonzero(rough >= (self._least(active) - margin)[:, None])
        of, hit = active[row], members[col]
        score = (self.q[of] * self.x[hit]).sum(axis=1)
        n = self.number[hit]
        ids = self.ids[np.repeat(self.first[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        of, score = np.repeat(of, n), np.repeat(score, n)
        other = self.own[of] != ids
        of, score, ids = of[other], score[other], ids[other]
        if not len(of):
            return
        # Old and new results of the queries concerned, best first, the first k of each.
        rows, k = np.unique(of), self.best.shape[1]
        query = np.concatenate([np.repeat(rows, k), of])
        all_s, all_i = np.concatenate([self.best[rows].ravel(), score]), np.concatenate([self.found[rows].ravel(), ids])
        by = np.lexsort((all_i, -all_s, query))
        count = np.bincount(np.searchsorted(rows, query[by]))
        place = np.arange(len(by)) - np.repeat(np.cumsum(count) - count, count)
        by = by[place < k]
        self.best[rows], self.found[rows] = all_s[by].reshape(-1, k), all_i[by].reshape(-1, k)


def search_here(x: np.ndarray, asked: np.ndarray, k: int, factors: tuple[float, ...], top: float) -> Iterator[tuple[float, list[list[tuple[float, int]]], float]]:
    """For each factor, the k best (-score, place) of rows asked for among few vectors, and the share that was compared."""
    full, ids = lifted(x, top), np.arange(len(x))
    centres = fit_centres(full, int(np.ceil(2 * np.sqrt(len(x)))))
    d = distances(full, centres)
    cell = d.argmin(axis=1)
    number = np.bincount(cell, minlength=len(centres))
    away = [d[cell == c, c].max(initial=0) for c in range(len(centres))]
    cells = Cells(centres, np.array(away), number, top)
    trees = {c: Tree(x[cell == c], ids[cell == c], np.ones(number[c], int), top) for c in np.flatnonzero(number).tolist()}
    to, near = cells.near(x[asked], k)
    for factor in factors:
        found: list[list[tuple[float, int]]] = [[] for _ in asked]
        kth = np.full(len(asked), -np.inf)
        for t in trees.values():
            t.compared = 0
        for first in (True, False):
            which = near if first else cells.far(x[asked], to, kth, factor) & ~near
            for c, tree in trees.items():
                rows = np.flatnonzero(which[:, c])
                if len(rows):
                    best, hit = tree.search(x[asked[rows]], asked[rows], k, factor, kth[rows])
                    for r, b, h in zip(rows.tolist(), best, hit, strict=True):
                        found[r] += [(-s, i) for s, i in zip(b.tolist(), h.tolist(), strict=True) if np.isfinite(s)]
            found = [sorted(f)[:k] for f in found]
            kth = np.array([-f[-1][0] if len(f) == k else -np.inf for f in found])
        yield factor, found, sum(t.compared for t in trees.values()) / max(1, len(asked) * len(x))


def choose_factor(x: np.ndarray, k: int, top: float, target: float = TARGET) -> float:
    """The largest factor that finds the target's share of the k nearest of some of few vectors, or one."""
    asked = np.arange(0, len(x), max(1, len(x) // ASKED))
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = -np.inf
    least = np.sort(scores, axis=1)[:, -min(k, len(x) - 1) :][:, 0] if len(x) > 1 else np.zeros(len(asked))
    margin = ROUNDING * top * top
    for factor, found, _ in search_here(x, asked, k, FACTORS, top):
        right = sum(-s >= t - margin for f, t in zip(found, least, strict=True) for s, _ in f)
        if right >= target * len(asked) * min(k, len(x) - 1):
            return factor
    return 1.0


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)


def _assign(centres: np.ndarray, top: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                d = distances(lifted(_matrix(b), top), centres)
                cell = d.argmin(axis=1)
                yield pa.record_batch([*b.columns, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(cell)), cell])], names=[*b.schema.names, "cell", "away"])

    return run


def _route(cells: Cells, k: int, factor: float, first: bool):
    """Each query with the shards that it searches first, or those that its k-th best score leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                q = _matrix(b)
                d, chosen = cells.near(q, k)
                kth = np.asarray(b.column("kth").to_numpy(zero_copy_only=False), np.float64)
                if not first:
                    chosen = cells.far(q, d, kth, factor) & ~chosen
                shards = [cells.shards_of(np.flatnonzero(c)) for c in chosen]
                yield pa.record_batch([*b.columns, pa.array(shards, pa.list_(pa.int64()))], names=[*b.schema.names, "shards"])

    return run


def _search(k: int, factor: float, top: float):
    """Rows sorted by shard and kind: a shard's vectors (0) come before its queries (1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, tree = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            s, block, kind, vec, kth = (b.column(n).to_numpy(zero_copy_only=False) for n in ("shard", "block", "kind", "vec_id", "kth"))
            x = _matrix(b)
            new = np.ones(b.num_rows, bool)
            new[1:] = (s[1:] != s[:-1]) | (block[1:] != block[:-1]) | (kind[1:] != kind[:-1])
            cuts = [*np.flatnonzero(new).tolist(), b.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if (s[lo], block[lo]) != shard:
                    shard, held, tree = (s[lo], block[lo]), [], None
                if kind[lo] == 0:
                    ids = b.column("ids").slice(lo, hi - lo)
                    held.append((x[lo:hi], ids.flatten().to_numpy(), pc.list_value_length(ids).to_numpy()))
                    continue
                if not held:
                    continue
                if tree is None:
                    tree = Tree(*(np.concatenate(y) for y in zip(*held, strict=True)), top)
                for at in range(lo, hi, 512):
                    part = slice(at, min(at + 512, hi))
                    best, found = tree.search(x[part], vec[part], k, factor, kth[part])
                    full = np.isfinite(best)
                    row = np.nonzero(full)[0]
                    yield pa.record_batch([pa.array(vec[part][row]), pa.array(found[full]), pa.array(best[full])], names=["query_id", "vec_id", "score"])

    return run


def usable(embedding: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return embedding.isNotNull() & F.forall(embedding, finite) & F.exists(embedding, lambda x: x != 0)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(
    vectors: DataFrame, query: Column, k: int = K, factor: float | None = 1.0, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found for rows where ``query`` holds."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    work = Scratch(spark, "nearest")
    base = vectors.where(F.col("vec_id").isNotNull() & F.coalesce(usable(F.col("embedding")), F.lit(False)))
    base = work.keep(base.groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    most = base.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    size = most["d"] if most else 0
    base = base.where(F.size("embedding") == size).select("vec_id", "embedding")
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    top, asked = base.agg(F.max(F.sqrt(norm)), F.count_if(query)).first()
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # Of equal vectors the k + 1 smallest ids, as a query may be one of them.
    alike = Window.partitionBy("embedding").orderBy("vec_id")
    points = base.withColumn("_nth", F.row_number().over(alike)).where(F.col("_nth") <= k + 1)
    points = work.keep(points.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    n_cells = min(MOST_CELLS, int(np.ceil(2 * np.sqrt(points.count()))))
    sample = points.orderBy(F.xxhash64(F.col("ids")[0]), F.col("ids")[0]).limit(min(SAMPLE_ROWS, max(TRIED, 16 * n_cells)))
    sample = _matrix(sample.select("embedding").toArrow().combine_chunks().to_batches()[0])
    centres = fit_centres(lifted(sample, top), n_cells)
    factor = factor or choose_factor(sample[:TRIED], k, top)

    kind = base.schema["embedding"].dataType.simpleString()
    dealt = work.keep(points.select("ids", "embedding").mapInArrow(_assign(centres, top), f"ids array<long>, embedding {kind}, cell int, away double"))
    number, radius = np.zeros(n_cells, np.int64), np.zeros(n_cells)
    for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("r")).collect():
        number[r["cell"]], radius[r["cell"]] = r["n"], r["r"]
    cells = Cells(centres, radius, number, top, shard_rows)
    shards = F.broadcast(spark.createDataFrame([(k, int(a), int(n)) for k, (a, n) in enumerate(zip(cells.first, cells.shards, strict=True))], "cell int, _first long, _n long"))
    blocks = -(-asked // QUERY_BLOCK)
    held = dealt.join(shards, "cell").select(
        (F.col("_first") + F.pmod(F.xxhash64(F.col("ids")[0]), F.col("_n"))).alias("shard"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        F.lit(0).alias("kind"), F.lit(0).cast("long").alias("vec_id"), "ids", "embedding", F.lit(0.0).alias("kth"),
    )
    queries = base.where(query).select("vec_id", "embedding", F.lit(float("-inf")).alias("kth"))
    routed = f"vec_id long, embedding {kind}, kth double, shards array<long>"

    def searched(asking: DataFrame, first: bool) -> DataFrame:
        sent = asking.mapInArrow(_route(cells, k, factor, first), routed).select(
            F.explode("shards").alias("shard"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"),
            F.lit(1).alias("kind"), "vec_id", F.lit(None).cast("array<long>").alias("ids"), "embedding", "kth",
        )
        rows = held.unionByName(sent).repartition("shard", "block").sortWithinPartitions("shard", "block", "kind")
        return rows.mapInArrow(_search(k, factor, top), "query_id long, vec_id long, score double")

    near = work.keep(_best(searched(queries, True), k).select("query_id", "vec_id", "score"))
    kth = near.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("kth"))
    again = queries.drop("kth").join(kth, F.col("vec_id") == F.col("query_id"), "left")
    again = again.select("vec_id", "embedding", F.coalesce("kth", F.lit(float("-inf"))).alias("kth"))
    return _best(near.unionByName(searched(again, False)), k).select("query_id", "rank", "vec_id", "score")
