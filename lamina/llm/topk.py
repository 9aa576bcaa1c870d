"""Exact top-k inner product search with a pivot-distance index.

Vectors become integers, floor(scale * x). With M the largest norm, x is given one more component,
sqrt(M^2 - |x|^2), and a query a zero there; then the distance d satisfies d^2 = |q|^2 + M^2 - 2 q.x, so
the largest products are the nearest neighbours, and the triangle inequality holds.

Index: each vector is keyed by its nearest pivot and its distance to it; the table is sorted by both, so that
a range of distances at a pivot, an annulus, is a stretch of few files. One pivot with a third of all vectors
(copies of one, say) is many annuli over many partitions.

Search: queries that lie side by side in the same order go in groups of about ``QUERIES``. A group first reads
the annuli at its own pivots around its own distances, of a width in which the pivot's density lets it expect some
times k vectors, and widens them fourfold for those queries that have not got k yet. That gives a lower bound for
each query's k-th score, and with it the radius R beyond which no vector can reach it, R^2 = |q|^2 + M^2 - 2 bound;
by the triangle inequality a vector of pivot p whose distance differs from d(q, p) by more than R is out. A second
scan reads for each pivot only the distances that the group's radii reach, and visits blocks of at most ``BLOCK`` vectors from the
nearest to the farthest for the queries that still reach them, whose bounds rise as it goes.

Each group's queries are sent to the tasks, so the broadcast has a fixed size. The pivots are chosen from at most
``SAMPLE`` vectors; every vector is indexed and no step is approximate. In data without any structure of distances
a group reads most of the index; then the search is a comparison in blocks.

Nulls: vectors that are null, empty, or hold null or non-finite components take no part; so do rows with a null
vec_id. Vectors are compared with those of their own length only; each length is a search by itself. A query's own
row is any row with its vec_id. Repeated rows of one vec_id are candidates each, and one query: the least of them
in the order of their components. Ties go to the smaller vec_id. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import Scratch, own_columns
from lamina.operators.ordering import numbered

SAMPLE, PIVOTS, BLOCK, QUERIES, SCALE = 4096, 64, 1024, 8192, 256


def integers(vectors: DataFrame, column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, v (array<double> of whole numbers)."""
    rows = own_columns(vectors, "vec_id", column).filter("vec_id is not null").select(F.col("vec_id").cast("long"), F.transform(F.col(column), lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"), F.col(column).alias("_x"))
    return rows.filter(F.size("_x") > 0).filter(F.forall("_x", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))).select("vec_id", "v")


def _matrix(column) -> np.ndarray:
    n = len(column)
    return np.asarray(column.flatten()).reshape(n, -1) if n else np.zeros((0, 1))


def choose_pivots(sample: np.ndarray, norm2: float, n: int = PIVOTS) -> np.ndarray:
    """Farthest-first traversal over the sample, in the augmented space; the last component is the added one."""
    x = np.hstack([sample, np.sqrt(np.maximum(0, norm2 - (sample**2).sum(1)))[:, None]])
    picked, far = [0], np.full(len(x), np.inf)
    while len(picked) < min(n, len(x)):
        far = np.minimum(far, ((x - x[picked[-1]]) ** 2).sum(1))
        best = int(far.argmax())
        if far[best] <= 0:
            break
        picked.append(best)
    return x[picked]


def _distances(x: np.ndarray, last: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x**2).sum(1) + last**2
    d2 = square[:, None] + (pivots**2).sum(1)[None, :] - 2 * (x @ pivots[:, :-1].T + last[:, None] * pivots[None, :, -1])
    return np.sqrt(np.maximum(0, d2))


def keyed(ints: DataFrame, pivots: np.ndarray, norm2: float, added: bool = True) -> DataFrame:
    """pivot, dist, vec_id, v. added: with the component that makes all norms equal, as vectors have it and queries do not."""

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("v"))
            d = _distances(x, np.sqrt(np.maximum(0, norm2 - (x**2).sum(1))) if added else np.zeros(len(x)), pivots)
            near = d.argmin(1)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(x)), near]), batch.column("vec_id"), batch.column("v")], ["pivot", "dist", "vec_id", "v"])

    return ints.select("vec_id", "v").mapInArrow(run, "pivot int, dist double, vec_id long, v array<double>")


def build(ints: DataFrame, pivots: np.ndarray, norm2: float, scratch: Scratch) -> DataFrame:
    """pivot, dist, vec_id, v, written in sorted order."""
    n = int(ints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return scratch.written(keyed(ints, pivots, norm2).repartitionByRange(n, "pivot", "dist", "vec_id").sortWithinPartitions("pivot", "dist", "vec_id"))


class Best:
    """The k best (score, vec_id) so far of each query; ``least`` is the score that a further one must reach."""

    def __init__(self, n: int, k: int, least: np.ndarray):
        self.k, self.least = k, least.copy()
        self.query, self.score, self.vec = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, vec: np.ndarray) -> None:
        q, s, v = np.concatenate([self.query, query]), np.concatenate([self.score, score]), np.concatenate([self.vec, vec])
        order = np.lexsort((v, -s, q))
        q, s, v = q[order], s[order], v[order]
        start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
        rank = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
        last = rank == self.k - 1
        self.least[q[last]] = np.maximum(self.least[q[last]], s[last])
        keep = rank < self.k
        self.query, self.score, self.vec = q[keep], s[keep], v[keep]


def _within(index: DataFrame, least: np.ndarray, most: np.ndarray) -> DataFrame:
    """The index's rows with distances from least[p] to most[p] at pivot p. The filter goes to the Parquet reader, which skips row groups by it."""
    some = [(F.col("pivot") == p) & F.col("dist").between(float(a), float(z)) for p, (a, z) in enumerate(zip(least, most)) if a <= z]
    if not some:
        return index.limit(0)
    while len(some) > 1:  # a balanced tree, as deep chains of OR take long to plan
        some = [some[k] | some[k + 1] if k + 1 < len(some) else some[k] for k in range(0, len(some), 2)]
    return index.filter(some[0])


def _scan(index: DataFrame, queries, k: int, norm2: float, radius: np.ndarray | None = None) -> DataFrame:
    """queries: a broadcast of (ids, matrix, distance to each pivot, own pivot, least scores). radius: only each query's own pivot, so far around its own distance."""

    def run(batches):
        ids, q, to_pivot, home, least = queries.value
        best = Best(len(ids), k, least)
        square = (q**2).sum(1)
        kind = np.float32 if norm2 < (1 << 24) else np.float64  # whole numbers below 2^24 are exact in either
        q = q.astype(kind)
        for batch in batches:
            pivot, dist, vec, x = np.asarray(batch.column("pivot")), np.asarray(batch.column("dist")), np.asarray(batch.column("vec_id")), _matrix(batch.column("v")).astype(kind)
            # Files are read in any order, and a batch may run across several: a block also ends where the order does.
            edges = sorted({0, len(pivot), *(np.flatnonzero((np.diff(pivot) != 0) | (np.diff(dist) < 0)) + 1).tolist()})
            blocks = []
            for a, z in ((i, min(i + BLOCK, e)) for s, e in zip(edges, edges[1:]) for i in range(s, e, BLOCK)):
                p, lo, hi = pivot[a], dist[a:z].min(), dist[a:z].max()
                gap = np.maximum(0, np.maximum(lo - to_pivot[:, p], to_pivot[:, p] - hi))
                blocks.append((float(gap.min(initial=np.inf)), a, z, p, gap))
            for _, a, z, p, gap in sorted(blocks, key=lambda b: b[:3]):
                if radius is not None:
                    chosen = np.flatnonzero((home == p) & (gap <= radius))
                else:
                    chosen = np.flatnonzero((square + norm2 - gap**2) / 2 + 1e-6 * (1 + norm2) >= best.least)
                for c in range(0, len(chosen), 1024):
                    some = chosen[c : c + 1024]
                    score = q[some] @ x[a:z].T
                    row, col = np.nonzero(score >= best.least[some][:, None])
                    own = ids[some[row]] == vec[a:z][col]
                    row, col = row[~own], col[~own]
                    if len(row):
                        best.add(some[row], score[row, col].astype(np.float64), vec[a:z][col])
        yield pa.RecordBatch.from_arrays([pa.array(ids[best.query]), pa.array(best.vec), pa.array(best.score.astype(np.int64))], ["query_id", "vec_id", "score"])

    return index.mapInArrow(run, "query_id long, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


_RESULT = "query_id long, rank int, vec_id long, score long"


def search(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score for each vec_id divisible by ``every`` against all other rows."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    ints = scratch.written(integers(vectors).withColumn("d", F.size("v")))
    lengths = ints.groupBy("d").agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("norm2"), F.count_if(F.col("vec_id") % every == 0).alias("asked")).filter("asked > 0").collect()  # a row a length
    path = scratch.folder()
    spark.createDataFrame([], _RESULT).write.parquet(path)
    for length in lengths:
        _search(ints.filter(F.col("d") == length.d), length.norm2, length.asked, k, every, scratch, path)
    return scratch.keep(spark.read.schema(_RESULT).parquet(path))


def _search(ints: DataFrame, norm2: float, asked: int, k: int, every: int, scratch: Scratch, path: str) -> None:
    """Append the results for vectors of one length."""
    spark = ints.sparkSession
    sample = ints.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    pivots = choose_pivots(np.array(sample["v"].tolist(), np.float64), norm2)
    index = build(ints, pivots, norm2, scratch)
    cells = {r.pivot: r for r in index.groupBy("pivot").agg(F.count("*").alias("n"), F.min("dist").alias("a"), F.max("dist").alias("z")).collect()}  # a row a pivot
    # the width around a distance in which a pivot's mean density has 4 k vectors
    width = np.array([(cells[p].z - cells[p].a) * 4 * (k + 1) / cells[p].n if p in cells else 0.0 for p in range(len(pivots))])
    furthest = max(r.z for r in cells.values()) + math.sqrt(norm2) + 1
    one = ints.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    # numbered in the order of pivot and distance, so that a group's queries lie side by side
    placed = numbered(keyed(one, pivots, norm2, added=False), ["pivot", "dist", "vec_id"], "at")
    asked_rows = scratch.written(placed.select("vec_id", "v", F.floor(F.col("at") / QUERIES).alias("grp")))
    for g in range(math.ceil(asked / QUERIES)):
        mine: pd.DataFrame = asked_rows.filter(F.col("grp") == g).select("vec_id", "v").toPandas()
        if mine.empty:  # repeated rows are one query, so the groups may be fewer
            break
        ids, q = mine["vec_id"].to_numpy(np.int64), np.array(mine["v"].tolist(), np.float64)
        to_pivot = _distances(q, np.zeros(len(q)), pivots)
        home = to_pivot.argmin(1)
        own, least, radius = to_pivot[np.arange(len(q)), home], np.full(len(q), -np.inf), width[home]
        while (open_ := np.flatnonzero(np.isneginf(least) & (radius <= 4 * furthest))).size:
            low, high = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
            np.minimum.at(low, home[open_], (own - radius)[open_])
            np.maximum.at(high, home[open_], (own + radius)[open_])
            sent = spark.sparkContext.broadcast((ids[open_], q[open_], to_pivot[open_], home[open_], least[open_]))
            near = _ranked(_scan(_within(index, low, high), sent, k, norm2, radius[open_]), k).filter(F.col("rank") == k).select("query_id", "score").toPandas()
            known = dict(zip(near["query_id"], near["score"]))
            least[open_] = [known.get(i, -np.inf) for i in ids[open_].tolist()]
            radius = np.where(np.isneginf(least), np.maximum(4 * radius, 1.0), radius)
        with np.errstate(invalid="ignore"):
            reach = np.where(np.isneginf(least), np.inf, np.sqrt(np.maximum(0, (q**2).sum(1) + norm2 - 2 * least)) + 1e-3)
        low, high = (to_pivot - reach[:, None]).min(0), (to_pivot + reach[:, None]).max(0)
        sent = spark.sparkContext.broadcast((ids, q, to_pivot, home, least))
        _ranked(_scan(_within(index, low, high), sent, k, norm2), k).select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
