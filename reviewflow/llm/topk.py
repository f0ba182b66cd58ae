"""Exact search for the vectors of largest inner product: multi-resolution segment statistics.

Vectors hold whole numbers, ``floor(scale * x)``. A level cuts the components into segments; a vector
keeps the mean and the standard deviation of each. The squared distance of two vectors is at least the sum,
over the segments, of the segment's length times the squares of the differences of both (Cauchy-Schwarz), so
with the norms their inner product is at most the sum of ``length (mean mean' + dev dev')``. A task holds a
block of queries and reads its vectors in growing batches. As soon as a query has enough results it has a score
to beat; then the levels are tried coarse to fine, each on what the one before left, and only pairs that no level
rules out get their exact product. Rounding is allowed for, so a bound never rules out a winner or a tie.

Queries go out in blocks of about ``BLOCK_BYTES``, one broadcast after the other; each is a pass over the
vectors, which are not shuffled, and a task returns at most ``k + 1`` rows for each query. A block's results are
written before the next block is read.

Defined results: a vector that is null or holds null, NaN or infinity takes no part; vectors of different
lengths are not compared; a query's own row is not among its results, but rows of equal id or vector are;
ties go to the smaller id, a null id after all others (it is never a query, and 2^63 - 1 counts as one);
queries that occur twice are answered twice; a score outside the range of a long becomes its nearest end; an
empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewflow.session import scratch_dir

#: Bytes of the queries that are sent at once.
BLOCK_BYTES = 32 << 20
#: Segments of the levels, coarse to fine; a level is used where it has fewer figures than a vector components.
LEVELS = (1, 4, 16)
#: Queries compared at once, and vectors: few at first, then twice as many each time.
QUERIES, FIRST, MOST = 512, 64, 2048
#: Share of the pairs of a batch up to which pairs are looked at one by one.
FEW = 0.02
#: Products below this are exact in floating point.
EXACT = float(1 << 53)
LAST = (1 << 63) - 1
_FOUND = "place long, query_id long, own long, vec_id long, score long"


class Block:
    """Vectors of one length, their ids, and what the levels keep of them."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        with np.errstate(over="ignore"):
            self.norm = np.sqrt((rows ** 2).sum(axis=1))
        self._levels: dict[int, np.ndarray] = {}

    def level(self, segments: int) -> np.ndarray:
        """Mean and deviation of each segment, times the root of its length."""
        if segments not in self._levels:
            cut = np.linspace(0, self.rows.shape[1], segments + 1).astype(np.int64)
            length = np.diff(cut)
            with np.errstate(over="ignore", invalid="ignore"):
                mean = np.add.reduceat(self.rows, cut[:-1], axis=1) / length
                spread = (self.rows - np.repeat(mean, length, axis=1)) ** 2
                dev = np.sqrt(np.add.reduceat(spread, cut[:-1], axis=1) / length)
            self._levels[segments] = np.concatenate([mean, dev], axis=1) * np.sqrt(np.r_[length, length])
        return self._levels[segments]

    def part(self, at: slice) -> Block:
        out = Block.__new__(Block)
        out.ids, out.rows, out.norm = self.ids[at], self.rows[at], self.norm[at]
        out._levels = {s: x[at] for s, x in self._levels.items()}
        return out


def blocks(ids: pa.Array, vectors: pa.Array, scale: int) -> Iterator[tuple[np.ndarray, Block]]:
    """The vectors that take part, by length: their rows in the input, and a block."""
    size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    with np.errstate(invalid="ignore", over="ignore"):
        values = np.floor(vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) * scale)
    start = np.cumsum(size) - size
    valid = vectors.is_valid().to_numpy(zero_copy_only=False)
    valid[np.repeat(np.arange(len(size)), size)[~np.isfinite(values)]] = False
    ids = pc.fill_null(ids.cast(pa.int64()), LAST).to_numpy(zero_copy_only=False)
    for n in np.unique(size[valid]):
        rows = np.flatnonzero(valid & (size == n))
        yield rows, Block(ids[rows], values[start[rows][:, None] + np.arange(n)])


def _big(a: np.ndarray, b: np.ndarray) -> int:
    whole = sum(int(x) * int(y) for x, y in zip(a, b))
    return max(-LAST, min(LAST, whole))


def _products(q: np.ndarray, v: np.ndarray, exact: bool) -> np.ndarray:
    """Inner product of each row of ``q`` with its row of ``v``."""
    if exact:
        return np.einsum("ij,ij->i", q, v).astype(np.int64)
    return np.array([_big(a, b) for a, b in zip(q, v)], np.int64)


def candidates(q: Block, v: Block, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, vector and exact score of the pairs that may reach the query's ``floor``."""
    most = float(q.norm.max()) * float(v.norm.max())
    exact, slack = most < EXACT, 1 + 1e-9 * most
    at, of = np.arange(len(q.rows)), np.arange(len(v.rows))
    open_, pairs = None, None
    levels = [s for s in LEVELS if 2 * s < q.rows.shape[1]] if np.isfinite(floor).all() else []
    for s in levels:
        mine, theirs = q.level(s), v.level(s)
        with np.errstate(over="ignore", invalid="ignore"):
            if pairs is not None:
                keep = ~(np.einsum("ij,ij->i", mine[pairs[0]], theirs[pairs[1]]) + slack < floor[pairs[0]])
                pairs = pairs[0][keep], pairs[1][keep]
                continue
            reach = ~(mine[at] @ theirs[of].T + slack < floor[at][:, None])
        open_ = reach if open_ is None else open_ & reach
        row, column = open_.any(axis=1), open_.any(axis=0)
        at, of, open_ = at[row], of[column], open_[row][:, column]
        if open_.sum() <= FEW * len(q.rows) * len(v.rows):
            row, column = np.nonzero(open_)
            pairs = at[row], of[column]
    if pairs is None and exact:
        score = (q.rows[at] @ v.rows[of].T).astype(np.int64)
        reach = score >= floor[at][:, None]
        row, column = np.nonzero(reach if open_ is None else open_ & reach)
        return at[row], of[column], score[row, column]
    if pairs is None:
        row, column = np.nonzero(np.ones((len(at), len(of)), bool) if open_ is None else open_)
        pairs = at[row], of[column]
    return *pairs, _products(q.rows[pairs[0]], v.rows[pairs[1]], exact)


class Best:
    """The ``k`` best vectors of each query so far, best first."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), -LAST - 1, np.int64)
        self.ids = np.full((queries, k), LAST, np.int64)
        self.have = np.zeros(queries, np.int64)

    def floor(self, at: slice) -> np.ndarray:
        """The score that a further vector has to reach."""
        return np.where(self.have[at] >= self.k, self.score[at, -1].astype(np.float64), -np.inf)

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        last, last_id = self.score[query, -1], self.ids[query, -1]
        wins = (self.have[query] < self.k) | (score > last) | ((score == last) & (ids < last_id))
        query, ids, score = query[wins], ids[wins], score[wins]
        if not len(query):
            return
        changed = np.unique(query)
        held = np.repeat(changed, self.have[changed])
        slot = np.arange(len(held)) - np.repeat(np.cumsum(self.have[changed]) - self.have[changed], self.have[changed])
        query = np.r_[held, query]
        ids, score = np.r_[self.ids[held, slot], ids], np.r_[self.score[held, slot], score]
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        keep = rank < self.k
        self.score[query[keep], rank[keep]], self.ids[query[keep], rank[keep]] = score[keep], ids[keep]
        self.have[changed] = np.bincount(query[keep], minlength=len(self.have))[changed]


def _searched(batches: Iterator[pa.RecordBatch], sent: pa.Table, k: int, scale: int) -> Iterator[pa.RecordBatch]:
    """The best vectors of one partition for each query sent."""
    queries = {}
    for places, block in blocks(sent.column(0).combine_chunks(), sent.column(1).combine_chunks(), scale):
        queries[block.rows.shape[1]] = places, block, Best(len(places), k)
    many = {n: FIRST for n in queries}
    for batch in batches:
        for _, vectors in blocks(batch.column(0), batch.column(1), scale):
            n = vectors.rows.shape[1]
            if n not in queries:
                continue
            _, block, best = queries[n]
            begin = 0
            while begin < len(vectors.rows):
                some = vectors.part(slice(begin, begin + many[n]))
                for i in range(0, len(block.rows), QUERIES):
                    at = slice(i, i + QUERIES)
                    query, found, score = candidates(block.part(at), some, best.floor(at))
                    best.add(query + i, some.ids[found], score)
                begin, many[n] = begin + many[n], min(MOST, 2 * many[n])
    for places, block, best in queries.values():
        own = _products(block.rows, block.rows, bool((block.norm ** 2 < EXACT).all()))
        query, slot = np.nonzero(np.arange(k) < best.have[:, None])
        ids = best.ids[query, slot]
        yield pa.RecordBatch.from_arrays(
            [pa.array(places[query], pa.int64()), pa.array(block.ids[query], pa.int64()),
             pa.array(own[query], pa.int64()), pa.array(ids, pa.int64(), mask=ids == LAST),
             pa.array(best.score[query, slot], pa.int64())],
            names=["place", "query_id", "own", "vec_id", "score"])


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 5, scale: int = 256, id_: str = "vec_id",
            vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` vectors of largest inner product with each query, which is
    itself a row of ``vectors``."""
    spark = queries.sparkSession
    folder = scratch_dir(spark, "nearest")
    asked = queries.select(F.col(id_).cast("long").alias("id"), F.col(vector).alias("vector")) \
        .where("id IS NOT NULL AND vector IS NOT NULL")
    size = asked.agg(F.sum(F.size("vector") * 8 + 16)).first()[0] or 0
    parts = -(-size // BLOCK_BYTES)
    # Numbers of rows spread evenly, also where one id has most rows.
    asked.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(max(1, parts)))) \
        .repartition("part").write.partitionBy("part").parquet(f"{folder}/queries")
    read = vectors.select(F.col(id_).cast("long").alias("id"), F.col(vector).alias("vector"))
    best = Window.partitionBy("place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    for part in range(parts):
        block = spark.read.parquet(f"{folder}/queries").where(F.col("part") == part).select("id", "vector").toArrow()
        sent = spark.sparkContext.broadcast(block)
        found = read.mapInArrow(lambda it, sent=sent: _searched(it, sent.value, k + 1, scale), _FOUND)
        found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1) \
            .write.parquet(f"{folder}/found/part={part}")
        sent.destroy()
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = spark.read.schema(_FOUND + ", n int, part int").parquet(f"{folder}/found")
    # The own row is one of those with the query's id and its product with itself; which one is the same.
    own = F.min(F.when((F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own")), F.col("n"))) \
        .over(Window.partitionBy("part", "place"))
    others = found.withColumn("own_n", F.coalesce(own, F.lit(k + 2))).where("n <> own_n")
    return others.select("query_id", (F.col("n") - F.when(F.col("n") > F.col("own_n"), 1).otherwise(0))
                         .cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
