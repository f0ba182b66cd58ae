"""An inverted-file index over thread vectors: lists around centroids, searched a few at a time.

Threads lie in folders by the centroid nearest to them. A query looks only into the lists of its nearest
centroids and compares itself exactly with what is there, so a search reads a share of the threads. It is
approximate; probing all lists is exact. ``top_k_threads`` remains the exact way.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewflow.operators.joins import block_count
from reviewflow.operators.retrieval import _best, _kept, _top, _unit

# Threads the centroids are fitted on, at most about; every thread is indexed.
INDEX_SAMPLE = 20_000
MOST_LISTS = 4096
# Share of the lists probed by default.
UNGROUPED = 0.6
ROUNDS = 15
# Threads and queries that a task compares, and rows of its results at which it lets go of all but the best.
PART_ROWS, QUERY_ROWS, HELD_FOUND = 50_000, 16_384, 1_000_000


def _centroids(units: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Directions of ``lists`` groups of the vectors (Lloyd's rounds over cosines)."""
    rng = np.random.default_rng(seed)
    centers = units[rng.choice(len(units), lists, replace=False)]
    for _ in range(ROUNDS):
        of = (units @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, of, units)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        # A group that ran empty starts again at some vector.
        lost = np.flatnonzero(size[:, 0] == 0)
        sums[lost] = units[rng.choice(len(units), len(lost))]
        centers = sums / np.where(size == 0, 1.0, size)
    return centers


def build_index(threads: DataFrame, path: str, lists: int | None = None, sample: int = INDEX_SAMPLE,
                thread_id: str = "vec_id", vector: str = "embedding") -> None:
    """Write all threads under ``path`` by list; ``lists`` is the root of their number unless given.

    Centroids are fitted on about ``sample`` threads drawn by a hash of their id. Vectors of another length than
    most, and those without a direction (zeros, null or NaN components), are left out, as by the exact search.
    """
    spark, path = threads.sparkSession, path.rstrip("/")
    length, n = threads.agg(F.mode(F.size(vector)), F.count(vector)).first()
    if not n:
        raise ValueError("no vectors to index")
    kept = threads.filter(F.size(vector) == F.lit(length)).filter(_has_direction(vector))
    drawn = F.pmod(F.xxhash64(thread_id), F.lit(1 << 20)) < max(1, int((1 << 20) * min(1.0, sample / n)))
    units = _unit(kept.filter(drawn).orderBy(F.xxhash64(thread_id)).limit(2 * sample).select(vector).toPandas()[vector])
    lists = min(lists or max(1, round(n ** 0.5)), MOST_LISTS, len(units))
    centers = _centroids(units, lists)
    spark.createDataFrame(pd.DataFrame({"list": range(lists), "center": centers.tolist()})).coalesce(1) \
        .write.parquet(f"{path}/centroids")
    sent = spark.sparkContext.broadcast(centers)

    @F.pandas_udf("int")
    def nearest(vectors: pd.Series) -> pd.Series:
        return pd.Series((_unit(vectors) @ sent.value.T).argmax(axis=1)).astype("int32")

    kept.select(thread_id, vector).withColumn("list", nearest(vector)).hint("rebalance", "list") \
        .write.partitionBy("list").parquet(f"{path}/lists")


def _has_direction(vector: str):
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(vector, lambda x: x != 0)


def search_index(queries: DataFrame, path: str, k: int = 2, probes: int | None = None, query_id: str = "vec_id",
                 thread_id: str = "vec_id", vector: str = "embedding", skip_self: bool = False) -> DataFrame:
    """query_id, thread id, similarity, rank: the ``k`` best threads of the ``probes`` nearest lists.

    By default three fifths of the lists are probed. That is for vectors that form no groups, of which it finds 93 in
    a hundred of the five best; where they do form groups a few lists are enough.
    Lists lie one after another in parts of ``PART_ROWS`` threads, a long list in several. A query goes once to each part
    that holds some of its lists, is compared there with those, and gets at most ``k`` threads of the part; a part meets
    queries in blocks of ``QUERY_ROWS``, so a task holds one of each. Only lists that a query probes are read.
    """
    spark: SparkSession = queries.sparkSession
    told = spark.read.parquet(f"{path}/centroids").orderBy("list").toPandas()
    centers = np.stack(told["center"])
    sent = spark.sparkContext.broadcast(centers)
    probes = min(probes or math.ceil(UNGROUPED * len(centers)), len(centers))
    every = probes == len(centers)
    threads = spark.read.parquet(f"{path}/lists")
    # Lists lie one after another, cut into parts; a list begins in the part of its first thread.
    count = np.zeros(len(centers), np.int64)
    for r in threads.groupBy("list").count().collect():
        count[r["list"]] = r["count"]
    start = np.cumsum(count) - count
    first, last = start // PART_ROWS, (start + np.maximum(count, 1) - 1) // PART_ROWS

    def nearest(vectors: pd.Series) -> np.ndarray:
        return np.argsort(-(_unit(vectors) @ sent.value.T), axis=1, kind="stable")[:, :probes]

    @F.pandas_udf("array<int>")
    def probed(vectors: pd.Series) -> pd.Series:
        return pd.Series(list(nearest(vectors).astype("int32")))

    @F.pandas_udf("array<array<int>>")
    def placed(vectors: pd.Series) -> pd.Series:
        """The parts that a query goes to: each with the lists that it probes there."""
        def parts(lists):
            held: dict[int, list[int]] = {}
            for at in lists.tolist():
                for part in range(first[at], last[at] + 1):
                    held.setdefault(part, [part]).append(at)
            return list(held.values())

        return pd.Series([parts(lists) for lists in nearest(vectors)])

    asked = queries.filter((F.size(vector) == F.lit(centers.shape[1])) & _has_direction(vector)) \
        .select(F.col(query_id).alias("_query"), F.col(vector).alias("_asked"))
    blocks = block_count(queries, QUERY_ROWS)
    block = F.pmod(F.xxhash64("_query"), F.lit(blocks)).cast("int").alias("block")
    if every:
        parts = F.transform(F.sequence(F.lit(0), F.lit(int(last[-1]))), lambda x: F.array(x))
    else:
        parts = placed("_asked")
    copied = asked.select("_query", "_asked", block, F.explode(parts).alias("_lists")) \
        .withColumn("part", F.col("_lists")[0])
    wanted = threads if every else threads.join(
        F.broadcast(asked.select(F.explode(probed("_asked")).alias("list")).distinct()), "list", "left_semi")
    sizes = spark.createDataFrame(list(enumerate(zip(start.tolist(), count.tolist()))),
                                  "list int, of struct<start: long, count: long>")
    # The rows of a list are dealt evenly to its places, those of a part to each block of queries.
    place = F.col("of.start") + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("of.count"))
    dealt = wanted.join(F.broadcast(sizes), "list").select(
        "list", thread_id, vector, F.floor(place / PART_ROWS).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    schema = f"query_id {dict(queries.dtypes)[query_id]}, {thread_id} {dict(threads.dtypes)[thread_id]}, similarity double"

    def compare(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        names = ("query_id", thread_id, "similarity")
        kept = pd.DataFrame({c: [] for c in names})
        if q.empty or t.empty:
            return kept
        asked, units = _unit(q["_asked"]), _unit(t[vector])
        asked_ids, thread_ids = q["_query"].to_numpy(), t[thread_id].to_numpy()

        def best(of, among):
            return pd.DataFrame(dict(zip(names, _best(
                asked_ids[of], asked[of], thread_ids[among], units[among], k, skip_self))))

        if every:
            return best(slice(None), slice(None))
        lists, probing = t["list"].to_numpy(), [x[1:] for x in q["_lists"]]
        of = np.repeat(np.arange(len(q)), [len(x) for x in probing])
        probing = np.concatenate(probing)
        order = np.argsort(probing, kind="stable")
        of, probing = of[order], probing[order]
        found = []
        for at in np.unique(lists):
            low, high = np.searchsorted(probing, [at, at + 1])
            found.append(best(of[low:high], np.flatnonzero(lists == at)))
            if sum(map(len, found)) > HELD_FOUND:
                found = [_kept(pd.concat(found), thread_id, k)]
        return _kept(pd.concat(found), thread_id, k)

    found = copied.select("part", "block", "_query", "_asked", "_lists").groupBy("part", "block").cogroup(
        dealt.groupBy("part", "block")).applyInPandas(lambda q, t: compare(q, t), schema)
    return _top(found, thread_id, k)
