"""Quality scores: logistic regression over hashed word n-grams, trained by follow the regularised leader.

Tokens are runs of letters and digits or runs of other signs, case kept; the features of a text are its
tokens, neighbouring pairs, and pairs of one token with itself one or two places on (one feature for
any token, so that new words that are repeated show), hashed, each with its share of the text. Learning takes a sample of the
labelled rows, at most about ``SAMPLE``, chosen by a hash of the id. Its rows are dealt to ``SHARDS``
tasks; each runs FTRL-proximal over its rows, some rounds in a fixed order, and the shards'
weights are averaged. Scores are sparse dot products of every whole text with the weights.

Defined results: a null or empty text scores by the bias alone; labels without value or document are not
learned from; of several labels of one document the highest counts; without learning rows all
scores are 0.5; null ids count as the text "" in the fold and stay null; repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewflow.llm.words import U, Words, hashes_of, mixed, slices

SAMPLE, SHARDS, ROUNDS = 20_000, 4, 4
FEATURES = 1 << 18
#: FTRL-proximal: learning rate, its offset, and the weights of both penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-5
#: What the shares of a text add up to.
LENGTH = 16.0
PREDICTED_FROM = 0.3


def tokens(texts: pa.Array) -> Words:
    """Runs of letters, digits and bytes beyond ASCII, and runs of other signs, of each text."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    n = int(offsets[-1] - offsets[0])
    raw = np.zeros(n + 8, np.uint8)
    raw[:n] = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    body = raw[:n]
    kind = np.full(n, 2, np.uint8)
    kind[(body >= 128) | ((body | 32) - 97 < 26) | (body - 48 < 10)] = 1
    kind[(body == 32) | (body - 9 < 5)] = 0
    cut = np.ones(n + 1, bool)
    cut[1:n] = kind[1:] != kind[:-1]
    cut[offsets] = True
    cuts = np.flatnonzero(cut)
    some = kind[cuts[:-1]] > 0 if n else np.zeros(0, bool)
    begin, end = cuts[:-1][some] if n else cuts[:0], cuts[1:][some] if n else cuts[:0]
    return Words(raw, begin, end, np.searchsorted(begin, offsets))


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature of each token and each pair of neighbours, row by row."""
    words = tokens(texts)
    own, row = hashes_of(words), words.rows
    pairs = mixed(own[:-1] * U(0x9E3779B97F4A7C15) + own[1:])
    inside = row[1:] == row[:-1]
    rows, found = [row, row[:-1][inside]], [own, pairs[inside]]
    for apart in (1, 2):
        same = (own[apart:] == own[:-apart]) & (row[apart:] == row[:-apart])
        rows.append(row[apart:][same])
        found.append(np.full(int(same.sum()), apart, U))
    rows = np.concatenate(rows)
    order = np.argsort(rows, kind="stable")
    return rows[order], (np.concatenate(found)[order] % U(FEATURES)).astype(np.int64)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rounds: int = ROUNDS) -> tuple:
    """Weights and bias learned from sparse rows (features, shares) in the given order."""
    z, n = np.zeros(FEATURES + 1), np.zeros(FEATURES + 1)

    def weight(at):
        zs = z[at]
        w = -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(zs) <= L1, 0.0, w)

    for _ in range(rounds):
        for (at, share), label in zip(rows, labels):
            w = weight(at)
            gradient = (1 / (1 + np.exp(-np.clip(w @ share, -35, 35))) - label) * share
            sigma = (np.sqrt(n[at] + gradient ** 2) - np.sqrt(n[at])) / ALPHA
            z[at] += gradient - sigma * w
            n[at] += gradient ** 2
    w = weight(np.arange(FEATURES + 1))
    return w[:-1], w[-1]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse rows of labelled texts: features in order and how often each occurs."""
    for batch in slices(batches):
        row, feature = features(batch.column("text"))
        key = np.sort(row * FEATURES + feature)
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else key
        times = np.diff(np.r_[first, len(key)])
        key = key[first]
        cuts = pa.array(np.searchsorted(key, np.arange(batch.num_rows + 1) * FEATURES), pa.int32())
        yield pa.RecordBatch.from_pydict({
            "shard": batch.column("shard"), "place": batch.column("place"), "label": batch.column("label"),
            "features": pa.ListArray.from_arrays(cuts, pa.array((key % FEATURES).astype(np.int32))),
            "times": pa.ListArray.from_arrays(cuts, pa.array(times.astype(np.int32)))})


def _learn(table: pa.Table) -> pa.Table:
    table = table.sort_by("place")
    rows = []
    for at, times in zip(table.column("features"), table.column("times")):
        at, times = at.values.to_numpy(), times.values.to_numpy().astype(float)
        rows.append((np.r_[at, FEATURES].astype(np.int64),
                     np.r_[times * LENGTH / max(1.0, times.sum()), 1.0]))
    w, bias = ftrl(rows, table.column("label").to_numpy().astype(float))
    some = np.flatnonzero(w)
    return pa.Table.from_pydict({"feature": pa.array(np.r_[some, FEATURES].astype(np.int32)),
                                 "weight": pa.array(np.r_[w[some], bias])})


def fold(column: str = "doc_id"):
    """The remainder that tells held-out rows (0) from learning rows."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % 5


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float] | None:
    """Learn from the labelled rows of the learning folds; None without any."""
    known = labels.where("doc_id is not null and quality is not null").where(fold() != 0) \
        .groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("quality").alias("quality"))
    n = known.count()
    if not n:
        return None
    own = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 20)
    some = known.where(own < min(1.0, sample / n))
    # About ``sample`` rows of 16 bytes.
    learning = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("id")).select(
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(SHARDS)).cast("int").alias("shard"),
        F.xxhash64("id", "text").alias("place"), F.col("quality").cast("int").alias("label"), "text")
    weights = learning.mapInArrow(
        _rows, "shard int, place long, label int, features array<int>, times array<int>") \
        .groupBy("shard").applyInArrow(_learn, "feature int, weight double") \
        .groupBy("feature").agg(F.sum("weight").alias("weight")).toArrow()
    out = np.zeros(FEATURES + 1)
    # Each shard gives the bias, so its sum over them holds how many there were.
    shards = learning.select("shard").distinct().count()
    if not shards:
        return None
    out[weights["feature"].to_numpy()] = weights["weight"].to_numpy() / shards
    return out[:-1].astype(np.float32), float(out[-1])


def _scored(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    weights, bias = model.value
    for batch in slices(batches):
        row, feature = features(batch.column("text"))
        n = np.bincount(row, minlength=batch.num_rows)
        dot = np.bincount(row, weights[feature], batch.num_rows) * LENGTH / np.maximum(n, 1)
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "score": pa.array(1 / (1 + np.exp(-np.clip(dot + bias, -35, 35))))})


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None) -> DataFrame:
    """One row per row of ``docs``: doc_id, score, predicted."""
    model = (np.zeros(FEATURES, np.float32), 0.0) if model is None else model
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text") \
        .mapInArrow(partial(_scored, model=sent), "doc_id long, score double") \
        .withColumn("predicted", (F.col("score") >= PREDICTED_FROM).cast("int"))
