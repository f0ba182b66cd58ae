"""Near-duplicate groups of texts: BagMinHash signatures, banding, exact check, connected groups.

A text is the bag of its five-word shingles. Each shingle has a Poisson process over time whose points
carry a slot of the signature and a weight level; a text that holds the shingle ``w`` times sees the
points of levels up to ``w``. Levels are drawn by a hierarchy of doubling ranges, (0, 1], (1, 2],
(2, 4] and so on, so a weight costs as many processes as it has bits. The slot keeps its earliest
point; two texts agree in a slot with a probability equal to their weighted Jaccard similarity.
Only points before a time that fills all slots of a text with high probability are drawn; texts with
an empty slot are drawn again for a longer time.

Texts, not documents, are compared: equal texts are one node. Nodes that agree in a band meet in a
bucket. There each node is checked against the pivot of the bucket, its most central node, the one with
most company over all bands; so a large group of copies costs one check per text and band instead of all
its pairs. Buckets whose nodes are then still in different groups are worked off in full by tasks that
get parts of bounded size: signatures estimate all pairs, and those that may reach the similarity are
checked from the likeliest on until the bucket's nodes are one group or every such pair has been
checked. Only links leave a task, never pairs. An estimate of ``DOUBT`` or less is five standard
deviations under 0.8, so what it leaves out is less than what the bands miss.

Defined results: a null text counts as empty; texts of fewer than five words have one shingle of all
their words; empty texts are equal to each other and near to nothing else; a null id comes after all
others; rows of equal id and text are one class; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewflow.llm.words import LAST_ID, U, hashes_of, mixed, shingles, slices, split_words
from reviewflow.session import delete_dir, scratch_dir

WIDTH = 5
SIMILARITY = 0.8
#: Bands and slots per band: two texts of similarity 0.8 meet with a probability over 0.9996.
BANDS, ROWS = 26, 6
#: Texts that a task compares with one text; nodes and bytes of text in each part of a bucket.
PARTNERS, PART, PART_BYTES = 128, 500, 8 << 20
#: Agreement of signatures up to which a pair is not checked.
DOUBT = 0.64
#: Node ids (16 bytes each) that are sent to all executors at most.
SENT_NODES = 500_000
_BITS = 40


def bags(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, 40-bit shingle hash and weight of each distinct shingle of each text, in that order."""
    words = split_words(texts)
    hashed, starts = shingles(words, hashes_of(words), width)
    row = np.repeat(np.arange(len(texts), dtype=U), np.diff(starts))
    keys = np.sort((row << U(_BITS)) | (hashed >> U(64 - _BITS)))
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    weight = np.diff(np.r_[first, len(keys)])
    keys = keys[first]
    return (keys >> U(_BITS)).astype(np.int64), keys & U((1 << _BITS) - 1), weight


def _points(seed, rate, until):
    """Points of Poisson processes, in rounds: process, time, hash of the point."""
    live, time = np.arange(len(seed)), np.zeros(len(seed))
    state = mixed(seed)
    while len(live):
        state = mixed(state + U(0x9E3779B97F4A7C15))
        time = time - np.log(((state >> U(11)).astype(float) + 0.5) * 2.0 ** -53) / rate
        on = time < until
        live, time, rate, until, state = live[on], time[on], rate[on], until[on], state[on]
        yield live, time, mixed(state ^ U(0xD6E8FEB86659FD93))


def signatures(rows: int, row: np.ndarray, shingle: np.ndarray, weight: np.ndarray,
               slots: int = BANDS * ROWS) -> np.ndarray:
    """BagMinHash signature of each row; rows without shingles have zeros."""
    best = np.full(rows * slots, ~U(0), U)
    total = np.bincount(row, weight, rows)
    todo, stretch = total > 0, np.log(slots) + 5
    while todo.any():
        until = np.where(total > 0, stretch * slots / np.maximum(total, 1), 0)
        some = todo[row]
        r, x, w = row[some], shingle[some], weight[some]
        level = 0
        while len(r):
            low, size = (0, 1) if level == 0 else (1 << (level - 1), 1 << (level - 1))
            process = mixed(x * U(64) + U(level))
            for live, time, point in _points(process, np.full(len(r), float(size)), until[r]):
                within = low + ((point >> U(32)) & U(0xFFFF)).astype(float) / 65536 * size
                own = within < w[live]
                at = live[own]
                slot = ((point[own] >> U(48)) * U(slots)) >> U(16)
                when = (time[own] / until[r[at]] * 2.0 ** 31).astype(U)
                np.minimum.at(best, r[at] * slots + slot.astype(np.int64),
                              (when << U(32)) | (mixed(point[own]) >> U(32)))
            more = w > low + size
            r, x, w, level = r[more], x[more], w[more], level + 1
        full = (best.reshape(rows, slots) != ~U(0)).all(axis=1)
        todo &= ~full
        best.reshape(rows, slots)[todo] = ~U(0)
        stretch *= 3
    out = best.reshape(rows, slots) & U(0xFFFFFFFF)
    out[total == 0] = 0
    return out


def _banded(batches: Iterator[pa.RecordBatch], bands: int, per_band: int) -> Iterator[pa.RecordBatch]:
    """Band keys and signature (16 bits a slot) of each text."""
    for batch in slices(batches):
        # One of equal texts of a slice is enough.
        nodes = batch.column("node").to_pylist()
        seen = {n: i for i, n in reversed(list(enumerate(nodes)))}
        batch = batch.take(pa.array(sorted(seen.values()), pa.int64()))
        row, shingle, weight = bags(batch.column("text"))
        sig = signatures(batch.num_rows, row, shingle, weight, bands * per_band)
        some = np.flatnonzero(np.bincount(row, minlength=batch.num_rows))
        key = np.zeros((len(some), bands), U)
        for j in range(per_band):
            key = mixed(key * U(0x9E3779B97F4A7C15) + sig[some][:, j::per_band][:, :bands])
        key = mixed(key + np.arange(bands, dtype=U))
        yield pa.RecordBatch.from_arrays(
            [batch.column("node").take(pa.array(some)),
             pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * bands, pa.int32()),
                                      pa.array(key.ravel().view(np.int64))),
             pa.array([s.tobytes() for s in sig[some].astype(np.uint16)], pa.binary())],
            names=["node", "bands", "signature"])


def similarities(first: tuple, bag: tuple) -> np.ndarray:
    """Weighted Jaccard similarity of one bag (shingles in order, weights) to each of several."""
    (x, w), (row, shingle, weight) = first, bag
    n = int(row[-1]) + 1 if len(row) else 0
    at = np.minimum(np.searchsorted(x, shingle), max(0, len(x) - 1))
    both = np.where(x[at] == shingle, np.minimum(w[at], weight), 0) if len(x) else np.zeros(len(row))
    common = np.bincount(row, both, n)
    return common / np.maximum(w.sum() + np.bincount(row, weight, n) - common, 1)


def _checked(table: pa.Table, least: float) -> pa.Table:
    """Links of one text, the row without partner, to those of its group."""
    table = table.combine_chunks()
    own = table.filter(table.column("b").is_null())
    rest = table.filter(table.column("b").is_valid())
    out = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("similarity", pa.float64())])
    if not own.num_rows or not rest.num_rows:
        return out.empty_table()
    _, x, w = bags(own.column("text").combine_chunks().slice(0, 1))
    found = np.zeros(rest.num_rows)
    at = 0
    for batch in slices(rest.to_batches()):
        some = similarities((x, w), bags(batch.column("text")))
        found[at:at + len(some)] = some
        at += batch.num_rows
    near = rest.append_column("similarity", pa.array(found)).filter(pa.array(found >= least))
    return near.select(["a", "b", "similarity"]).cast(out)


def _settled(table: pa.Table, least: float) -> pa.Table:
    """Links that join different groups of a bucket, or of two parts of it."""
    table = table.combine_chunks()
    out = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("similarity", pa.float64())])
    group, _ = pd.factorize(np.array(table.column("label").to_pylist(), object))
    sides = table.column("side").to_numpy()
    sig = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint16).reshape(len(group), -1)
    row, shingle, weight = (np.concatenate(x) for x in zip(*_bags_of(table.column("text"))))
    starts = np.searchsorted(row, np.arange(len(group) + 1))
    parent = list(range(int(group.max()) + 1))

    def top(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    ones, others, likely = [], [], []
    for i in range(len(group)):
        rest = np.arange(i + 1, len(group))
        rest = rest[(group[rest] != group[i]) & ((sides[rest] != sides[i]) | (sides[i] == 2))]
        share = (sig[rest] == sig[i]).mean(axis=1)
        rest, share = rest[share > DOUBT], share[share > DOUBT]
        ones.append(np.full(len(rest), i))
        others.append(rest)
        likely.append(share)
    ones, others, likely = map(np.concatenate, (ones, others, likely))
    nodes, found = table.column("node").to_pylist(), []
    for k in np.argsort(-likely, kind="stable").tolist():
        i, j = int(ones[k]), int(others[k])
        if top(group[i]) == top(group[j]):
            continue
        x, y = slice(starts[i], starts[i + 1]), slice(starts[j], starts[j + 1])
        s = similarities((shingle[x], weight[x]), (np.zeros(y.stop - y.start, int), shingle[y], weight[y]))[0]
        if s >= least:
            parent[top(group[i])] = top(group[j])
            found.append((*sorted((nodes[i], nodes[j])), float(s)))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), out)],
                                schema=out) if found else out.empty_table()


def _bags_of(texts: pa.ChunkedArray) -> Iterator[tuple]:
    at = 0
    for batch in slices(pa.table({"text": texts}).to_batches()):
        row, shingle, weight = bags(batch.column("text"))
        yield row + at, shingle, weight
        at += batch.num_rows


class _Work:
    """Written tables of one run, in the shared folder."""

    def __init__(self, spark):
        self.spark, self.folder, self.n = spark, scratch_dir(spark, "near-dups"), 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.folder}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{self.n}")

    def clear(self) -> None:
        delete_dir(self.spark, self.folder)


def _texts_of(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """The texts of some nodes; their list is sent to the executors if it is short."""
    nodes = nodes.distinct()
    if nodes.count() <= SENT_NODES:
        nodes = F.broadcast(nodes)
    return texts.join(nodes, "node", "left_semi").dropDuplicates(["node"])


def checked_links(texts: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of nodes whose texts have at least the similarity ``least``.

    The partners of a text are dealt to tasks ``PARTNERS`` at a time, each with a copy of the text.
    """
    texts = _texts_of(texts, pairs.select(F.col("a").alias("node")).union(
        pairs.select(F.col("b").alias("node"))))
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("shares"))
    dealt = pairs.join(shares, "a").withColumn("share", F.expr("pmod(xxhash64(b), shares)"))
    partners = dealt.join(texts, dealt["b"] == texts["node"]).select("a", "share", "b", "text")
    own = shares.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
    own = own.join(texts, own["a"] == texts["node"]).select(
        "a", "share", F.lit(None).cast("binary").alias("b"), "text")
    return partners.union(own).groupBy("a", "share").applyInArrow(
        lambda t: _checked(t, least), "a binary, b binary, similarity double")


def settled_links(texts: DataFrame, marks: DataFrame, named: DataFrame, least: float) -> DataFrame:
    """Links between groups of the buckets in ``named`` (band, node, label).

    A bucket is dealt to parts; every two parts meet in a task, and each part by itself.
    """
    nodes = named.select("node")
    size = _texts_of(texts, nodes).select("node", "text")
    known = size.join(marks.select("node", "signature").dropDuplicates(["node"]), "node")
    sizes = named.join(size.select("node", F.octet_length("text").alias("bytes")), "node") \
                 .groupBy("band").agg(F.greatest(F.ceil(F.count("*") / PART),
                                                 F.ceil(F.sum("bytes") / PART_BYTES)).alias("parts"))
    dealt = named.join(sizes, "band").withColumn("part", F.expr("pmod(xxhash64(node), parts)"))
    # A task is two parts (low, high); a row goes to every task of its part and says which of the two it
    # is of. A part by itself compares all its rows, which is side 2.
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    met = met.select("band", "node", "label", F.least("part", "other").alias("low"),
                     F.greatest("part", "other").alias("high"),
                     F.when(F.col("part") == F.col("other"), 2).when(F.col("part") < F.col("other"), 0)
                     .otherwise(1).alias("side"))
    return met.join(known, "node").groupBy("band", "low", "high").applyInArrow(
        lambda t: _settled(t, least), "a binary, b binary, similarity double")


def connected(work: _Work, edges: DataFrame) -> DataFrame:
    """Least node of the connected group of each node of the edges: node, label."""
    both = work.keep(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = work.keep(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")))
    while True:
        # The least label around a node, then the label of that label.
        around = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(around, labels["node"] == around["a"]) \
                     .select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        new = work.keep(step.join(jump, step["label"] == jump["via"], "left").select(
            "node", F.least("label", F.coalesce("far", "label")).alias("label"), "old"))
        labels = new.select("node", "label")
        if not new.where("label <> old").count():
            return labels


def links(work: _Work, docs: DataFrame, least: float = SIMILARITY, bands: int = BANDS,
          per_band: int = ROWS) -> tuple:
    """Checked links between different texts and the group of each linked text.

    ``docs`` has node (a 16-byte hash of the text) and text. Gives (a, b, similarity) and
    (node, label). Links within a group that the others join anyway may be left out.
    """
    marks = work.keep(docs.where(F.length("text") > 0).mapInArrow(
        lambda it: _banded(it, bands, per_band), "node binary, bands array<bigint>, signature binary"))
    rows = work.keep(marks.select(F.explode("bands").alias("band"), "node").distinct())
    shared = rows.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    live = work.keep(rows.join(shared, "band").select("band", "node", "n"))
    company = live.groupBy("node").agg(F.sum("n").alias("company"))
    pivots = live.join(company, "node").groupBy("band").agg(
        F.max(F.struct("company", "node")).alias("pivot")).select("band", F.col("pivot.node").alias("a"))
    pairs = live.join(pivots, "band").where("a <> node").select("a", F.col("node").alias("b")).distinct()
    edges = work.keep(checked_links(docs, work.keep(pairs), least))
    labels = connected(work, edges)
    named = live.where("n > 2").join(labels, "node", "left").select(
        "band", "node", F.coalesce("label", "node").alias("label"))
    apart = named.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")) \
                 .where("low < high").select("band")
    named = work.keep(named.join(apart, "band"))
    if named.isEmpty():
        return edges, labels
    edges = work.keep(edges.union(settled_links(docs, marks, named, least)).dropDuplicates(["a", "b"]))
    return edges, connected(work, edges)


def noded(docs: DataFrame) -> DataFrame:
    """doc_id (never null), node and text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc_id"),
                       F.unhex(F.md5(text)).alias("node"), text.alias("text"))


def grouped(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id (never null), node, label of the group, exact_id, class_id and links of each row."""
    own = noded(docs)
    result, work = _Work(docs.sparkSession), _Work(docs.sparkSession)
    ids = result.keep(own.select("doc_id", "node"))
    edges, labels = links(work, own.select("node", "text"), least)
    n = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))) \
             .groupBy("node").agg(F.count("*").alias("links"))
    classes = ids.groupBy("node").agg(F.min("doc_id").alias("exact_id"))
    named = classes.join(labels, "node", "left").join(n, "node", "left").select(
        "node", "exact_id", F.coalesce("label", "node").alias("label"),
        F.coalesce("links", F.lit(0).cast("long")).alias("links"))
    groups = named.groupBy("label").agg(F.min("exact_id").alias("class_id"))
    named = result.keep(named.join(groups, "label").select("node", "label", "exact_id", "class_id", "links"))
    work.clear()
    return ids.join(named, "node")


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, exact_id, class_id, links, kept.

    ``exact_id``: least id of the documents with the same text; ``class_id``: least id of the
    documents connected by links; ``links``: links of the text to other texts that were checked (a
    group of n texts has at least n - 1 of them); ``kept``: the document that stands for its group.
    """
    ids = [F.when(F.col(c) < LAST_ID, F.col(c)).alias(c) for c in ("doc_id", "exact_id", "class_id")]
    return grouped(docs, least).select(*ids, "links", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group the document of the least id stays, in one row."""
    own = docs.select(F.struct(*docs.columns).alias("doc"),
                      F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc_id"),
                      F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("node"))
    rows = grouped(docs).groupBy("label", "doc_id", "node").agg(F.count("*").alias("n"))
    kept = rows.groupBy("label").agg(F.min(F.struct("doc_id", "node", "n")).alias("k")).select("k.*")
    out = own.join(kept, ["doc_id", "node"], "left_semi")
    if kept.where("n > 1").limit(1).count():  # rows that are repeated as a whole
        out = out.dropDuplicates(["doc_id", "node"])
    return out.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
