"""Removal of word windows that an earlier document has: super-k-mer partitioning.

A window is ``width`` consecutive words of one document. Its minimiser is the least hash among its
runs of three words. Neighbouring windows with one minimiser travel as one packed string to the
bucket of the minimiser, so equal windows meet there; sorting groups them by a hash, and within a
group the 64-bit hashes of all thirteen words are compared. Windows that a slice of the input holds twice are settled there and
only the document of the least id sends them on: a passage that a third of all documents share
reaches its bucket once per slice.

Defined results: a null text has no words; a null id comes after all others; rows of equal id never
remove from each other; a text of fewer than ``width`` words keeps all; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewflow.llm.words import (LAST_ID, U, Words, give_back, hashes_of, rolled, runs, slices,
                                  split_words, words_at)

#: Words of the runs whose hashes are compared for the minimiser.
RUN = 3
#: Bytes of text for which one more bucket is made.
BUCKET_BYTES = 4 << 20
#: Bytes of packed strings that are put together before they are compressed and sent.
WAITING_BYTES = 48 << 20
SPANS = "key long, tag int, start long, stop long"
_SENT = "bucket int, key long, tag int, start long, stop long, packed binary"
_SPAN_ARROW = pa.schema([("key", pa.int64()), ("tag", pa.int32()), ("start", pa.int64()),
                         ("stop", pa.int64())])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:len(out) - step], out[step:])
        have += step
    return out


def repeated(hashed: np.ndarray, key: np.ndarray, at: np.ndarray, codes: np.ndarray,
             width: int) -> np.ndarray:
    """Which windows are also in a document with a smaller key.

    ``codes``: what stands for each word; ``at``: where in codes the windows begin.
    """
    dup = np.zeros(len(hashed), bool)
    if len(hashed) < 2:
        return dup
    order = np.argsort(hashed)
    new = np.r_[True, hashed[order][1:] != hashed[order][:-1]]
    group = np.cumsum(new) - 1
    sizes = np.bincount(group)
    many = sizes[group] > 1
    order, group = order[many], group[many]
    if not len(order):
        return dup
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[first, len(group)])
    head = np.repeat(order[first], size)
    same = np.ones(len(order), bool)
    for j in range(width):
        same &= codes[at[order] + j] == codes[at[head] + j]
    least = np.repeat(np.minimum.reduceat(key[order], first), size)
    dup[order] = key[order] > least
    # Two different windows of one hash: settle the group word by word.
    for g in np.unique(np.repeat(np.arange(len(first)), size)[~same]):
        members, by_words = order[first[g]:first[g] + size[g]], {}
        for m in members:
            by_words.setdefault(codes[at[m]:at[m] + width].tobytes(), []).append(m)
        for equal in by_words.values():
            dup[equal] = key[equal] > key[equal].min()
    return dup


def _windows(words: Words, own: np.ndarray, width: int):
    """Row, place in the text and place among all words of each window."""
    n = np.maximum(words.counts - width + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, at, at + words.starts[:-1][row]


def _span_batch(key, tag, start, stop) -> dict:
    return {"key": pa.array(key, pa.int64()), "tag": pa.array(tag, pa.int32()),
            "start": pa.array(start, pa.int64()), "stop": pa.array(stop, pa.int64())}


class _Waiting:
    """Packed strings of several slices, put together by bucket before they are sent."""

    def __init__(self):
        self.parts: dict[int, list[tuple[np.ndarray, bytes]]] = {}
        self.size = 0
        self.squeeze = zstandard.ZstdCompressor(level=6)

    def add(self, bucket: int, head: np.ndarray, text: bytes) -> None:
        self.parts.setdefault(bucket, []).append((head, text))
        self.size += len(text) + head.nbytes

    def sent(self) -> pa.RecordBatch:
        blobs = []
        for parts in self.parts.values():
            head = np.concatenate([h for h, _ in parts], axis=1)
            blobs.append(self.squeeze.compress(np.int64(head.shape[1]).tobytes() + head.tobytes()
                                               + b" ".join([t for _, t in parts])))
        k = len(blobs)
        out = pa.RecordBatch.from_pydict({
            "bucket": pa.array(list(self.parts), pa.int32()), "key": pa.nulls(k, pa.int64()),
            "tag": pa.nulls(k, pa.int32()), "start": pa.nulls(k, pa.int64()),
            "stop": pa.nulls(k, pa.int64()), "packed": pa.array(blobs, pa.binary())})
        self.parts, self.size = {}, 0
        return out


def _send(batches: Iterator[pa.RecordBatch], width: int, buckets: int) -> Iterator[pa.RecordBatch]:
    waiting = _Waiting()
    for batch in slices(batches):
        words = split_words(batch.column("text"))
        own = hashes_of(words)
        row, at, place = _windows(words, own, width)
        if not len(row):
            continue
        key = batch.column("key").to_numpy()
        tag = batch.column("tag").to_numpy()
        dup = repeated(rolled(own, width)[place], key[row], place, own, width)
        a, b = runs(dup, row, at)
        # What this slice settles takes the same way as the rest, to a bucket by document.
        settled = _span_batch(key[row[a]], tag[row[a]], at[a], at[b] + width)
        settled["bucket"] = pa.array((row[a] % buckets).astype(np.int32))
        settled["packed"] = pa.nulls(len(a), pa.binary())
        if len(a):
            yield pa.RecordBatch.from_pydict(settled).select(
                ["bucket", "key", "tag", "start", "stop", "packed"])
        least = sliding_min(rolled(own, RUN), width - RUN + 1)[place]
        kept = np.flatnonzero(~dup)
        if not len(kept):
            continue
        new = np.r_[True, (row[kept][1:] != row[kept][:-1]) | (at[kept][1:] != at[kept][:-1] + 1)
                    | (least[kept][1:] != least[kept][:-1])]
        first = kept[new]
        last = kept[np.r_[np.flatnonzero(new)[1:] - 1, len(kept) - 1]]
        bucket = (least[first] % U(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        cuts = np.r_[0, np.flatnonzero(np.diff(bucket[order])) + 1, len(order)]
        lengths = at[last] - at[first] + width
        raw = words.raw.tobytes()
        lo, hi = words.begin[place[first]], words.end[place[last] + width - 1]
        for i, j in zip(cuts, cuts[1:]):
            s = order[i:j]
            head = np.stack([key[row[first[s]]], at[first[s]], lengths[s], tag[row[first[s]]]]).astype(np.int64)
            waiting.add(int(bucket[s[0]]), head,
                        b" ".join([raw[x:y] for x, y in zip(lo[s].tolist(), hi[s].tolist())]))
        if waiting.size >= WAITING_BYTES:
            yield waiting.sent()
    if waiting.parts:
        yield waiting.sent()


def _meet(table: pa.Table, width: int) -> pa.Table:
    """Spans of one bucket: those settled before and those whose windows repeat here."""
    settled = table.filter(table.column("packed").is_null()).select(["key", "tag", "start", "stop"])
    blobs = table.column("packed").drop_null().to_pylist()
    if not blobs:
        return settled.cast(_SPAN_ARROW)
    squeeze = zstandard.ZstdDecompressor()
    heads, texts = [], []
    for blob in blobs:
        raw = squeeze.decompress(blob)
        k = int(np.frombuffer(raw, np.int64, 1)[0])
        heads.append(np.frombuffer(raw, np.int64, 4 * k, 8).reshape(4, k))
        texts.append(raw[8 + 32 * k:])
    del blobs, table
    key, start, n, tag = np.concatenate(heads, axis=1)
    joined = b" ".join(texts)
    del texts
    words = words_at(np.frombuffer(joined + bytes(8), np.uint8), np.array([0, len(joined)]))
    own = hashes_of(words)
    count = n - width + 1
    of = np.repeat(np.arange(len(n)), count)
    inside = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    place = inside + (np.cumsum(n) - n)[of]
    dup = repeated(rolled(own, width)[place], key[of], place, own, width)
    a, b = runs(dup, of, inside)
    found = pa.Table.from_pydict(_span_batch(
        key[of[a]], tag[of[a]], start[of[a]] + inside[a], start[of[a]] + inside[b] + width))
    del words, own, of, inside, place, dup
    give_back()
    return pa.concat_tables([settled.cast(_SPAN_ARROW), found.cast(_SPAN_ARROW)])


def keyed(docs: DataFrame) -> DataFrame:
    """The columns the work needs: a key that is never null, a hash that tells texts of one id apart."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("key"),
                       F.hash(F.coalesce("text", F.lit(""))).alias("tag"), "text")


def repeated_spans(docs: DataFrame, width: int = 13) -> DataFrame:
    """Word spans ``[start, stop)`` to remove, by key and tag of ``keyed``; spans may overlap."""
    if width < RUN:
        raise ValueError(f"a window has {RUN} words at least")
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    sent = keyed(docs).mapInArrow(lambda it: _send(it, width, buckets), _SENT)
    return sent.groupBy("bucket").applyInArrow(lambda t: _meet(t, width), SPANS)


def _apply(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        n_words, n_removed, kept = [], [], []
        rest = batch.column("rest")
        doc = pa.StructArray.from_arrays(
            [batch.column("text") if c == "text" else rest.field(c) for c in columns], columns)
        texts = pc.fill_null(batch.column("text"), "").cast(pa.binary())
        for text, spans in zip(texts.to_pylist(), batch.column("spans").to_pylist()):
            words = text.split()  # bytes are split at ASCII white space
            n_words.append(len(words))
            if spans:
                keep = np.ones(len(words), bool)
                for span in spans:
                    start = span >> 31
                    keep[start:start + (span & ((1 << 31) - 1))] = False
                words = list(compress(words, keep.tolist()))
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words))
        digests = [hashlib.sha256(x).hexdigest() for x in kept]
        yield pa.RecordBatch.from_arrays(
            [doc, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
             pa.array(kept, pa.binary()).cast(pa.string()), pa.array(digests, pa.string())],
            names=["doc", "n_words", "n_removed", "kept", "kept_sha256"])


def remove_repeats(docs: DataFrame, width: int = 13) -> DataFrame:
    """One row per row of ``docs``: doc (a struct of its columns), n_words, n_removed, kept (the words
    left, joined by one space) and kept_sha256."""
    spans = repeated_spans(docs, width).groupBy("key", "tag").agg(
        F.collect_list(F.col("start") * (1 << 31) + F.col("stop") - F.col("start")).alias("spans"))
    # The text goes through the join once, beside the other columns.
    own = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest"), "text",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("key"),
        F.hash(F.coalesce("text", F.lit(""))).alias("tag"))
    joined = own.join(spans, ["key", "tag"], "left").select("rest", "text", "spans")
    schema = T.StructType([T.StructField("doc", docs.schema), T.StructField("n_words", T.LongType()),
                           T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()),
                           T.StructField("kept_sha256", T.StringType())])
    columns = docs.columns
    return joined.mapInArrow(lambda it: _apply(it, columns), schema)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays; one that loses words keeps the rest, joined by spaces."""
    changed = F.col("n_removed") > 0
    new = {"text": F.when(changed, F.col("kept")).otherwise(F.col("doc.text")),
           "n_chars": F.when(changed, F.length("kept").cast("long")).otherwise(F.col("doc.n_chars"))
           if "n_chars" in docs.columns else None}
    return remove_repeats(docs).select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
