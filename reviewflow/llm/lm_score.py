"""Language-model scores from a log-frequency Bloom filter.

Counts of words, and in a second pass of word pairs, of the learning documents are gathered in buckets by
hash; each slice of the input sends a bucket every n-gram once with its count. A bucket writes its counts,
quantised by logarithm, into its own segment of the filter: an n-gram of level q is entered as (n-gram, 1)
to (n-gram, q), so probing levels until one is missing gives the count back, never too low. The
probability of a word after another is read from such probes only:

    p(w | v) = (1 - l(v)) c(v, w) / c(v) + l(v) p(w),   p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1))

where l depends on the level of c(v) and is the share of pairs seen once among the learning tokens after
words of that level; the buckets count both over all their pairs, which come with that level. The filter
of words is broadcast in parts of at most ``WORD_BYTES``, which a worker goes through one at a time; the
filter of pairs in parts of at most ``PART_BYTES``, each being one pass that scores the pairs that lie in it.

The base score uses exact counts: those of the ``HEAD`` most frequent words are broadcast, the words
beyond are joined by hash, and since they are rare no key of that join is hot.

Defined results: a null text is empty and has the end token only; null ids count as the text "" in the
fold and stay null; repeated rows are scored one by one; without learning documents all words are
unknown; an empty table gives none. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewflow.llm.words import U, hashes_of, mixed, slices, split_words
from reviewflow.session import scratch_dir

#: A level is this many times as frequent as the one below.
BASE = 1.5
LEVELS = 64
BITS, PROBES = 8, 5
#: Bytes of text for which one more bucket is made; n-grams held by a task before it sends them.
BUCKET_BYTES, HELD = 4 << 20, 1_000_000
WORD_BYTES, PART_BYTES = 64 << 20, 80 << 20
HEAD = 1 << 20
#: Stands for the end of a text, and for the place before its first word.
END = U(1)
_WORDS = "bucket int, token long, n long, filter binary"
_PAIRS = "bucket int, filter binary, q array<int>, n array<long>, once array<long>"
_SCORED = ("row long, doc_id long, token long, n_tokens long, n_known long, base double, score double")
_EDGES = np.ceil(BASE ** np.arange(LEVELS) - 1e-9)


def levels_of(counts: np.ndarray) -> np.ndarray:
    """Level of each count; level q begins at 1.5 to the power of q - 1."""
    return np.searchsorted(_EDGES, counts, "right")


def counts_of(levels: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level; level 0 is count 0."""
    low, high = _EDGES, np.r_[_EDGES[1:], _EDGES[-1] * BASE]
    return np.r_[0, np.maximum((low + np.maximum(high - 1, low)) / 2, low)][levels]


def _bits(keys: np.ndarray, level: np.ndarray | int, size: np.ndarray, i: int) -> np.ndarray:
    h = mixed(keys + np.asarray(level, U) * U(0x9E3779B97F4A7C15))
    step = mixed(h) | U(1)
    return (h + U(i) * step) % size


def segment(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """The filter segment of some n-grams."""
    levels = levels_of(counts)
    size = max(64, int(levels.sum()) * BITS // 64 * 64)
    field = np.zeros(size, bool)
    for q in range(1, int(levels.max(initial=0)) + 1):
        some = keys[levels >= q]
        for i in range(PROBES):
            field[_bits(some, q, U(size), i).astype(np.int64)] = True
    return np.packbits(field, bitorder="little").tobytes()


class Filter(NamedTuple):
    """Segments of buckets ``first`` to ``first + len(size)`` of ``buckets``."""

    buckets: int
    first: int
    start: np.ndarray  # bits before each segment
    size: np.ndarray  # bits of each segment
    field: np.ndarray

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Which keys belong to a bucket of this part."""
        bucket = (keys % U(self.buckets)).astype(np.int64) - self.first
        return (bucket >= 0) & (bucket < len(self.size))

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Level of each key, by probing until a level is missing."""
        out = np.zeros(len(keys), np.int64)
        bucket = (keys % U(self.buckets)).astype(np.int64) - self.first
        live = np.arange(len(keys))
        for q in range(1, LEVELS + 1):
            for i in range(PROBES):
                at = _bits(keys[live], q, self.size[bucket[live]], i).astype(np.int64) \
                    + self.start[bucket[live]]
                live = live[(self.field[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
            if not len(live):
                break
            out[live] = q
        return out


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all texts, each text closed by the end token, the key of each token with the one
    before, and where each text begins."""
    words = split_words(texts, lower=True)
    # Hashes 0 and 1 are kept for the end.
    tokens = np.insert(np.maximum(hashes_of(words), U(2)), words.starts[1:], END)
    starts = words.starts + np.arange(len(words.starts))
    before = np.r_[END, tokens[:-1]]
    before[starts[:-1]] = END
    return tokens, mixed(mixed(before) + tokens), starts


def _levels(tokens: np.ndarray, words: list[Broadcast]) -> np.ndarray:
    """Level of each token, from all parts of the filter of words."""
    out = np.zeros(len(tokens), np.int64)
    for sent in words:
        part = sent.value
        here = np.flatnonzero(part.holds(tokens))
        out[here] = part.levels(tokens[here])
        if len(words) > 1:
            # Read again from the worker's disk when needed, so that it holds one part at a time.
            del part
            vars(sent).pop("_value", None)
    return out


def _before(codes: np.ndarray, distinct: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Code of the token before each, the end token before the first."""
    before = np.r_[0, codes[:-1]]
    before[starts[:-1]] = np.flatnonzero(distinct == END)[0] if len(distinct) else 0
    return before


def _summed(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, their counts, and the level that comes with each."""
    keys, counts, levels = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys)
    keys, counts, levels = keys[order], counts[order], levels[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first), levels[first]


def _send(batches: Iterator[pa.RecordBatch], buckets: int, words=None) -> Iterator[pa.RecordBatch]:
    """Counts of words by bucket; with the filter of words, counts of pairs and the level of the word before."""
    squeeze = zstandard.ZstdCompressor(level=1)

    def flush(parts):
        keys, counts, levels = _summed(parts)
        bucket = (keys % U(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        cuts = np.r_[0, np.flatnonzero(np.diff(bucket[order])) + 1, len(order)]
        data = [np.int64(j - i).tobytes() + keys[order[i:j]].tobytes()
                + squeeze.compress(counts[order[i:j]].astype(np.int64).tobytes() + levels[order[i:j]].tobytes())
                for i, j in zip(cuts, cuts[1:])]
        for i in range(0, len(data), 64):
            part = data[i:i + 64]
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array(bucket[order][cuts[:-1]][i:i + 64]),
                "data": pa.array(part, pa.binary())})

    held, n = [], 0
    for batch in slices(batches):
        tokens, keys, starts = grams(batch.column("text"))
        levels = np.zeros(len(tokens), np.uint8)
        if words is not None:
            codes, distinct = pd.factorize(tokens)
            levels = _levels(distinct, words).astype(np.uint8)[_before(codes, distinct, starts)]
        held.append(_summed([(tokens if words is None else keys, np.ones(len(keys), np.int64), levels)]))
        n += len(held[-1][0])
        if n > HELD:
            yield from flush(held)
            held, n = [], 0
    if held:
        yield from flush(held)


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a bucket, their counts and levels."""
    squeeze, parts = zstandard.ZstdDecompressor(), []
    for data in table.column("data").to_pylist():
        n = int(np.frombuffer(data, np.int64, 1)[0])
        rest = squeeze.decompress(data[8 + 8 * n:])
        parts.append((np.frombuffer(data, U, n, 8), np.frombuffer(rest, np.int64, n),
                      np.frombuffer(rest, np.uint8, n, 8 * n)))
    return _summed(parts)


def _merge_words(table: pa.Table) -> pa.Table:
    """Counts of the words of a bucket, the first row with their filter segment."""
    keys, counts, _ = _merged(table)
    rest = [None] * (len(keys) - 1)
    return pa.Table.from_pydict({
        "bucket": pa.array(np.full(len(keys), table.column("bucket")[0].as_py(), np.int32)),
        "token": pa.array(keys.view(np.int64)), "n": pa.array(counts),
        "filter": pa.array([segment(keys, counts), *rest], pa.binary())})


def _merge_pairs(table: pa.Table) -> pa.Table:
    """The filter segment of the pairs of a bucket and, by level of the word before, how many learning
    tokens are in its pairs and how many in pairs seen once."""
    keys, counts, levels = _merged(table)
    n = np.bincount(levels, counts, LEVELS + 1).astype(np.int64)
    once = np.bincount(levels[counts == 1], minlength=LEVELS + 1)
    some = np.flatnonzero(n)
    return pa.Table.from_pydict({
        "bucket": table.column("bucket").slice(0, 1), "filter": pa.array([segment(keys, counts)], pa.binary()),
        "q": pa.array([some.astype(np.int32)]), "n": pa.array([n[some]]), "once": pa.array([once[some]])})


def _parts(sizes: dict[int, int], buckets: int, most: int) -> list[tuple[int, int]]:
    """Ranges that cover all buckets, of at most ``most`` bytes together or of one bucket."""
    out, first, total = [], 0, 0
    for bucket in range(buckets):
        if total and total + sizes.get(bucket, 0) > most:
            out.append((first, bucket))
            first, total = bucket, 0
        total += sizes.get(bucket, 0)
    return [*out, (first, buckets)]


def _filter(rows: DataFrame, buckets: int, first: int, last: int) -> Filter:
    """Bring one part of the filter, of a bounded size, together."""
    found = {r[0]: r[1] for r in rows.where(F.col("bucket").between(first, last - 1))
             .select("bucket", "filter").collect()}
    data = [bytes(found.get(b) or bytes(8)) for b in range(first, last)]
    size = np.array([8 * len(d) for d in data], U)
    start = np.r_[0, np.cumsum([8 * len(d) for d in data])[:-1]].astype(np.int64)
    return Filter(buckets, first, start, size, np.frombuffer(b"".join(data), np.uint8))


class Model(NamedTuple):
    counts: DataFrame  # token, n
    head: tuple[np.ndarray, np.ndarray]
    least: int  # count from which on words are in the head
    tokens: int
    vocabulary: int
    buckets: int
    words: list[Broadcast]  # parts of the filter
    pairs: DataFrame  # bucket, filter
    parts: list[tuple[int, int]]
    backoff: np.ndarray  # l by level


def gather(train: DataFrame) -> Model:
    """Count words and pairs of the column text of ``train``."""
    spark, folder = train.sparkSession, scratch_dir(train.sparkSession, "lm")
    size = train.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))

    def gathered(name: str, words, merge, schema: str) -> DataFrame:
        train.select("text").mapInArrow(partial(_send, buckets=buckets, words=words), "bucket int, data binary") \
             .groupBy("bucket").applyInArrow(merge, schema).write.parquet(f"{folder}/{name}")
        return spark.read.schema(schema).parquet(f"{folder}/{name}")

    def parts(filters: DataFrame, most: int) -> list[tuple[int, int]]:
        sizes = {r[0]: r[1] for r in filters.select("bucket", F.octet_length("filter")).collect()}
        return _parts(sizes, buckets, most)

    rows = gathered("words", None, _merge_words, _WORDS)
    counts, filters = rows.select("token", "n"), rows.where("filter is not null").select("bucket", "filter")
    edges = F.array(*[F.lit(float(e)) for e in _EDGES])
    by_level = counts.groupBy(F.size(F.filter(edges, lambda e: e <= F.col("n"))).alias("q")) \
                     .agg(F.count("*").alias("words"), F.sum("n").alias("n")).orderBy(F.desc("q")).collect()
    in_head, least = 0, 1 << 62
    for r in by_level:
        in_head += r["words"]
        if in_head > HEAD:
            break
        least = int(_EDGES[r["q"] - 1])
    head = counts.where(F.col("n") >= least).select("token", "n").toArrow()
    tokens, n = head["token"].to_numpy().view(U), head["n"].to_numpy()
    order = np.argsort(tokens)
    words = [spark.sparkContext.broadcast(_filter(filters, buckets, a, b)) for a, b in parts(filters, WORD_BYTES)]
    pairs = gathered("pairs", words, _merge_pairs, _PAIRS)
    backoff = np.ones(LEVELS + 1)
    for r in pairs.select(F.explode(F.arrays_zip("q", "n", "once")).alias("x")).groupBy("x.q") \
            .agg(F.sum("x.n").alias("n"), F.sum("x.once").alias("once")).collect():
        backoff[r["q"]] = (r["once"] + 0.5) / (r["n"] + 1)
    pairs = pairs.select("bucket", "filter")
    return Model(counts, (tokens[order], n[order]), least, sum(r["n"] for r in by_level),
                 sum(r["words"] for r in by_level), buckets, words, pairs,
                 parts(pairs, PART_BYTES), backoff)


def _probed(texts: pa.Array, words: list[Broadcast], pairs: Filter) -> tuple:
    """Starts of the texts, token code of each place, distinct tokens, level of each distinct token,
    which places have their pair in this part, and the pairs' levels there."""
    tokens, keys, starts = grams(texts)
    codes, distinct = pd.factorize(tokens)
    levels = _levels(distinct, words)
    here = np.flatnonzero(pairs.holds(keys))
    some, each = pd.factorize(keys[here])[::-1]
    return starts, codes, distinct, levels, here, pairs.levels(some)[each]


def _scored(batches: Iterator[pa.RecordBatch], words, pairs, shared, first: bool) -> Iterator[pa.RecordBatch]:
    """Scores of a part; on the first part also the base score and the words beyond the head."""
    head, n, total, vocabulary, backoff = shared.value
    whole = total + 0.1 * (vocabulary + 1)
    for batch in slices(batches):
        starts, codes, distinct, levels, here, found = _probed(
            batch.column("text"), words, pairs.value)
        rows = len(starts) - 1
        row = np.repeat(np.arange(rows), np.diff(starts))
        alone = (counts_of(levels) + 0.1) / whole
        context = levels[_before(codes, distinct, starts)[here]]
        after = counts_of(found) / np.maximum(counts_of(context), 1)
        p = (1 - backoff[context]) * np.minimum(after, 1) + backoff[context] * alone[codes[here]]
        out = {"row": batch.column("row").to_numpy(), "doc_id": batch.column("doc_id"),
               "token": pa.nulls(rows, pa.int64()), "n_tokens": np.diff(starts),
               "n_known": np.zeros(rows, np.int64), "base": np.zeros(rows),
               "score": np.bincount(row[here], np.log10(p), rows)}
        if first:
            at = np.minimum(np.searchsorted(head, distinct), max(0, len(head) - 1))
            known = head[at] == distinct if len(head) else np.zeros(len(distinct), bool)
            term = np.where(known, np.log10((n[at] if len(n) else 0) + 0.1) - np.log10(whole), 0.0)
            out["n_known"] = np.bincount(row, known[codes], rows).astype(np.int64)
            out["base"] = np.bincount(row, term[codes], rows)
        names = list(out)
        yield pa.RecordBatch.from_pydict({c: pa.array(out[c]) if isinstance(out[c], np.ndarray) else out[c]
                                          for c in names})
        if first:
            rare = np.flatnonzero(~known[codes])
            key = np.sort(row[rare] * len(distinct) + codes[rare])
            new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else key
            tf = np.diff(np.r_[new, len(key)])
            key = key[new]
            k, of = len(key), key // max(1, len(distinct))
            yield pa.RecordBatch.from_pydict({
                "row": pa.array(batch.column("row").to_numpy()[of]), "doc_id": pa.nulls(k, pa.int64()),
                "token": pa.array(distinct[key % max(1, len(distinct))].view(np.int64)),
                "n_tokens": pa.array(tf.astype(np.int64)), "n_known": pa.nulls(k, pa.int64()),
                "base": pa.nulls(k, pa.float64()), "score": pa.nulls(k, pa.float64())})


def score(docs: DataFrame, train: DataFrame) -> DataFrame:
    """Score every row of ``docs`` with a model of ``train``: doc_id, n_tokens, n_known, train_tokens,
    base_score, score (both log10 of the text's probability)."""
    spark = docs.sparkSession
    send, folder = spark.sparkContext.broadcast, scratch_dir(spark, "lm-scores")
    m = gather(train)
    shared = send((*m.head, m.tokens, m.vocabulary, m.backoff))
    rows = docs.select(F.monotonically_increasing_id().alias("row"),
                       F.col("doc_id").cast("long").alias("doc_id"), "text")
    for i, (a, b) in enumerate(m.parts):
        pairs = send(_filter(m.pairs, m.buckets, a, b))
        rows.mapInArrow(partial(_scored, words=m.words, pairs=pairs, shared=shared, first=i == 0), _SCORED) \
            .write.parquet(f"{folder}/{i}")
        pairs.unpersist()
    found = spark.read.schema(_SCORED).parquet(*[f"{folder}/{i}" for i in range(len(m.parts))])
    rest = m.counts.where(F.col("n") < m.least).select("token", "n")
    whole = float(m.tokens + 0.1 * (m.vocabulary + 1))
    rare = found.where("token is not null").join(rest, "token", "left").select(
        "row", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_tokens"),
        F.when(F.col("n").isNotNull(), F.col("n_tokens")).otherwise(0).alias("n_known"),
        (F.col("n_tokens") * (F.log10(F.coalesce("n", F.lit(0)) + 0.1) - F.log10(F.lit(whole)))).alias("base"),
        F.lit(0.0).alias("score"))
    whole_rows = found.where("token is null").select("row", "doc_id", "n_tokens", "n_known", "base", "score")
    return whole_rows.union(rare).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"),
        F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score")) \
        .select("doc_id", "n_tokens", "n_known", F.lit(m.tokens).cast("long").alias("train_tokens"),
                "base_score", "score")


def fold(column: str = "doc_id"):
    """The remainder that tells held-out rows (0) from learning rows."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % 10
