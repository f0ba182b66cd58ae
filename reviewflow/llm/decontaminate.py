"""Benchmark decontamination: SimHash of item-sized windows, multi-index lookup, exact check.

Every benchmark item and every window of its size in a document is a bag of five-word shingles with a
64-bit SimHash: bit j tells whether more than half of the shingles' hashes have bit j. Window sizes
grow by a tenth, so an item is compared with windows within about a twentieth of its size; windows
begin a twelfth of their size apart, from a document's first shingle on, and one more ends at its last.
A fingerprint is cut in four blocks of 16 bits. Two fingerprints that differ in at most 15 bits differ
in at most three bits of some block, so looking up each block among all values within three bits of
the items' blocks finds every fingerprint in the radius. For each hit, the windows of the item's own
size around it are compared with the item by the weighted Jaccard similarity of their shingles, the
weight being how often each occurs. Measured on planted
passages: all exact copies are in the radius, and 99 % of edited ones of similarity 0.8 to 0.9.

The benchmark is worked off in blocks of items of a bounded size, each sent to all executors; a block
is one pass over the documents, which are not shuffled.

Defined results: a null text has no words and no leak; items without words match nothing; an item of
fewer than five words has one shingle; a document shorter than an item is one window; items of over
``LONGEST`` words are searched piece by piece, and the best windows of all pieces together are compared with
the whole item; null ids stay null; repeated ids, items and documents give a row each, into however many
blocks the items are cut; an empty table on either side gives no leak.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewflow.llm.words import U, hashes_of, shingles, slices, split_words

WIDTH = 5
SIMILARITY = 0.8
RADIUS = 15
#: Words of an item searched as a whole; counts of a window's bits must fit a byte.
LONGEST = 200
#: Bytes of items sent to the executors at once, and items at once.
BLOCK_BYTES, BLOCK_ITEMS = 1 << 20, 2000
#: Windows looked up at once.
AT_ONCE = 1 << 14
_LOW = U(0x0101010101010101)
_HIGH = U(0x8080808080808080)
LEAKS = "doc_id long, item_id long, similarity double, start long, n_words long, distance int"


class SizeClass(NamedTuple):
    """Items looked up by windows of one size (in shingles), of one shingle width."""

    width: int
    size: int
    step: int
    prints: np.ndarray
    items: np.ndarray
    has: np.ndarray
    heads: np.ndarray
    members: np.ndarray


class Index(NamedTuple):
    ids: list
    owner: list[int]  # the item that a piece is of
    whole: Counter  # shingles of an item, all its pieces together
    pieces: Counter  # pieces of an item
    bags: list[Counter]
    classes: list[SizeClass]


def lanes(hashes: np.ndarray) -> list[np.ndarray]:
    """The 64 bits of each hash as bytes of eight numbers, summed up from the first hash on."""
    out = []
    for j in range(8):
        sums = np.zeros(len(hashes) + 1, U)
        np.cumsum((hashes >> U(j)) & _LOW, out=sums[1:])
        out.append(sums)
    return out


def prints_of(sums: list[np.ndarray], first, last, size: int | np.ndarray) -> np.ndarray:
    """SimHash of the shingles from ``first`` to before ``last`` (two indexes or two slices); sums wrap
    around, their differences do not."""
    bias = (U(127) - np.asarray(size, U) // U(2)) * _LOW
    out = None
    for s in sums:
        bit = s[last] - s[first]
        bit += bias
        bit &= _HIGH
        if out is None:
            out = bit
        else:
            out >>= U(1)
            out |= bit
    return out


def _near_keys() -> np.ndarray:
    masks = [0]
    for n in range(1, RADIUS // 4 + 1):
        masks += [sum(1 << b for b in bits) for bits in combinations(range(16), n)]
    return np.array(masks, np.uint16)


def _pieces(words: list[bytes]) -> list[list[bytes]]:
    n = -(-len(words) // LONGEST)
    return [words[len(words) * i // n:len(words) * (i + 1) // n] for i in range(n)]


def nearest_size(n: int) -> int:
    """The window size nearest to ``n``; sizes grow by a tenth."""
    below = size = 1
    while size < n:
        below, size = size, max(size + 1, size * 11 // 10)
    return below if n - below < size - n else size


def index(ids: list, texts: list[str | None]) -> Index:
    """Fingerprints of a block of items in tables by block value."""
    owner, parts = [], []
    for item, text in enumerate(texts):
        for part in _pieces((text or "").encode().split()):
            owner.append(item)
            parts.append(part)
    groups: dict[tuple[int, int], list[int]] = {}
    hashed = []
    for i, part in enumerate(parts):
        width = min(WIDTH, len(part))
        words = split_words(pa.array([b" ".join(part).decode()]))
        hashed.append(shingles(words, hashes_of(words), width)[0])
        groups.setdefault((width, nearest_size(len(hashed[-1]))), []).append(i)
    masks, classes = _near_keys(), []
    for (width, size), items in sorted(groups.items()):
        prints = np.array([prints_of(lanes(hashed[i]), np.array([0]), np.array([len(hashed[i])]),
                                     len(hashed[i]))[0] for i in items], U)
        keys = prints[:, None] >> (U(16) * np.arange(4, dtype=U))[None, :] & U(0xFFFF)
        near = (keys.astype(np.uint16)[:, :, None] ^ masks) + (np.arange(4) << 16)[None, :, None]
        flat = near.reshape(-1)
        of = np.repeat(np.arange(len(items)), 4 * len(masks))
        order = np.argsort(flat, kind="stable")
        heads = np.searchsorted(flat[order], np.arange((4 << 16) + 1)).astype(np.int32)
        classes.append(SizeClass(width, size, max(1, size // 12), prints, np.array(items),
                                 (np.diff(heads) > 0).reshape(4, 1 << 16), heads,
                                 of[order].astype(np.int32)))
    whole: Counter = Counter()
    for item, h in zip(owner, hashed):
        whole[item] += len(h)
    return Index(ids, owner, whole, Counter(owner), [Counter(h.tolist()) for h in hashed], classes)


def _lookup(c: SizeClass, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window, item and distance of the fingerprints within the radius of an item."""
    window, item = [], []
    blocks = np.ascontiguousarray(prints).view(np.uint16).reshape(-1, 4).T
    for j, key in enumerate(blocks):
        some = np.flatnonzero(c.has[j].take(key))
        at = key[some].astype(np.int64) + (j << 16)
        head = c.heads[at]
        count = c.heads[at + 1] - head
        of = np.repeat(some, count)
        window.append(of)
        item.append(c.members[np.repeat(head - (np.cumsum(count) - count), count) + np.arange(len(of))])
    window, item = np.concatenate(window), np.concatenate(item)
    distance = np.bitwise_count(prints[window] ^ c.prints[item])
    near = distance <= RADIUS
    return window[near], item[near], distance[near]


def _windows(c: SizeClass, starts: np.ndarray) -> Iterator[np.ndarray]:
    """First shingles of the windows to look at, some at once: a grid that begins at the first shingle of
    each text, and a window that ends at its last. With step 1 that is every shingle, and some windows
    lie over a border of texts."""
    if c.step == 1:
        last = int(starts[-1]) - c.size + 1
        yield from (np.arange(a, min(a + AT_ONCE, last)) for a in range(0, last, AT_ONCE))
        return
    room = np.diff(starts) - c.size
    count = np.where(room >= 0, -(-room // c.step) + 1, 0)
    row = np.repeat(np.arange(len(room)), count)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    first = starts[row] + np.minimum(place * c.step, room[row])
    yield from (first[a:a + AT_ONCE] for a in range(0, len(first), AT_ONCE))


def _hits(c: SizeClass, sums: list[np.ndarray], starts: np.ndarray) -> Iterator[tuple]:
    """Row, first shingle, item and distance of the windows within the radius of an item."""
    n = np.diff(starts)
    for first in _windows(c, starts):
        # Neighbouring windows are read as slices, windows further apart by their indexes.
        at = slice(int(first[0]), int(first[-1]) + 1) if c.step == 1 else first
        to = slice(at.start + c.size, at.stop + c.size) if c.step == 1 else first + c.size
        window, item, distance = _lookup(c, prints_of(sums, at, to, c.size))
        first = first[window]
        row = np.searchsorted(starts, first, "right") - 1
        whole = first + c.size <= starts[row + 1]
        if whole.any():
            yield row[whole], (first - starts[row])[whole], item[whole], distance[whole]
    # A text shorter than the window is one window, if it is long enough to be like an item of the class.
    short = np.flatnonzero((n < c.size) & (n * 2 > c.size))
    if len(short):
        window, item, distance = _lookup(
            c, prints_of(sums, starts[short], starts[short + 1], n[short]))
        if len(window):
            yield short[window], np.zeros(len(window), np.int64), item, distance


def search(texts: pa.Array, idx: Index, least: float) -> list[tuple]:
    """Row, item, similarity, first word, words and distance: the best window of each item in each text."""
    words = split_words(texts)
    own = hashes_of(words)
    best: dict[tuple, tuple] = {}
    for width in sorted({c.width for c in idx.classes}):
        hashed, starts = shingles(words, own, width)
        sums = lanes(hashed)
        for c in (c for c in idx.classes if c.width == width):
            for row, at, item, distance in _hits(c, sums, starts):
                # One look per item and neighbourhood of hits.
                order = np.lexsort((at, item, row))
                row, at, item, distance = row[order], at[order], item[order], distance[order]
                near = np.r_[False, (row[1:] == row[:-1]) & (item[1:] == item[:-1])
                             & (at[1:] - at[:-1] <= c.step)]
                heads = np.flatnonzero(~near)
                for h, t in zip(heads.tolist(), np.r_[heads[1:], len(row)].tolist()):
                    r, i = int(row[h]), int(c.items[item[h]])
                    bag = idx.bags[i]
                    found = _best(hashed[starts[r]:starts[r + 1]], bag, int(at[h]), int(at[t - 1]),
                                  c.size, c.step)
                    alone = idx.pieces[idx.owner[i]] == 1
                    if found[0] >= (least if alone else 0) and found[0] > best.get((r, i), (0.0,))[0]:
                        best[r, i] = *found, width, int(distance[h:t].min())
    out, parts = [], {}
    for (r, i), (s, start, n, common, width, d) in best.items():
        if idx.pieces[idx.owner[i]] == 1:
            out.append((r, idx.ids[idx.owner[i]], s, start, n + width - 1, d))
        else:
            parts.setdefault((r, idx.owner[i]), []).append((start, start + n + width - 1, n, common, d))
    for (r, item), found in parts.items():
        start, end, n, common, d = zip(*found)
        s = sum(common) / (idx.whole[item] + sum(n) - sum(common))
        if s >= least:
            out.append((r, idx.ids[item], s, min(start), max(end) - min(start), min(d)))
    return out


def _best(text: np.ndarray, bag: Counter, first: int, last: int, size: int, step: int) -> tuple:
    """Weighted Jaccard similarity, first shingle, shingles and common ones of the best window near some hits."""
    n = min(sum(bag.values()), len(text))
    slack = abs(n - size) + step
    a, b = max(0, first - slack), max(0, min(last + slack, len(text) - n))
    a = min(a, b)
    span = text[a:b + n].tolist()
    if sum(x in bag for x in span) * 2 < n:
        return 0.0, 0, n, 0
    window = Counter(span[:n])
    common = sum(min(w, bag[x]) for x, w in window.items() if x in bag)
    total = sum(bag.values()) + n
    best, at = common, a
    for k in range(b - a):
        out, new = span[k], span[k + n]
        common -= window[out] <= bag[out] if out in bag else 0
        window[out] -= 1
        window[new] += 1
        common += window[new] <= bag[new] if new in bag else 0
        if common > best:
            best, at = common, a + k + 1
    return best / (total - best), at, n, best


def blocks(benchmark: DataFrame) -> Iterator[Index]:
    """The benchmark in blocks of a bounded number of items and bytes."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    size, n = items.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    # Half of a block on average leaves room for chance.
    parts = max(1, -(-2 * (size or 0) // BLOCK_BYTES), -(-2 * n // BLOCK_ITEMS))
    if parts == 1:
        rows = items.collect()
        if rows:
            yield index([r[0] for r in rows], [r[1] for r in rows])
        return
    dealt = items.withColumn("part", F.expr(f"pmod(xxhash64(item_id, text), {parts})"))
    for part in range(parts):
        rows = dealt.where(F.col("part") == part).collect()
        if rows:
            yield index([r[0] for r in rows], [r[1] for r in rows])


def _found(batches: Iterator[pa.RecordBatch], idx, least: float) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = search(batch.column("text"), idx.value, least)
        columns = list(zip(*rows)) if rows else [()] * 6
        kinds = [pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int32()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(columns[0], pa.int64()))]
            + [pa.array(c, k) for c, k in zip(columns[1:], kinds)],
            names=["doc_id", "item_id", "similarity", "start", "n_words", "distance"])


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The best window of each item that leaks into a document: doc_id, item_id, similarity, first
    word, number of words, Hamming distance of the fingerprints."""
    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for idx in blocks(benchmark):
        sent = spark.sparkContext.broadcast(idx)
        part = narrow.mapInArrow(partial(_found, idx=sent, least=least), LEAKS)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], LEAKS) if out is None else out


def _clean(batches: Iterator[pa.RecordBatch], idx, least: float) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        gone = {r[0] for r in search(batch.column("text"), idx.value, least)}
        yield batch.filter(pa.array([i not in gone for i in range(batch.num_rows)], pa.bool_()))


def without_leaks(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The documents into which no item leaks, with all their columns."""
    for idx in blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(idx)
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema.fields])
        docs = docs.mapInArrow(partial(_clean, idx=sent, least=least), schema)
    return docs


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with a leak of a benchmark item go."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))
