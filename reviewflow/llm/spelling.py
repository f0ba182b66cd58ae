"""Spelling variants: words one edit apart, found in bit-sliced position indexes.

Two words are near if one inserted, deleted or replaced code point makes them equal. A task holds the
words of a block as bitsets, one for each letter at each place, a bit a word. A query word goes through
its letters once and carries four bitsets along: the words equal so far, and those with one replaced
letter, one letter more and one letter less so far, the last two compared at shifted places. Every
step treats 64 words at a time.

Near words meet without comparing all with all: of a pair whose shorter word has ``m`` letters, the
number of equal first letters lies in some range ``[a, b)``; both words then have the same first ``a``
letters and the same last ``m - b``. Words are placed by ``m``, the range and those letters. A place with
more than ``PLACE_WORDS`` words is cut into the two halves of its range, and again, until it is small or its
range is one number: then its words differ in one or two given letters. A pair is found at one place only,
so counts need no pairs to travel; a place returns its near count and best near word for each word.

Defined results: a null text has no words; null ids count as empty; equal words in the given counts are
added up; a word is never near itself; an empty table gives none. Words may be of any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewflow.session import scratch_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RUN = r"[A-Za-zÀ-ÿ]+"
#: Words of one place that are compared at once.
PLACE_WORDS = 4096
#: Words, and letters, after which a block of places is closed.
BLOCK_WORDS, BLOCK_LETTERS = 1024, 1 << 18
#: Query words that go through a block together.
QUERIES = 512
_PLACE = ["m", "a", "b", "key"]
_FOUND = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def runs(docs: DataFrame) -> DataFrame:
    """Each run of letters of each text, small from A to Z only: doc_id, run."""
    small = F.translate("text", UPPER, UPPER.lower())
    return docs.select("doc_id", F.explode(F.regexp_extract_all(small, F.lit(RUN), F.lit(0))).alias("run"))


def without_letter(run: Column, at: Column) -> Column:
    """The run without its code point ``at``, counted from 0."""
    at = at.cast("int")
    return F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.length(run)))


def counted(words: DataFrame, letters: int = 5, least: int = 3) -> DataFrame:
    """word, n: how often each word of at least ``letters`` letters occurs, if ``least`` times or more."""
    return words.where(F.length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")) \
        .where(F.col("n") >= least)


def _keyed(places: DataFrame) -> DataFrame:
    first, last = F.col("a"), F.greatest(F.col("m") - F.col("b"), F.lit(0))
    return places.withColumn("key", F.xxhash64(
        "m", F.col("word").substr(F.lit(1), first), F.right("word", last)))


def _halves(places: DataFrame) -> DataFrame:
    """Each place with its range cut in two."""
    middle = F.expr("(a + b) div 2").cast("int")
    half = F.explode(F.array(F.struct(F.col("a"), middle.alias("b")),
                             F.struct(middle.alias("a"), F.col("b")))).alias("half")
    cut = places.select("word", "n", "m", half).select("word", "n", "m", "half.a", "half.b")
    return _keyed(cut.where("a < b"))


def placed(words: DataFrame, most: int = PLACE_WORDS) -> DataFrame:
    """The places of all words: word, n, m, a, b, key; words that can be near share one of them.

    A word of ``L`` letters is placed for pairs whose shorter word has ``L`` or ``L - 1``.
    """
    spark = words.sparkSession
    folder = scratch_dir(spark, "spelling")
    length = F.length("word")
    places = words.select("word", "n", F.explode(F.array(length - 1, length)).alias("m")).select(
        "word", "n", "m", F.lit(0).alias("a"), (F.col("m") + 1).alias("b"))
    places, small = _halves(places), []
    while True:
        at = f"{folder}/{len(small)}"
        places.groupBy(*_PLACE).count().where((F.col("count") > most) & (F.col("b") - F.col("a") > 1)) \
            .select(*_PLACE).write.parquet(at)
        large = spark.read.parquet(at)
        if large.isEmpty():
            return reduce(DataFrame.unionByName, small, places)
        small.append(places.join(large, _PLACE, "left_anti").select("word", "n", *_PLACE))
        places = _halves(places.join(large, _PLACE, "left_semi"))


def _bits(rows: np.ndarray, members: np.ndarray, n_rows: int, width: int) -> np.ndarray:
    """Bitsets: row ``rows[i]`` holds member ``members[i]``; ``width`` blocks of 64 members."""
    out = np.zeros((n_rows, width), np.uint64)
    np.bitwise_or.at(out, (rows, members >> 6), np.uint64(1) << (members & 63).astype(np.uint64))
    return out


def _members(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and member of every set bit."""
    row, block = np.nonzero(bits)
    one = np.unpackbits(bits[row, block].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    which, bit = np.nonzero(one)
    return row[which], block[which] * 64 + bit


class Index:
    """Words of a block as bitsets by letter and place, by length and by group."""

    def __init__(self, words: list[str], group: np.ndarray):
        self.length = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        _, letter = np.unique(points, return_inverse=True)
        kinds = int(letter.max(initial=-1)) + 1
        member = np.repeat(np.arange(len(words)), self.length)
        at = np.arange(len(points)) - np.repeat(np.cumsum(self.length) - self.length, self.length)
        longest = int(self.length.max(initial=0))
        self.width = -(-len(words) // 64)
        # Slot 0 is the empty set, of letters that no word has at a place; a place more on either side.
        used, slot = np.unique(at * max(kinds, 1) + letter, return_inverse=True)
        self.slot = np.zeros((longest + 2, max(kinds, 1)), np.int64)
        self.slot[1 + used // max(kinds, 1), used % max(kinds, 1)] = np.arange(1, len(used) + 1)
        self.sets = _bits(slot + 1, member, len(used) + 1, self.width)
        self.letters = np.zeros((len(words), longest), np.int32)
        self.letters[member, at] = letter
        every = np.arange(len(words))
        self.of_length = _bits(self.length, every, longest + 2, self.width)
        self.group = np.unique(group, return_inverse=True)[1]
        self.of_group = _bits(self.group, every, int(self.group.max(initial=-1)) + 1, self.width)

    def at(self, place: int, letter: np.ndarray) -> np.ndarray:
        """The words that have the letter at the place, one row for each letter."""
        return self.sets[self.slot[place + 1, letter]]

    def near(self, queries: np.ndarray, m: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of near words of one group, of which the shorter has ``m`` letters and the number of equal
        first letters lies in ``[a, b)``. All queries have one length."""
        n = int(self.length[queries[0]])
        equal = self.of_group[self.group[queries]]
        replaced, longer, shorter = (np.zeros_like(equal) for _ in range(3))
        from_a, from_b = equal, np.zeros_like(equal)
        for i in range(n):
            if i == a:
                from_a = equal
            if i == b:
                from_b = equal
            letter = self.letters[queries, i]
            same = self.at(i, letter)
            if n == m:
                longer = (longer | equal) & self.at(i + 1, letter)
                replaced = (replaced & same) | (equal & ~same)
            else:
                shorter = (shorter & self.at(i - 1, letter)) | equal
            equal = equal & same
        if a == n:
            from_a = equal
        if b == n:
            from_b = equal
        if n == m:
            found = (replaced & self.of_length[n]) | ((longer | equal) & self.of_length[n + 1])
        else:
            found = shorter & self.of_length[m]
        row, member = _members(found & from_a & ~from_b)
        return queries[row], member


def _best_near(words: list[str], n: np.ndarray, m: np.ndarray, a: np.ndarray, b: np.ndarray,
               group: np.ndarray) -> pa.RecordBatch | None:
    """For each word of the block with near words: how many, and the one of largest n, then least."""
    index = Index(words, group)
    order = np.lexsort((b, a, m, index.length))
    kind = np.stack([index.length, m, a, b])[:, order]
    cuts = np.r_[0, np.flatnonzero((kind[:, 1:] != kind[:, :-1]).any(axis=0)) + 1, len(order)]
    pairs = []
    for i, j in zip(cuts, cuts[1:]):
        for k in range(i, j, QUERIES):
            pairs.append(index.near(order[k:min(j, k + QUERIES)], *kind[1:, i].tolist()))
    query, near = (np.concatenate(x) for x in zip(*pairs))
    if not len(query):
        return None
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[near], -n[near], query))
    query, near = query[order], near[order]
    first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
    return pa.RecordBatch.from_arrays(
        [pa.array([words[i] for i in query[first]], pa.string()),
         pa.array(np.diff(np.r_[first, len(query)]), pa.int64()), pa.array(n[near[first]], pa.int64()),
         pa.array([words[i] for i in near[first]], pa.string())], schema=_FOUND)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of sorted places; only whole places are looked at, some at a time."""
    for table in _whole(batches):
        cols = [table.column(c).to_numpy() for c in ("n", *_PLACE)]
        new = np.r_[True, reduce(np.logical_or, (c[1:] != c[:-1] for c in cols[1:]))]
        group = np.cumsum(new) - 1
        # A word alone at its place has no near word there.
        keep = np.bincount(group)[group] > 1
        if not keep.any():
            continue
        table, cols, group = table.filter(pa.array(keep)), [c[keep] for c in cols], group[keep]
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        letters = np.cumsum(pc.utf8_length(table.column("word")).to_numpy())
        begin = 0
        for end in [*starts[1:].tolist(), len(group)]:
            grown = letters[end - 1] - (letters[begin - 1] if begin else 0)
            if end - begin >= BLOCK_WORDS or grown >= BLOCK_LETTERS or end == len(group):
                words = table.column("word").slice(begin, end - begin).to_pylist()
                found = _best_near(words, *[c[begin:end] for c in cols[:4]], group[begin:end])
                if found is not None:
                    yield found
                begin = end


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in tables that end where a place ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = [batch.column(c).to_numpy() for c in _PLACE]
        new = np.flatnonzero(reduce(np.logical_or, (c[1:] != c[:-1] for c in ids)))
        if held and [c[0] for c in ids] != [held[-1].column(c)[-1].as_py() for c in _PLACE]:
            yield pa.Table.from_batches(held)
            held = []
        if len(new):
            end = int(new[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, end)])
            held = [batch.slice(end)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def links(words: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n: the near word of largest n, where that n is at least twice the word's."""
    places = placed(words).repartition(*_PLACE).sortWithinPartitions(*_PLACE)
    found = places.select("word", "n", *_PLACE).mapInArrow(_found, "word string, near long, best_n long, best string")
    own = words.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast("long").alias("best_n"),
                       F.lit(None).cast("string").alias("best"))
    best = F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("minus"), "best"))
    joined = own.unionByName(found.withColumn("n", F.lit(None).cast("long"))).groupBy("word").agg(
        F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min(best).alias("best"))
    form_n = -F.col("best.minus")
    leads = form_n >= 2 * F.col("n")
    return joined.select("word", "n", "n_near", F.when(leads, F.col("best.best")).alias("form"),
                         F.when(leads, form_n).alias("form_n"))


def variants(words: DataFrame) -> DataFrame:
    """``links`` with ``root``, the last word that forms lead to, of a table of words and their counts n.

    Every round doubles the forms that a word has followed. Counts at least double with every form, so
    64 forms, six rounds, are the most there can be.
    """
    spark = words.sparkSession
    folder = scratch_dir(spark, "spelling")
    words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("word").isNotNull()) \
        .write.parquet(f"{folder}/words")
    links(spark.read.parquet(f"{folder}/words")).write.parquet(f"{folder}/links")
    linked = spark.read.parquet(f"{folder}/links")
    at = linked.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    step = 0
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at.join(on, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")) \
            .write.parquet(f"{folder}/roots-{step}")
        at = spark.read.parquet(f"{folder}/roots-{step}")
        if at.where("moved").isEmpty():
            break
        at, step = at.drop("moved"), step + 1
    return linked.join(at.select("word", "root"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
