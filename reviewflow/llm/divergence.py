"""Source divergence: which terms a source uses more than its language does, and how far sources differ.

A term is a run of ASCII letters and of code points from U+0080 on, small from A to Z only. A language keeps
the terms that at least ``least`` of its documents hold. The kept terms, sorted, are cut into shards; each
shard becomes a minimal acyclic transducer (states with equal continuations are one) that gives a
term its number in the order of the terms, from the terms that leave each state. The texts are then streamed
through it: each slice of the input sorts its terms by shard and sends them there as packed strings, and the
transducer counts those it knows by number. Numbers stand for terms from then on: counts, shares and sums are
worked out over them, and they break ties.

With ``p = 1 + floor(10^9 (count + 2) / (N + 2 V))`` for a group's ``V`` kept terms with ``N`` occurrences, two
groups differ by the sum of ``floor((p - q)^2 / (p + q))`` over all kept terms, seen there or not. All is done
in whole numbers.

Bounds: a shard holds about ``SHARD_TERMS`` terms, and of the texts about ``SHARD_BYTES`` (a shard with more is
read by several tasks that each count a part). Only shard borders go through the driver, at most about
``MOST_SHARDS``. Pairs of sources are summed over blocks of terms, in tiles of ``TILE`` sources.

Defined results: null text, lang or source count as ''; a group without kept terms has no ``term`` rows and
differs from others by what its even shares give, or 0 where the language keeps no term; a language of
one source has no ``pair`` rows; each row is a document, whatever its id; an empty table gives none.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewflow.llm.words import gather, give_back, slices
from reviewflow.session import scratch_dir

#: Terms of a shard, and bytes of text whose terms one task of a shard takes in, both on average.
SHARD_TERMS, SHARD_BYTES = 16_384, 8 << 20
MOST_SHARDS = 20_000
#: Sampled terms for each border, and characters of a border.
SAMPLED, BORDER = 8, 1000
#: Sources of a tile, and shares that a task holds at once.
TILE, CELLS = 256, 1 << 20
SCALE = 1_000_000_000


def named(docs: DataFrame) -> DataFrame:
    """lang, source and text without nulls."""
    return docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])


class Tokens(NamedTuple):
    """Terms of some texts: the distinct ones in order, the number of each occurrence's term, and its text."""

    distinct: pa.Array
    code: np.ndarray
    row: np.ndarray


def tokens(texts: pa.Array) -> Tokens:
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    raw = raw + (((raw - 65) < 26).astype(np.uint8) << 5)
    inside = (raw >= 128) | ((raw - 97) < 26)
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    between = offsets[(offsets > 0) & (offsets < len(raw))]
    begin[between] = inside[between]
    end[between - 1] = inside[between - 1]
    begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
    ends = np.concatenate([[0], np.cumsum(end - begin)])
    found = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(raw[inside])]).dictionary_encode()
    order = pc.sort_indices(found.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return Tokens(found.dictionary.take(order), rank[found.indices.to_numpy()],
                  np.searchsorted(offsets, begin, side="right") - 1)


def _numbered(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct values in order, and which of them each row has."""
    found = column.dictionary_encode()
    order = pc.sort_indices(found.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return found.dictionary.take(order), rank[found.indices.to_numpy()]


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of each slice and language hold each term."""
    for batch in slices(batches):
        terms, code, row = tokens(batch.column("text"))
        langs, lang = _numbered(batch.column("lang"))
        once = np.unique(row * max(1, len(terms)) + code)
        row, code = np.divmod(once, max(1, len(terms)))
        cell, n = np.unique(lang[row] * max(1, len(terms)) + code, return_counts=True)
        lang, code = np.divmod(cell, max(1, len(terms)))
        yield pa.RecordBatch.from_arrays(
            [langs.take(pa.array(lang)), terms.take(pa.array(code)).cast(pa.large_string()).cast(pa.string()),
             pa.array(n, pa.int64())], names=["lang", "term", "n"])
        give_back()


def kept_terms(docs: DataFrame, least: int = 10) -> DataFrame:
    """lang, term: terms that at least ``least`` documents of the language hold; of ``named`` rows."""
    return docs.select("lang", "text").mapInArrow(_held, "lang string, term string, n long") \
        .groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("lang", "term")


# Shards

def border_key(lang: Column, term: Column) -> Column:
    """What decides the shard of a term: equal keys share a shard, keys are ordered as (lang, term) is."""
    return F.concat(F.substring(lang, 1, BORDER), F.lit("\0"), F.substring(term, 1, BORDER))


def borders(kept: DataFrame) -> list[bytes]:
    """First keys of all shards but the first, as UTF-8, from a sample by hash of the kept terms."""
    terms = kept.count()
    size = max(SHARD_TERMS, -(-terms // MOST_SHARDS))
    if terms <= size:
        return []
    drawn = F.pmod(F.xxhash64("lang", "term"), F.lit(max(1, size // SAMPLED))) == 0
    keys = kept.where(drawn).select(border_key(F.col("lang"), F.col("term")).alias("key")).distinct()
    found = sorted(r.key.encode() for r in keys.toLocalIterator())
    return found[SAMPLED::SAMPLED]


def _shards(lang: str, terms: pa.Array, codes: np.ndarray, limits: list[bytes]) -> np.ndarray:
    """Shard of each of the terms ``codes``, in order, of a language."""
    key = lambda i: f"{lang[:BORDER]}\0{terms[codes[i]].as_py().decode()[:BORDER]}".encode()
    low, high = bisect_right(limits, key(0)), bisect_right(limits, key(len(codes) - 1))
    cuts = [bisect_left(range(len(codes)), x, key=key) for x in limits[low:high]]
    return low + np.searchsorted(np.array(cuts, np.int64), np.arange(len(codes)), side="right")


# Transducers

class Transducer:
    """Numbers of sorted terms from a minimal acyclic automaton.

    ``code``: state * 256 + byte of each arc, sorted; ``target`` its state; ``before``: terms that leave the
    arc's state earlier in the order; ``final``: whether a term ends in the state. A term's number is the sum of
    ``before`` along its path.
    """

    def __init__(self, code, target, before, final):
        self.code, self.target, self.before, self.final = code, target, before, final

    @classmethod
    def build(cls, terms: list[bytes]) -> Transducer:
        """Of distinct terms in order: a state is settled, or found to equal a settled one, as soon as no
        further term can pass through it."""
        known: dict[tuple, int] = {}
        settled: list[tuple] = []
        sizes: list[int] = []
        # The path of the last term: for each state whether final, and its arcs so far.
        path: list[list] = [[False, []]]
        last = b""

        def settle(depth: int) -> None:
            while len(path) > depth:
                ends, arcs = path.pop()
                state = (ends, tuple(arcs))
                at = known.get(state)
                if at is None:
                    at = known[state] = len(settled)
                    settled.append(state)
                    sizes.append(ends + sum(sizes[to] for _, to in arcs))
                if path:
                    arc = path[-1][1]
                    arc[-1] = (arc[-1][0], at)

        for term in terms:
            common = 0
            for x, y in zip(term, last):
                if x != y:
                    break
                common += 1
            settle(common + 1)
            for byte in term[common:]:
                path[-1][1].append((byte, -1))
                path.append([False, []])
            path[-1][0] = True
            last = term
        settle(0)
        # The first state is settled last; turned round, it is state 0.
        top = len(settled) - 1
        code, target, before = [], [], []
        for state in range(top, -1, -1):
            ends, arcs = settled[state]
            passed = int(ends)
            for byte, to in arcs:
                code.append((top - state) * 256 + byte)
                target.append(top - to)
                before.append(passed)
                passed += sizes[to]
        return cls(np.array(code, np.int64), np.array(target, np.int64), np.array(before, np.int64),
                   np.array([settled[s][0] for s in range(top, -1, -1)], bool))

    def packed(self) -> bytes:
        head = np.array([len(self.code), len(self.final)], np.int64)
        return b"".join(x.tobytes() for x in (head, self.code, self.target, self.before, self.final))

    @classmethod
    def unpacked(cls, raw: bytes) -> Transducer:
        arcs, states = np.frombuffer(raw, np.int64, 2)
        whole = np.frombuffer(raw, np.int64, 3 * arcs, 16).reshape(3, arcs)
        return cls(*whole, np.frombuffer(raw, bool, states, 16 + 24 * arcs))

    def numbers(self, raw: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Number of each term ``raw[begin:begin + length]``, -1 for unknown ones."""
        state = np.zeros(len(begin), np.int64)
        number = np.zeros(len(begin), np.int64)
        live = np.arange(len(begin))
        if not len(self.code):
            return np.where((length == 0) & bool(len(self.final) and self.final[0]), 0, -1)
        done = 0
        while True:
            more = length[live] > done
            live = live[more]
            if not len(live):
                break
            wanted = state[live] * 256 + raw[begin[live] + done]
            arc = np.minimum(np.searchsorted(self.code, wanted), len(self.code) - 1)
            hit = self.code[arc] == wanted
            state[live[~hit]] = -1
            live, arc = live[hit], arc[hit]
            state[live] = self.target[arc]
            number[live] += self.before[arc]
            done += 1
        known = (state >= 0) & self.final[state]
        return np.where(known, number, -1)

    def term(self, number: int) -> bytes:
        """The term of a number."""
        state, out = 0, bytearray()
        while number or not self.final[state]:
            low, high = np.searchsorted(self.code, [state * 256, state * 256 + 256])
            arc = low + np.searchsorted(self.before[low:high], number, side="right") - 1
            number -= int(self.before[arc])
            out.append(int(self.code[arc]) & 255)
            state = int(self.target[arc])
        return bytes(out)


def _built(key: tuple, table: pa.Table) -> pa.Table:
    terms = sorted(table.column("raw").to_pylist())
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "lang": pa.array([key[1].as_py()]),
                     "n_terms": pa.array([len(terms)], pa.int64()),
                     "packed": pa.array([Transducer.build(terms).packed()], pa.binary())})


def transducers(kept: DataFrame, limits: list[bytes]) -> DataFrame:
    """shard, lang, n_terms, packed, base: a transducer for each language of each shard, and the number of its
    first term among the language's."""
    key = F.encode(border_key(F.col("lang"), F.col("term")), "UTF-8")
    shard = _shard_column(key, limits)
    built = kept.select(shard.alias("shard"), "lang", F.encode("term", "UTF-8").alias("raw")) \
        .groupBy("shard", "lang").applyInArrow(_built, "shard int, lang string, n_terms long, packed binary")
    earlier = Window.partitionBy("lang").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return built.withColumn("base", F.coalesce(F.sum("n_terms").over(earlier), F.lit(0)).cast("long"))


def _shard_column(key: Column, limits: list[bytes]) -> Column:
    @F.pandas_udf("int")
    def shard(keys):
        return keys.map(lambda k: bisect_right(limits, bytes(k))).astype("int32")

    return shard(key)


# Counting

def _sent(batches: Iterator[pa.RecordBatch], limits: list[bytes], salts: int) -> Iterator[pa.RecordBatch]:
    """The terms of each slice, each once for a language, packed for each shard, with their counts by source."""
    schema = pa.schema([("shard", pa.int32()), ("salt", pa.int32()), ("langs", pa.list_(pa.string())),
                        ("sources", pa.list_(pa.string())), ("packed", pa.binary())])
    for turn, batch in enumerate(slices(batches)):
        terms, code, row = tokens(batch.column("text"))
        if not len(terms):
            continue
        (langs, lang), (sources, source) = (_numbered(batch.column(c)) for c in ("lang", "source"))
        values = np.frombuffer(terms.buffers()[2], np.uint8)
        starts = np.frombuffer(terms.buffers()[1], np.int64)[:len(terms) + 1]
        cell, n = np.unique((lang[row] * len(terms) + code) * len(sources) + source[row], return_counts=True)
        # Counts come by language, then term, then source; so do the terms of a language.
        entry, source = np.divmod(cell, len(sources))
        own, entry = np.unique(entry, return_inverse=True)
        lang, code = np.divmod(own, len(terms))
        shard = np.zeros(len(own), np.int64)
        for at in np.unique(lang):
            a, b = np.searchsorted(lang, [at, at + 1])
            shard[a:b] = _shards(langs[int(at)].as_py(), terms, code[a:b], limits)
        out = {c: [] for c in schema.names}
        by_shard = np.argsort(shard[entry], kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(shard[entry][by_shard]) > 0])
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(by_shard)]):
            here = by_shard[a:b]
            mine, which = np.unique(entry[here], return_inverse=True)
            from_, of = np.unique(source[here], return_inverse=True)
            in_, speech = np.unique(lang[mine], return_inverse=True)
            head = [np.array([len(mine), len(here)]), np.diff(starts)[code[mine]], speech, which, of, n[here]]
            out["shard"].append(int(shard[mine[0]]))
            out["salt"].append(turn % salts)
            out["langs"].append(langs.take(pa.array(in_)).to_pylist())
            out["sources"].append(sources.take(pa.array(from_)).to_pylist())
            out["packed"].append(b"".join(x.astype(np.int64).tobytes() for x in head)
                                 + gather(values, starts, code[mine]).tobytes())
        yield pa.RecordBatch.from_pydict(out, schema=schema)
        del terms, code, row, cell, out
        give_back()


class _Sums:
    """Counts by (source, number) of one language, reduced whenever many have come in."""

    def __init__(self, size: int):
        self.size, self.sources = size, {}
        self.code, self.n, self.waiting = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

    def add(self, source: np.ndarray, number: np.ndarray, n: np.ndarray) -> None:
        self.code.append(source * self.size + number)
        self.n.append(n)
        self.waiting += len(n)
        if self.waiting > CELLS:
            self.reduced()

    def reduced(self) -> tuple[np.ndarray, np.ndarray]:
        code, n = np.concatenate(self.code), np.concatenate(self.n)
        order = np.argsort(code, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(code[order]) > 0]) if len(code) else order
        self.code = [code[order][first]]
        self.n = [np.add.reduceat(n[order], first) if len(code) else n]
        self.waiting = 0
        return self.code[0], self.n[0]


def _through(key: tuple, known: pa.Table, texts: pa.Table) -> pa.Table:
    """Counts by term number of the packed terms of one shard."""
    machines = {r["lang"]: (Transducer.unpacked(r["packed"]), _Sums(r["n_terms"])) for r in known.to_pylist()}
    for langs, sources, packed in zip(*(texts.column(c).to_pylist() for c in ("langs", "sources", "packed"))):
        n_terms, n_counts = np.frombuffer(packed, np.int64, 2)
        length, speech = np.frombuffer(packed, np.int64, 2 * n_terms, 16).reshape(2, n_terms)
        which, of, n = np.frombuffer(packed, np.int64, 3 * n_counts, 16 + 16 * n_terms).reshape(3, n_counts)
        raw = np.frombuffer(packed, np.uint8, -1, 16 + 16 * n_terms + 24 * n_counts)
        begin = np.cumsum(length) - length
        for at, lang in enumerate(langs):
            if lang not in machines:
                continue
            machine, sums = machines[lang]
            # Terms of a language lie together, and so do their counts.
            a, b = np.searchsorted(speech, [at, at + 1])
            number = machine.numbers(raw, begin[a:b], length[a:b])
            i, j = np.searchsorted(which, [a, b])
            number = number[which[i:j] - a]
            ids = np.array([sums.sources.setdefault(x, len(sums.sources)) for x in sources])
            hit = number >= 0
            sums.add(ids[of[i:j]][hit], number[hit], n[i:j][hit])
    out = []
    for lang, (_, sums) in machines.items():
        code, n = sums.reduced()
        names = pa.array(list(sums.sources), pa.string())
        out.append(pa.table({
            "shard": pa.array(np.full(len(n), key[0].as_py()), pa.int32()),
            "lang": pa.array([lang], pa.string()).take(pa.array(np.zeros(len(n), np.int64))),
            "source": names.take(pa.array(code // sums.size)), "local": pa.array(code % sums.size, pa.int32()),
            "count": pa.array(n, pa.int64())}))
    return pa.concat_tables(out) if out else pa.table(
        [pa.array([], t) for t in (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int64())],
        names=["shard", "lang", "source", "local", "count"])


def counts(docs: DataFrame, machines: DataFrame, limits: list[bytes]) -> DataFrame:
    """lang, source, shard, local, ord, count: occurrences of the kept terms where there are any; ``ord`` is the
    term's number in its language, ``local`` that in its shard."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    salts = max(1, -(-size // ((len(limits) + 1) * SHARD_BYTES)))
    sent = docs.mapInArrow(lambda it: _sent(it, limits, salts),
                           "shard int, salt int, langs array<string>, sources array<string>, packed binary")
    copied = machines.select("shard", "lang", "n_terms", "packed",
                             F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    found = copied.groupBy("shard", "salt").cogroup(sent.groupBy("shard", "salt")) \
        .applyInArrow(_through, "shard int, lang string, source string, local int, count long")
    return found.join(machines.select("shard", "lang", "base"), ["shard", "lang"]).groupBy(
        "lang", "source", "shard", "local", (F.col("base") + F.col("local")).alias("ord")) \
        .agg(F.sum("count").alias("count"))


# Figures

def share(count: str, n: str, v: str) -> Column:
    """``1 + floor(10^9 (count + 2) / (n + 2 v))`` in whole numbers of any size; null where there are no terms."""
    return F.expr(f"1 + ({SCALE} * CAST({count} + 2 AS DECIMAL(28, 0))) div "
                  f"CAST(nullif({n} + 2 * {v}, 0) AS DECIMAL(28, 0))")


def _pairs(key: tuple, table: pa.Table) -> pa.Table:
    """Sums over a block of terms for each pair of sources of two tiles (or of one, twice named)."""
    lang, _, first, second = (x.as_py() for x in key)
    # In order of the names, not of arrival: a pair must be named one way round in all blocks.
    names, index = _numbered(table.column("source").combine_chunks())
    tile, at, p, width = (table.column(c).to_numpy() for c in ("tile", "at", "p", "width"))
    # One row of each source has the share of the terms it lacks, the others those it has.
    alone = at < 0
    shares = np.zeros((len(names), int(width[0])), np.int64)
    shares[index[alone]] = p[alone][:, None]
    shares[index[~alone], at[~alone]] = p[~alone]
    of = np.zeros(len(names), np.int64)
    of[index] = tile
    low, high = np.flatnonzero(of == first), np.flatnonzero(of == second)
    one, other, value = ([np.zeros(0, np.int64)] for _ in range(3))
    for i in low:
        against = high if first < second else low[low > i]
        one.append(np.full(len(against), i))
        other.append(against)
        mine, theirs = shares[i], shares[against]
        value.append(((mine - theirs) ** 2 // (mine + theirs)).sum(axis=1))
    one, other, value = (np.concatenate(x) for x in (one, other, value))
    return pa.table({"lang": pa.array([lang] * len(one), pa.string()), "source": names.take(pa.array(one)),
                     "item": names.take(pa.array(other)), "value": pa.array(value, pa.int64())})


def _sums(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """lang, source, item, value of each pair of sources of a language."""
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    tiles = -(-most // TILE) or 1
    block = CELLS // TILE
    tile = F.pmod(F.xxhash64("source"), F.lit(tiles)).cast("int").alias("tile")
    last = F.greatest(F.ceil(F.col("v") / block).cast("int") - 1, F.lit(0))
    every = groups.select("lang", "source", tile, F.lit(-1).alias("at"), share("0L", "n", "v").alias("p"), "v",
                          F.explode(F.sequence(F.lit(0), last)).alias("block"))
    some = shares.select("lang", "source", tile, (F.col("ord") % block).cast("int").alias("at"), "p", "v",
                         F.floor(F.col("ord") / block).cast("int").alias("block"))
    width = F.least(F.lit(block), F.col("v") - F.col("block") * block).cast("int").alias("width")
    # Each row goes to all pairs of tiles that its own is one of.
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.lit(tiles - 1)), lambda x: F.struct(
        F.least(x, "tile").alias("first"), F.greatest(x, "tile").alias("second")))).alias("pair")
    sent = every.unionByName(some).select("lang", "source", "tile", "at", F.coalesce("p", F.lit(0)).alias("p"),
                                          "block", width, pair)
    return sent.select("*", "pair.first", "pair.second").drop("pair") \
        .groupBy("lang", "block", "first", "second") \
        .applyInArrow(_pairs, "lang string, source string, item string, value long") \
        .groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _spelled(key: tuple, known: pa.Table, rows: pa.Table) -> pa.Table:
    machine = [Transducer.unpacked(x) for x in known.column("packed").to_pylist()]
    items = [machine[0].term(i).decode() for i in rows.column("local").to_pylist()]
    return rows.drop_columns(["shard", "local"]).append_column("item", pa.array(items, pa.string()))


def divergence(docs: DataFrame, least: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank for each group of rows of one lang and source.

    Part ``pair``: every other source of the language, furthest first. Part ``term``: the ``top`` kept terms
    used more than in the whole language, by what they add to the distance from it.
    """
    spark = docs.sparkSession
    folder = scratch_dir(spark, "divergence")
    rows = named(docs)

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    kept = written(kept_terms(rows, least), "kept")
    limits = borders(kept)
    machines = written(transducers(kept, limits), "transducers")
    found = written(counts(rows, machines, limits), "counts")
    size = machines.groupBy("lang").agg(F.sum("n_terms").alias("v"))
    held = found.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = written(
        rows.select("lang", "source").distinct().join(held, ["lang", "source"], "left").join(size, "lang", "left")
        .select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v")),
        "groups")
    shares = found.join(groups, ["lang", "source"]).withColumn("p", share("count", "n", "v"))
    whole = groups.groupBy("lang").agg(F.sum("n").alias("all_n"))
    over = found.groupBy("lang", "ord").agg(F.sum("count").alias("all")).join(whole, "lang")

    value = F.expr("((p - q) * (p - q)) div (p + q)")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ord")
    terms = shares.join(over, ["lang", "ord"]).withColumn("q", share("all", "all_n", "v")).where("p > q") \
        .withColumn("value", value).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top) \
        .select("lang", "source", "shard", "local", "value", "rank")
    terms = machines.select("shard", "lang", "packed").groupBy("shard", "lang") \
        .cogroup(terms.groupBy("shard", "lang")) \
        .applyInArrow(_spelled, "lang string, source string, value long, rank int, item string")

    sums = written(_sums(groups, shares), "pairs")
    other = sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    far = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = sums.unionByName(other).withColumn("rank", F.row_number().over(far))
    return pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term"))) \
        .select("lang", "source", "part", "item", "value", "rank")
