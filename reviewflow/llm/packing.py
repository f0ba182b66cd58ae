"""Best-fit packing of token sequences: hierarchical residual packing.

Each partition tokenises its texts, cuts those longer than a sequence into pieces and packs the
pieces best-fit, longest first. Bins that are full or nearly so are finished. Underfull bins are
opened and what they hold goes up a tree: its pieces are dealt to the nodes of the next level by a hash, so
that each node sees the mix of all, and packs them again best-fit; the root finishes everything. Pieces
longer than half a sequence never fit together, so a node above the partitions passes on a bounded number
of pieces and finishes its fullest bins beyond it; by then they have met the whole mix, so little fill is
lost, and no piece.

Defined results: a null text is empty; every document ends with the id 0, so an empty one is one
piece of length 1; null ids and repeated rows are packed like others; an empty table gives no pieces.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewflow.llm.words import U, gather, hashes_of, mixed, slices, split_words
from reviewflow.session import scratch_dir

CAPACITY = 2048
#: Children of a node of the tree; pieces of a node are at most about this many times ``PASSED_ON``.
FAN_IN = 16
#: A bin with at most this share of a sequence free is finished.
NEARLY_FULL = 1 / 64
#: Pieces that a node passes on at most; a partition, which sees no mix, passes on all.
PASSED_ON = 50_000
#: Pieces that are packed at once in a partition.
AT_ONCE = 1_000_000
#: Words whose ids a worker remembers.
REMEMBERED = 400_000
#: Where a word can be cut without changing its ids: before ASCII signs other than the apostrophe.
SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")

PIECES = ("doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, "
          "offset long, node int, deal int, finished boolean")
_NAMES = [c.split()[0] for c in PIECES.split(", ")]

_encoders: dict = {}


def _encoder(path: str):
    """The tokenizer of a worker, its control strings, and the ids it remembers."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        control = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        _encoders[path] = tokenizer, control, {}
    return _encoders[path]


def word_ids(words: list[str], path: str) -> list[bytes]:
    """Ids of each word as 32-bit numbers.

    The tokenizer never joins ids over white space, nor over the border between a letter and a sign
    that follows, and drops case, so stem and signs are looked up apart. What follows a letter counts in its
    small form: that of U+0130 ends in a mark. A word with a control string, which gets the id of that
    string, is looked up whole.
    """
    tokenizer, control, known = _encoder(path)
    every = "\n".join(words)
    control = [c for c in control if c in every]
    cores = []
    for word in words:
        if control and any(c in word for c in control):
            cores.append((word, ""))
            continue
        core = word.rstrip(SIGNS)
        if len(core) < len(word) and not core[-1:].lower()[-1:].isalpha():
            core = word
        cores.append((core.lower() if core.isascii() else core, word[len(core):]))
    new = {part for pair in cores for part in pair} - known.keys()
    fresh = known if len(known) + len(new) <= REMEMBERED else dict(known)
    new = list(new)
    for i in range(0, len(new), 10_000):
        for part, coded in zip(new[i:i + 10_000],
                               tokenizer.encode_batch_fast(new[i:i + 10_000], add_special_tokens=False)):
            fresh[part] = np.array(coded.ids, "<u4").tobytes()
    return [fresh[core] + fresh[signs] for core, signs in cores]


def token_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each followed by the id 0, and where each text's begin."""
    words = split_words(texts)
    codes, distinct = pd.factorize(hashes_of(words))
    first = np.full(len(distinct), len(codes))
    np.minimum.at(first, codes, np.arange(len(codes)))
    raw = words.raw.tobytes()
    spelled = [raw[a:b].decode() for a, b in zip(words.begin[first].tolist(), words.end[first].tolist())]
    coded = word_ids(spelled, path)
    starts = np.r_[0, np.cumsum([len(c) // 4 for c in coded] + [1])].astype(np.int64)
    values = np.frombuffer(b"".join(coded) + bytes(4), "<u4")
    codes = np.insert(codes, words.starts[1:], len(distinct))
    places = np.r_[0, np.cumsum(np.diff(starts)[codes])]
    return gather(values, starts, codes), places[words.starts + np.arange(len(words.starts))]


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each piece, and what is free in each bin."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    free: list[int] = []
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r is set where a bin has r free
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = some >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = open_at[r].pop()
            if not open_at[r]:
                some &= ~(1 << r)
        else:
            r, b = capacity, len(free)
            free.append(capacity)
        bins[i], offsets[i] = b, capacity - r
        free[b] = r - n
        if r > n:
            open_at[r - n].append(b)
            some |= 1 << (r - n)
    return bins, offsets, np.array(free, np.int64)


def pack(pieces: dict[str, np.ndarray], first_id: int, node: int, last: bool, capacity: int,
         most: int | None = None) -> tuple[dict[str, np.ndarray], int]:
    """Pack pieces and say which bins are finished; also the number of bins. ``most``: pieces passed on."""
    bins, offsets, free = best_fit(pieces["length"], capacity)
    finished = np.ones(len(free), bool) if last else free <= capacity * NEARLY_FULL
    if not last:
        held = np.bincount(bins, minlength=len(free))
        rest = np.flatnonzero(~finished)
        rest = rest[np.argsort(-free[rest], kind="stable")]
        finished[rest[np.cumsum(held[rest]) > (PASSED_ON if most is None else most)]] = True
    done = finished[bins]
    return {**pieces, "sequence_id": np.where(done, first_id + bins, -1),
            "offset": np.where(done, offsets, -1), "finished": done,
            "node": np.full(len(bins), node, np.int32),
            "deal": (mixed(U(first_id) + np.arange(len(bins), dtype=U)) >> U(33)).astype(np.int32)}, len(free)


def _batch(out: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({c: out[c] for c in _NAMES})


def _first(level: int, node: int) -> int:
    """First sequence id of a node: level, node and bin have bits of their own."""
    return (level << 56) | (node << 28)


def _cut(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[dict]:
    """The pieces of each slice of texts."""
    for batch in slices(batches):
        ids, places = token_ids(batch.column("text"), path)
        size = np.diff(places)
        n = -(-size // capacity)
        row = np.repeat(np.arange(len(size)), n)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        start = piece * capacity
        length = np.minimum(size[row] - start, capacity)
        raw, at = ids.tobytes(), (places[:-1][row] + start) * 4
        crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist())]
        yield {"doc_id": batch.column("doc_id").cast(pa.int64()).take(pa.array(row)),
               "piece": piece.astype(np.int32), "start": start, "length": length,
               "ids_crc32": np.array(crc, np.int64)}


def _leaf(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    node = TaskContext.get().partitionId()
    held, n, used = [], 0, 0

    def flush():
        nonlocal held, n, used
        pieces = {c: pa.concat_arrays([h[c] for h in held]) if c == "doc_id"
                  else np.concatenate([h[c] for h in held]) for c in held[0]}
        out, bins = pack(pieces, _first(0, node) + used, node, False, capacity, n)
        held, n, used = [], 0, used + bins
        return _batch(out)

    for pieces in _cut(batches, path, capacity):
        held.append(pieces)
        n += len(pieces["piece"])
        if n >= AT_ONCE:
            yield flush()
    if held:
        yield flush()


def _node(table: pa.Table, level: int, last: bool, capacity: int) -> pa.Table:
    table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
    node = table.column("node")[0].as_py()
    pieces = {c: table.column(c).combine_chunks() if c == "doc_id" else table.column(c).to_numpy()
              for c in _NAMES[:5]}
    out, _ = pack(pieces, _first(level, node), node, last, capacity)
    return pa.Table.from_batches([_batch(out)])


def _packer(level: int, last: bool, capacity: int):
    return lambda table: _node(table, level, last, capacity)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Each level of the
    tree is a written table; all but the first hold underfull bins only.
    """
    spark, folder = docs.sparkSession, scratch_dir(docs.sparkSession, "packing")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    level = 0
    narrow.mapInArrow(lambda it: _leaf(it, tokenizer_path, capacity), PIECES) \
          .write.parquet(f"{folder}/0")
    while True:
        below = spark.read.schema(PIECES).parquet(f"{folder}/{level}").where(~F.col("finished"))
        top, n = below.agg(F.max("node"), F.count("*")).first()
        if top is None:
            break
        level += 1
        nodes = max(top // FAN_IN + 1, -(-n // (FAN_IN * PASSED_ON)))
        below.withColumn("node", F.pmod("deal", F.lit(nodes))).groupBy("node") \
             .applyInArrow(_packer(level, nodes == 1, capacity), PIECES) \
             .write.parquet(f"{folder}/{level}")
    paths = [f"{folder}/{k}" for k in range(level + 1)]
    return spark.read.schema(PIECES).parquet(*paths).where("finished").select(*_NAMES[:7])


def sequences(docs: DataFrame, pieces: DataFrame, tokenizer_path: str) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids. Documents need distinct ids here."""

    def cut(batches):
        for batch in slices(batches):
            ids, places = token_ids(batch.column("text"), tokenizer_path)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "ids": pa.ListArray.from_arrays(pa.array(places, pa.int32()),
                                                pa.array(ids.astype(np.int32)))})

    ids = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "doc_id long, ids array<int>")
    placed = pieces.join(ids, "doc_id").select(
        "sequence_id", "offset", F.expr("slice(ids, int(start) + 1, int(length))").alias("ids"))
    # At most ``capacity`` tokens come together in a row.
    return placed.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))),
                              lambda x: x["ids"])).alias("ids"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of all documents and their places in sequences."""
    return pack_documents(docs, default_tokenizer())
