"""Words, hashes and Arrow batches shared by the operators.

A word is a run of bytes other than ASCII white space (``[^\\x20\\x09-\\x0D]+``), unchanged. Texts come
in Arrow batches; all work on them is array work over the words of a slice of bounded size.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text worked on at once.
SLICE_BYTES = 4 << 20
#: Stands for a null id, after every other id.
LAST_ID = (1 << 63) - 1


class Words(NamedTuple):
    """Words of some texts: word ``k`` is ``raw[begin[k]:end[k]]``; text ``i`` has the words from
    ``starts[i]`` to ``starts[i + 1]``."""

    raw: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    starts: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    @property
    def rows(self) -> np.ndarray:
        """The text each word is of."""
        return np.repeat(np.arange(len(self.starts) - 1), self.counts)


def give_back() -> None:
    """Return freed memory to the system: a worker goes on to other tasks and keeps what it once had."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text",
           most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of about ``most`` bytes of text; one long text is a slice by itself."""
    give_back()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(sizes) - sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
        del batch
        give_back()


def split_words(texts: pa.Array, lower: bool = False) -> Words:
    """Words of each text; a null text has none. ``lower``: A to Z become small letters first."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    body = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    raw = np.zeros(len(body) + 8, np.uint8)  # eight more bytes, so that whole blocks can be read
    raw[:len(body)] = body
    if lower:
        raw += ((raw - 65) < 26).astype(np.uint8) << 5
    return words_at(raw, offsets - offsets[0])


def words_at(raw: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of the texts ``raw[offsets[i]:offsets[i + 1]]``; eight bytes follow the last."""
    n = int(offsets[-1])
    space = (raw[:n] == 32) | ((raw[:n] - 9) < 5)
    begin, end = ~space, ~space
    begin[1:] &= space[:-1]
    end[:-1] &= space[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    begin[inner] = ~space[inner]
    end[inner - 1] = ~space[inner - 1]
    begin = np.flatnonzero(begin)
    return Words(raw, begin, np.flatnonzero(end) + 1, np.searchsorted(begin, offsets))


def hashes_of(words: Words) -> np.ndarray:
    """64-bit hash of each word, from blocks of eight bytes."""
    left = words.end - words.begin
    blocks = np.lib.stride_tricks.sliding_window_view(words.raw, 8)
    out = left.astype(U)
    at, live = words.begin, None
    while len(at):
        block = blocks[at].view(U).ravel()
        block &= (U(1) << (U(8) * np.minimum(left, 7).astype(U))) - U(1) | np.where(
            left >= 8, ~U(0), U(0))
        if live is None:
            out = mixed(out * U(0x9E3779B97F4A7C15) + block)
            live = np.arange(len(at))
        else:
            out[live] = mixed(out[live] * U(0x9E3779B97F4A7C15) + block)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the splitmix64 finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` neighbours, over the borders of texts as well."""
    n = max(0, len(hashes) - width + 1)
    out = hashes[:n].copy()
    for j in range(1, width):
        out *= U(0x9E3779B97F4A7C15)
        out += hashes[j:j + n]
    return mixed(out)


def shingles(words: Words, own: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``width``-word shingles of each text and where each text's begin, from the word
    hashes ``own``.

    A text of fewer words has one shingle of all its words; a text without words has none.
    """
    counts = words.counts
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    starts = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(starts[-1]) + np.repeat(words.starts[:-1] - starts[:-1], n)
    all_runs = rolled(own, width)
    out = all_runs[np.minimum(at, max(0, len(all_runs) - 1))] if len(all_runs) else np.zeros(len(at), U)
    for row in np.flatnonzero((counts > 0) & (counts < width)):
        run = own[words.starts[row]:words.starts[row + 1]]
        out[starts[row]] = rolled(run, len(run))[0] ^ U(len(run))
    return out, starts


def gather(values: np.ndarray, starts: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Join the pieces ``values[starts[c]:starts[c + 1]]`` of all ``codes``."""
    lengths = np.diff(starts)[codes]
    before = np.cumsum(lengths) - lengths
    return values[np.repeat(starts[:-1][codes] - before, lengths) + np.arange(int(lengths.sum()))]


def runs(flag: np.ndarray, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of neighbouring places of one row that have the flag."""
    chosen = np.flatnonzero(flag)
    if not len(chosen):
        return chosen, chosen
    new = np.r_[True, (row[chosen][1:] != row[chosen][:-1]) | (at[chosen][1:] != at[chosen][:-1] + 1)]
    first = np.flatnonzero(new)
    return chosen[first], chosen[np.r_[first[1:] - 1, len(chosen) - 1]]
