"""Language identification by error-correcting output codes.

Every language has a codeword. For each bit, a binary classifier over hashed character n-grams (one to
four letters, word borders included) says whether the language of a text has the bit: a naive Bayes
margin, the mean over the text's n-grams of the log odds between the languages with and without it.
Decoding adds up, for each language, the logistic loss of every bit's margin against its codeword,
weighted by how well the bit's classifier did in training; the nearest codeword wins, and a text whose
second language is almost as near is flagged as ambiguous.

N-gram counts come from a sample of the learning rows, by default about 4,000 of each language
(``SAMPLE``), chosen by a hash of the id and gathered as grouped sums; the margins' scale and the
bits' weights come from the same rows. Every text is scored as a whole.

Defined results: a null text or one without any letter gets ``und`` with score 0; with no learning row
every text does; rows without language are not learned from; with one language every text with a
letter gets it; null ids count as the text "" in the fold and stay null; repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewflow.llm.words import U, hashes_of, mixed, slices, split_words

#: Learning rows of each language, about; n-grams are hashed to so many features.
SAMPLE, FEATURES = 4000, 1 << 16
#: Most languages: weights of all bits are sent to the executors.
MOST_LANGUAGES = 500
#: Characters of a word that are looked at; longer words are cut into parts of this length.
LONGEST = 40
#: A text is ambiguous if its best language has less than this share against the second.
CLEAR = 0.6
#: Bytes of text worked on at once: each of its distinct words has some thirty n-grams.
AT_ONCE = 2 << 20
UNKNOWN = "und"
PREDICTED = "doc_id long, lang_pred string, score double, second string, ambiguous boolean, letters boolean"


class Model(NamedTuple):
    langs: list[str]
    code: np.ndarray  # languages x bits, of -1 and 1
    weights: np.ndarray  # features x bits, of log odds
    scale: np.ndarray  # what a margin is multiplied with, by bit
    trust: np.ndarray  # weight of the loss, by bit


def codewords(n: int) -> np.ndarray:
    """Codewords of n languages: all splits for up to six, else random ones far from each other."""
    if n == 1:
        return np.ones((1, 1))
    if n <= 6:
        splits = np.arange(1, 1 << (n - 1))
        return np.array([[1 if i == 0 else 1 - 2 * int(s >> (i - 1) & 1) for s in splits] for i in range(n)])
    rng, best, far = np.random.default_rng(7), None, -1
    bits = int(np.ceil(12 * np.log2(n)))
    for _ in range(50):
        code = rng.choice([-1, 1], (n, bits))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        near = (code.shape[1] - (code @ code.T - np.eye(n) * 4 * bits).max()) / 2
        if near > far:
            best, far = code, near
    return best


class Grams(NamedTuple):
    """Features of the distinct words of some texts, and the words of each text."""

    features: np.ndarray
    starts: np.ndarray
    codes: np.ndarray
    words: np.ndarray


def grams(texts: pa.Array) -> Grams:
    """Hashed n-grams of the letters of every word; capitals count as small letters."""
    words = split_words(pc.utf8_lower(texts))
    codes, distinct = pd.factorize(hashes_of(words))
    first = np.zeros(len(distinct), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    raw = words.raw.tobytes()
    spelled = pa.array([raw[a:b] for a, b in zip(words.begin[first].tolist(), words.end[first].tolist())],
                       pa.binary()).cast(pa.string())
    cores = pc.replace_substring_regex(spelled, r"[^\p{L}\p{M}]+", " ")
    cores = pc.replace_substring_regex(cores, r"(\S{%d})" % LONGEST, r"\1 ")
    cores = pc.utf8_trim_whitespace(cores)
    cores = pc.if_else(pc.equal(cores, ""), "", pc.binary_join_element_wise(" ", cores, " ", ""))
    points = np.frombuffer("".join(cores.to_pylist()).encode("utf-32-le"), np.uint32).astype(U)
    size = pc.utf8_length(cores).to_numpy(zero_copy_only=False).astype(np.int64)
    word = np.repeat(np.arange(len(size)), size)
    features, owner = [], []
    for n in range(1, 5):
        k = max(0, len(points) - n + 1)
        gram = np.full(k, U(n))
        for j in range(n):
            gram = gram * U(0x100000001B3) + points[j:j + k]
        inside = word[:k] == word[n - 1:n - 1 + k]
        if n == 1:
            inside &= points[:k] != 32
        features.append((mixed(gram[inside]) % U(FEATURES)).astype(np.int64))
        owner.append(word[:k][inside])
    owner, features = np.concatenate(owner), np.concatenate(features)
    order = np.argsort(owner, kind="stable")
    starts = np.searchsorted(owner[order], np.arange(len(size) + 1))
    return Grams(features[order], starts, codes, words.starts)


def per_text(g: Grams, values: np.ndarray) -> np.ndarray:
    """Sum over each text of a value (or a row of values) of its words."""
    sums = np.zeros((len(g.codes) + 1, *values.shape[1:]))
    np.cumsum(values[g.codes], axis=0, out=sums[1:])
    return sums[g.words[1:]] - sums[g.words[:-1]]


def margins(g: Grams, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean log odds of each text's n-grams by bit, and how many n-grams it has."""
    own = np.zeros((len(g.starts) - 1, weights.shape[1]), weights.dtype)
    count = np.diff(g.starts)
    some = np.flatnonzero(count)
    if len(some):
        own[some] = np.add.reduceat(weights[g.features], g.starts[:-1][some], axis=0)
    n = per_text(g, count.astype(float))
    return per_text(g, own) / np.maximum(n, 1)[:, None], n


def _counted(batches: Iterator[pa.RecordBatch], langs: list[str]) -> Iterator[pa.RecordBatch]:
    """Counts of each feature by language, of one partition."""
    place = {x: i for i, x in enumerate(langs)}
    total: dict[int, np.ndarray] = {}
    for batch in slices(batches, most=AT_ONCE):
        g = grams(batch.column("text"))
        lang = np.repeat([place[x] for x in batch.column("lang").to_pylist()], np.diff(g.words))
        for i in np.unique(lang).tolist():
            use = np.bincount(g.codes[lang == i], minlength=len(g.starts) - 1)
            counts = np.bincount(g.features, np.repeat(use, np.diff(g.starts)), FEATURES)
            total[i] = total.get(i, 0) + counts
    for i, counts in total.items():
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(np.full(len(some), i, np.int32)),
                                          "feature": pa.array(some.astype(np.int32)),
                                          "n": pa.array(counts[some].astype(np.int64))})


def _tried(batches: Iterator[pa.RecordBatch], langs: list[str], code, weights) -> Iterator[pa.RecordBatch]:
    """By bit, of one partition: rows, size of the margins and how many have the right sign."""
    place = {x: i for i, x in enumerate(langs)}
    for batch in slices(batches, most=AT_ONCE):
        m, n = margins(grams(batch.column("text")), weights)
        want = code[[place[x] for x in batch.column("lang").to_pylist()]]
        m, want = m[n > 0], want[n > 0]
        yield pa.RecordBatch.from_pydict({
            "bit": pa.array(np.arange(code.shape[1], dtype=np.int32)),
            "n": pa.array(np.full(code.shape[1], float(len(m)))), "size": pa.array(np.abs(m).sum(axis=0)),
            "right": pa.array((m * want > 0).sum(axis=0).astype(float))})


def fit(rows: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learn from the columns lang and text of ``rows``; None without rows."""
    rows = rows.where("lang is not null")
    counts = sorted((r[0], r[1]) for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang")
                    .limit(MOST_LANGUAGES).collect())
    if not counts:
        return None
    langs = [c[0] for c in counts]
    share = F.create_map(*[F.lit(x) for lang, n in counts for x in (lang, min(1.0, sample / n))])
    own = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)
    some = rows.where(F.col("lang").isin(langs)).where(own < share[F.col("lang")]).select("lang", "text")
    counted = some.mapInArrow(partial(_counted, langs=langs), "lang int, feature int, n long") \
        .groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((len(langs), FEATURES))
    table[counted["lang"].to_numpy(), counted["feature"].to_numpy()] = counted["n"].to_numpy()
    code = codewords(len(langs))
    share = (table + 0.5) / (table + 0.5).sum(axis=1, keepdims=True)
    weights = np.stack([
        np.log(share[bit > 0].mean(axis=0)) - (np.log(share[bit < 0].mean(axis=0)) if (bit < 0).any() else 0)
        for bit in code.T], axis=1).astype(np.float32)
    if len(langs) == 1:
        return Model(langs, code, weights, np.ones(1), np.ones(1))
    tried = some.mapInArrow(partial(_tried, langs=langs, code=code, weights=weights),
                            "bit int, n double, size double, right double") \
        .groupBy("bit").agg(F.sum("n"), F.sum("size"), F.sum("right")).orderBy("bit").toArrow()
    n, size, right = (tried.column(i).to_numpy() for i in (1, 2, 3))
    right = (right + 1) / (n + 2)
    # A margin of usual size speaks for its bit with the odds that the bit's classifier is right.
    trust = np.maximum(np.log(right / (1 - right)), 0.05)
    return Model(langs, code, weights, trust / np.maximum(size / np.maximum(n, 1), 1e-9), trust / trust.sum())


def decode(model: Model, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the nearest codeword, of the second, and the first's share of both likelihoods."""
    loss = np.logaddexp(0, -model.code[None] * (margin * model.scale)[:, None]) @ (
        model.trust * model.code.shape[1])
    order = np.argsort(loss, axis=1, kind="stable")
    first, second = order[:, 0], order[:, min(1, loss.shape[1] - 1)]
    row = np.arange(len(loss))
    gap = loss[row, second] - loss[row, first]
    return first, second, 1 / (1 + np.exp(-gap)) if loss.shape[1] > 1 else np.ones(len(loss))


def told(texts: pa.Array, m: Model | None) -> dict[str, pa.Array]:
    """Language, score, second language and whether it is ambiguous, of each text."""
    some = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    lang, second, score, clear = (np.full(len(texts), UNKNOWN, object), np.full(len(texts), None, object),
                                  np.zeros(len(texts)), np.zeros(len(texts), bool))
    if m is not None and some.any():
        names = np.array(m.langs, object)
        a, b, s = decode(m, margins(grams(texts.filter(pa.array(some))), m.weights)[0])
        lang[some], second[some], score[some], clear[some] = names[a], names[b], s, s >= CLEAR
    return {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score),
            "second": pa.array(second, pa.string()), "ambiguous": pa.array(some & ~clear),
            "letters": pa.array(some)}


def _predicted(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, most=AT_ONCE):
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id").cast(pa.int64()),
            **told(batch.column("text"), model and model.value)})


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score, second, ambiguous, letters."""
    sent = None if model is None else docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text") \
               .mapInArrow(partial(_predicted, model=sent), PREDICTED)


def fold(column: str = "doc_id"):
    """The remainder that tells learning rows (not 1) from held-out ones (1)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % 3


def learned(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    return fit(docs.where(fold() != 1).select("doc_id", "lang", "text"), sample)


def _kept(batches: Iterator[pa.RecordBatch], model, targets: frozenset[str]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, most=AT_ONCE):
        lang = told(batch.column("text"), model.value)["lang_pred"]
        yield batch.filter(pc.is_in(lang, pa.array(sorted(targets), pa.string())))


def stage(spark, docs: DataFrame, sf_dir: str, targets: Collection[str] | None = None) -> DataFrame:
    """Pipeline stage: documents stay whose predicted language is one of ``targets``, by default all those
    learned; so texts without a letter go. Where nothing can be learned, for want of labels, nothing can be
    rejected and all documents stay."""
    model = learned(docs)
    if model is None:
        return docs
    kept = frozenset(model.langs if targets is None else targets)
    return docs.mapInArrow(partial(_kept, model=spark.sparkContext.broadcast(model), targets=kept), docs.schema)
