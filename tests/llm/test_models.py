"""Learned operators against plain loops: the decoder of languages, features, training and scores of quality."""

from __future__ import annotations

import re as bytes_re
from collections import Counter
from math import exp, log1p

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F


from reviewflow.llm import language, quality  # noqa: E402
from reviewflow.llm.words import hashes_of, split_words  # noqa: E402

MASK = (1 << 64) - 1


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def mixed(x: int) -> int:
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def letter_grams(text: str):
    """Features of the one to four letters in a row of every word, blanks at its ends included."""
    for word in text.lower().encode().split():
        core = regex.sub(r"[^\p{L}\p{M}]+", " ", word.decode())
        core = regex.sub(r"(\S{%d})" % language.LONGEST, r"\1 ", core).strip()
        spelled = f" {core} " if core else ""
        for n in range(1, 5):
            for i in range(len(spelled) - n + 1):
                if n > 1 or spelled[i] != " ":
                    gram = n
                    for c in spelled[i:i + n]:
                        gram = (gram * 0x100000001B3 + ord(c)) & MASK
                    yield mixed(gram) % language.FEATURES


def plain_language(text, m):
    found = list(letter_grams(text))
    margin = [sum(float(m.weights[f, b]) for f in found) / max(1, len(found)) for b in range(m.code.shape[1])]
    loss = []
    for code in m.code:
        loss.append(sum(log1p(exp(-c * x * s)) * t * len(code)
                        for c, x, s, t in zip(code, margin, m.scale, m.trust)))
    first, second = sorted(range(len(loss)), key=lambda i: loss[i])[:2]
    return m.langs[first], m.langs[second], 1 / (1 + exp(loss[first] - loss[second]))


def test_languages_are_those_of_a_plain_decoder(spark, docs):
    m = language.learned(docs)
    rows = [(r.doc_id, r.text[:3000]) for r in docs.where("doc_id < 25").collect()]
    rows += [(1000 + i, t) for i, t in enumerate(["the", "straße über", "l'été où", "日本語 the", "x" * 90, "a1b2 c"])]
    got = language.predict(spark.createDataFrame(rows, "doc_id long, text string"), m).collect()
    by_id = dict(rows)
    for r in got:
        lang, second, score = plain_language(by_id[r.doc_id], m)
        assert (r.lang_pred, r.second) == (lang, second) and abs(r.score - score) < 1e-5


def test_language_weights_are_those_of_plain_counts(spark):
    texts = [("en", "the cat and the dog"), ("de", "der hund und die katze"), ("fr", "le chat et le chien")] * 3
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(texts)], "doc_id long, lang string, text string")
    m = language.fit(df)
    counts = {x: Counter(f for lang, t in texts if lang == x for f in letter_grams(t)) for x in m.langs}
    share = {x: (np.array([c[f] for f in range(language.FEATURES)]) + 0.5) for x, c in counts.items()}
    share = np.stack([share[x] / share[x].sum() for x in m.langs])
    for b, bit in enumerate(m.code.T):
        want = np.log(share[bit > 0].mean(axis=0)) - np.log(share[bit < 0].mean(axis=0))
        assert np.allclose(m.weights[:, b], want, atol=1e-5)


def quality_features(text) -> Counter:
    found = [t.decode("latin-1") for t in bytes_re.findall(
        rb"[A-Za-z0-9\x80-\xff]+|[^A-Za-z0-9\x80-\xff\x20\x09-\x0d]+", (text or "").encode())]
    own = [int(hashes_of(split_words(quality.pa.array([t])))[0]) if t.isascii() else None for t in found]
    for i, t in enumerate(found):
        if own[i] is None:
            own[i] = int(hashes_of(split_words(quality.pa.array([t.encode("latin-1").decode()])))[0])
    out = list(own)
    out += [mixed((a * 0x9E3779B97F4A7C15 + b) & MASK) for a, b in zip(own, own[1:])]
    for apart in (1, 2):
        out += [apart for a, b in zip(own, own[apart:]) if a == b]
    return Counter(x % quality.FEATURES for x in out)


def plain_ftrl(rows, labels):
    z, n = Counter(), Counter()

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        shrunk = z[i] - (quality.L1 if z[i] > 0 else -quality.L1)
        return -shrunk / ((quality.BETA + n[i] ** 0.5) / quality.ALPHA + quality.L2)

    for _ in range(quality.ROUNDS):
        for row, label in zip(rows, labels):
            w = {i: weight(i) for i in row}
            p = 1 / (1 + exp(-max(-35, min(35, sum(w[i] * x for i, x in row.items())))))
            for i, x in row.items():
                g = (p - label) * x
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / quality.ALPHA * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z}


def test_quality_is_learned_and_scored_as_by_a_plain_loop(spark, docs, small):
    labels = spark.read.parquet(f"{small}/labels.parquet").where("doc_id < 60")
    weights, bias = quality.fit(docs, labels)
    learning = docs.join(labels.select("doc_id", "quality"), "doc_id").where(quality.fold() != 0).select(
        "text", "quality", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(quality.SHARDS)).alias("shard"),
        F.xxhash64("doc_id", "text").alias("place")).orderBy("place").collect()
    bias_at, total, shards = quality.FEATURES, Counter(), {r.shard for r in learning}
    for shard in shards:
        rows = []
        for r in (r for r in learning if r.shard == shard):
            found = quality_features(r.text)
            size = max(1, sum(found.values()))
            rows.append({**{i: n * quality.LENGTH / size for i, n in found.items()}, bias_at: 1.0})
        for i, w in plain_ftrl(rows, [r.quality for r in learning if r.shard == shard]).items():
            total[i] += w / len(shards)
    assert abs(total[bias_at] - bias) < 1e-6
    want = np.array([total[i] for i in range(quality.FEATURES)])
    assert np.abs(weights - want).max() < 1e-5 and np.count_nonzero(weights) > 100
    held = docs.where("doc_id between 60 and 90")
    texts = {r.doc_id: r.text for r in held.collect()}
    texts[-1] = None
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in quality.score(df, (weights, bias)).collect():
        found = quality_features(texts[r.doc_id])
        dot = sum(n * total[i] for i, n in found.items()) * quality.LENGTH / max(1, sum(found.values())) + total[bias_at]
        assert abs(r.score - 1 / (1 + exp(-dot))) < 1e-4 and r.predicted == (r.score >= quality.PREDICTED_FROM)
