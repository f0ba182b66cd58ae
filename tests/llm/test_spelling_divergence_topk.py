"""Spelling variants, source divergence and exact search against plain versions, SQL and odd rows."""

from __future__ import annotations

import os
import sys
from collections import Counter, defaultdict
from itertools import pairwise
from math import floor, isfinite

import numpy as np
import pyarrow as pa
import pytest
from oracle_check import compare, duck

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import texts as plain  # noqa: E402

from reviewflow.llm import divergence, queries, spelling, topk  # noqa: E402


@pytest.fixture(scope="module")
def odd(spark):
    return plain.odd_table(spark)


@pytest.fixture(scope="module")
def none(spark):
    return plain.empty_table(spark)


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_source_divergence", "op13_exact_top_k"])
def test_query_matches_sql(spark, small, name):
    _, n, verdict = compare(spark, duck(small), small, queries.queries()[name], queries.oracle_sql()[name])
    assert verdict == "ok" and n


# Spelling variants

def near(a: str, b: str) -> bool:
    """Whether one edit makes the words equal."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(words: dict[str, int]) -> set[tuple]:
    form, out = {}, set()
    close = {w: [x for x in words if near(w, x)] for w in words}
    for w in words:
        best = min(close[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(close[w]), words[form[w]] if form[w] else None))
    return out


def random_words(n: int, letters: str, lengths: tuple[int, int]) -> dict[str, int]:
    rng = np.random.default_rng(5)
    return {"".join(rng.choice(list(letters), int(rng.integers(*lengths)))): int(rng.zipf(1.3)) % 5000 + 1
            for _ in range(n)}


@pytest.mark.parametrize("letters,lengths,most", [
    ("ab", (1, 9), 4096), ("ab", (1, 9), 5), ("abcdeéß÷", (3, 7), 20), ("aab", (0, 6), 1)])
def test_spelling_variants_are_those_of_all_pairs(spark, monkeypatch, letters, lengths, most):
    """Also where places are cut down to one letter, and with words of every length down to none."""
    monkeypatch.setattr(spelling, "PLACE_WORDS", most)
    monkeypatch.setattr(spelling.placed, "__defaults__", (most,))
    monkeypatch.setattr(spelling, "BLOCK_WORDS", 70)
    words = random_words(700, letters, lengths)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = [tuple(r) for r in spelling.variants(df).collect()]
    assert len(got) == len(words) and set(got) == plain_variants(words)


def test_places_of_a_common_beginning_are_cut(spark):
    """A third of the words begin alike; no place keeps more than a few of them."""
    rng = np.random.default_rng(2)
    tail = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    words = {"anticonstitution" + tail(8) for _ in range(2000)} | {tail(24) for _ in range(4000)}
    df = spark.createDataFrame([(w, 1) for w in sorted(words)], "word string, n long")
    sizes = spelling.placed(df, 100).groupBy("m", "a", "b", "key").count()
    assert max(r["count"] for r in sizes.collect()) <= 100


def test_spelling_of_very_long_words(spark):
    long = "x" * 30_000
    words = {long: 9, long + "y": 3, long[:-1] + "z": 2, long[1:]: 1, "y" + long[2:]: 40, "short": 1}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert {tuple(r) for r in spelling.variants(df).collect()} == plain_variants(words)


def test_forms_are_followed_to_the_last(spark):
    chain = ["a" * i for i in range(1, 40)]
    words = {w: 1 << i for i, w in enumerate(chain)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert {tuple(r) for r in spelling.variants(df).collect()} == plain_variants(words)


def test_spelling_of_odd_rows(spark, odd, none):
    runs = Counter(r.run for r in spelling.runs(odd).collect())
    assert runs["three"] == 3 and runs["Ünïcode".replace("U", "u")] == 1 and "" not in runs
    words = spelling.runs(odd).select("*", spelling.F.col("run").alias("word"))
    got = {r.word: r.n for r in spelling.variants(spelling.counted(words, 1, 1)).collect()}
    assert got == runs
    assert spelling.variants(spelling.counted(spelling.runs(none).withColumnRenamed("run", "word"))).collect() == []
    twice = spark.createDataFrame([("abcde", 2), ("abcde", 3), (None, 7)], "word string, n long")
    assert [tuple(r) for r in spelling.variants(twice).collect()] == [("abcde", None, "abcde", 5, 0, None)]


# Source divergence

def terms(text: str | None) -> list[str]:
    small = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if "a" <= c <= "z" or ord(c) >= 128 else " " for c in small).split(" ")


def plain_divergence(docs, least=10, top=10) -> set[tuple]:
    rows = [(lang or "", source or "", [t for t in terms(text) if t]) for text, lang, source in docs]
    held = Counter((lang, t) for lang, _, ts in rows for t in set(ts))
    kept = defaultdict(list)
    for (lang, t), n in held.items():
        if n >= least:
            kept[lang].append(t)
    count, groups = Counter(), {(lang, source) for lang, source, _ in rows}
    for lang, source, ts in rows:
        count.update((lang, source, t) for t in ts)

    def shares(lang, of):
        n, v = sum(of(t) for t in kept[lang]), len(kept[lang])
        return {t: 1 + 10 ** 9 * (of(t) + 2) // (n + 2 * v) for t in kept[lang]}

    apart = lambda p, q: (p - q) ** 2 // (p + q)
    p = {g: shares(g[0], lambda t, g=g: count[(*g, t)]) for g in groups}
    out = set()
    for lang, source in groups:
        mine = p[lang, source]
        whole = shares(lang, lambda t, lang=lang: sum(count[x, s, t] for x, s in groups if x == lang))
        parts = {"pair": [(-sum(apart(mine[t], p[lang, s][t]) for t in mine), s.encode())
                          for x, s in groups if x == lang and s != source],
                 "term": [(-apart(mine[t], whole[t]), t.encode()) for t in mine
                          if count[lang, source, t] and mine[t] > whole[t]]}
        for part, found in parts.items():
            for rank, (value, item) in enumerate(sorted(found), 1):
                if part == "pair" or rank <= top:
                    out.add((lang, source, part, item.decode(), -value, rank))
    return out


def some_documents():
    rng = np.random.default_rng(7)
    vocabulary = ["a", "ab", "abc", "b", "é", "éa", "日本", "日本語", "z" * 300, *(f"w{chr(97 + i)}" for i in range(20))]
    out = [(" ".join(rng.choice(vocabulary, 12)) + ", X1y!", rng.choice(["en", "de", "fr"]), f"s{rng.zipf(1.4) % 7}")
           for _ in range(400)]
    # A language of one source, one without kept terms, groups without terms, nulls and empty names.
    out += [("only here", "it", "one")] * 12 + [("few terms", "nl", "s1"), ("here", "nl", "s2"), ("123", "en", "none")]
    return out + [(None, None, None), ("", "", "x"), ("   ", None, "y")] + [("Null words", None, "z")] * 11


@pytest.mark.parametrize("shard,tile", [(16_384, 256), (4, 2)])
def test_divergence_is_that_of_a_plain_count(spark, monkeypatch, shard, tile):
    monkeypatch.setattr(divergence, "SHARD_TERMS", shard)
    monkeypatch.setattr(divergence, "SAMPLED", 2)
    monkeypatch.setattr(divergence, "SHARD_BYTES", shard * 200)
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "CELLS", 8 * tile)
    docs = some_documents()
    df = spark.createDataFrame([(t, str(lang) if lang is not None else None, s) for t, lang, s in docs],
                               "text string, lang string, source string").repartition(3)
    if shard == 4:
        assert len(divergence.borders(divergence.kept_terms(divergence.named(df)))) > 3
    assert {tuple(r) for r in divergence.divergence(df).collect()} == plain_divergence(docs)


def test_a_transducer_is_minimal_and_numbers_terms_in_order():
    rng = np.random.default_rng(3)
    words = sorted({"".join(rng.choice(list("abc"), int(rng.integers(1, 7)))).encode() for _ in range(300)}
                   | {"été".encode(), "étés".encode()})
    machine = divergence.Transducer.unpacked(divergence.Transducer.build(words).packed())
    raw = np.frombuffer(b"".join(words), np.uint8)
    length = np.array([len(w) for w in words])
    assert machine.numbers(raw, np.cumsum(length) - length, length).tolist() == list(range(len(words)))
    assert [machine.term(i) for i in range(len(words))] == words
    others = [b"", b"abcabcabc", "ét".encode(), b"zzz", words[0] + b"q"]
    raw, length = np.frombuffer(b"".join(others), np.uint8), np.array([len(w) for w in others])
    want = [words.index(w) if w in words else -1 for w in others]
    assert machine.numbers(raw, np.cumsum(length) - length, length).tolist() == want
    # As many states as beginnings that can go on differently.
    rest = defaultdict(set)
    for w in words:
        for i in range(len(w) + 1):
            rest[w[:i]].add(w[i:])
    assert len(machine.final) == len({frozenset(x) for x in rest.values()})


def test_pairs_are_named_one_way_round_however_the_rows_of_a_block_arrive():
    """Blocks of terms are shuffled by themselves, so the same sources may come in another order in each."""
    key = tuple(pa.scalar(x) for x in ("en", 0, 0, 0))
    rows = [("b", -1, 5), ("a", -1, 7), ("c", -1, 9), ("a", 1, 20), ("c", 0, 30)]
    found = [{(r["source"], r["item"], r["value"]) for r in divergence._pairs(key, pa.table({
        "source": [s for s, _, _ in order], "tile": [0] * len(order), "at": [at for _, at, _ in order],
        "p": [p for _, _, p in order], "width": [2] * len(order)})).to_pylist()} for order in (rows, rows[::-1])]
    assert found[0] == found[1]
    assert {(s, i) for s, i, _ in found[0]} == {("a", "b"), ("a", "c"), ("b", "c")}


def test_divergence_of_odd_rows(odd, none):
    docs = [(r.text, r.lang, r.source) for r in odd.collect()]
    for least in (1, 10):
        assert {tuple(r) for r in divergence.divergence(odd, least).collect()} == plain_divergence(docs, least)
    assert divergence.divergence(none).collect() == []


def test_shares_of_very_large_counts_are_exact(spark):
    n, v = 3 * 10 ** 17 + 7, 123_456
    row = spark.createDataFrame([(n - 5, n, v)], "c long, n long, v long").select(divergence.share("c", "n", "v"))
    assert row.first()[0] == 1 + 10 ** 9 * (n - 3) // (n + 2 * v)


# Exact search

def plain_search(queries_, vectors, k=5):
    def whole(v):
        if v is None or any(x is None or not isfinite(x) for x in v):
            return None
        return [floor(256 * x) for x in v]

    out = Counter()
    rows = [(i, whole(v)) for i, v in vectors]
    for at in queries_:
        qid, q = rows[at]
        if q is None or qid is None:
            continue
        scored = sorted((-max(-topk.LAST, min(topk.LAST, sum(a * b for a, b in zip(q, v)))), i is None, i or 0)
                        for j, (i, v) in enumerate(rows) if j != at and v is not None and len(v) == len(q))
        for rank, (score, no, i) in enumerate(scored[:k], 1):
            out[qid, rank, None if no else i, -score] += 1
    return out


def searched(spark, vectors, divisor, **kw):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    found = topk.nearest(df.where(f"vec_id % {divisor} = 0"), df, **kw)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    at = [i for i, (v, _) in enumerate(vectors) if v is not None and v % divisor == 0]
    return Counter(tuple(r) for r in found.collect()), plain_search(at, vectors, kw.get("k", 5))


@pytest.mark.parametrize("block", [32 << 20, 3000])
def test_search_is_that_of_all_products(spark, monkeypatch, block):
    """Smooth vectors, which the levels tell apart, in one block of queries and in many."""
    monkeypatch.setattr(topk, "BLOCK_BYTES", block)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(6, 8)).repeat(8, axis=1)
    vectors = [(i, (base[i % 6] * rng.uniform(0.2, 1) + rng.normal(size=64) * 0.05).tolist()) for i in range(3000)]
    got, want = searched(spark, vectors, 40)
    assert got == want and len({q for q, *_ in got}) == 75


def test_search_with_ties_copies_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    same = [0.5, -0.25, 1.0, 0.0]
    vectors = [(10 * i, same) for i in range(40)] + [(20, same), (20, [0.5, 0.0, 0.0, 0.0]), (20, None)]
    vectors += [(None, same), (30, [1.0, nan, 0.0, 0.0]), (40, [1.0, None, 0.0, 0.0]), (50, [inf, 0.0, 0.0, 0.0])]
    vectors += [(60, [1.0, 2.0]), (61, [3.0, 4.0]), (62, []), (70, []), (80, [0.0]), (-20, [-1.0, 0.0, 0.0, -0.001])]
    for k in (1, 5, 100):
        got, want = searched(spark, vectors, 10, k=k)
        assert got == want
    assert searched(spark, vectors[:3], 10) == (plain_search([0, 1, 2], vectors[:3]),) * 2


def test_search_of_large_numbers_is_exact(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, (rng.normal(size=6) * 10.0 ** int(rng.integers(0, 12))).tolist()) for i in range(300)]
    vectors += [(300, [1e300] * 6), (301, [-1e300] * 6)]
    got, want = searched(spark, vectors, 30)
    assert got == want


def test_search_in_empty_tables_and_beside_other_columns(spark):
    df = spark.createDataFrame([(0, [1.0], "x"), (1, [2.0], "y")], "vec_id long, embedding array<float>, place string")
    df = df.selectExpr("*", "1 AS score", "2 AS rank", "3 AS part", "'q' AS query_id", "0 AS id", "0 AS n")
    assert [tuple(r) for r in topk.nearest(df.where("vec_id = 0"), df).collect()] == [(0, 1, 1, 256 * 512)]
    assert topk.nearest(df.where("false"), df).collect() == []
    assert topk.nearest(df.where("false"), df.where("false")).collect() == []


def test_levels_never_rule_out_a_winner():
    rng = np.random.default_rng(9)
    rows = np.floor(rng.normal(size=(200, 64)).cumsum(axis=1) * 50)
    q, v = topk.Block(np.arange(40), rows[:40]), topk.Block(np.arange(160), rows[40:])
    exact = q.rows @ v.rows.T
    for levels in pairwise((0, *topk.LEVELS)):
        bound = q.level(levels[1]) @ v.level(levels[1]).T
        assert (bound >= exact - 1e-6 * np.abs(exact)).all()
    limit = np.sort(exact, axis=1)[:, -6]
    a, b, score = topk.candidates(q, v, limit)
    assert {(int(x), int(y)) for x, y in zip(a, b)} >= set(zip(*(x.tolist() for x in np.nonzero(exact >= limit[:, None]))))
    assert (score == exact[a, b]).all()
