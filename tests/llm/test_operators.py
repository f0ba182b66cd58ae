"""Each operator against a plain version, a round trip or held-out rows, and on odd rows."""

from __future__ import annotations

import hashlib
import os
import re
import sys
import textwrap
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
from oracle_check import compare, duck
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import texts as plain  # noqa: E402

from reviewflow.llm import (chat, decontaminate, language, licenses, lm_score, merkle, near_dups,  # noqa: E402
                            packing, quality, queries, substring)


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def by_id(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    return plain.odd_table(spark)


@pytest.fixture(scope="module")
def none(spark):
    return plain.empty_table(spark)


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def keyed(df, *cols):
    return {r.doc_id: tuple(r[c] for c in cols) for r in df.collect()}


# Packing

def encoded(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def check_packing(rows, wanted, capacity):
    got = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    want = Counter()
    for doc_id, text in wanted:
        ids = encoded(text)
        for k in range(0, len(ids), capacity):
            part = ids[k:k + capacity]
            want[doc_id, k // capacity, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert got == want
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(r.length for r in rows)


def test_packing_holds_every_id_once_in_nearly_full_sequences(docs, by_id):
    rows = packing.pack_documents(docs.repartition(40), packing.default_tokenizer()).collect()
    bins, tokens = check_packing(rows, by_id.items(), 2048)
    assert bins <= -(-tokens // 2048) + 1


def test_packing_of_odd_rows(odd, none):
    rows = packing.pack_documents(odd, packing.default_tokenizer(), 64).collect()
    check_packing(rows, plain.ODD, 64)
    assert packing.pack_documents(none, packing.default_tokenizer()).collect() == []


def test_packing_gives_the_ids_of_the_plain_tokenizer():
    """Words of letters with odd small forms, marks, signs and control strings."""
    rng = np.random.default_rng(6)
    signs = ["İ", "ı", "ß", "Σ", "e\u0301", "ﬁ", "日本", "'s", "'", ".", ",", "|>", "<|", "<|endoftext|>",
             "<|startoftext|>", "a", "B", "9", " ", "\t", "\u00a0", "!", "%", "_", "🙂", "\u0301"]
    texts = ["DENİZLİ, İ.", "x<|endoftext|>y", "<|EndOfText|>"]
    texts += ["".join(rng.choice(signs, int(rng.integers(1, 12)))) for _ in range(4000)]
    ids, starts = packing.token_ids(packing.pa.array(texts), packing.default_tokenizer())
    from tokenizers import Tokenizer

    plain_tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    for text, a, b in zip(texts, starts, [*starts[1:], len(ids)]):
        assert ids[a:b].tolist() == [*plain_tokenizer.encode(text, add_special_tokens=False).ids, 0], repr(text)


def test_packed_sequences_give_the_ids_back(docs, by_id):
    few = docs.where("doc_id < 20")
    pieces = packing.pack_documents(few, packing.default_tokenizer())
    held = {r.sequence_id: r.ids for r in packing.sequences(few, pieces, packing.default_tokenizer()).collect()}
    for r in pieces.collect():
        want = encoded(by_id[r.doc_id])[r.start:r.start + r.length].tolist()
        assert held[r.sequence_id][r.offset:r.offset + r.length] == want


def test_best_fit_takes_the_fullest_bin_that_fits():
    bins, offsets, free = packing.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert bins.tolist() == [0, 1, 0, 1, 1] and offsets.tolist() == [0, 0, 6, 5, 8]
    assert free.tolist() == [0, 0]


def test_packing_of_documents_sorted_by_source_is_as_full_as_of_mixed_ones(spark):
    """Sources of 17 and of 14 tokens fit together, but each meets only itself in its partitions."""
    half = 64_000
    sorted_ = spark.range(0, 2 * half, 1, 32).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") < half, F.repeat(F.lit("the "), 16))
        .otherwise(F.repeat(F.lit("the "), 13)).alias("text"))
    pieces = packing.pack_documents(sorted_, packing.default_tokenizer(), 32)
    found = pieces.agg(F.count("*"), F.countDistinct("doc_id"), F.countDistinct("sequence_id"), F.sum("length"))
    n, ids, bins, tokens = found.first()
    assert n == ids == 2 * half and tokens == 31 * half
    assert bins <= 1.01 * half


def test_pieces_over_half_a_sequence_are_not_passed_on_without_bound(monkeypatch):
    monkeypatch.setattr(packing, "PASSED_ON", 10)
    lengths = np.full(100, 1500)
    out, _ = packing.pack({"length": lengths}, 0, 0, False, 2048)
    assert (~out["finished"]).sum() == 10


# Decontamination

def test_decontamination_finds_what_every_window_finds(spark, small, docs, by_id):
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(docs, items).collect()}
    want = plain.leaks(by_id, {r.item_id: r.text for r in items.collect()})
    assert got.keys() == want.keys() and want
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_decontamination_in_blocks_gives_the_same(spark, small, docs, monkeypatch):
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    whole = sorted(map(tuple, decontaminate.leaks(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 30)
    assert sorted(map(tuple, decontaminate.leaks(docs, items).collect())) == whole


def test_decontamination_of_edited_passages(spark, by_id):
    """Passages with one or two words changed, at a similarity of at least 0.8."""
    rng = np.random.default_rng(3)
    body = [w.decode() for i in range(60) for w in plain.words(by_id[i])]
    items, rows = {}, {}
    for i in range(300):
        at = int(rng.integers(0, len(body) - 70))
        words = body[at:at + int(rng.integers(15, 60))]
        items[i] = " ".join(words)
        edited = list(words)
        for k in rng.integers(0, len(words), int(rng.integers(0, 3))):
            edited[k] = f"changed{k}"
        rows[i] = " ".join([*(f"left{i}_{j}" for j in range(40)), *edited, *(f"right{i}_{j}" for j in range(9))])
    want = plain.leaks(rows, items)
    got = decontaminate.leaks(spark.createDataFrame(list(rows.items()), "doc_id long, text string"),
                              spark.createDataFrame(list(items.items()), "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in got.collect()}
    assert got <= want.keys()
    exact = {k for k, s in want.items() if s == 1}
    assert exact <= got and len(got) >= 0.97 * len(want)


def test_decontamination_of_documents_that_begin_or_end_with_an_item():
    """Every place in the slice finds a document that is an item, or has one at an end."""
    rng = np.random.default_rng(11)
    items = {n: " ".join(f"w{k}" for k in rng.integers(0, 1 << 40, n)) for n in range(27, 201)}
    texts, owners = [], []
    for n, item in items.items():
        rest = " ".join(f"x{k}" for k in rng.integers(0, 1 << 40, 61 + n % 13))
        for text in (item, f"{item} {rest}", f"{rest} {item}", "some other words " * int(rng.integers(2, 9))):
            texts.append(text)
            owners.append(n if item in text else None)
    found = {(r, i): s for r, i, s, *_ in decontaminate.search(
        decontaminate.pa.array(texts), decontaminate.index(list(items), list(items.values())), 0.8)}
    assert found == {(r, n): 1.0 for r, n in enumerate(owners) if n is not None}


def test_decontamination_of_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "one two three"), (2, None), (3, ""), (None, "a text without an id, of some"),
                                   (4, " ".join(plain.LONG.split()[100:900]))], "item_id long, text string")
    found = sorted((r.doc_id or 0, r.item_id or 0) for r in decontaminate.leaks(odd, items).collect())
    assert found == [(0, 0), (8, 4), (9, 1), (9, 1), (10, 1)]
    left = decontaminate.without_leaks(odd, items)
    assert left.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [5, 6, 7, 11, 12]
    assert decontaminate.leaks(none, items).count() == 0
    no_items = items.where("false")
    assert decontaminate.leaks(odd, no_items).count() == 0
    assert decontaminate.without_leaks(odd, no_items).count() == len(plain.ODD)


@pytest.mark.parametrize("items_at_once", [1, 30, 2000])
def test_decontamination_keeps_items_of_one_id_apart(spark, odd, monkeypatch, items_at_once):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", items_at_once)
    items = spark.createDataFrame(
        [(1, "one two three"), (1, "a text without an id, of some more words"), (1, "one two three"),
         (None, "one two three"), (None, "a text without an id, of some more words"), (None, None), (2, "zzz qqq")],
        "item_id long, text string")
    found = Counter((r.doc_id, r.item_id) for r in decontaminate.leaks(odd, items).collect())
    assert found == Counter({(9, 1): 4, (9, None): 2, (10, 1): 2, (10, None): 1, (None, 1): 1, (None, None): 1})


def test_decontamination_compares_a_long_item_as_a_whole(spark):
    rng = np.random.default_rng(8)
    item = [f"w{k}" for k in rng.integers(0, 1 << 40, 1000)]
    edited = [f"e{k}" if k % 97 == 0 else w for k, w in enumerate(item)]
    rows = [(1, " ".join(item[:200])), (2, " ".join(item)), (3, "before " * 30 + " ".join(edited) + " after" * 9),
            (4, " ".join(item[:700]))]
    found = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"),
                                spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert {r.doc_id for r in found} == {2, 3}
    by_doc = {r.doc_id: r for r in found}
    assert by_doc[2].similarity == 1 and (by_doc[2].start, by_doc[2].n_words) == (0, 1000)
    assert abs(by_doc[3].similarity - plain.similarity(plain.bag(" ".join(edited)), plain.bag(" ".join(item)))) < 0.02


# Language

def test_language_on_held_out_rows(docs):
    told = language.predict(docs, language.learned(docs)).join(docs.select("doc_id", "lang"), "doc_id")
    held = told.where(language.fold() == 1).collect()
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in held)


def test_codewords_are_far_apart():
    for n in (2, 3, 4, 6, 12, 40):
        code = language.codewords(n)
        apart = (code[:, None] != code[None]).sum(axis=2)[~np.eye(n, dtype=bool)]
        assert apart.min() >= (1 if n < 3 else code.shape[1] // 4)


def test_language_of_odd_rows(docs, odd, none):
    told = language.predict(odd, language.learned(docs)).collect()
    assert len(told) == len(plain.ODD)
    for r in told:
        assert (r.lang_pred == "und") == (r.doc_id in (5, 6, 7, 11)) and (r.score == 0) == (r.lang_pred == "und")
    assert {r.lang_pred for r in language.predict(odd, language.learned(none)).collect()} == {"und"}
    assert language.predict(none, language.learned(docs)).count() == 0
    one = language.predict(odd, language.learned(odd)).where("doc_id = 10").collect()
    assert [r.lang_pred for r in one] == ["en"]
    assert language.stage(docs.sparkSession, odd, "").columns == odd.columns


def test_language_stage_keeps_all_where_nothing_is_learned(docs, odd):
    without = odd.withColumn("lang", F.lit(None).cast("string"))
    assert sorted(map(repr, language.stage(docs.sparkSession, without, "").collect())) == \
        sorted(map(repr, without.collect()))


def test_language_stage_keeps_the_languages_asked_for(docs):
    kept = language.stage(docs.sparkSession, docs, "", ["en", "de"])
    told = language.predict(docs, language.learned(docs))
    assert sorted(r.doc_id for r in kept.collect()) == \
        sorted(r.doc_id for r in told.where("lang_pred in ('en', 'de')").collect())
    langs = Counter(r.lang for r in kept.collect())
    assert langs["en"] and langs["de"] and langs["fr"] + langs["es"] <= 0.02 * kept.count()


def test_mixed_text_is_ambiguous(spark, docs):
    texts = {r.lang: " ".join(x for (x,) in docs.where(F.col("lang") == r.lang).select("text").limit(3).collect())
             for r in docs.select("lang").distinct().collect()}
    n = min(len(t) for t in texts.values())
    both = spark.createDataFrame([(1, texts["de"][:n] + " " + texts["en"][:n])], "doc_id long, text string")
    r = language.predict(both, language.learned(docs)).first()
    assert {r.lang_pred, r.second} == {"de", "en"}


# Fingerprints

def test_fingerprints_and_edited_texts(docs, by_id):
    rows = {r.doc_id: r for r in merkle.edited(docs).collect()}
    ids = sorted(by_id)
    assert sorted(rows) == ids
    prints = keyed(merkle.fingerprints(docs), "fingerprint")
    for k, i in enumerate(ids):
        text, after = by_id[i] or "", by_id[ids[(k + 1) % len(ids)]] or ""
        half = len(text) // 2
        assert rows[i].n_chars == len(text)
        assert rows[i].edited_sha256 == sha(text[:len(text) - half] + after[:half])
        assert rows[i].fingerprint == prints[i][0]
        assert 0 <= rows[i].near_edited <= 1 and 0 <= rows[i].near_next <= 1
    assert len({(rows[i].fingerprint, by_id[i]) for i in ids}) == len({t for t in by_id.values()}) \
        == len({rows[i].fingerprint for i in ids})
    assert np.mean([r.near_edited > r.near_next for r in rows.values()]) > 0.9


def plain_leaves(text):
    import xxhash

    out = []
    for part in re.split(r"\n+|(?<=[.!?])[ \t]+|(?<=[\u3002\uff01\uff1f])", text or ""):
        if len(part) <= merkle.LONG:
            out.append(part)
            continue
        words, piece = re.split(r"(?<=[\s\u3001\uff0c\uff1b;,|])", part, flags=re.ASCII), []
        for word in words:
            piece.append(word)
            if zlib.crc32(word.encode()) % merkle.PIECE == 0 or len(piece) == merkle.MOST:
                out.append("".join(piece))
                piece = []
        out.append("".join(piece))
    return {xxhash.xxh64(p.encode(), seed=42).hexdigest() for p in out if p}


def test_likeness_is_that_of_plain_leaves(spark, by_id):
    """Also of texts of one line, which are cut by their content."""
    rng = np.random.default_rng(12)
    texts = {i: by_id[i] for i in range(40)}
    texts |= {100 + i: " ".join(f"w{k}" for k in rng.integers(0, 500, 700)) for i in range(5)}
    texts |= {200: "word " * 400, 201: "、".join(f"字{k}" for k in rng.integers(0, 500, 900)), 202: "話" * 900, 203: ""}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = {r.doc_id: r for r in merkle.edited(df).collect()}
    ids = sorted(texts)

    def likeness(a, b):
        x, y = plain_leaves(a), plain_leaves(b)
        return 1.0 if (a or "") == (b or "") else min(len(x & y) / max(1, len(x | y)), 0.999999)

    for k, i in enumerate(ids):
        text, after = texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
        half = len(text) // 2
        assert set(re.findall("[0-9a-f]{16}", re.sub("[0-9a-f]{16}=", "", rows[i].fingerprint.split(":")[1]))) \
            == plain_leaves(text)
        assert abs(rows[i].near_edited - likeness(text, text[:len(text) - half] + after[:half])) < 1e-9
        assert abs(rows[i].near_next - likeness(text, after)) < 1e-9
    # Half of the text stays, so a third of the pieces of both are common, but for chance.
    assert np.mean([rows[i].near_edited for i in range(100, 105)]) > 0.25
    assert rows[200].near_edited > 0 and rows[201].near_edited > 0.15


def test_differing_branches_locate_the_edit(spark):
    lines = [f"line {i} of the text" for i in range(100)]
    changed = [*lines[:40], "an edited line", *lines[41:]]
    a, b = (merkle.fingerprint(F.lit("\n".join(x))) for x in (lines, changed))
    same, differing = spark.range(1).select(merkle.differing(a, a), merkle.differing(b, a)).first()
    assert same == []
    assert sum(len(s.paragraphs) for s in differing) == 1


def test_fingerprints_of_odd_rows(spark, odd, none):
    rows = merkle.edited(odd).collect()
    assert len(rows) == len(plain.ODD)
    assert {r.fingerprint for r in rows if r.doc_id in (5, 6)} == {merkle_of(spark, "")}
    assert merkle.edited(none).collect() == []
    one = merkle.edited(spark.createDataFrame([(1, "abc")], "doc_id long, text string")).collect()
    assert [(r.edited_sha256, r.near_next) for r in one] == [(sha("aba"), 1.0)]
    far = spark.createDataFrame([(i * (1 << 55) + 1, f"text {i}. more {i}.") for i in range(-50, 50)],
                                "doc_id long, text string")
    ordered = sorted(far.collect())
    for r in merkle.edited(far).collect():
        k = [x.doc_id for x in ordered].index(r.doc_id)
        text, after = ordered[k].text, ordered[(k + 1) % len(ordered)].text
        assert r.edited_sha256 == sha(text[:len(text) - len(text) // 2] + after[:len(text) // 2])


def merkle_of(spark, text):
    return spark.range(1).select(merkle.fingerprint(F.lit(text))).first()[0]


# Chat

def test_chat_reads_back_every_conversation(spark, small):
    rows = spark.read.parquet(f"{small}/conversations.parquet").collect()
    by_conv = {}
    for r in sorted(rows):
        by_conv.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    said = "\\### Assistant: </turn> ok"
    by_conv[-7] = [("user", said), ("assistant", said)]
    got = {r.conv_id: r for r in queries.op5_chat_format(spark, small).collect()}
    assert got.keys() == by_conv.keys()
    for i, turns in by_conv.items():
        learned = "".join(t for role, t in turns if role == "assistant")
        assert got[i].n_turns == len(turns) and got[i].loss_chars == len(learned)
        assert got[i].turns_sha256 == sha("".join(f"{role}\n{t}\n" for role, t in turns))
        assert got[i].loss_sha256 == sha(learned)


def test_chat_matches_sql(spark, small):
    _, n, verdict = compare(spark, duck(small), small, queries.op5_chat_format,
                            queries.oracle_sql()["op5_chat_format"])
    assert n and verdict == "ok"


def test_chat_escapes_and_odd_rows(spark):
    texts = ["\\", "###", "\\h", "####", "</turn>\n", "</tu</turn>rn>", "\\### Assistant: </turn> ok", "", None,
             "ü\n\n### x: y</turn>\n\\b\\t\\"]
    rows = [(1, i, r, t) for i, (t, r) in enumerate(zip(texts, ["assistant", "user", "a: b", "\\c:"] * 3))]
    rows += [(None, 0, None, "no conversation"), (None, None, "assistant", "no turn"),
             (2, 5, "user", "tie b"), (2, 5, "user", "tie a"), (2, 5, "user", "tie a")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    texts_of = chat.kept(chat.formatted(chat.by_turn(table.selectExpr("*", "1 AS leaf", "2 AS tree"))))
    got = {}
    for r in sorted(chat.read_back(texts_of).collect(), key=lambda r: (r.tree, r.turn)):
        got.setdefault(r.tree, []).append((r.role, r.text, r.masked))
    want = [(r, t or "", (t or "") if r == "assistant" else None) for _, _, r, t in rows[:len(texts)]]
    assert got[1] == want
    assert got[chat.NO_ID] == [("assistant", "no turn", "no turn"), ("", "no conversation", None)]
    assert [t for _, t, _ in got[2]] == ["tie a", "tie a", "tie b"]
    for r in texts_of.collect():
        spans = [r.formatted[s.start:s.start + s.length] for s in r.loss_spans]
        assert len(spans) == sum(m is not None for _, _, m in got[r.tree])
    assert chat.formatted(chat.by_turn(table.where("false"))).count() == 0


def test_chat_ranks_the_branches_of_a_tree(spark):
    #      1 - 2 - 3 (0.9)
    #        \ 4 (0.2) - 5 (0.1)     6 - 7 - 6 is a circle, 9 answers an unknown message
    rows = [(1, 1, None, "user", "q", None), (1, 2, 1, "assistant", "a", 0.5), (1, 3, 2, "user", "b", 0.9),
            (1, 4, 1, "assistant", "c", 0.2), (1, 5, 4, "user", "d", 0.1), (1, 6, 7, "user", "x", 1.0),
            (1, 7, 6, "user", "y", 1.0), (2, 9, 77, "user", "lost", 0.0)]
    messages = spark.createDataFrame(rows, "tree long, id long, parent long, role string, text string, score double")
    paths = {}
    for r in chat.chosen_paths(messages, None).collect():
        paths.setdefault((r.tree, r.rank), []).append((-r.up, r.node))
    assert {k: [n for _, n in sorted(v)] for k, v in paths.items()} == {
        (1, 1): [1, 2, 3], (1, 2): [1, 4, 5], (2, 1): [9]}
    best = {r.tree: r.formatted for r in chat.formatted(messages).collect()}
    assert best == {1: "### user: q</turn>\n### assistant: a</turn>\n### user: b</turn>\n",
                    2: "### user: lost</turn>\n"}


# Near duplicates

def test_near_duplicates_against_all_pairs(docs, by_id):
    got = keyed(near_dups.near_duplicates(docs), "class_id")
    assert {i: g for i, (g,) in got.items()} == plain.groups(by_id)


def test_large_groups_and_chains(spark):
    """A group of copies of copies, texts that are alike only by way of others, and a bucket of texts that
    share most words without being near."""
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(200)]
    rows = {i: " ".join(base) for i in range(80)}
    for i in range(80, 200):
        w = list(base)
        w[int(rng.integers(0, 200))] = f"x{i}"
        rows[i] = " ".join(w)
    chain = [f"c{i}" for i in range(100)]
    for i in range(200, 230):  # each drops the first words of the one before and adds others
        k = 4 * (i - 200)
        rows[i] = " ".join((chain + [f"d{j}" for j in range(200)])[k:k + 100])
    for i in range(230, 330):
        rows[i] = " ".join([*(f"s{j}" for j in range(70)), *(f"o{i}_{j}" for j in range(14))])
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(7)
    got = keyed(near_dups.near_duplicates(df), "class_id")
    assert {i: g for i, (g,) in got.items()} == plain.groups(rows)


def test_signature_agreement_is_the_weighted_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 40, 300).astype(np.uint64)
    a = rng.integers(1, 9, 300)
    b = np.where(rng.random(300) < 0.5, a, rng.integers(1, 40, 300))
    row = np.repeat([0, 1], 300)
    sig = near_dups.signatures(2, row, np.r_[x, x], np.r_[a, b], 4000)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 0.03


def test_near_duplicates_of_odd_rows(spark, odd, none):
    rows = near_dups.near_duplicates(odd).collect()
    assert len(rows) == len(plain.ODD)
    got = {r.doc_id: (r.exact_id, r.class_id) for r in rows}
    assert got[5] == got[6] == (5, 5) and got[9] == got[10] == (9, 9) and got[7] == (7, 7)
    left = near_dups.stage(spark, odd, "")
    assert left.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 5, 7, 8, 9, 11, 12]
    assert near_dups.near_duplicates(none).count() == 0
    near = " ".join(f"n{i}" for i in range(60))
    same_id = spark.createDataFrame([(1, near), (1, near + " more"), (1, "something else"), (2, near)],
                                    "doc_id long, text string")
    assert sorted(r.text for r in near_dups.stage(spark, same_id, "").collect()) in (
        [near, "something else"], [near + " more", "something else"])


# Language model

def test_lm_base_score_and_model(spark, docs, by_id, monkeypatch):
    monkeypatch.setattr(lm_score, "HEAD", 500)
    monkeypatch.setattr(lm_score, "PART_BYTES", 20_000)  # several passes
    rows = {r.doc_id: r for r in lm_score.score(docs, docs.where(lm_score.fold() != 0)).collect()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {i: [*re.findall("[^\x20\x09-\x0D]+", (t or "").translate(lower)), None] for i, t in by_id.items()}
    held = {i for i in by_id if zlib.crc32(str(i).encode()) % 10 == 0}
    count = Counter(t for i in by_id if i not in held for t in tokens[i])
    n, v = sum(count.values()), len(count)
    for i, own in tokens.items():
        base = sum(log10((count[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own)
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(t in count for t in own), n)
        assert abs(r.base_score - base) < 1e-6 * abs(base) and r.score < 0
    # Known texts get likelier by pairs; on held-out texts the model is at least as good as the base.
    assert sum(r.score - r.base_score for i, r in rows.items() if i not in held) > 0
    assert sum(rows[i].score - rows[i].base_score for i in held) > 0


def test_lm_scores_do_not_depend_on_the_parts_of_the_pairs(docs, monkeypatch):
    """A word after the text start and boilerplate pairs lie in one part only."""
    scores = []
    some = docs.select("doc_id", F.concat(F.lit("always the same notice "), "text").alias("text"))
    for size in (lm_score.PART_BYTES, 20_000):
        monkeypatch.setattr(lm_score, "PART_BYTES", size)
        scores.append({r.doc_id: r.score for r in lm_score.score(some, some.where(lm_score.fold() != 0)).collect()})
    assert scores[0].keys() == scores[1].keys()
    assert all(abs(s - scores[1][i]) < 1e-6 * abs(s) for i, s in scores[0].items())


def test_lm_scores_do_not_depend_on_the_bytes_of_the_words(docs, monkeypatch):
    scores = []
    for size in (lm_score.WORD_BYTES, 3_000):
        monkeypatch.setattr(lm_score, "WORD_BYTES", size)
        scores.append({r.doc_id: r.score for r in lm_score.score(docs, docs.where(lm_score.fold() != 0)).collect()})
    assert scores[0].keys() == scores[1].keys()
    assert all(abs(s - scores[1][i]) < 1e-6 * abs(s) for i, s in scores[0].items())


def test_log_frequency_filter_gives_counts_back():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
    counts = rng.geometric(0.02, 20_000)
    part = lm_score.segment(keys, counts)
    f = lm_score.Filter(1, 0, np.array([0]), np.array([8 * len(part)], np.uint64), np.frombuffer(part, np.uint8))
    found = f.levels(keys)
    assert (found >= lm_score.levels_of(counts)).all() and (found == lm_score.levels_of(counts)).mean() > 0.95
    assert (f.levels(rng.integers(0, 1 << 63, 20_000).astype(np.uint64)) > 0).mean() < 0.05
    assert lm_score.counts_of(lm_score.levels_of(np.array([1, 2, 3]))).tolist() == [1, 2, 3]


def test_lm_of_odd_rows(odd, none):
    rows = lm_score.score(odd, odd).collect()
    assert len(rows) == len(plain.ODD)
    assert all(r.n_known == r.n_tokens and np.isfinite(r.score) for r in rows)
    assert [r.n_tokens for r in rows if r.doc_id in (5, 6, 7)] == [1, 1, 1]
    unlearned = lm_score.score(odd, none).collect()
    assert len(unlearned) == len(plain.ODD) and all(r.n_known == 0 and r.train_tokens == 0 for r in unlearned)
    assert lm_score.score(none, odd).count() == 0


# Licences

def test_license_headers_and_inheritance(spark):
    mit = "Released under the MIT License."
    apache = "Licensed under the Apache License, Version 2.0."
    rows = [("a/LICENSE", mit), ("a/x.txt", "some words of a text"), ("a/b/y.txt", "others\nand more\nof them\n" + apache),
            ("a/b/c/z.txt", "nothing to see here"), ("a/b/d/COPYING", apache), ("a/b/d/e/w.txt", "more words"),
            ("q/v.txt", "the license of this is under the table"), (None, mit), ("a/n.txt", None), ("top.txt", "")]
    got = {r.path: (r.license, r.how, r.from_path) for r in licenses.scan(
        spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {
        "a/LICENSE": ("MIT", "file", None), "a/x.txt": ("MIT", "inherited", "a/LICENSE"),
        "a/b/y.txt": ("Apache-2.0", "header", None), "a/b/c/z.txt": ("MIT", "inherited", "a/LICENSE"),
        "a/b/d/COPYING": ("Apache-2.0", "file", None), "a/b/d/e/w.txt": ("Apache-2.0", "inherited", "a/b/d/COPYING"),
        "q/v.txt": (None, None, None), None: ("MIT", "file", None), "a/n.txt": ("MIT", "inherited", "a/LICENSE"),
        "top.txt": (None, None, None)}


def test_wrapped_headers_licence_files_and_notices_in_a_line(spark):
    """Headers over several lines, whole licence texts, and a notice inside a long line."""
    code = "\n".join(f"value{i} = compute{i}(left{i}, right{i})" for i in range(120))
    prose = " ".join(f"word{i} tells of{i} nothing" for i in range(80))
    gnu = ("# This program is free software{0} you can redistribute it and/or modify\n# it under the terms of the "
           "GNU {1} as published by\n# the Free Software Foundation, either version {2} of the License, or\n"
           "# (at your option) any later version.\n")
    mit, bsd, bsd3 = (textwrap.fill(max((t for n, t in licenses.TEMPLATES if n == name), key=len), 70)
                      for name in ("MIT", "BSD-2-Clause", "BSD-3-Clause"))
    mit = "MIT License\n\nCopyright (c) 2020 Some Author\n\n" + mit
    gpl = ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C)"
           " 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy\n" + prose + "\n" + prose)
    rows = [("s/gpl.py", gnu.format(":", "General Public License", 3) + code),
            ("s/gpl2.py", gnu.format(";", "General Public License", 2) + code),
            ("s/agpl.py", gnu.format(":", "Affero General Public License", 3) + code),
            ("s/lgpl.py", gnu.format(":", "Lesser General Public License", 3) + code),
            ("s/bsd.py", bsd + "\n" + code), ("s/bsd3.py", bsd3 + "\n" + code), ("s/code.py", code),
            ("s/line.txt", f"{prose} Released under the MIT License. {prose}"),
            ("m/LICENSE", mit), ("m/x.py", code), ("b/LICENSE", bsd), ("b/x.py", code),
            ("g/COPYING", gpl), ("g/d/x.py", code)]
    got = {r.path: (r.license, r.how) for r in licenses.scan(
        spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {
        "s/gpl.py": ("GPL-3.0", "header"), "s/gpl2.py": ("GPL-2.0", "header"), "s/agpl.py": ("AGPL-3.0", "header"),
        "s/lgpl.py": ("LGPL-3.0", "header"), "s/bsd.py": ("BSD-2-Clause", "header"),
        "s/bsd3.py": ("BSD-3-Clause", "header"), "s/code.py": (None, None), "s/line.txt": ("MIT", "header"),
        "m/LICENSE": ("MIT", "file"), "m/x.py": ("MIT", "inherited"), "b/LICENSE": ("BSD-2-Clause", "file"),
        "b/x.py": ("BSD-2-Clause", "inherited"), "g/COPYING": ("GPL-3.0", "file"), "g/d/x.py": ("GPL-3.0", "inherited")}


def test_license_lines_of_the_documents(spark, small, by_id):
    rows = queries.op8_license_scan(spark, small).collect()
    found = {r.doc_id for r in rows if r.how in ("file", "header")}
    assert found == {i for i, t in by_id.items() if re.search("(?i)licen[sc]ed? ", t or "")
                     or re.search("(?i)license", t or "")}
    assert len(rows) == len(by_id)


def test_licenses_of_odd_rows(odd, none):
    assert licenses.scan(licenses.placed(odd), "doc_id").count() == len(plain.ODD)
    assert licenses.scan(licenses.placed(none), "doc_id").count() == 0


# Substring dedup

def test_substring_dedup_matches_sql(spark, small):
    _, n, verdict = compare(spark, duck(small), small, queries.op9_substring_dedup,
                            queries.oracle_sql()["op9_substring_dedup"])
    assert n and verdict == "ok"


def test_substring_dedup_of_odd_rows(spark, odd, none):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(1, f"{passage} one"), (2, f"two\n{passage}  {passage}"), (2, f"another {passage}"), (3, passage),
            (4, passage.replace(" ", "\u00a0")), (None, f"{passage} null"), (7, " ".join(["same"] * 100)),
            (8, " ".join(["same"] * 50)), (9, " ".join(f"p{i}" for i in range(12)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = Counter((r.doc.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(df).collect())
    assert got == Counter([
        (1, 31, 0, f"{passage} one"), (2, 61, 60, "two"), (2, 31, 30, "another"), (3, 30, 30, ""),
        (4, 1, 0, passage.replace(" ", "\u00a0")), (None, 31, 30, "null"), (7, 100, 0, " ".join(["same"] * 100)),
        (8, 50, 50, ""), (9, 12, 0, " ".join(f"p{i}" for i in range(12)))])
    out = substring.stage(spark, odd, "")
    assert out.columns == odd.columns and out.count() == len(plain.ODD)
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in odd.collect()}
    assert substring.remove_repeats(none).count() == 0


def test_windows_of_one_hash_are_told_apart():
    codes = np.array([1, 2, 1, 3, 1, 2], np.uint64)
    at = np.array([0, 2, 4])
    dup = substring.repeated(np.zeros(3, np.uint64), np.array([5, 6, 7]), at, codes, 2)
    assert dup.tolist() == [False, False, True]


# Quality

def test_quality_on_held_out_rows(spark, small, docs):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    rows = quality.score(docs, quality.fit(docs, labels)).join(labels, "doc_id").where(quality.fold() == 0).collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    assert all(r.predicted == (r.score >= 0.3) for r in rows)


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(9, 1), (9, 0), (8, 0), (None, 1), (5, None), (99, 1)],
                                   "doc_id long, quality int")
    for known in (labels, labels.where("false")):
        rows = quality.score(odd, quality.fit(odd, known)).collect()
        assert len(rows) == len(plain.ODD) and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id in (5, 6, 7)}) == 1
    assert {r.score for r in quality.score(odd, None).collect()} == {0.5}
    assert quality.score(none, quality.fit(none, labels)).count() == 0
