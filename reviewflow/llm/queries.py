"""The queries of the operators: each applies one to a whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewflow.llm import (chat, decontaminate, divergence, language, licenses, lm_score, merkle, near_dups,
                             packing, quality, spelling, substring, topk)

_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, packing.default_tokenizer())


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    told = language.predict(docs.select("doc_id", "text"), language.learned(docs))
    return told.select("doc_id", (language.fold() == 1).alias("held_out"), "lang_pred", "score", "second",
                       "ambiguous")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edited(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    texts = chat.formatted(chat.by_turn(rows.union(extra)))
    texts = chat.kept(texts)
    return chat.digests(texts).select(
        F.when(F.col("tree") != chat.NO_ID, F.col("tree")).alias("conv_id"), "n_turns", "turns_sha256",
        "loss_chars", "loss_sha256", "formatted_chars")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lm_score.score(docs, docs.where(lm_score.fold() != 0))
    return scored.withColumn("held_out", lm_score.fold() == 0)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return licenses.scan(licenses.placed(docs), "doc_id")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.remove_repeats(docs).select(
        "doc.doc_id", "n_words", "n_removed", "kept_sha256")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality.score(docs, model).select(
        "doc_id", (quality.fold() == 0).alias("held_out"), "score", "predicted")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spelling.runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    run = F.col("run")
    code = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), run))
    # Every 97th occurrence loses a letter, chosen by the same hash.
    words = runs.select("run", code.alias("code")).select(
        F.when(F.col("code") % 97 == 0, spelling.without_letter(run, F.col("code") % F.length(run)))
         .otherwise(run).alias("word"))
    return spelling.variants(spelling.counted(words))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents").select("lang", "source", "text"))


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.nearest(vectors.where("vec_id % 50 = 0"), vectors)


_ESCAPED = r"replace(replace(replace({0}, '\', '\b'), '</turn>', '\t'), '###', '\h')"
_SQL["op5_chat_format"] = rf"""
WITH extra(conv_id, turn, role, text) AS (
  VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL FROM extra))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))
         AS loss_sha256,
       CAST(sum(length('### : </turn>') + 1 + length(replace({_ESCAPED.format("role")}, ':', '\c'))
                + length({_ESCAPED.format("text")})) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id"""

_SQL["op9_substring_dedup"] = """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'),
                             lambda x: x <> '') AS words FROM documents),
win AS (
  SELECT doc_id, i, list_slice(words, i, i + 12) AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13)),
dup AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS least FROM win)
  WHERE doc_id > least),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM dup),
word AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM word ANTI JOIN gone USING (doc_id, i)
  GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(words) AS n_words, coalesce(n, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SQL["op11_spelling_variants"] = f"""
WITH RECURSIVE crc_step(t) AS (
  SELECT list(list_reduce(list_prepend(i, range(8)),
                          lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
              ORDER BY i) FROM range(256) AS r(i)),
run AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS keyed, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  GROUP BY ALL),
bytes AS (
  SELECT run, n, flatten(list_transform(range(1, length(keyed) + 1), lambda i:
    CASE WHEN unicode(keyed[i]) < 128 THEN [unicode(keyed[i])::BIGINT]
         ELSE [195::BIGINT, unicode(keyed[i])::BIGINT - 64] END)) AS b FROM run),
coded AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda c, x:
    xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS h FROM bytes, crc_step),
word AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT n, CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word
    FROM coded) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
gap AS (
  SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM word)),
pair AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM gap a JOIN gap b USING (i, rest) WHERE a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM gap a JOIN word b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM gap a JOIN word b ON a.rest = b.word),
best AS (
  SELECT word, n, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n
  FROM pair GROUP BY word, n),
link AS (
  SELECT word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form,
         CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n
  FROM word w LEFT JOIN best USING (word)),
chain(word, here, following) AS (
  SELECT word, word, form FROM link
  UNION ALL SELECT c.word, l.word, l.form FROM chain c JOIN link l ON c.following = l.word)
SELECT link.word, form, here AS root, n, n_near, form_n
FROM link JOIN chain ON link.word = chain.word AND following IS NULL"""

_SQL["op12_source_divergence"] = rf"""
WITH doc AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
use AS (SELECT row, lang, source, unnest(terms) AS term FROM doc),
kept AS (SELECT lang, term FROM use GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
here AS (SELECT DISTINCT lang, source FROM doc),
cell AS (SELECT lang, source, term, count(*) AS c FROM use JOIN kept USING (lang, term) GROUP BY ALL),
dense AS (
  SELECT here.lang, here.source, kept.term, coalesce(c, 0)::HUGEINT AS c
  FROM here JOIN kept USING (lang) LEFT JOIN cell USING (lang, source, term)),
p AS (
  SELECT *, 1 + (1000000000 * (c + 2)) // (sum(c) OVER g + 2 * count(*) OVER g) AS p
  FROM dense WINDOW g AS (PARTITION BY lang, source)),
whole AS (SELECT lang, term, sum(c)::HUGEINT AS c FROM dense GROUP BY ALL),
q AS (
  SELECT lang, term, 1 + (1000000000 * (c + 2)) // (sum(c) OVER g + 2 * count(*) OVER g) AS q
  FROM whole WINDOW g AS (PARTITION BY lang)),
pair AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
term AS (
  SELECT p.lang, p.source, term AS item, ((p - q) * (p - q)) // (p + q) AS value
  FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM here a JOIN here b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL SELECT lang, source, 'term', item, value FROM term)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM ranked QUALIFY part = 'pair' OR rank <= 10"""

_SQL["op13_exact_top_k"] = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id,
         CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON len(q.e) = len(c.e) AND q.row <> c.row WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
FROM scored WINDOW w AS (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST) QUALIFY rank <= 5"""


QUERIES: list[Callable[[SparkSession, str], DataFrame]] = [
    op1_best_fit_packing, op2_decontamination, op3_language_id, op4_fingerprints, op5_chat_format,
    op6_near_duplicates, op7_lm_score, op8_license_scan, op9_substring_dedup, op10_quality,
    op11_spelling_variants, op12_source_divergence,
    op13_exact_top_k]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {fn.__name__: fn for fn in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
