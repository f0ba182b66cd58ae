"""Retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewflow.operators import retrieval as rv
from reviewflow.operators.vector_index import MOST_LISTS, build_index, search_index
from reviewflow.plans.registry import query, rounded
from reviewflow.session import scratch_dir

_TOP_THREADS = """
    SELECT query_id, vec_id, rank, email_thread, round(similarity, 6) AS similarity
    FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id
                ORDER BY similarity DESC, vec_id) AS INT) AS rank
          FROM (SELECT q.vec_id AS query_id, e.vec_id, e.email_thread,
                    round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9)
                        AS similarity
                FROM email_threads q, email_threads e WHERE q.vec_id <> e.vec_id))
    WHERE rank <= 5"""


def named(t, found):
    return rounded(found.join(t["email_threads"].select("vec_id", "email_thread"), "vec_id"), "similarity")


query("v1_top_k_threads", _TOP_THREADS)(
    lambda t: named(t, rv.top_k_threads(t["email_threads"], t["email_threads"], 5, skip_self=True)))


def indexed(t, probes):
    path = scratch_dir(t.spark, "threads")
    build_index(t["email_threads"], path)
    return search_index(t["email_threads"], path, 5, probes, skip_self=True)


# All lists of the index probed: exact.
query("v1_index_all_lists", _TOP_THREADS)(lambda t: named(t, indexed(t, MOST_LISTS)))


def thread_records(t):
    """Threads with gaps: no client for label 0, no description for label 1."""
    return t["embeddings"].select(
        "vec_id", F.concat(F.lit("user"), "vec_id").alias("sender"),
        F.when(F.col("label") != 0, F.concat(F.lit("client "), "label")).alias("client"),
        F.concat(F.lit("thread "), "vec_id").alias("email_thread"),
        F.when(F.col("label") != 1, F.lit("about")).alias("description"),
        F.col("embedding").alias("$vector"))


_MISSING = """CASE label WHEN 0 THEN 'client' WHEN 1 THEN 'description' ELSE '' END"""
query("u1_missing_fields", f"SELECT vec_id, {_MISSING} AS missing FROM embeddings")(
    lambda t: thread_records(t).select("vec_id", F.array_join(rv.missing_fields(
        rv.present_fields(thread_records(t), rv.THREAD_FIELDS)), ",").alias("missing")))
query("v2_valid_threads", """
    SELECT vec_id, 'user' || vec_id AS sender, 'client ' || label AS client,
        'thread ' || vec_id AS email_thread FROM embeddings WHERE label NOT IN (0, 1)""")(
    lambda t: rv.valid_threads(thread_records(t))[0]
    .select("vec_id", "sender", "client", "email_thread"))
query("v2_rejected_threads",
      f"SELECT vec_id, {_MISSING} AS missing FROM embeddings WHERE label IN (0, 1)")(
    lambda t: rv.valid_threads(thread_records(t))[1]
    .select("vec_id", F.array_join("missing", ",").alias("missing")))

_WORDS = r"list_distinct(list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''))"
query("j10_match_client", f"""
    WITH mail_words AS (SELECT message_id, unnest({_WORDS.format('body')}) AS word FROM mails),
    folder_words AS (SELECT item_id, text, unnest({_WORDS.format('text')}) AS word FROM benchmark),
    shared AS (SELECT message_id, item_id, text, CAST(count(*) AS INT) AS shared_words
        FROM mail_words JOIN folder_words USING (word) GROUP BY ALL),
    best AS (SELECT *, row_number() OVER (PARTITION BY message_id
            ORDER BY shared_words DESC, item_id) AS n FROM shared)
    SELECT mails.message_id, item_id AS client_folder_id, text AS client_name, shared_words,
        item_id IS NOT NULL AS client_matched
    FROM mails LEFT JOIN best ON mails.message_id = best.message_id AND n = 1""")(
    lambda t: rv.match_client(t["mails"], t["benchmark"].select(
        F.col("item_id").alias("folder_id"), F.col("text").alias("name"))))

_DOCS = """
    SELECT p_partkey AS document_id, p_brand AS folder_id, CASE p_type
        WHEN 'ECONOMY' THEN concat('Final Brief v', p_size % 3) WHEN 'PROMO' THEN concat('Guest bio v', p_size)
        WHEN 'LARGE' THEN concat('Angles v', p_size) ELSE p_name END AS name FROM {part}"""
_ASKS = """
    SELECT message_id, CASE WHEN message_id % 10 <> 0
            THEN concat('Brand#', message_id % 40) END AS client_folder_id,
        concat(body, CASE message_id % 3 WHEN 0 THEN ' Please send a bio'
            WHEN 1 THEN ' Which angles and bio?' ELSE '' END) AS body FROM {mails}"""


def folder_docs(t):
    """Parts as documents; even brands hold no final paper."""
    docs = t.spark.sql(_DOCS, part=t["part"])
    return docs.filter(~(F.col("folder_id").rlike("[02468]$") & F.col("name").startswith("Final")))


query("j11_pick_document", f"""
    WITH docs AS (SELECT * FROM ({_DOCS.format(part='part')})
        WHERE NOT (regexp_matches(folder_id, '[02468]$') AND starts_with(name, 'Final'))),
    asks AS ({_ASKS.format(mails='mails')}),
    ranked AS (SELECT message_id, document_id, name, count(*) OVER (PARTITION BY message_id) AS found,
            row_number() OVER (PARTITION BY message_id ORDER BY
                CASE WHEN contains(lower(name), 'final brief') OR contains(lower(name), 'final draft')
                        THEN 0
                    WHEN contains(lower(body), 'bio') AND contains(lower(name), 'bio') THEN 1
                    WHEN (contains(lower(body), 'angle') OR contains(lower(body), 'talking point'))
                        AND (contains(lower(name), 'angle') OR contains(lower(name), 'talking point'))
                        THEN 1
                    ELSE 2 END,
                coalesce(TRY_CAST(regexp_extract(lower(name), '\\bv(\\d+)', 1) AS INT), 0) DESC,
                document_id) AS n
        FROM asks JOIN docs ON client_folder_id = folder_id)
    SELECT asks.message_id, client_folder_id, document_id AS selected_document_id,
        name AS selected_document_name, CAST(coalesce(found, 0) AS INT) AS documents_found,
        CASE WHEN client_folder_id IS NULL THEN 'No matching client folder found'
            WHEN document_id IS NULL THEN 'No documents found in the client folder'
            ELSE 'Success' END AS extraction_status
    FROM asks LEFT JOIN ranked ON asks.message_id = ranked.message_id AND n = 1""")(
    lambda t: rv.pick_document(folder_docs(t), t.spark.sql(_ASKS, mails=t["mails"])).drop("body"))
