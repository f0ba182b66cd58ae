"""Similar threads, client folders and documents."""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewflow.operators.joins import block_count, blocked_pairs, send_if_small

# Query vectors that may be sent to every executor: rows and bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 16_384, 64 * 1024 * 1024
VECTOR_BLOCK = 4096
# Passes over the threads that a large batch of queries may take, and how much larger they may become.
MOST_PASSES, LARGER_PASS = 64, 8
# Similarities a task holds at once: 16 MB. Pairs of vectors that it multiplies in full at once.
HELD_SIMILARITIES, HELD_PAIRS = 4_000_000, 65_536
# Pairs of mail and folder that one task counts shared words of.
TASK_PAIRS = 2_000_000
# Similarities that agree to this many digits are a tie, which the lower id wins.
TIE_DIGITS = 9

THREAD_FIELDS = ("sender", "client", "email_thread", "description", "$vector")


def _unit(vectors) -> np.ndarray:
    rows = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length == 0, np.nan, length)


def _best(query_ids, query_units, thread_ids, thread_units, k: int, skip_self: bool):
    """The k best threads of each query as columns: query id, thread id, similarity.

    Works through the queries a few at a time, so the similarities held at once stay small. Vectors without a
    direction have no similarity.
    """
    order = np.argsort(thread_ids, kind="stable")
    order = order[np.isfinite(thread_units[order]).all(axis=1)]
    ids, units = thread_ids[order], thread_units[order]
    asked = np.isfinite(query_units).all(axis=1)
    query_ids, query_units = query_ids[asked], query_units[asked]
    step = max(1, HELD_SIMILARITIES // max(1, len(ids)))
    rough = units.astype(np.float32)
    parts = [_best_of_few(query_ids[i:i + step], query_units[i:i + step], ids, units, rough, k, skip_self)
             for i in range(0, max(1, len(query_ids)), step)]
    return tuple(np.concatenate(columns) for columns in zip(*parts))


def _best_of_few(query_ids, query_units, ids, units, rough, k: int, skip_self: bool):
    """Rough products in single precision rule out the pairs that cannot be among the best, by more than their
    error; the others are worked out in full."""
    sims = query_units.astype(np.float32) @ rough.T
    if skip_self:
        low, high = (np.searchsorted(ids, query_ids, side) for side in ("left", "right"))
        own = np.repeat(np.arange(len(low)), high - low)
        sims[own, np.arange(len(own)) - np.repeat(np.cumsum(high - low) - high, high - low)] = -np.inf
    if len(ids) > k:
        error = 2.0 ** -23 * (units.shape[1] + 8)
        floor = _kth(sims, k) - np.float32(2 * error)
        at, col = np.divmod(np.flatnonzero(sims >= floor[:, None]), len(ids))
        known = sims[at, col] > -2
        at, col = at[known], col[known]
    else:
        at, col = np.nonzero(sims > -2)
    value = np.empty(len(at))
    for i in range(0, len(at), HELD_PAIRS):
        few = slice(i, i + HELD_PAIRS)
        value[few] = np.round(np.einsum("ij,ij->i", query_units[at[few]], units[col[few]]), TIE_DIGITS)
    by = np.lexsort((col, -value, at))
    at, col, value = at[by], col[by], value[by]
    keep = np.arange(len(at)) - np.searchsorted(at, at, side="left") < k
    return query_ids[at[keep]], ids[col[keep]], value[keep]


def _kth(sims: np.ndarray, k: int) -> np.ndarray:
    """At most the k-th largest of each row: that of the largest of groups of columns, of which there are
    enough to come close to it."""
    groups = max(128, 16 * k)
    width = sims.shape[1] // groups
    if width > 1:
        sims = sims[:, :width * groups].reshape(len(sims), width, groups).max(axis=1)
    return np.partition(sims, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k]


def _kept(found: pd.DataFrame, thread_id: str, k: int) -> pd.DataFrame:
    """The k best rows of each query."""
    found = found.sort_values(["query_id", "similarity", thread_id], ascending=[True, False, True])
    return found[found.groupby("query_id").cumcount() < k]


def _schema(queries: DataFrame, threads: DataFrame, query_id: str, thread_id: str) -> str:
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    return (f"query_id {kind(queries, query_id)}, {thread_id} {kind(threads, thread_id)}, "
            "similarity double")


def top_k_threads(queries: DataFrame, threads: DataFrame, k: int = 2, query_id: str = "vec_id",
                  thread_id: str = "vec_id", vector: str = "embedding", skip_self: bool = False,
                  broadcast_rows: int = BROADCAST_ROWS, block: int = VECTOR_BLOCK) -> DataFrame:
    """The k threads with the highest cosine similarity to each query vector.

    A batch of queries small enough to send (rows and bytes are checked) goes to every executor,
    which keeps the best k of each query per partition; threads are not shuffled. A larger batch goes in
    some passes, and one beyond ``MOST_PASSES`` is compared block by block. In any case a task returns at
    most k rows per query, and the best k of those remain.
    """
    schema = _schema(queries, threads, query_id, thread_id)
    # Vectors of another length than most threads have cannot be compared.
    length = threads.agg(F.mode(F.size(vector))).first()[0]
    queries, threads = (df.filter(F.size(vector) == F.lit(length)) for df in (queries, threads))

    def searched(few: pd.DataFrame) -> DataFrame:
        sent = threads.sparkSession.sparkContext.broadcast(
            (few[query_id].to_numpy(), _unit(few[vector])))

        def partition(batches):
            query_ids, units = sent.value
            kept = None
            for pdf in batches:
                if pdf.empty:
                    continue
                found = pd.DataFrame(dict(zip(("query_id", thread_id, "similarity"), _best(
                    query_ids, units, pdf[thread_id].to_numpy(), _unit(pdf[vector]), k,
                    skip_self))))
                kept = _kept(found if kept is None else pd.concat([kept, found]), thread_id, k)
            if kept is not None:
                yield kept

        return threads.select(thread_id, vector).mapInPandas(partition, schema)

    # Half a pass on average leaves room for chance.
    n = queries.count()
    held = min(broadcast_rows, BROADCAST_BYTES // (8 * max(1, length or 1)))
    passes = -(-2 * n // held) if held and n > held else 1
    # Beyond that many passes they become larger, while their bytes allow it.
    larger = min(LARGER_PASS * broadcast_rows, BROADCAST_BYTES // (8 * max(1, length or 1)))
    if passes > MOST_PASSES and -(-2 * n // max(1, larger)) <= MOST_PASSES:
        passes = MOST_PASSES
    if not n:
        return threads.sparkSession.createDataFrame([], schema + ", rank int")
    if held and passes <= MOST_PASSES:
        place = F.pmod(F.xxhash64(query_id), F.lit(passes))
        parts = (queries.select(query_id, vector).filter(place == i).toPandas() for i in range(passes))
        found = reduce(DataFrame.union, [searched(p) for p in parts if not p.empty])
    else:
        blocks = (block_count(queries, block), block_count(threads, block))

        def compare(q, th):
            if q.empty or th.empty:
                return pd.DataFrame({"query_id": [], thread_id: [], "similarity": []})
            return pd.DataFrame(dict(zip(("query_id", thread_id, "similarity"), _best(
                q["_query"].to_numpy(), _unit(q[vector]), th[thread_id].to_numpy(),
                _unit(th[vector]), k, skip_self))))

        found = blocked_pairs(
            queries.select(F.col(query_id).alias("_query"), vector),
            threads.select(thread_id, vector), F.col("_query"), F.col(thread_id), blocks,
            compare, schema)
    return _top(found, thread_id, k)


def _top(found: DataFrame, thread_id: str, k: int) -> DataFrame:
    """Best k per query of the candidates; partial ranks cut them before the shuffle."""
    from pyspark.sql import Window

    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.asc(thread_id))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def missing_fields(present: Column, required=THREAD_FIELDS) -> Column:
    """Required names that are not among the present ones."""
    return F.array_except(F.array(*[F.lit(f) for f in required]), present)


def present_fields(df: DataFrame, names) -> Column:
    """Names of the given columns that hold a value in the row."""
    held = F.array(*[F.when(F.col(f"`{n}`").isNotNull(), F.lit(n)) if n in df.columns
                     else F.lit(None).cast("string") for n in names])
    return F.filter(held, lambda n: n.isNotNull())


def valid_threads(df: DataFrame, required=THREAD_FIELDS, dimension: int | None = None,
                  vector: str = "$vector") -> tuple[DataFrame, DataFrame]:
    """Threads with every required field, and the rejected rows with what they miss.

    With ``dimension``, a vector of another length counts as missing.
    """
    missing = missing_fields(present_fields(df, required), required)
    if dimension is not None and vector in required:
        wrong = F.size(f"`{vector}`") != dimension
        missing = F.when(wrong, F.array_append(missing, vector)).otherwise(missing)
    marked = df.withColumn("missing", missing)
    return (marked.filter(F.size("missing") == 0).drop("missing"),
            marked.filter(F.size("missing") > 0))


def name_tokens(text: Column) -> Column:
    """Distinct lower-case words of letters and digits."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_remove(F.array_distinct(words), "")


def match_client(mails: DataFrame, folders: DataFrame, mail_id: str = "message_id",
                 text_col: str = "body") -> DataFrame:
    """The folder whose name shares most words with the mail; NULL when none is shared.

    A fixed stand-in for a choice made by a model. Equal counts go to the lower folder id.
    ``folders``: folder_id, name. Mails are cut to the words that occur in a folder name before
    anything is shuffled; then words meet by a join, hits are counted per mail and folder, and the
    best folder of a mail is a grouped minimum. Where the folder words can be sent, mails are dealt to tasks before
    their words meet folders, so a task counts at most about ``TASK_PAIRS`` pairs of mail and folder.
    """
    named = folders.select("folder_id", "name", name_tokens(F.col("name")).alias("_words"))
    held = named.select("folder_id", F.explode("_words").alias("_word"))
    known = send_if_small(held.select("_word").distinct())
    worded = mails.select(mail_id, F.explode(name_tokens(F.col(text_col))).alias("_word")) \
                  .join(known, "_word", "left_semi")
    sent = send_if_small(held)
    if sent is not held:
        # Words of a mail stay together, so pairs are counted where they arise, a bounded number in a task.
        tasks = -(-mails.count() * folders.count() // TASK_PAIRS)
        worded = worded.repartition(max(mails.sparkSession.sparkContext.defaultParallelism, tasks), mail_id)
    shared = worded.join(sent, "_word").groupBy(mail_id, "folder_id") \
                   .agg(F.count("*").cast("int").alias("_shared"))
    best = shared.groupBy(F.col(mail_id).alias("_mail")).agg(
        F.min(F.struct((-F.col("_shared")).alias("n"), "folder_id")).alias("_best"))
    best = best.join(named.select(F.col("folder_id").alias("_folder"), "name"),
                     F.col("_best.folder_id") == F.col("_folder"))
    return mails.select(mail_id).join(best, F.col(mail_id) == F.col("_mail"), "left").select(
        mail_id, F.col("_best.folder_id").alias("client_folder_id"), F.col("name").alias("client_name"),
        (-F.col("_best.n")).alias("shared_words"), F.col("_mail").isNotNull().alias("client_matched"))


# How document names are ranked and what asks for the special kinds.
FINAL_NAMES = ("final brief", "final draft")
BIO_WORDS, ANGLE_WORDS = ("bio",), ("angle", "talking point")
# Outcome of the document choice.
PICKED, NO_FOLDER, NO_DOCUMENT = (
    "Success", "No matching client folder found", "No documents found in the client folder")


def _mentions(text: Column, words) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.lower(F.coalesce(text, F.lit(""))).contains(word)
    return hit


def pick_document(docs: DataFrame, mails: DataFrame, folder_col: str = "client_folder_id",
                  text_col: str = "body") -> DataFrame:
    """The document of the mail's folder that serves best, with the outcome.

    Final briefs and drafts come first, then a bio or angles paper when the mail asks for one,
    then the highest version; the lower id breaks a tie. ``docs``: document_id, folder_id, name.
    Whether a mail asks for bio or angles leaves four cases, so the best document of each case is
    found once per folder and a mail looks its case up; no mail meets all documents of its folder.
    """
    version = F.coalesce(
        F.regexp_extract(F.lower("name"), r"\bv(\d+)", 1).try_cast("int"), F.lit(0))
    final, bio, angles = (_mentions(F.col("name"), words)
                          for words in (FINAL_NAMES, BIO_WORDS, ANGLE_WORDS))

    def best(asks_bio: bool, asks_angles: bool) -> Column:
        asked = (bio & F.lit(asks_bio)) | (angles & F.lit(asks_angles))
        tier = F.when(final, 0).when(asked, 1).otherwise(2)
        return F.min(F.struct(tier.alias("tier"), (-version).alias("v"), F.col("document_id"),
                              F.col("name").alias("document_name")))

    folders = docs.groupBy(F.col("folder_id").alias("_folder")).agg(
        best(False, False).alias("_plain"), best(True, False).alias("_bio"),
        best(False, True).alias("_angles"), best(True, True).alias("_both"),
        F.count(F.lit(1)).cast("int").alias("documents_found"))
    wants_bio, wants_angles = (_mentions(F.col(text_col), w) for w in (BIO_WORDS, ANGLE_WORDS))
    asks = mails.withColumn("_wants", wants_bio.cast("int") + 2 * wants_angles.cast("int"))
    chosen = F.get(F.array("_plain", "_bio", "_angles", "_both"), F.col("_wants"))
    return asks.join(folders, F.col(folder_col) == F.col("_folder"), "left").select(
        *mails.columns, chosen["document_id"].alias("selected_document_id"),
        chosen["document_name"].alias("selected_document_name"),
        F.coalesce("documents_found", F.lit(0)).alias("documents_found"),
        F.when(F.col(folder_col).isNull(), NO_FOLDER).when(F.col("_folder").isNull(), NO_DOCUMENT)
         .otherwise(PICKED).alias("extraction_status"))


def _held(value, *path) -> list:
    """The list at the end of a path of keys, empty where something on the way is missing."""
    for key in path:
        value = value.get(key) if isinstance(value, dict) else None
    return value if isinstance(value, list) else []


def _reading_order(tree) -> str:
    """Text of a parsed document tree; a stack takes the place of recursion, so any depth will do."""
    out, stack = [], list(reversed(tree)) if isinstance(tree, list) else []
    while stack:
        element = stack.pop()
        if not isinstance(element, dict):
            continue
        if element.get("paragraph") is not None:
            runs = (r.get("textRun") for r in _held(element, "paragraph", "elements") if isinstance(r, dict))
            texts = (r.get("content") for r in runs if isinstance(r, dict))
            out += [t for t in texts if isinstance(t, str)]
        else:
            cells = [c for row in _held(element, "table", "tableRows") for c in _held(row, "tableCells")]
            stack += [e for c in reversed(cells) for e in reversed(_held(c, "content"))]
    return "".join(out)


def doc_text(df: DataFrame, col: str = "content") -> DataFrame:
    """Text of a document tree in reading order, tables inside tables included to any depth.

    What is not JSON has no text. A schema for ``from_json`` would end at some depth, so the trees are
    parsed in Arrow batches.
    """
    @F.pandas_udf("string")
    def text(trees: pd.Series) -> pd.Series:
        def one(tree):
            try:
                return _reading_order(json.loads(tree)) if tree else ""
            except ValueError:
                return ""

        return trees.map(one)

    return df.select(*[c for c in df.columns if c != col], text(F.coalesce(col, F.lit(""))).alias("text"))


FORM_FIELD = "MAP<STRING, MAP<STRING, STRUCT<initial_value: STRING, value: STRING, multiline: BOOLEAN>>>"


def parse_form(df: DataFrame, col: str = "state") -> DataFrame:
    """Recipient, subject and body of a review form; ``error`` when one is missing.

    A field with an initial value holding ``@`` is the recipient, another initial value is the
    subject, a multi-line field without initial value the body; of several the last counts.
    """
    form = F.from_json(F.get_json_object(col, "$.values"), FORM_FIELD)
    fields = F.flatten(F.transform(F.map_values(form), F.map_values))
    last = lambda test: F.try_element_at(F.filter(F.col("_fields"), test), F.lit(-1))["value"]
    given = lambda f: f["initial_value"].isNotNull()
    found = df.withColumn("_fields", fields).select(
        *[c for c in df.columns if c != col],
        last(lambda f: given(f) & f["initial_value"].contains("@")).alias("recipient"),
        last(lambda f: given(f) & ~f["initial_value"].contains("@")).alias("subject"),
        last(lambda f: ~given(f) & F.coalesce(f["multiline"], F.lit(False))).alias("body"))
    whole = F.lit(True)
    for name in ("recipient", "subject", "body"):
        whole = whole & (F.coalesce(name, F.lit("")) != "")
    return found.withColumn("error", F.when(~whole, F.lit("incomplete form")))
