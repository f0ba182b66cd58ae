"""Chat formatting of reply trees.

A message names its parent; a conversation is a path from a root to a leaf. Paths come from iterative
self-joins that double the distance each time: after k joins a message knows its ancestor 2^k replies
up and the sum of the scores in between, so depth costs a logarithm of joins. Leaves are ranked within
their tree by the mean score of their path, and the paths of the chosen leaves are listed by the same
ancestors, again doubling. Each path becomes one text:

    ### <role>: <text></turn>\\n

with control strings inside escaped by a backslash and a letter: backslash as \\b, ### as \\h, </turn>
as \\t, and in roles a colon as \\c. In an escaped text every backslash begins such a pair, so
replacing the pairs in any order, \\b last, gives the text back. The loss mask is the list of spans,
in code points of the formatted text, that hold the texts of the assistant.

Defined results: null texts and roles are empty; a message whose parent is unknown is a root; messages
that answer each other in a circle are in no conversation; ties of score go to the least leaf; in a
table by turn, equal turns follow in order of role and text, null turns come first, and rows with a null
conversation form one conversation; an empty table gives none. A conversation is one row by nature, so
its messages come together in one task, after everything that can be done per message is done.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewflow.session import scratch_dir

OPEN, AFTER_ROLE, CLOSE = "### ", ": ", "</turn>\n"
LEARNED = "assistant"
NO_ID = -(1 << 63)


def escaped(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(out, F.lit("</turn>"), F.lit("\\t")), F.lit("###"), F.lit("\\h"))


def unescaped(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("\\t"), F.lit("</turn>")), F.lit("\\h"), F.lit("###"))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit(":"), F.lit("\\c"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("\\c"), F.lit(":")))


class _Work:
    """Written tables of one run, in the shared folder."""

    def __init__(self, spark):
        self.spark, self.folder, self.n = spark, scratch_dir(spark, "chat"), 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.folder}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{self.n}")


def chosen_paths(messages: DataFrame, top: int | None = 1) -> DataFrame:
    """Messages of the ``top`` best paths of each tree (None: of all paths): tree, leaf, rank, node and
    up, its distance from the leaf. ``messages``: tree, id, parent, score."""
    work = _Work(messages.sparkSession)
    own = messages.select("tree", "id", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = own.select(F.col("tree").alias("t"), F.col("id").alias("p"))
    inner = own.where("parent is not null").join(
        known, (F.col("tree") == F.col("t")) & (F.col("parent") == F.col("p")), "left")
    live = work.keep(inner.select("tree", "id", F.col("p").alias("jump"), F.col("score").alias("total"),
                                  F.lit(1).cast("long").alias("n"))
                     .union(own.where("parent is null").select(
                         "tree", "id", F.lit(None).cast("long"), "score", F.lit(1).cast("long"))))
    sizes = own.groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    parents = live.where("jump is not null").select("tree", F.col("jump").alias("id")).distinct()
    leaves = live.join(parents, ["tree", "id"], "left_anti").select("tree", "id")
    jumps, done = [], live.where("jump is null").select("tree", "id", "total", "n")
    # Beyond the size of the largest tree only circles are left.
    for _ in range(max(1, sizes).bit_length()):
        rest = live.where("jump is not null")
        if not rest.limit(1).count():
            break
        jumps.append(rest.select("tree", F.col("id").alias("node"), F.col("jump").alias("above")))
        up = live.select(F.col("tree").alias("t"), F.col("id").alias("j"), F.col("jump").alias("jump2"),
                         F.col("total").alias("total2"), F.col("n").alias("n2"))
        live = work.keep(rest.join(up, (rest["tree"] == up["t"]) & (rest["jump"] == up["j"])).select(
            "tree", "id", F.col("jump2").alias("jump"), (F.col("total") + F.col("total2")).alias("total"),
            (F.col("n") + F.col("n2")).alias("n"))
            .union(done.select("tree", "id", F.lit(None).cast("long"), "total", "n")))
        done = live.where("jump is null").select("tree", "id", "total", "n")
    ranked = leaves.join(done, ["tree", "id"]).withColumn("score", F.col("total") / F.col("n"))
    best = Window.partitionBy("tree").orderBy(F.desc("score"), "id")
    ranked = ranked.withColumn("rank", F.row_number().over(best))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    paths = work.keep(ranked.select("tree", F.col("id").alias("leaf"), "rank", F.col("id").alias("node"),
                                    F.lit(0).cast("long").alias("up")))
    for k, jump in enumerate(jumps):
        further = paths.join(jump, ["tree", "node"]).select(
            "tree", "leaf", "rank", F.col("above").alias("node"), F.col("up") + (1 << k))
        paths = work.keep(paths.union(further))
    return paths


def formatted(messages: DataFrame, top: int | None = 1) -> DataFrame:
    """One row per chosen path: tree, leaf, rank, formatted, loss_spans (start and length).

    ``messages``: tree, id and parent (long), role, text, score.
    """
    paths = chosen_paths(messages, top)
    turns = paths.join(messages.select("tree", F.col("id").alias("node"), "role", "text"), ["tree", "node"])
    head = F.concat(F.lit(OPEN), escaped_role(F.col("role")), F.lit(AFTER_ROLE))
    body = escaped(F.col("text"))
    turns = turns.select("tree", "leaf", "rank", "up", head.alias("head"), body.alias("body"),
                         (F.col("role") == LEARNED).alias("learned"))
    turns = turns.withColumns({"chars": F.length("body").cast("long"),
                               "before": F.length("head").cast("long")})
    order = Window.partitionBy("tree", "leaf", "rank").orderBy(F.desc("up"))
    size = F.col("before") + F.col("chars") + len(CLOSE)
    turns = turns.withColumn("start", F.sum(size).over(order) - size + F.col("before"))
    piece = F.struct(F.col("start"), F.concat("head", "body", F.lit(CLOSE)).alias("turn"),
                     F.when(F.col("learned"), F.col("chars")).alias("length"))
    return turns.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(piece)).alias("turns")) \
        .select("tree", "leaf", "rank",
                F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"),
                F.transform(F.filter("turns", lambda t: t["length"].isNotNull()),
                            lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
                .alias("loss_spans"))


def kept(texts: DataFrame) -> DataFrame:
    """Formatted texts as a written table, which what reads them reads again."""
    return _Work(texts.sparkSession).keep(texts)


def read_back(texts: DataFrame) -> DataFrame:
    """Turns read from formatted texts and their loss mask: tree, leaf, turn, role, text, masked.

    ``masked`` is the text under the mask in the turn, null where there is none.
    """
    parts = texts.select("tree", "leaf", F.posexplode(F.split("formatted", CLOSE)).alias("turn", "part")) \
                 .where(F.col("part") != "")
    head = F.locate(AFTER_ROLE, F.col("part")) + (len(AFTER_ROLE) - 1)
    parts = parts.withColumn("head", head.cast("long"))
    order = Window.partitionBy("tree", "leaf").orderBy("turn")
    size = F.length("part").cast("long") + len(CLOSE)
    parts = parts.withColumn("begin", F.sum(size).over(order) - size)
    parts = parts.withColumn("start", F.col("begin") + F.col("head"))
    spans = texts.select("tree", "leaf", F.explode("loss_spans").alias("span")) \
                 .select("tree", "leaf", F.col("span.start").alias("start"), F.col("span.length").alias("length"))
    marked = parts.join(spans, ["tree", "leaf", "start"], "left")
    return marked.select(
        "tree", "leaf", "turn",
        unescaped_role(F.expr(f"substring(part, {len(OPEN) + 1}, int(head) - {len(OPEN) + len(AFTER_ROLE)})"))
        .alias("role"),
        unescaped(F.expr("substring(part, int(head) + 1)")).alias("text"),
        F.when(F.col("length").isNotNull(), unescaped(F.expr("substring(part, int(head) + 1, int(length))")))
        .alias("masked"))


def by_turn(conversations: DataFrame) -> DataFrame:
    """Messages of a table of conversations by turn: each answers the one before."""
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = conversations.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("tree"),
                                "turn", "role", "text")
    rows = rows.withColumn("id", F.row_number().over(order).cast("long"))
    return rows.select("tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text",
                       F.lit(0.0).alias("score"))


def digests(texts: DataFrame) -> DataFrame:
    """What the formatted texts hold, read back from them, one row per conversation."""
    turns = read_back(texts).groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(
        F.struct("turn", "role", "text", "masked"))).alias("turns"))
    masked = F.array_join(F.transform("turns", lambda t: F.coalesce(t["masked"], F.lit(""))), "")
    told = turns.select(
        "tree", "leaf", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"],
                                                                   F.lit("\n"))), ""), 256)
        .alias("turns_sha256"),
        F.length(masked).cast("long").alias("loss_chars"), F.sha2(masked, 256).alias("loss_sha256"))
    size = texts.select("tree", "leaf", F.length("formatted").cast("long").alias("formatted_chars"))
    return told.join(size, ["tree", "leaf"])
