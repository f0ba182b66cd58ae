"""Document fingerprints: a Merkle tree over the paragraphs and sections of a text.

A paragraph is a line, or a sentence of it. One of over ``LONG`` characters (a list, a log, a text without
sentence marks) is cut by its content, after words whose hash is divisible by ``PIECE``, and after ``MOST`` words at
the latest, so an edit changes the piece that holds it and no piece before. A paragraph whose hash is divisible by ``SECTION`` closes
a section, so an edit moves no section border but its own. A leaf is the hash of a paragraph, a section
the hash of its leaves, the root a SHA-256 of the length and the sections. The fingerprint is the
root, a colon, and the sections, each as its hash and its leaves, so two fingerprints tell whether the
texts are equal (roots), which sections differ, and which paragraphs of those.

Likeness is 1 for equal roots; otherwise the share of leaves in common among all leaves of both (Jaccard
over distinct leaves), kept under 1. Everything is built-in functions. The next document of each comes
from one shuffle: rows go to ranges of ids, whose borders are exact ids found on the id column alone,
and the first row of a range goes to the range before as well.

Defined results: a null text is empty and has no paragraph; the tree of an empty text has no leaf, and
two empty texts have likeness 1; null ids come first, rows of one id are in the order of their texts;
a single document is its own next one; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewflow.functions.binding import let

#: A section ends after a paragraph whose hash is divisible by this.
SECTION = 8
#: Ranges of ids for each shuffle partition.
RANGES = 4
#: Where a text is cut: at line ends and after sentences.
CUT = r"\n+|(?<=[.!?])[ \t]+|(?<=[\u3002\uff01\uff1f])"
#: Characters from which on a paragraph is cut further; where its words end; words of a piece, on average and at most.
LONG, WORD_END, PIECE, MOST = 600, r"(?<=[\s\u3001\uff0c\uff1b;,|])", 16, 64


def pieces(paragraph: Column) -> Column:
    """A long paragraph in pieces that its content decides."""
    def cut(words: Column) -> Column:
        last = F.size(words) - 1
        closing = F.transform(words, lambda w, i: F.when((F.crc32(w) % PIECE == 0) | (i == last), i))
        return let(F.filter(closing, lambda i: i.isNotNull()), lambda ends: joined(words, ends))

    def joined(words: Column, ends: Column) -> Column:
        whole = F.transform(ends, lambda end, k: F.struct(
            F.when(k > 0, F.get(ends, k - 1) + 1).otherwise(0).alias("start"), end.alias("end")))
        short = F.flatten(F.transform(whole, lambda x: F.transform(
            F.sequence(x["start"], x["end"], F.lit(MOST)),
            lambda a: F.struct(a.alias("start"), F.least(a + MOST - 1, x["end"]).alias("end")))))
        return F.transform(short, lambda x: F.array_join(
            F.slice(words, x["start"] + 1, x["end"] - x["start"] + 1), ""))

    return F.filter(let(F.split(paragraph, WORD_END), cut), lambda p: p != "")


def leaves(text: Column) -> Column:
    """Hashes of the paragraphs of a text, and of the pieces of long ones, in order."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), CUT), lambda p: p != "")
    short = F.flatten(F.transform(parts, lambda p: F.when(F.length(p) > LONG, pieces(p)).otherwise(F.array(p))))
    return F.transform(short, lambda p: F.xxhash64(p))


def sections(hashes: Column) -> Column:
    """The leaves as hex, sixteen letters each, with a bar after each leaf that closes a section."""
    return F.array_join(F.transform(hashes, lambda h: F.concat(
        F.lpad(F.lower(F.hex(h)), 16, "0"), F.when(h % SECTION == 0, "|").otherwise(""))), "")


def tree(hashes: Column) -> Column:
    """Sections and leaves: ``section=leaves|section=leaves``."""
    return F.array_join(F.transform(F.filter(F.split(sections(hashes), r"\|"), lambda s: s != ""),
                                    lambda s: F.concat(F.lpad(F.lower(F.hex(F.xxhash64(s))), 16, "0"),
                                                       F.lit("="), s)), "|")


def root(text: Column, tree_: Column) -> Column:
    """The root covers the text's own SHA-256 too, so equal roots are equal texts even where white space
    between paragraphs is all that differs."""
    tops = F.regexp_replace(tree_, "=[0-9a-f]*", "")
    return F.sha2(F.concat(F.sha2(text, 256), tops), 256)


def fingerprint(text: Column) -> Column:
    """Root and tree, with a colon between."""
    own = tree(leaves(text))
    return F.concat(root(F.coalesce(text, F.lit("")), own), F.lit(":"), own)


def parsed(print_: Column) -> Column:
    """Root and leaves of a fingerprint."""
    tree = F.substring_index(print_, ":", -1)
    hexed = F.regexp_replace(F.regexp_replace(tree, "[0-9a-f]{16}=", ""), r"\|", "")
    return F.struct(F.substring_index(print_, ":", 1).alias("root"),
                    F.regexp_extract_all(hexed, F.lit("([0-9a-f]{16})"), 1).alias("leaves"))


def likeness(a_root: Column, a_leaves: Column, b_root: Column, b_leaves: Column) -> Column:
    """1 for equal roots, else the share of common leaves among those of both, under 1."""
    both = F.size(F.array_intersect(a_leaves, b_leaves)).cast("double")
    either = F.size(F.array_union(a_leaves, b_leaves))
    return F.when(a_root == b_root, 1.0).otherwise(
        F.when(either == 0, 0.0).otherwise(F.least(both / either, F.lit(0.999999))))


def differing(a_print: Column, b_print: Column) -> Column:
    """Sections of the first fingerprint that the second has not, each with its number, and the numbers
    of those of its paragraphs that the second has nowhere."""
    a, b = (F.filter(F.split(F.substring_index(p, ":", -1), r"\|"), lambda s: s != "")
            for p in (a_print, b_print))
    theirs = parsed(b_print)["leaves"]
    numbered = F.transform(a, lambda s, i: F.struct(i.alias("section"), s.alias("tree")))
    changed = F.filter(numbered, lambda s: ~F.array_contains(b, s["tree"]))
    return F.transform(changed, lambda s: F.struct(
        s["section"].alias("section"),
        F.filter(F.transform(F.regexp_extract_all(F.substring_index(s["tree"], "=", -1),
                                                  F.lit("([0-9a-f]{16})"), 1),
                             lambda x, i: F.when(~F.array_contains(theirs, x), i)),
                 lambda i: i.isNotNull()).alias("paragraphs")))


def _range_of(key: Column, borders: list[int]) -> Column:
    """Number of borders at or below the key, by binary search in a literal array."""
    array = F.lit(borders) if borders else F.array().cast("array<bigint>")
    steps = max(1, len(borders).bit_length())
    found = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0).alias("low"), F.lit(len(borders)).alias("high")),
        lambda s, _: F.when(s["low"] >= s["high"], s).otherwise(F.when(
            F.get(array, F.floor((s["low"] + s["high"]) / 2).cast("int")) <= key,
            F.struct((F.floor((s["low"] + s["high"]) / 2) + 1).cast("int").alias("low"), s["high"].alias("high")))
            .otherwise(F.struct(s["low"].alias("low"),
                                F.floor((s["low"] + s["high"]) / 2).cast("int").alias("high")))))
    return found["low"]


def with_next(docs: DataFrame, *columns: str) -> DataFrame:
    """``docs`` (doc_id and ``columns``) with a struct ``next`` of the columns of the next document.

    The borders are as many numbers as there are ranges: ``RANGES`` per shuffle partition.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    ids = docs.select(key.alias("key"))
    n = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    guessed = ids.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 10 * n)).first()[0] or []
    guessed = sorted(set(guessed))
    # The guess may be off for ids beyond 2^53; the least id of each range is exact.
    lows = sorted(r[1] for r in ids.groupBy(_range_of(F.col("key"), guessed)).agg(F.min("key")).collect())
    if not lows:
        return docs.withColumn("next", F.struct(*columns))
    borders = lows[1:]
    own = docs.withColumn("_key", key)
    part = _range_of(F.col("_key"), borders)
    # Where a row goes: its own range; the first rows of a range also to the one before, and the very
    # first also behind the last.
    places = F.array(F.struct(part.alias("part"), F.lit(0).alias("after"), F.lit(True).alias("real")))
    here = F.get(F.lit(borders) if borders else F.array().cast("array<bigint>"), part - 1)
    before = F.when((part > 0) & (here == F.col("_key")),
                    F.array(F.struct((part - 1).alias("part"), F.lit(0).alias("after"),
                                     F.lit(False).alias("real"))))
    around = F.when(F.col("_key") == lows[0],
                    F.array(F.struct(F.lit(len(borders)).alias("part"), F.lit(1).alias("after"),
                                     F.lit(False).alias("real"))))
    empty = F.array().cast("array<struct<part:int,after:int,real:boolean>>")
    placed = own.withColumn("_place", F.explode(F.concat(
        places, F.coalesce(before, empty), F.coalesce(around, empty))))
    w = Window.partitionBy("_place.part").orderBy("_place.after", "_key", "text")
    return placed.withColumn("next", F.lead(F.struct(*columns)).over(w)).where("_place.real") \
                 .drop("_key", "_place")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every document."""
    return docs.select("doc_id", fingerprint(F.col("text")).alias("fingerprint"))


def edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, whose last half (rounded down) gives way
    to as much of the next document's beginning; how like they are, and how like the next document is."""

    def treed(df: DataFrame, text: str, name: str) -> DataFrame:
        df = df.withColumn(f"{name}leaves", leaves(F.col(text)))
        df = df.withColumn(f"{name}tree", tree(F.col(f"{name}leaves")))
        return df.withColumn(f"{name}root", root(F.col(text), F.col(f"{name}tree")))

    def likeness_to(other: str) -> Column:
        return likeness(F.col("root"), F.col("leaves"), F.col(f"{other}root"), F.col(f"{other}leaves"))

    def whole(name: str) -> Column:
        return F.concat(f"{name}root", F.lit(":"), f"{name}tree")

    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = treed(own, "text", "").drop("tree")
    pairs = with_next(own, "text", "leaves", "root")
    half = "int(floor(length(text) / 2))"
    pairs = pairs.withColumn("edited", F.concat(F.expr(f"substring(text, 1, length(text) - {half})"),
                                                F.expr(f"substring(next.text, 1, {half})")))
    out = treed(pairs, "edited", "edited_").withColumn("tree", tree(F.col("leaves")))
    return out.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"), whole("").alias("fingerprint"),
        whole("edited_").alias("edited_fingerprint"), likeness_to("edited_").alias("near_edited"),
        likeness_to("next.").alias("near_next"))
