"""Join shapes shared by the operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

from reviewflow.session import scratch_dir

# Rows and bytes of text of one key that a single task may take on the many side of a left join.
HOT_ROWS, PART_BYTES = 1_000_000, 1 << 30
# Rows that a key with as many as a task may take has in the sample that hot keys are looked for in, about.
SEEN_ROWS = 2000
# Ids that may be sent to every executor, and their bytes: a million text ids of 36 characters take 50 MB.
SENT_IDS, SENT_BYTES = 1_000_000, 128 << 20
# Rows per side of one block in a blocked all-against-all comparison.
BLOCK_ROWS = 4096


def value_bytes(value: Column, kind: DataType) -> Column:
    """About how many bytes a value takes in memory."""
    if isinstance(kind, StructType):
        return reduce(add, [value_bytes(value[f.name], f.dataType) for f in kind.fields], F.lit(8))
    if isinstance(kind, (ArrayType, MapType)):
        return F.coalesce(F.octet_length(F.to_json(value)), F.lit(0)) + 16
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    return F.lit(8)


def send_if_small(ids: DataFrame, rows: int = SENT_IDS, most_bytes: int = SENT_BYTES) -> DataFrame:
    """Mark a frame of ids for broadcast when a count of rows and bytes shows that it is small enough.

    Without the mark the planner knows only the size of the unfiltered table, and would shuffle
    the large table on the other side before it finds out. Beyond the limit the frame stays
    unmarked: both sides shuffle and the adaptive skew join splits hot keys.
    """
    size = reduce(add, [value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in ids.schema.fields], F.lit(0))
    n, total = ids.agg(F.count("*"), F.sum(size.cast("long"))).first()
    return F.broadcast(ids) if n <= rows and (total or 0) <= most_bytes else ids


def left_join_many(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                   hot_rows: int = HOT_ROWS, part_bytes: int = PART_BYTES) -> DataFrame:
    """Left join to a 1:N table in which one key may own most rows.

    Keys with more than ``hot_rows`` rows or ``part_bytes`` of text are found in a sample of the rows, large
    enough that such a key has about ``SEEN_ROWS`` in it; which keys are found decides the plan, not the result.
    Their rows are dealt out to numbered parts by the number of the row in its input partition, so
    they spread evenly whatever they hold, and the left row is repeated once per part. Every part of
    a hot key that stays empty would add an unmatched row, so those are dropped: a hot key always has
    matches. Other keys keep part 0, where an unmatched left row stays. Without a hot key the join is
    a plain one. Columns of ``right`` other than the key are appended.
    """
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in right.schema.fields
             if f.dataType.simpleString() == "string" and f.name != right_key]
    size = reduce(add, texts, F.lit(0)).cast("long")
    share = min(1.0, SEEN_ROWS / hot_rows)
    parts = F.greatest(F.ceil(F.col("_rows") / F.lit(hot_rows * share)),
                       F.ceil(F.col("_bytes") / F.lit(part_bytes * share))).cast("int")
    seen = right if share == 1 else right.sample(share, seed=1)
    hot = seen.groupBy(right_key).agg(F.count("*").alias("_rows"), F.sum(size).alias("_bytes")) \
        .select(F.col(right_key).alias("_hot"), parts.alias("_parts")).filter("_parts > 1 AND _hot IS NOT NULL")
    # Written once: both sides must deal by the same parts.
    at = scratch_dir(right.sparkSession, "hot")
    hot.write.parquet(at)
    hot = right.sparkSession.read.parquet(at)
    kept = [c for c in right.columns if c != right_key]
    if hot.isEmpty():
        many = right.select(F.col(right_key).alias("_right_key"),
                            *[F.col(c).alias(f"_right_{c}") for c in kept])
        joined = left.join(many, F.col(left_key) == F.col("_right_key"), "left")
        return joined.select(*left.columns, *[F.col(f"_right_{c}").alias(c) for c in kept])
    hot = send_if_small(hot)
    number = F.monotonically_increasing_id()
    many = right.withColumn("_number", number).join(
        hot, F.col(right_key) == F.col("_hot"), "left").select(
        F.col(right_key).alias("_right_key"), F.lit(True).alias("_match"),
        *[F.col(c).alias(f"_right_{c}") for c in kept],
        F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod("_number", F.col("_parts")))
         .cast("int").alias("_right_part"))
    parts = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    one = left.join(hot, F.col(left_key) == F.col("_hot"), "left") \
        .withColumn("_part", F.explode(parts))
    joined = one.join(many, (F.col(left_key) == F.col("_right_key"))
                      & (F.col("_part") == F.col("_right_part")), "left")
    return joined.filter(F.col("_parts").isNull() | F.col("_match").isNotNull()).select(
        *left.columns, *[F.col(f"_right_{c}").alias(c) for c in kept])


def blocked_pairs(left: DataFrame, right: DataFrame, left_id: Column, right_id: Column,
                  blocks: tuple[int, int],
                  compare: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
                  schema: str) -> DataFrame:
    """Compare every left row with every right row, one bounded block pair per task.

    Both sides are cut into blocks by a hash of their unique id. A left row is sent once to each
    right block and the other way round, and ``compare`` sees one block of each side. It must
    return only what can still win, so a block gives a few rows per left row and never its pairs.
    """
    n_left, n_right = blocks
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    a = left.withColumn("_lb", place(left_id, n_left)).withColumn("_rb", numbers(n_right))
    b = right.withColumn("_rb", place(right_id, n_right)).withColumn("_lb", numbers(n_left))
    return a.groupBy("_lb", "_rb").cogroup(b.groupBy("_lb", "_rb")) \
            .applyInPandas(lambda x, y: compare(x, y), schema)


def block_count(df: DataFrame, rows: int = BLOCK_ROWS) -> int:
    """Blocks that keep the expected block size at ``rows``."""
    return max(1, -(-df.count() // rows))
