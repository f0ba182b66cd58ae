"""Tables of one row per key that are changed in place, a part at a time.

The rows lie in folders by a hash of their key. A change reads the folders that its keys fall into and
overwrites those; the files of all others are neither read nor written, so a small change to a large
table stays small. Any operator that maps the table to its next state can be applied this way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from reviewflow.operators.workflow import apply_updates
from reviewflow.session import delete_dir, scratch_dir

BUCKET = "_bucket"
# Numbers of folders that go through the driver.
MOST_BUCKETS = 100_000


class KeyedTable:
    """A table under ``path``, in ``buckets`` folders by the hash of ``key``.

    About 100 MB a folder are good: a change costs as much as the folders it touches. Keys are unique; a
    null key is kept but never matched. One writer at a time; a reader that must not see a change half
    done reads before or after it. A lost executor's tasks are run again: folders are exchanged only when all
    new files are written. They are exchanged one by one, so a driver lost in that moment can leave one missing, its
    rows in the staging folder beside the others.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        told = spark.read.schema("key STRING, buckets INT, ddl STRING").json(f"{self.path}/about").first()
        self.key, self.buckets, self.schema = told.key, told.buckets, StructType.fromDDL(told.ddl)

    @classmethod
    def create(cls, df: DataFrame, path: str, key: str, buckets: int) -> KeyedTable:
        """Write ``df`` as a new table."""
        if not 1 <= buckets <= MOST_BUCKETS:
            raise ValueError(f"between 1 and {MOST_BUCKETS} buckets")
        spark, path = df.sparkSession, path.rstrip("/")
        df.withColumn(BUCKET, _bucket(key, buckets)).hint("rebalance", BUCKET) \
            .write.mode("errorifexists").partitionBy(BUCKET).parquet(f"{path}/rows")
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        spark.createDataFrame([(key, buckets, ddl)], "key STRING, buckets INT, ddl STRING") \
            .coalesce(1).write.json(f"{path}/about")
        return cls(spark, path)

    def _rows(self) -> DataFrame:
        whole = StructType([*self.schema.fields, StructField(BUCKET, IntegerType())])
        return self.spark.read.schema(whole).parquet(f"{self.path}/rows")

    def _keys(self, keys: DataFrame) -> DataFrame:
        """The first column as the table's keys; equal numbers of another type hash apart."""
        return keys.select(F.col(keys.columns[0]).cast(self.schema[self.key].dataType).alias("_asked")) \
            .where("_asked IS NOT NULL")

    def read(self) -> DataFrame:
        return self._rows().drop(BUCKET)

    def touched(self, keys: DataFrame) -> list[int]:
        """Numbers of the folders that the keys, the first column, fall into."""
        found = self._keys(keys).select(_bucket("_asked", self.buckets).alias(BUCKET)).distinct()
        return sorted(r[0] for r in found.collect())

    def find(self, keys: DataFrame) -> DataFrame:
        """The rows of the keys, the first column; only their folders are read."""
        rows = self._rows().where(F.col(BUCKET).isin(self.touched(keys))).drop(BUCKET)
        return rows.join(self._keys(keys), F.col(self.key) == F.col("_asked"), "left_semi")

    def rewrite(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Put ``change(rows)`` in the place of the rows of all folders that the keys fall into.

        ``keys``: a frame whose first column holds the keys. ``change`` must leave rows of other keys as they
        are, and keys in their folders. Returns the numbers of the folders.
        """
        touched = self.touched(keys)
        if touched:
            rows = self._rows().where(F.col(BUCKET).isin(touched)).drop(BUCKET)
            after = change(rows).select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in self.schema.fields]) \
                .withColumn(BUCKET, _bucket(self.key, self.buckets))
            after.hint("rebalance", BUCKET).write.mode("overwrite") \
                .option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(f"{self.path}/rows")
        return touched

    def update(self, updates: DataFrame, columns: list[str]) -> list[int]:
        """Take ``columns`` from ``updates``, one row per key, where a key has one; NULL counts as a value."""
        with _Staged(updates.select(self.key, *columns), self.key) as new:
            return self.rewrite(new, lambda rows: apply_updates(rows, new, self.key, columns))

    def upsert(self, rows: DataFrame) -> list[int]:
        """Put whole rows, one per key, in the place of those of their keys, or beside them."""
        with _Staged(rows.select(*self.schema.names).where(F.col(self.key).isNotNull()), self.key) as new:
            return self.rewrite(new.select(self.key), lambda old: old.join(
                self._keys(new.select(self.key)), F.col(self.key) == F.col("_asked"), "left_anti").unionByName(new))


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class _Staged:
    """Changes written once to scratch, so that their plan runs once and their size is known to the planner."""

    def __init__(self, rows: DataFrame, key: str):
        self.rows, self.key = rows, key

    def __enter__(self) -> DataFrame:
        spark = self.rows.sparkSession
        self.at = scratch_dir(spark, "changes")
        self.rows.write.parquet(self.at)
        staged = spark.read.schema(self.rows.schema).parquet(self.at)
        twice = staged.where(F.col(self.key).isNotNull()).groupBy(self.key).count().where("count > 1").head(1)
        if twice:
            raise ValueError(f"more than one row for {self.key} = {twice[0][0]}")
        return staged

    def __exit__(self, *_) -> None:
        delete_dir(self.rows.sparkSession, self.at)
