"""Record pages, attribute values and multi-select updates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECORDS = "ARRAY<STRUCT<id: STRUCT<record_id: STRING>, values: MAP<STRING, STRING>>>"
ENTRY = "ARRAY<MAP<STRING, STRING>>"


# Rows before a page that a sort may drop on one task; beyond, the part of the table around the page is found first.
NEAR_ROWS = 10_000
# Key values drawn to guess where a page lies, about, and what is taken on either side of the guess, as a share.
DRAWN, MARGIN = 4000, 0.03


def page(df: DataFrame, keys: list[str], number: int, size: int) -> DataFrame:
    """Page ``number`` in the order of ``keys``, of any types.

    A deep page is guessed from a sample to lie between two values of the keys. The rows before both are
    counted, which settles whether the guess is right (else it is widened), and only those between are sorted. All keys
    together are compared, so one value of the first may hold most rows.
    """
    skipped = (number - 1) * size
    if skipped <= NEAR_ROWS:
        return df.orderBy(*keys).offset(skipped).limit(size)
    n = df.count()
    drawn = df.select(*keys).sample(min(1.0, DRAWN / max(1, n)), seed=1).orderBy(*keys).collect()
    whole = F.struct(*keys)
    bound = lambda row: F.struct(*[F.lit(row[k]).cast(df.schema[k].dataType).alias(k) for k in keys])
    margin = MARGIN
    while True:
        a = min(len(drawn) - 1, math.floor(len(drawn) * (skipped / max(1, n) - margin)))
        b = math.ceil(len(drawn) * ((skipped + size) / max(1, n) + margin))
        after = whole >= bound(drawn[a]) if a > 0 else F.lit(True)
        until = whole < bound(drawn[b]) if b < len(drawn) else F.lit(True)
        before, upto = df.agg(F.count_if(~after), F.count_if(until)).first()
        if before <= skipped and (upto >= skipped + size or b >= len(drawn)):
            return df.filter(after & until).orderBy(*keys).offset(skipped - before).limit(size)
        margin *= 4


def page_after(df: DataFrame, keys: list[str], last: list | None, size: int) -> DataFrame:
    """The page after the row with the key values ``last`` (None: the first page). Keys are not null and
    unique together; no row before the page is sorted."""
    if last is not None:
        later = F.lit(False)
        for key, value in reversed(list(zip(keys, last))):
            later = (F.col(key) > F.lit(value)) | ((F.col(key) == F.lit(value)) & later)
        df = df.filter(F.col(keys[0]) >= F.lit(last[0])).filter(later)
    return df.orderBy(*keys).limit(size)


def open_envelope(df: DataFrame, col: str) -> DataFrame:
    """Records of a reply that holds them in ``data`` or in ``data.records``: id and values."""
    data = F.get_json_object(col, "$.data")
    records = F.when(data.startswith("["), data) \
               .otherwise(F.get_json_object(col, "$.data.records"))
    others = [c for c in df.columns if c != col]
    return df.select(*others, F.explode(F.from_json(records, RECORDS)).alias("_r")).select(
        *others, F.coalesce("_r.id.record_id", F.lit("")).alias("id"),
        F.col("_r.values").alias("values"))


def flatten_record(df: DataFrame, col: str = "values", out: str = "attributes") -> DataFrame:
    """Current value of each attribute: the first entry whose ``active_until`` is there and NULL.

    Its ``value`` counts, else the ``title`` of its ``option``. Attributes without one are left out.
    """
    entries = F.transform_values(F.col(col), lambda _, v: F.from_json(v, ENTRY))
    current = lambda e: F.map_contains_key(e, "active_until") & e["active_until"].isNull()
    first = F.transform_values(entries, lambda _, v: F.get(F.filter(v, current), F.lit(0)))
    title = lambda e: F.get_json_object(F.try_element_at(e, F.lit("option")), "$.title")
    chosen = lambda e: F.when(F.map_contains_key(e, "value"), F.try_element_at(e, F.lit("value"))) \
                        .otherwise(title(e))
    usable = lambda _, e: F.coalesce(
        F.map_contains_key(e, "value") | title(e).isNotNull(), F.lit(False))
    return df.withColumn(out, F.transform_values(F.map_filter(first, usable),
                                                 lambda _, e: chosen(e)))


def crm_update(df: DataFrame, updates: DataFrame, overwrite: bool = False, key: str = "id",
               col: str = "options") -> DataFrame:
    """Multi-select values after the updates: appended without repeats, or replaced."""
    new = updates.select(F.col(key).alias("_key"), F.col(col).alias("_new"))
    merged = F.col("_new") if overwrite else \
        F.array_union(F.coalesce(col, F.array().cast("array<string>")), "_new")
    return df.join(new, F.col(key) == F.col("_key"), "left").select(*[
        F.when(F.col("_new").isNotNull(), merged).otherwise(F.col(col)).alias(col)
        if c == col else F.col(c) for c in df.columns])


def crm_filter(df: DataFrame, col: str, value) -> DataFrame:
    """Rows whose attribute equals ``value`` or lists it, without case.

    A list of one is that one value; a longer or empty list is compared as a whole.
    """
    if isinstance(value, (list, tuple)) and len(value) == 1:
        value = value[0]
    is_list = dict(df.dtypes)[col].startswith("array")
    if isinstance(value, (list, tuple)):
        if not is_list:
            return df.limit(0)
        wanted = F.array(*[F.lit(str(v).lower()) for v in value]).cast("array<string>")
        return df.filter(F.transform(F.col(col), F.lower) == wanted)
    text = str(value).lower()
    if is_list:
        return df.filter(F.exists(F.col(col), lambda x: F.lower(x) == text))
    return df.filter(F.lower(F.col(col).cast("string")) == text)
