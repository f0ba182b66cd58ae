"""Constraint checks over the log tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewflow.operators.dashboard import rows
from reviewflow.schemas import (ALLOWED_VALUES, MAX_LENGTHS, RANGES, REFERENCES, REQUIRED_COLUMNS,
                                UNIQUE_KEYS)

PASS_SHARE = 80.0


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _out_of_range(col: Column, low, high) -> Column:
    bad = F.lit(False)
    if low is not None:
        bad = bad | (col < low)
    if high is not None:
        bad = bad | (col > high)
    return bad


def range_rules(df: DataFrame, table: str) -> dict[str, Column]:
    return {f"{c} in range": _out_of_range(F.col(c), *bounds)
            for c, bounds in RANGES.get(table, {}).items() if c in df.columns}


def value_rules(df: DataFrame, table: str) -> dict[str, Column]:
    rules = {f"{c} present": F.col(c).isNull()
             for c in REQUIRED_COLUMNS.get(table, ()) if c in df.columns}
    for c, limit in MAX_LENGTHS.get(table, {}).items():
        if c in df.columns:
            rules[f"{c} length"] = F.length(c) > limit
    for (name, c), values in ALLOWED_VALUES.items():
        if name == table and c in df.columns:
            rules[f"{c} allowed"] = ~F.col(c).isin(*values)
    return rules


def _check(t, make, tables) -> DataFrame:
    """Violations of every rule: one pass per table, all its rules in one aggregate."""
    parts = []
    for table in tables:
        if table not in t:
            continue
        df = t[table]
        rules = make(df, table)
        if not rules:
            continue
        counts = df.agg(*[F.count_if(bad).alias(name) for name, bad in rules.items()])
        pairs = F.explode(F.array(*[
            F.struct(F.lit(name).alias("rule"), F.col(f"`{name}`").alias("violations"))
            for name in rules]))
        parts.append(counts.select(pairs.alias("_r"))
                     .select(F.lit(table).alias("table_name"), "_r.*"))
    return _union(parts)


def check_ranges(t) -> DataFrame:
    return _check(t, range_rules, RANGES)


def check_values(t) -> DataFrame:
    ruled = {*REQUIRED_COLUMNS, *MAX_LENGTHS, *(table for table, _ in ALLOWED_VALUES)}
    return _check(t, value_rules, sorted(ruled))


def bad_rows(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break a rule, with the names of the rules they break."""
    broken = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]),
                      lambda r: r.isNotNull())
    return df.withColumn("broken_rules", broken).filter(F.size("broken_rules") > 0)


def duplicates(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return df.groupBy(*keys).agg(rows().alias("copies")).filter(F.col("copies") > 1)


def check_unique(t) -> DataFrame:
    """Number of key values that repeat, per table."""
    return _union([
        duplicates(t[table], keys).agg(rows().alias("violations")).select(
            F.lit(table).alias("table_name"), F.lit(", ".join(keys)).alias("rule"), "violations")
        for table, keys in UNIQUE_KEYS.items() if table in t])


def _without(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    known = parent.select(F.col(key).alias("_known"))
    return child.filter(F.col(column).isNotNull()) \
                .join(known, F.col(column) == F.col("_known"), "left_anti")


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows that name a parent which does not exist."""
    return _without(child, column, parent, key)


def check_orphans(t) -> DataFrame:
    """Number of orphans per reference; children are counted per key before they are joined."""
    return _union([
        _without(t[child].groupBy(column).agg(rows().alias("_rows")), column, t[parent], key)
        .agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("violations"))
        .select(F.lit(child).alias("table_name"), F.lit(f"{column} -> {parent}").alias("rule"),
                "violations")
        for child, column, parent, key in REFERENCES
        if child in t and parent in t and column in t[child].columns])


def check_score(results: DataFrame, share: float = PASS_SHARE) -> DataFrame:
    """Share of checks without violation, and whether it is enough."""
    ok = (F.col("violations") == 0).cast("int")
    return results.agg(F.sum(ok).cast("long").alias("passed"), rows().alias("checks"),
                       (F.avg(ok) * 100).alias("score")) \
                  .withColumn("sufficient", F.col("score") >= share)
