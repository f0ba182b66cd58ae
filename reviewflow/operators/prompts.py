"""Prompt templates, versions and use."""

from __future__ import annotations

from heapq import heappop, heappush
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from reviewflow.functions.period import rate, within
from reviewflow.functions.ranking import ID_RUN, number_in_group
from reviewflow.operators.dashboard import rows
from reviewflow.operators.joins import left_join_many, send_if_small
from reviewflow.session import scratch_dir

# How a seeded version is described.
SEED_NOTE, SEED_AUTHOR = "Initial version", "system"
# Blocks of days have up to 2 ** LEVELS days, more than a date can be apart.
LEVELS = 22


def _with(df: DataFrame, *names: str) -> list[str]:
    return [n for n in names if n in df.columns]


def active_prompts(t) -> DataFrame:
    """Templates with their active versions, one row per active version."""
    templates, versions = t["prompt_templates"], t["prompt_versions"]
    active = versions.filter("is_active").select(
        F.col("prompt_name").alias("_name"), F.col("id").alias("version_id"),
        *_with(versions, "version", "content", "performance_score", "usage_count", "created_at",
               "created_by"))
    kept = _with(templates, "prompt_name", "description", "category")
    return templates.select(*kept).join(active, F.col("prompt_name") == F.col("_name")) \
        .drop("_name").orderBy("prompt_name")


def all_prompts(t) -> DataFrame:
    """Every template with its active versions, if any; missing score and use count as 0."""
    templates = t["prompt_templates"]
    active = t["prompt_versions"].filter("is_active").select(
        F.col("prompt_name").alias("_name"), F.col("id").alias("active_version_id"),
        F.col("version").alias("active_version"), "performance_score", "usage_count")
    kept = templates.select(*_with(templates, "prompt_name", "description", "category"))
    return left_join_many(kept, active, "prompt_name", "_name") \
        .withColumn("performance_score",
                    F.coalesce(F.col("performance_score").cast("double"), F.lit(0.0))) \
        .withColumn("usage_count", F.coalesce("usage_count", F.lit(0))).orderBy("prompt_name")


def latest_active(versions: DataFrame) -> DataFrame:
    """The newest active version of each prompt."""
    others = [c for c in versions.columns if c != "prompt_name"]
    newest = F.max_by(F.struct(*others), F.col("version"))
    return versions.filter("is_active").groupBy("prompt_name").agg(newest.alias("_v")) \
        .select("prompt_name", "_v.*").select(*versions.columns)


def assign_versions(current: DataFrame, new: DataFrame, order: str = "id",
                    run: int = ID_RUN) -> DataFrame:
    """New rows with the next version numbers of their prompt, in the order of ``order``."""
    top = current.groupBy("prompt_name").agg(F.max("version").alias("last"))
    return number_in_group(new, ["prompt_name"], order, "version", run, after=top)


def version_history(versions: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Versions newest first; a missing score counts as 0."""
    found = versions if names is None else versions.filter(F.col("prompt_name").isin(names))
    kept = _with(versions, "prompt_name", "id", "version", "description", "created_at",
                 "created_by", "is_active", "usage_count")
    return found.select(*kept, F.coalesce(F.col("performance_score").cast("double"), F.lit(0.0))
                        .alias("performance_score")) \
                .orderBy("prompt_name", F.desc("version"))


def prompt_stats(t) -> DataFrame:
    """Catalogue figures over ``all_prompts``: a missing version counts as one."""
    return all_prompts(t).agg(
        rows().alias("total_prompts"),
        F.coalesce(F.sum(F.coalesce(F.nullif("active_version", F.lit(0)), F.lit(1))), F.lit(0))
        .alias("total_versions"),
        F.round(F.coalesce(F.avg("usage_count"), F.lit(0.0)), 0).alias("avg_usage"),
        F.round(F.coalesce(F.avg("performance_score"), F.lit(0.0)), 2).alias("avg_performance"))


def activate(versions: DataFrame, picks: DataFrame) -> DataFrame:
    """Make the picked version the only active one of its prompt.

    ``picks``: prompt_name and version, or prompt_name and version_id. A number that the prompt
    does not have changes nothing; an id that it does not have leaves it without active version.
    Prompts without a pick stay as they are.
    """
    by_id = "version_id" in picks.columns
    key = "version_id" if by_id else "version"
    wanted = picks.groupBy(F.col("prompt_name").alias("_name")).agg(F.max(key).alias("_pick"))
    target = versions["id"] if by_id else versions["version"]
    if not by_id:
        held = versions.select("prompt_name", "version").distinct()
        wanted = wanted.join(held, (F.col("_name") == F.col("prompt_name"))
                             & (F.col("_pick") == F.col("version")), "left_semi")
    return versions.join(wanted, versions["prompt_name"] == F.col("_name"), "left").select(*[
        F.when(F.col("_pick").isNull(), versions[c]).otherwise(target == F.col("_pick")).alias(c)
        if c == "is_active" else versions[c] for c in versions.columns])


def seed_prompts(t, defaults: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Templates and versions after seeding ``defaults`` (prompt_name, content, category).

    A default without template gets one. A default without active version gets a new active version,
    with the next number of its prompt, so no number is given twice.
    """
    templates, versions = t["prompt_templates"], t["prompt_versions"]
    known = templates.select("prompt_name").distinct()
    active = versions.filter("is_active").select("prompt_name").distinct()
    new_templates = defaults.join(known, "prompt_name", "left_anti").select(
        *[c for c in templates.columns if c in defaults.columns])
    last = versions.groupBy("prompt_name").agg(F.max("version").alias("_last"))
    missing = defaults.join(active, "prompt_name", "left_anti").join(last, "prompt_name", "left")
    new_versions = missing.select(
        "prompt_name", "content", (F.coalesce("_last", F.lit(0)) + 1).alias("version"), F.lit(True).alias("is_active"),
        F.lit(SEED_NOTE).alias("description"), F.lit(SEED_AUTHOR).alias("created_by"))
    return (templates.unionByName(new_templates, allowMissingColumns=True),
            versions.unionByName(new_versions, allowMissingColumns=True))


def usage_counts(versions: DataFrame, usage: DataFrame) -> DataFrame:
    """Versions with the uses in the log added to their count."""
    used = usage.groupBy(F.col("prompt_version_id").alias("_version")).agg(rows().alias("_uses"))
    return versions.join(used, F.col("id") == F.col("_version"), "left").select(*[
        (F.coalesce(c, F.lit(0)) + F.coalesce("_uses", F.lit(0))).cast("long").alias(c)
        if c == "usage_count" else F.col(c) for c in versions.columns])


def prompt_performance(t, days: int = 30, as_of=None) -> DataFrame:
    """Uses, success share, mean time and mean score per version over a period."""
    used = within(t["prompt_usage"], "created_at", as_of, days).groupBy("prompt_version_id").agg(
        rows().alias("uses"), F.count_if("success").alias("_ok"),
        F.avg("execution_time_ms").alias("avg_ms"),
        F.avg(F.col("output_quality_score").cast("double")).alias("avg_score"))
    versions = t["prompt_versions"].select(F.col("id").alias("_id"), "prompt_name", "version")
    return used.join(versions, F.col("prompt_version_id") == F.col("_id")).select(
        "prompt_name", "version", "uses", rate(F.col("_ok"), F.col("uses")).alias("success_rate"),
        "avg_ms", "avg_score")


def assign_variants(sessions: DataFrame, split: float, key: str = "id") -> DataFrame:
    """Variant a or b by a stable hash of the session and the traffic split."""
    digest = F.substring(F.md5(F.col(key).cast("string")), 1, 8)
    place = F.conv(digest, 16, 10).cast("long") % 10000
    return sessions.withColumn(
        "variant", F.when(place < round(split * 10000), "a").otherwise("b"))


def _micros(at) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def _midnight(number) -> Column:
    """Start of the day of a number, in microseconds."""
    return _micros(F.date_from_unix_date(number))


@F.pandas_udf(ArrayType(ArrayType(LongType())))
def _won(since: pd.Series, until: pd.Series) -> pd.Series:
    """Times since, until and place of the first piece that runs between them; pieces come best first."""
    def sweep(begin, end):
        order = sorted(range(len(begin)), key=begin.__getitem__)
        times = sorted({*begin, *end})
        out, running, at = [], [], 0
        for now, then in pairwise(times):
            while at < len(order) and begin[order[at]] <= now:
                heappush(running, order[at])
                at += 1
            while running and end[running[0]] <= now:
                heappop(running)
            if running and out and out[-1][1:] == [now, running[0]]:
                out[-1][1] = then
            elif running:
                out.append([now, then, running[0]])
        return out

    return pd.Series([sweep(x.tolist(), y.tolist()) for x, y in zip(since, until)])


def winning_tests(configs: DataFrame, first_day, last_day) -> DataFrame:
    """prompt_name, day, since, until, test_id, split, a, b: the active test that wins a prompt between two times
    (microseconds) of a day; the times do not overlap.

    Of overlapping tests the one started last wins, then the one of the smallest id. A test runs from its start
    up to its end, if it has one. Over whole days a test is cut into blocks of 1, 2, 4, ... days, and the best test of a
    block goes on to its days, so a long test makes a few rows; its first and last day are pieces. Of equal
    pieces the best remains, and of a day's pieces the times that each wins.
    """
    start, end = F.col("start_date"), F.col("end_date")
    low, high = (F.unix_date(F.lit(x).cast("date")) for x in (first_day, last_day))
    test = F.struct(F.negate(_micros(start)).alias("order"), F.col("id").alias("test_id"),
                    F.col("start_date"), F.col("end_date"), F.round(F.col("traffic_split") * 10000).alias("split"),
                    F.col("variant_a_version_id").alias("a"), F.col("variant_b_version_id").alias("b"))
    running = configs.filter(F.col("is_active") & start.isNotNull() & (end.isNull() | (end > start))).select(
        "prompt_name", test.alias("test"), F.unix_date(F.to_date(start)).alias("first"),
        F.unix_date(F.to_date(end)).alias("final"), _micros(start).alias("since"), _micros(end).alias("until")) \
        .filter((F.col("first") <= high) & (F.col("final").isNull() | (F.col("final") >= low)))

    begun = F.col("first") + (F.col("since") > _midnight(F.col("first"))).cast("int")
    whole = running.groupBy("prompt_name", F.greatest(begun, low).alias("from"),
                            F.least("final", high + 1).alias("to")).agg(F.min("test").alias("test")) \
        .filter(F.col("from") < F.col("to")).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))) \
        .withColumns({"from": F.expr("shiftright(from + shiftleft(1, level) - 1, level)"),
                      "to": F.expr("shiftright(to, level)")}).filter("from < to")
    blocks = whole.withColumn("block", F.explode(F.array_compact(F.array(
        F.when(F.col("from") % 2 != 0, F.col("from")), F.when(F.col("to") % 2 != 0, F.col("to") - 1))))) \
        .groupBy("prompt_name", "level", "block").agg(F.min("test").alias("test"))
    days = blocks.withColumn("day", F.explode(F.expr(
        "sequence(shiftleft(block, level), shiftleft(block + 1, level) - 1)"))) \
        .groupBy("prompt_name", "day").agg(F.min("test").alias("test")) \
        .select("prompt_name", "day", _midnight(F.col("day")).alias("since"),
                _midnight(F.col("day") + 1).alias("until"), "test")

    edges = F.array_distinct(F.array(
        F.struct(F.col("first").alias("day"), "since",
                 F.least("until", _midnight(F.col("first") + 1)).alias("until")),
        F.struct(F.col("final").alias("day"), F.greatest("since", _midnight(F.col("final"))).alias("since"), "until")))
    pieces = running.select("prompt_name", "test", F.explode(edges).alias("piece")) \
        .select("prompt_name", "test", "piece.*").filter((F.col("since") < F.col("until")) & F.col("day").between(low, high)) \
        .groupBy("prompt_name", "day", "since", "until").agg(F.min("test").alias("test"))

    held = days.unionByName(pieces).groupBy("prompt_name", "day").agg(
        F.sort_array(F.collect_list(F.struct("test", "since", "until"))).alias("pieces")) \
        .withColumn("won", _won(F.col("pieces.since"), F.col("pieces.until")))
    won = F.transform("won", lambda x: F.struct(x[0].alias("since"), x[1].alias("until"), F.get(
        F.col("pieces"), x[2].cast("int"))["test"].alias("test")))
    return held.select("prompt_name", F.date_from_unix_date("day").alias("day"), F.inline(won)) \
        .select("prompt_name", "day", "since", "until", "test.test_id", "test.split", "test.a", "test.b")


def assign_configured(uses: DataFrame, configs: DataFrame, key: str = "session_id",
                      time_col: str = "created_at") -> DataFrame:
    """``uses`` with test_id, variant and version_id of the test that runs for its prompt at its time, if any.

    The configuration gives prompt, dates, split and versions. Uses meet the winning tests by prompt and day, of
    which at most one has their time, so the join is one by equality and multiplies nothing. A session has one
    variant in a test, by a stable hash of both. The winning tests, at most twice as many as tests and days of
    prompts, are written once and sent if they are few.
    """
    first, last = uses.agg(F.to_date(F.min(time_col)), F.to_date(F.max(time_col))).first()
    at = scratch_dir(uses.sparkSession, "tests")
    winning_tests(configs, first, last).withColumnsRenamed({"prompt_name": "_prompt", "day": "_day"}) \
        .select("_prompt", "_day", "since", "until", F.struct("test_id", "split", "a", "b").alias("_test")) \
        .withColumnsRenamed({"since": "_since", "until": "_until"}).write.parquet(at)
    tests = send_if_small(uses.sparkSession.read.parquet(at))
    used = _micros(F.col(time_col))
    joined = uses.join(tests, (F.col("prompt_name") == F.col("_prompt")) & (F.to_date(time_col) == F.col("_day"))
                       & (used >= F.col("_since")) & (used < F.col("_until")), "left")
    digest = F.md5(F.concat_ws(":", F.col("_test.test_id").cast("string"), F.col(key).cast("string")))
    place = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 10000
    first = place < F.col("_test.split")
    return joined.select(
        *uses.columns, F.col("_test.test_id").alias("test_id"), F.when(first, "a").when(~first, "b").alias("variant"),
        F.when(first, F.col("_test.a")).otherwise(F.col("_test.b")).alias("version_id"))


def compare_variants(usage: DataFrame, variants: DataFrame) -> DataFrame:
    """Use of each variant; ``variants``: session_id, variant."""
    chosen = variants.select(F.col("session_id").alias("_session"), "variant")
    return usage.join(chosen, F.col("session_id") == F.col("_session")).groupBy("variant").agg(
        rows().alias("uses"), F.count_if("success").alias("_ok"),
        F.avg("execution_time_ms").alias("avg_ms"),
        F.avg(F.col("output_quality_score").cast("double")).alias("avg_score")) \
        .select("variant", "uses", rate(F.col("_ok"), F.col("uses")).alias("success_rate"),
                "avg_ms", "avg_score")
