"""Prompt queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewflow.operators import prompts as p
from reviewflow.plans.registry import query, rounded

query("j7_active_prompts", """
    SELECT pt.prompt_name, category, id AS version_id, version, content, performance_score,
        usage_count
    FROM prompt_templates pt JOIN prompt_versions pv ON pt.prompt_name = pv.prompt_name
    WHERE is_active""")(lambda t: p.active_prompts(t))

_ALL = """
    SELECT pt.prompt_name, category, id AS active_version_id, version AS active_version,
        coalesce(CAST(performance_score AS DOUBLE), 0) AS performance_score,
        coalesce(usage_count, 0) AS usage_count
    FROM prompt_templates pt LEFT JOIN prompt_versions pv
        ON pt.prompt_name = pv.prompt_name AND is_active"""
query("j8_all_prompts", _ALL)(lambda t: p.all_prompts(t))

query("a19_prompt_stats", f"""
    SELECT count(*) AS total_prompts,
        CAST(sum(coalesce(nullif(active_version, 0), 1)) AS BIGINT) AS total_versions,
        round(avg(usage_count), 0) AS avg_usage, round(avg(performance_score), 2) AS avg_performance
    FROM ({_ALL})""")(lambda t: p.prompt_stats(t))

_NEWEST = """
    SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY prompt_name
        ORDER BY version DESC) AS n FROM prompt_versions WHERE is_active) WHERE n = 1"""
query("w2_latest_active", _NEWEST)(lambda t: p.latest_active(t["prompt_versions"]))


def new_versions(t):
    """New texts: every part once more, under the prompt of its type and brand."""
    return t["part"].select((F.col("p_partkey") + 1_000_000).alias("id"),
                            F.col("p_brand").alias("prompt_name"), F.col("p_type").alias("content"))


for _run, _name in ((1_000_000, "w3_assign_versions"), (100, "w3_assign_versions_short_runs")):
    query(_name, """
        SELECT p_partkey + 1000000 AS id, p_brand AS prompt_name, p_type AS content,
            CAST(top + row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INT) AS version
        FROM part JOIN (SELECT prompt_name, max(version) AS top FROM prompt_versions
            GROUP BY prompt_name) ON p_brand = prompt_name""")(
        lambda t, run=_run: p.assign_versions(t["prompt_versions"], new_versions(t), run=run))

query("w7_version_history", """
    SELECT prompt_name, id, version, is_active, usage_count,
        coalesce(CAST(performance_score AS DOUBLE), 0) AS performance_score
    FROM prompt_versions""")(lambda t: p.version_history(t["prompt_versions"]))


def picks(t):
    """Pick a number by how many promo parts a brand has; brands that end in 5 pick a missing one."""
    return t["part"].groupBy(F.col("p_brand").alias("prompt_name")).agg(
        (F.count_if(F.col("p_type") == "PROMO") + 1).alias("_n")).select(
            "prompt_name", F.when(F.col("prompt_name").endswith("5"), 10_000_000)
            .otherwise(F.col("_n")).cast("int").alias("version"))


query("l10_activate", """
    SELECT pv.* REPLACE (CASE WHEN ends_with(prompt_name, '5') THEN is_active
        ELSE version = pick END AS is_active)
    FROM prompt_versions pv JOIN (SELECT p_brand, count(*) FILTER (p_type = 'PROMO') + 1 AS pick
        FROM part GROUP BY p_brand) ON prompt_name = p_brand""")(
    lambda t: p.activate(t["prompt_versions"], picks(t)))
query("l10_activate_by_id", """
    SELECT pv.* REPLACE (id = pick AS is_active) FROM prompt_versions pv
    JOIN (SELECT p_brand, max(p_partkey) AS pick FROM part GROUP BY p_brand)
        ON prompt_name = p_brand""")(
    lambda t: p.activate(t["prompt_versions"], t["part"].groupBy(
        F.col("p_brand").alias("prompt_name")).agg(F.max("p_partkey").alias("version_id"))))


def defaults(t):
    """A default prompt for every part type and every brand."""
    types = t["part"].select(F.col("p_type").alias("prompt_name"), F.lit("type").alias("category"))
    brands = t["part"].select(F.col("p_brand").alias("prompt_name"), F.lit("brand").alias("category"))
    return types.unionByName(brands).distinct() \
        .withColumn("content", F.concat(F.lit("default "), "prompt_name"))


query("l11_seed_templates", """
    SELECT prompt_name, category FROM prompt_templates
    UNION ALL SELECT DISTINCT p_type, 'type' FROM part""")(
    lambda t: p.seed_prompts(t, defaults(t))[0].select("prompt_name", "category"))
query("l11_seed_versions", """
    SELECT prompt_name, version, content, is_active, CAST(NULL AS VARCHAR) AS created_by
    FROM prompt_versions
    UNION ALL SELECT name, CAST(1 + coalesce((SELECT max(version) FROM prompt_versions
            WHERE prompt_name = name), 0) AS INT), 'default ' || name, true, 'system'
    FROM (SELECT DISTINCT p_type AS name FROM part UNION SELECT p_brand FROM part)
    WHERE name NOT IN (SELECT prompt_name FROM prompt_versions WHERE is_active)""")(
    lambda t: p.seed_prompts(t, defaults(t))[1]
    .select("prompt_name", "version", "content", "is_active", "created_by"))

query("l12_usage_counts", """
    SELECT pv.* REPLACE (CAST(usage_count + coalesce(uses, 0) AS BIGINT) AS usage_count)
    FROM prompt_versions pv LEFT JOIN (SELECT prompt_version_id, count(*) AS uses
        FROM prompt_usage GROUP BY 1) ON id = prompt_version_id""")(
    lambda t: p.usage_counts(t["prompt_versions"], t["prompt_usage"]))

query("i3_prompt_performance", """
    SELECT prompt_name, version, uses, round_even(ok / greatest(uses, 1) * 100, 1) AS success_rate,
        avg_ms, round(avg_score, 6) AS avg_score
    FROM (SELECT prompt_version_id, count(*) AS uses, count(*) FILTER (success) AS ok,
            avg(execution_time_ms) AS avg_ms, avg(CAST(output_quality_score AS DOUBLE)) AS avg_score
          FROM prompt_usage WHERE created_at > (SELECT max(created_at) FROM prompt_usage)
              - INTERVAL 365 DAY GROUP BY 1) JOIN prompt_versions ON prompt_version_id = id""")(
    lambda t: rounded(p.prompt_performance(t, 365), "avg_score"))


_VARIANT = """CASE WHEN CAST('0x' || substr(md5(CAST({0} AS VARCHAR)), 1, 8) AS BIGINT) % 10000
    < 3000 THEN 'a' ELSE 'b' END"""
query("i2_assign_variants", f"SELECT id, {_VARIANT.format('id')} AS variant FROM email_sessions")(
    lambda t: p.assign_variants(t["email_sessions"].select("id"), 0.3))
query("i2_compare_variants", f"""
    SELECT variant, uses, round_even(ok / greatest(uses, 1) * 100, 1) AS success_rate, avg_ms,
        round(avg_score, 6) AS avg_score
    FROM (SELECT {_VARIANT.format('session_id')} AS variant,
            count(*) AS uses, count(*) FILTER (success) AS ok, avg(execution_time_ms) AS avg_ms,
            avg(CAST(output_quality_score AS DOUBLE)) AS avg_score
          FROM prompt_usage GROUP BY 1)""")(
    lambda t: rounded(p.compare_variants(t["prompt_usage"], p.assign_variants(
        t["email_sessions"].select(F.col("id").alias("session_id")), 0.3, "session_id")),
        "avg_score"))


def configured(t):
    """Uses of prompts, and tests with dates: a third are active, some have no end, many overlap."""
    configs = t["ab_test_configs"].withColumns({
        "start_date": F.expr("TIMESTAMP_NTZ'1995-01-02 06:00:00' + make_interval(0, 0, 0, CAST(id % 2400 AS INT))"),
        "end_date": F.expr("""CASE WHEN id % 11 <> 0 THEN TIMESTAMP_NTZ'1995-01-02 18:00:00'
            + make_interval(0, 0, 0, CAST(id % 2400 + id % 50 AS INT)) END""")})
    names = t["prompt_versions"].select(F.col("id").alias("_id"), "prompt_name")
    uses = t["prompt_usage"].join(names, F.col("prompt_version_id") == F.col("_id")).select(
        "session_id", "node_name", "prompt_name", "created_at", "execution_time_ms")
    return p.assign_configured(uses, configs)


_CONFIGURED = """
    WITH cfg AS (SELECT id, prompt_name, variant_a_version_id AS a, variant_b_version_id AS b, traffic_split,
            TIMESTAMP '1995-01-02 06:00:00' + to_days(CAST(id % 2400 AS INT)) AS since,
            CASE WHEN id % 11 <> 0 THEN TIMESTAMP '1995-01-02 18:00:00'
                + to_days(CAST(id % 2400 + id % 50 AS INT)) END AS until
        FROM ab_test_configs WHERE is_active),
    used AS (SELECT row_number() OVER () AS n, session_id, node_name, prompt_name, created_at, execution_time_ms
        FROM prompt_usage JOIN prompt_versions v ON prompt_version_id = v.id),
    met AS (SELECT u.*, c.id AS test_id, a, b, traffic_split FROM used u LEFT JOIN cfg c
        ON u.prompt_name = c.prompt_name AND since <= created_at AND (until IS NULL OR created_at < until)
        QUALIFY row_number() OVER (PARTITION BY n ORDER BY since DESC, c.id) = 1),
    placed AS (SELECT *, CAST('0x' || substr(md5(test_id || ':' || session_id), 1, 8) AS BIGINT) % 10000
        < traffic_split * 10000 AS first FROM met),
    chosen AS (SELECT session_id, node_name, prompt_name, created_at, execution_time_ms, test_id,
        CASE WHEN first THEN 'a' WHEN NOT first THEN 'b' END AS variant,
        CASE WHEN first THEN a WHEN NOT first THEN b END AS version_id FROM placed)
"""
query("i2_configured_variants", _CONFIGURED + "SELECT * FROM chosen")(configured)
query("i2_configured_comparison", _CONFIGURED + """
    SELECT test_id, variant, version_id, count(*) AS uses, avg(execution_time_ms) AS avg_ms
    FROM chosen WHERE test_id IS NOT NULL GROUP BY ALL""")(
    lambda t: configured(t).filter("test_id IS NOT NULL").groupBy("test_id", "variant", "version_id").agg(
        F.count("*").alias("uses"), F.avg("execution_time_ms").alias("avg_ms")))
