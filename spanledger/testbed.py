"""The driver's generic event table as agent events: a fixed projection, for queries that need a store."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POLICIES = {"gamma": "per_record_sum"}
BILLING = {"beta": {"mode": "subscription", "planUsdPerMonth": 20.0}, "delta": {"mode": "api", "models": {"prov-0/m-0": "local"}}}
DAY = 86_400_000
START = 1_704_067_200_000  # 2024-01-01
PRICES = [
    ("prov-0", "m-0", 0, 3.0, 15.0, 0.3, 3.75, None, "litellm"),
    ("prov-0", "m-0", START + 14 * DAY, 2.0, 10.0, 0.2, 2.5, 12.0, "litellm"),
    ("prov-1", "m-1", START + 4 * DAY, 1.0, 5.0, 0.1, 1.25, None, "openrouter"),
    ("prov-1", "m-1", START + 4 * DAY, 1.5, 6.0, 0.1, 1.25, None, "override"),
]
PRICE_SCHEMA = "provider string, model string, effective_from long, input_per_mtok double, output_per_mtok double, cache_read_per_mtok double, cache_write_per_mtok double, reasoning_per_mtok double, price_source string"


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, PRICE_SCHEMA)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    e, u, t = F.col("event_id"), F.col("user_id"), F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("long")
    text = lambda prefix, n: F.concat(F.lit(prefix), (u % n).cast("string") if n else u.cast("string"))
    agent = F.element_at(F.array(*map(F.lit, ["alpha", "beta", "gamma", "delta"])), (u % 4 + 1).cast("int"))
    kinds = {"purchase": "generation.end", "click": "tool.start", "view": "message.user", "error": "error", "signup": "session.start"}
    kind = F.coalesce(*[F.when(t == a, F.lit(b)) for a, b in kinds.items()], F.lit("unknown"))
    caps = ["tool", "skill", "mcp", "plugin", "connector", "command", "subagent", "hook"]
    cap = F.when(t == "click", F.element_at(F.array(*map(F.lit, caps)), (u % 8 + 1).cast("int")))
    order = Window.partitionBy("session_id").orderBy("timestamp", "id")
    rows = raw.select(
        F.lpad(e.cast("string"), 12, "0").alias("id"), agent.alias("agent_id"), text("h-", 2).alias("host_id"), text("src-", 5).alias("source_id"), text("s-", 0).alias("session_id"), text("p-", 10).alias("project_id"),
        F.when(u % 4 == 2, text("t-", 0)).alias("thread_id"), F.when(e % 7 == 0, F.lit(None)).when(e % 11 == 0, F.lit("")).otherwise(F.floor(e / 3).cast("string")).alias("request_id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), kind.alias("type"), F.when(t == "view", F.when(e % 5 == 0, "custom-title").when(e % 3 == 0, "ai-title")).when(t == "signup", "started").alias("subtype"),
        text("prov-", 3).alias("provider"), text("m-", 3).alias("model"), F.when(t == "purchase", 10 * k).alias("input_tokens"), F.when(t.isin("purchase", "view"), k).alias("output_tokens"),
        F.when((t == "purchase") & (e % 2 == 0), 3 * k).alias("cache_read_tokens"), F.when((t == "purchase") & (e % 4 == 0), k).alias("cache_write_tokens"), F.when((t == "purchase") & (e % 3 == 0), 2 * k).alias("reasoning_tokens"),
        F.when(t.isin("purchase", "view"), "reported").otherwise("missing").alias("usage_source"), F.when(t == "error", "error").otherwise("ok").alias("status"),
        F.when((u % 4 == 3) & (e % 5 == 0), F.round("value", 2)).alias("cost_reported"), F.when(u % 4 == 1, F.round("value", 2)).alias("credits"),
        cap.alias("capability_type"), F.when(cap.isNotNull(), F.concat(F.lit("c-"), (e % 6).cast("string"))).alias("capability_name"), F.when(t == "click", F.round(F.col("value") * 10).cast("long")).alias("duration_ms"),
        F.when(t == "view", F.concat(F.lit('{"value":{"title":"T '), (e % 97).cast("string"), F.lit('"},"subagentThread":'), (e % 13 == 0).cast("string"), F.lit("}"))).otherwise(F.concat(F.lit('{"subagentThread":'), (e % 13 == 0).cast("string"), F.lit("}"))).alias("metadata"),
        F.concat(F.lit("v"), (u % 3 + 1).cast("string")).alias("parser_version"), e.alias("_e"))
    return rows.withColumn("raw_seq", F.row_number().over(order).cast("long")).withColumn("parent_event_id", F.lag("id").over(order)).drop("_e")


#: The same projection for DuckDB, as common table expressions that queries go on from.
SQL = """
WITH base AS (
  SELECT event_id AS e, user_id AS u, event_type AS t, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, epoch_us(ts) // 1000 AS timestamp FROM events),
ev0 AS (
  SELECT lpad(CAST(e AS VARCHAR), 12, '0') AS id, ['alpha','beta','gamma','delta'][u % 4 + 1] AS agent_id, 'h-' || (u % 2) AS host_id, 'src-' || (u % 5) AS source_id, 's-' || u AS session_id, 'p-' || (u % 10) AS project_id,
    CASE WHEN u % 4 = 2 THEN 't-' || u END AS thread_id, CASE WHEN e % 7 = 0 THEN NULL WHEN e % 11 = 0 THEN '' ELSE CAST(e // 3 AS VARCHAR) END AS request_id, timestamp,
    CASE t WHEN 'purchase' THEN 'generation.end' WHEN 'click' THEN 'tool.start' WHEN 'view' THEN 'message.user' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'session.start' ELSE 'unknown' END AS type,
    CASE WHEN t = 'view' AND e % 5 = 0 THEN 'custom-title' WHEN t = 'view' AND e % 3 = 0 THEN 'ai-title' WHEN t = 'signup' THEN 'started' END AS subtype,
    'prov-' || (u % 3) AS provider, 'm-' || (u % 3) AS model, CASE WHEN t = 'purchase' THEN 10 * k END AS input_tokens, CASE WHEN t IN ('purchase', 'view') THEN k END AS output_tokens,
    CASE WHEN t = 'purchase' AND e % 2 = 0 THEN 3 * k END AS cache_read_tokens, CASE WHEN t = 'purchase' AND e % 4 = 0 THEN k END AS cache_write_tokens, CASE WHEN t = 'purchase' AND e % 3 = 0 THEN 2 * k END AS reasoning_tokens,
    CASE WHEN t IN ('purchase', 'view') THEN 'reported' ELSE 'missing' END AS usage_source, CASE WHEN t = 'error' THEN 'error' ELSE 'ok' END AS status,
    CASE WHEN u % 4 = 3 AND e % 5 = 0 THEN round(value, 2) END AS cost_reported, CASE WHEN u % 4 = 1 THEN round(value, 2) END AS credits,
    CASE WHEN t = 'click' THEN ['tool','skill','mcp','plugin','connector','command','subagent','hook'][u % 8 + 1] END AS capability_type, CASE WHEN t = 'click' THEN 'c-' || (e % 6) END AS capability_name,
    CASE WHEN t = 'click' THEN CAST(round(value * 10) AS BIGINT) END AS duration_ms, CASE WHEN t = 'view' THEN 'T ' || (e % 97) END AS title, e % 13 = 0 AS sub, 'v' || (u % 3 + 1) AS parser_version
  FROM base),
ev AS (SELECT *, row_number() OVER w AS raw_seq, lag(id) OVER w AS parent_event_id, strftime(make_timestamp(timestamp * 1000), '%Y-%m-%d') AS day FROM ev0 WINDOW w AS (PARTITION BY session_id ORDER BY timestamp, id)),
keyed AS (SELECT *, CASE WHEN agent_id = 'gamma' THEN id ELSE coalesce(nullif(request_id, ''), id) END AS req_key FROM ev WHERE {where}),
fold AS (
  SELECT agent_id AS agent_key, req_key, max(coalesce(input_tokens, 0)) AS input_tokens, max(coalesce(output_tokens, 0)) AS output_tokens, max(coalesce(cache_read_tokens, 0)) AS cache_read_tokens,
    max(coalesce(cache_write_tokens, 0)) AS cache_write_tokens, max(coalesce(reasoning_tokens, 0)) AS reasoning_tokens, max(coalesce(duration_ms, 0)) AS duration_ms, max(cost_reported) AS rep_cost, max(credits) AS credits,
    max(id) AS rep_id, count(*) AS member_count, min(timestamp) AS min_ts, max(timestamp) AS max_ts FROM keyed GROUP BY ALL),
req AS (SELECT f.*, f.agent_key AS agent_id, r.host_id, r.project_id, r.session_id, r.thread_id, r.model, r.provider, r.capability_type, r.capability_name, r.status, r.usage_source, r.timestamp, r.day FROM fold f JOIN ev r ON r.id = f.rep_id),
prices(provider, model, eff, pin, pout, pcr, pcw, preason, prio) AS (VALUES
  ('prov-0', 'm-0', 0::BIGINT, 3.0::DOUBLE, 15.0::DOUBLE, 0.3::DOUBLE, 3.75::DOUBLE, NULL::DOUBLE, 1), ('prov-0', 'm-0', 1705276800000, 2.0, 10.0, 0.2, 2.5, 12.0, 1),
  ('prov-1', 'm-1', 1704412800000, 1.0, 5.0, 0.1, 1.25, NULL, 2), ('prov-1', 'm-1', 1704412800000, 1.5, 6.0, 0.1, 1.25, NULL, 4)),
bucket AS (
  SELECT {dims}agent_key, provider, model, timestamp // 86400000 AS dayno, rep_cost IS NULL AS unreported, sum(input_tokens) AS i, sum(output_tokens) AS o, sum(cache_read_tokens) AS cr, sum(cache_write_tokens) AS cw, sum(reasoning_tokens) AS re
  FROM req GROUP BY ALL HAVING sum(input_tokens + output_tokens + cache_read_tokens + cache_write_tokens + reasoning_tokens) > 0),
in_force AS (
  SELECT d.provider, d.model, d.dayno, arg_max(q.pin, q.eff * 10 + q.prio) AS pin, arg_max(q.pout, q.eff * 10 + q.prio) AS pout, arg_max(q.pcr, q.eff * 10 + q.prio) AS pcr, arg_max(q.pcw, q.eff * 10 + q.prio) AS pcw,
    arg_max(coalesce(q.preason, 0), q.eff * 10 + q.prio) AS preason, max(q.eff) AS eff
  FROM (SELECT DISTINCT provider, model, dayno FROM bucket) d JOIN prices q ON q.provider = d.provider AND q.model = d.model AND q.eff <= d.dayno * 86400000 + 43200000 GROUP BY ALL),
priced AS (
  SELECT b.*, p.eff, CAST(b.i AS DECIMAL(13,0)) * e(p.pin) + CAST(b.o AS DECIMAL(13,0)) * e(p.pout) + CAST(b.cr AS DECIMAL(13,0)) * e(p.pcr) + CAST(b.cw AS DECIMAL(13,0)) * e(p.pcw) + CAST(b.re AS DECIMAL(13,0)) * e(p.preason) AS usd,
    CASE WHEN b.agent_key = 'beta' OR (b.agent_key = 'delta' AND b.model = 'm-0') THEN false ELSE true END AS cash
  FROM bucket b LEFT JOIN in_force p ON p.provider = b.provider AND p.model = b.model AND p.dayno = b.dayno)
"""


def sql(where: str = "true", dims: str = "") -> str:
    """The common table expressions with a filter on events before the fold, and dimensions of the price buckets."""
    each = lambda m: f"CAST(CAST({m[1]} AS DECIMAL(18,6)) * CAST(0.000001 AS DECIMAL(7,6)) AS DECIMAL(20,12))"  # noqa: E731  dollars a token
    return re.sub(r"\be\(([a-z.]+)\)", each, SQL).replace("{where}", where).replace("{dims}", dims)
