"""Registered queries over the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanledger import testbed
from spanledger.functions import model, pricing, text
from spanledger.functions.model import TOKENS
from spanledger.operators import derive, reports
from spanledger.plans import cube, fold
from spanledger.plans.spec import LISTS, Spec
from spanledger.sources import export

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, tuple[Query, str]] = {}
_DIGITS = 6


def context(spark: SparkSession, sf_dir: str, billing: bool = False) -> cube.Context:
    return cube.Context(testbed.events(spark, sf_dir), testbed.POLICIES, testbed.prices(spark), testbed.BILLING if billing else None, now=testbed.START + 30 * testbed.DAY)


def register(sql: str):
    def own(f: Query) -> Query:
        _FOUND[f.__name__] = (f, sql)
        return f

    return own


# The cube, generated: the same spec in DataFrame operations and in SQL.

_DIM_SQL = {"time": "day", "day": "day", "week": "strftime(date_trunc('week', make_timestamp(timestamp * 1000)), '%Y-%m-%d')", "month": "strftime(make_timestamp(timestamp * 1000), '%Y-%m')", "capability_name": "CASE WHEN capability_type IS NULL THEN '' ELSE coalesce(capability_name, '') END"}


def _dim_sql(d: str) -> str:
    return _DIM_SQL.get(d) or (f"coalesce({cube._PLAIN[d]}, '')" if d in cube._PLAIN else f"CASE WHEN capability_type = '{d}' THEN coalesce(capability_name, '') ELSE '' END")


def _where_sql(chosen: dict) -> str:
    parts = [f"{LISTS[k]} IN ({', '.join(repr(x) for x in v)})" for k, v in chosen.items() if k in LISTS and v]
    parts += [f"timestamp {op} {chosen[k]}" for k, op in (("since", ">="), ("until", "<=")) if k in chosen]
    return " AND ".join(parts + ["NOT sub"] * (chosen.get("include_subagent_threads") is False)) or "true"


_FOLD_SQL = {"tokens_input": "sum(input_tokens)", "tokens_output": "sum(output_tokens)", "tokens_cache_read": "sum(cache_read_tokens)", "tokens_cache_write": "sum(cache_write_tokens)", "tokens_reasoning": "sum(reasoning_tokens)", "duration": "sum(duration_ms)", "tokens_total": "sum(input_tokens + output_tokens + cache_read_tokens + cache_write_tokens + reasoning_tokens)"}
_MONEY = ("cost_reported", "cost_api_equiv", "cost_total", "credits")


def cube_sql(spec: Spec, billing: bool = False) -> str:
    names = [f"d_{d}" for d in spec.dims]
    dims = "".join(f"{_dim_sql(d)} AS d_{d}, " for d in spec.dims)
    on = " AND ".join(f"a.{n} = {{0}}.{n}" for n in names) or "true"
    own = "CASE WHEN cash OR usd IS NULL THEN usd ELSE 0 END" if billing else "usd"
    out = {"events": "a.events", "sessions": "a.sessions", "cost_reported": "a.cost_reported", "cost_api_equiv": "c.api", "credits": "f.credits"}
    out |= {m: f"CAST(coalesce(f.{m}, 0) AS BIGINT)" for m in _FOLD_SQL}
    out["cost_total"] = "CASE WHEN coalesce(c.n_own, 0) > 0 AND c.own IS NULL THEN NULL WHEN coalesce(c.n_own, 0) = 0 AND f.reported IS NULL THEN NULL ELSE CAST(coalesce(f.reported, 0) AS DECIMAL(30,12)) + CAST(coalesce(c.own, 0) AS DECIMAL(30,12)) END"
    chosen = ", ".join(f"CAST(round({out[m]}, {_DIGITS}) AS DOUBLE) AS {m}" if m in _MONEY else f"{out[m]} AS {m}" for m in spec.metrics)
    return f"""{testbed.sql(_where_sql(spec.filter), dims)},
a AS (SELECT {dims}count(*) AS events, count(DISTINCT session_id) AS sessions, sum(CAST(cost_reported AS DECIMAL(24,12))) AS cost_reported FROM keyed{' GROUP BY ALL' if names else ''}),
f AS (SELECT {dims}{', '.join(f'{v} AS {k}' for k, v in _FOLD_SQL.items())}, sum(CAST(credits AS DECIMAL(24,12))) AS credits, sum(CAST(rep_cost AS DECIMAL(24,12))) AS reported FROM req{' GROUP BY ALL' if names else ''}),
c AS (SELECT {''.join(n + ', ' for n in names)}CASE WHEN count(*) = count(usd) THEN sum(usd) END AS api, count(CASE WHEN unreported THEN 1 END) AS n_own,
  CASE WHEN count(CASE WHEN unreported THEN 1 END) = count(CASE WHEN unreported THEN usd END) THEN sum(CASE WHEN unreported THEN {own} END) END AS own FROM priced{' GROUP BY ALL' if names else ''})
SELECT {''.join(f'a.d_{d} AS {d}, ' for d in spec.dims)}{chosen} FROM a LEFT JOIN f ON {on.format('f')} LEFT JOIN c ON {on.format('c')}"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({m: F.round(F.col(m).cast("decimal(38,12)"), _DIGITS).cast("double") for m in _MONEY if m in df.columns})


def _cube(name: str, metrics: str, dims: str = "", billing: bool = False, **chosen) -> None:
    spec = Spec(tuple(metrics.split()), tuple(dims.split()), chosen)
    _FOUND[name] = (lambda spark, sf_dir: _rounded(cube.query(spec, context(spark, sf_dir, billing)).rows), cube_sql(spec, billing))


for _unit in ("day", "week", "month"):
    _cube(f"cube_events_by_{_unit}", "events sessions", _unit)
_cube("cube_events_by_time", "events", "time")
_cube("cube_sessions_by_agent", "events sessions", "agent")
for _d in ("host", "thread", "status", "usage_source", "provider", "session"):
    _cube(f"dim_{_d}", "events tokens_total", _d)
_cube("fold_tokens_by_agent", "events tokens_input tokens_output tokens_cache_read tokens_cache_write tokens_reasoning tokens_total", "agent")
_cube("fold_tokens_by_project", "tokens_input tokens_output tokens_total", "project")
_cube("fold_tokens_by_model", "tokens_total events", "model provider")
_cube("fold_tokens_agent_day", "tokens_total tokens_input events", "agent day")
_cube("fold_duration_by_capability", "duration events", "capability_type")
_cube("credits_by_agent", "credits events", "agent")
_cube("cost_reported_by_agent", "cost_reported events", "agent")
_cube("cost_api_equiv_by_model", "cost_api_equiv tokens_total", "model")
_cube("cost_api_equiv_by_day", "cost_api_equiv", "day")
_cube("filter_priced_cost_by_day", "cost_api_equiv", "day", model=["m-0", "m-1"])
_cube("cost_total_by_agent", "cost_total cost_api_equiv cost_reported", "agent")
_cube("filter_priced_cost_by_agent", "cost_total cost_api_equiv cost_reported", "agent", model=["m-0"])
_cube("cost_total_by_agent_model", "cost_total cost_api_equiv cost_reported credits", "agent model")
_cube("cost_by_billing_mode", "cost_total cost_api_equiv", "agent model", billing=True)
_cube("grand_totals", "events sessions tokens_total duration credits cost_reported cost_api_equiv cost_total")
_cube("filter_window", "events tokens_total", "agent", since=testbed.START + 5 * testbed.DAY, until=testbed.START + 12 * testbed.DAY)
_cube("filter_in_lists", "events tokens_total", "project", agent=["alpha", "gamma"], type=["generation.end", "message.user"], status=["ok"])
_cube("filter_model_provider", "events tokens_total", "agent", model=["m-1"], provider=["prov-1"])
_cube("filter_subagent_switch", "events tokens_total", "agent", include_subagent_threads=False)
_cube("filter_capability", "events duration", "capability_name", capability_type=["tool", "mcp"])
for _d in ("tool", "skill", "mcp", "plugin", "connector", "command", "subagent", "hook"):
    _cube(f"dim_{_d}", "events", _d)
_cube("dim_capability_name", "events duration", "capability_type capability_name")
_cube("error_counts", "events sessions", "agent", status=["error"])
_cube("host_table", "events sessions", "agent host")


@register(testbed.sql() + "SELECT agent_id AS agent, day, CAST(count(*) AS BIGINT) AS events, CAST(grouping(agent_id, day) AS BIGINT) AS level FROM ev GROUP BY GROUPING SETS ((agent_id, day), (agent_id), ())")
def grand_totals_grouping_sets(spark, sf_dir):
    df = testbed.events(spark, sf_dir).select(F.col("agent_id").alias("agent"), cube.dim("day").alias("day"))
    return df.groupingSets([["agent", "day"], ["agent"], []], "agent", "day").agg(F.count("*").alias("events"), F.grouping_id().alias("level"))


@register(testbed.sql() + "SELECT agent_key, req_key, rep_id, CAST(input_tokens AS BIGINT) AS input_tokens, CAST(output_tokens AS BIGINT) AS output_tokens, member_count, min_ts, max_ts FROM fold")
def materialized_fold(spark, sf_dir):
    return fold.folded(testbed.events(spark, sf_dir), testbed.POLICIES, certificate=True).select("agent_key", "req_key", "rep_id", "input_tokens", "output_tokens", "member_count", "min_ts", "max_ts")


_WINDOW = (testbed.START + 3 * testbed.DAY, testbed.START + 9 * testbed.DAY)


@register(testbed.sql(f"timestamp >= {_WINDOW[0]} AND timestamp <= {_WINDOW[1]}") + "SELECT agent_key AS agent, CAST(sum(input_tokens) AS BIGINT) AS tokens_input, CAST(sum(output_tokens) AS BIGINT) AS tokens_output, count(*) AS requests FROM fold GROUP BY 1")
def materialized_window_certificate(spark, sf_dir):
    events = testbed.events(spark, sf_dir)
    rows = fold.windowed(fold.folded(events, testbed.POLICIES, certificate=True), events, *_WINDOW, testbed.POLICIES)
    return rows.groupBy(F.col("agent_key").alias("agent")).agg(F.sum("input_tokens").alias("tokens_input"), F.sum("output_tokens").alias("tokens_output"), F.count("*").alias("requests"))


@register(testbed.sql() + "SELECT agent_key, req_key, rep_id, CAST(output_tokens AS BIGINT) AS output_tokens, member_count FROM fold")
def incremental_fold_equivalence(spark, sf_dir):
    events = testbed.events(spark, sf_dir)
    late = F.col("timestamp") >= testbed.START + 20 * testbed.DAY
    old = fold.folded(events.where(~late), testbed.POLICIES, certificate=True)
    return fold.refolded(old, events, fold.keyed(events.where(late), testbed.POLICIES), testbed.POLICIES).select("agent_key", "req_key", "rep_id", "output_tokens", "member_count")


@register(testbed.sql(f"timestamp >= {_WINDOW[0]}") + "SELECT agent_key, req_key, rep_id, CAST(output_tokens AS BIGINT) AS output_tokens, member_count FROM fold")
def prune_refold(spark, sf_dir):
    events = testbed.events(spark, sf_dir)
    gone = events.where(F.col("timestamp") < _WINDOW[0])
    left = events.where(F.col("timestamp") >= _WINDOW[0])
    return fold.refolded(fold.folded(events, testbed.POLICIES, certificate=True), left, fold.keyed(gone, testbed.POLICIES), testbed.POLICIES).select("agent_key", "req_key", "rep_id", "output_tokens", "member_count")


@register(testbed.sql() + "SELECT agent_id AS agent, count(*) AS n, CAST(sum(CASE WHEN req_key = id THEN 1 ELSE 0 END) AS BIGINT) AS own_key, CAST(sum(CASE WHEN request_id = '' THEN 1 ELSE 0 END) AS BIGINT) AS blank FROM keyed GROUP BY 1")
def fold_null_request_rows(spark, sf_dir):
    rows = fold.keyed(testbed.events(spark, sf_dir), testbed.POLICIES)
    return rows.groupBy(F.col("agent_id").alias("agent")).agg(F.count("*").alias("n"), F.count_if(F.col("req_key") == F.col("id")).alias("own_key"), F.count_if(F.col("request_id") == "").alias("blank"))


@register(testbed.sql() + """, g AS (SELECT agent_id, CAST(sum(mx) AS BIGINT) AS one_policy FROM (SELECT agent_id, coalesce(nullif(request_id, ''), id) AS k, max(coalesce(output_tokens, 0)) AS mx FROM ev GROUP BY ALL) GROUP BY 1), h AS (SELECT agent_key, CAST(sum(output_tokens) AS BIGINT) AS own_policy FROM fold GROUP BY 1)
SELECT g.agent_id AS agent, g.one_policy, h.own_policy, g.one_policy = h.own_policy AS same FROM g JOIN h ON h.agent_key = g.agent_id""")
def fold_policy_negative_control(spark, sf_dir):
    events = testbed.events(spark, sf_dir)
    total = lambda policies, name: fold.folded(events, policies).groupBy(F.col("agent_key").alias("agent")).agg(F.sum("output_tokens").alias(name))
    return total({}, "one_policy").join(total(testbed.POLICIES, "own_policy"), "agent").withColumn("same", F.col("one_policy") == F.col("own_policy"))


@register(testbed.sql() + "SELECT agent_key AS agent, CAST(round(sum(usd), 6) AS DOUBLE) AS api_equivalent, CAST(round(sum(CASE WHEN cash THEN usd ELSE 0 END), 6) AS DOUBLE) AS cash, bool_or(usd IS NULL) AS partial FROM priced GROUP BY 1")
def cost_portions_floor(spark, sf_dir):
    return cube.portions(context(spark, sf_dir, billing=True)).withColumns({c: F.round(F.col(c).cast("decimal(38,12)"), 6).cast("double") for c in ("api_equivalent", "cash")})


@register(testbed.sql() + "SELECT DISTINCT b.provider, b.model, CAST(b.dayno AS BIGINT) AS dayno, a.eff AS effective_from, a.pin AS input_per_mtok FROM bucket b LEFT JOIN in_force a ON a.provider = b.provider AND a.model = b.model AND a.dayno = b.dayno")
def price_asof_lookup(spark, sf_dir):
    ctx = context(spark, sf_dir)
    days = cube.cost_buckets(fold.folded(ctx.events, ctx.policies), {}, ctx.prices)
    return days.select("provider", "model", F.col("_day").alias("dayno"), "effective_from", "input_per_mtok").distinct()


@register("SELECT * FROM (VALUES ('prov-0', 'm-0', 'litellm', 2::BIGINT), ('prov-1', 'm-1', 'openrouter', 1), ('prov-1', 'm-1', 'override', 1), ('prov-9', 'm-2', 'openrouter', 1)) t(provider, model, price_source, n)")
def price_gap_fill(spark, sf_dir):
    extra = spark.createDataFrame([("prov-9", "M-2", 0, 9.0, 9.0, None, None, None, "openrouter"), ("prov-9", "m-0:free", 0, 9.0, 9.0, None, None, None, "openrouter")], testbed.PRICE_SCHEMA)
    return pricing.gap_filled(testbed.prices(spark), extra).groupBy("provider", pricing.model_name(F.col("model")).alias("model"), "price_source").agg(F.count("*").alias("n"))


@register(testbed.sql() + "SELECT b.provider, b.model, CAST(sum(i + o + cr + cw + re) AS BIGINT) AS tokens, CAST(max(b.dayno) AS BIGINT) AS last_day, count(*) AS buckets FROM priced b WHERE usd IS NULL GROUP BY 1, 2")
def price_gaps(spark, sf_dir):
    ctx = context(spark, sf_dir)
    rows = cube.cost_buckets(fold.folded(ctx.events, ctx.policies), {}, ctx.prices).where("_usd is null")
    return rows.groupBy("provider", "model").agg(F.sum(sum(F.col(t) for t in TOKENS)).alias("tokens"), F.max("_day").alias("last_day"), F.count("*").alias("buckets"))


_TOTAL = "sum(input_tokens + output_tokens + cache_read_tokens + cache_write_tokens + reasoning_tokens)"


@register(testbed.sql() + f"SELECT project_id AS project, CAST({_TOTAL} AS BIGINT) AS tokens_total, row_number() OVER (ORDER BY {_TOTAL} DESC, project_id) AS position FROM req GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def topk_projects(spark, sf_dir):
    spec = Spec(("tokens_total",), ("project",), limit=5)
    rows = cube.query(spec, context(spark, sf_dir)).rows.limit(5)
    return rows.withColumn("position", F.row_number().over(Window.orderBy(F.desc("tokens_total"), "project")).cast("long"))


@register(testbed.sql() + f""", r AS (SELECT session_id AS session, CAST({_TOTAL} AS BIGINT) AS tokens_total FROM req GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY tokens_total DESC, session) AS n FROM r WHERE tokens_total > 0)
SELECT session, tokens_total, CAST(n AS INTEGER) AS rank FROM k WHERE n < 8 UNION ALL SELECT 'Other', CAST(sum(tokens_total) AS BIGINT), 8 FROM k WHERE n >= 8""")
def topn_other(spark, sf_dir):
    rows = cube.query(Spec(("tokens_total",), ("session",)), context(spark, sf_dir)).rows
    return derive.top_n_other(rows, "session", "tokens_total", 8)


@register(testbed.sql() + "SELECT session_id, count(*) AS event_count, min(timestamp) AS first_timestamp, max(timestamp) AS last_timestamp FROM ev GROUP BY 1")
def session_summary(spark, sf_dir):
    return derive.session_summary(testbed.events(spark, sf_dir))


@register(testbed.sql() + f""", s AS (SELECT session_id, count(*) AS event_count, max(timestamp) AS last_timestamp FROM ev GROUP BY 1), t AS (SELECT session_id, CAST({_TOTAL} AS BIGINT) AS tokens_total FROM req GROUP BY 1)
SELECT s.session_id AS session, s.event_count, s.last_timestamp, coalesce(t.tokens_total, 0) AS tokens_total, row_number() OVER (ORDER BY s.last_timestamp DESC, s.session_id) AS position FROM s LEFT JOIN t USING (session_id) ORDER BY 5 LIMIT 20""")
def session_list(spark, sf_dir):
    return reports.sessions(context(spark, sf_dir), limit=20)


@register(testbed.sql() + "SELECT id, type, timestamp, raw_seq, CAST(row_number() OVER (ORDER BY timestamp, raw_seq, id) - 1 AS INTEGER) AS position FROM ev WHERE session_id = 's-7'")
def session_timeline(spark, sf_dir):
    return derive.timeline(testbed.events(spark, sf_dir), "s-7").select("id", "type", "timestamp", "raw_seq", "position")


@register(testbed.sql() + ", span AS (SELECT session_id, min(timestamp) AS lo, greatest(1, max(timestamp + coalesce(duration_ms, 0)) - min(timestamp)) AS w FROM ev GROUP BY 1) SELECT ev.session_id, ev.id, round(100.0 * (timestamp - lo) / w, 4) AS left_pct, round(greatest(0.4, 100.0 * coalesce(duration_ms, 0) / w), 4) AS width_pct FROM ev JOIN span USING (session_id)")
def session_waterfall(spark, sf_dir):
    return derive.waterfall(testbed.events(spark, sf_dir)).withColumns({c: F.round(c, 4) for c in ("left_pct", "width_pct")})


@register(testbed.sql() + ", t AS (SELECT session_id, arg_max(title, timestamp) FILTER (subtype = 'custom-title') AS c, arg_max(title, timestamp) FILTER (subtype = 'ai-title') AS a FROM ev WHERE subtype IN ('custom-title', 'ai-title') GROUP BY 1) SELECT session_id, coalesce(c, a) AS title FROM t")
def session_title(spark, sf_dir):
    return derive.session_titles(testbed.events(spark, sf_dir))


@register(testbed.sql() + ", c AS (SELECT session_id, project_id, count(*) AS n, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, project_id) AS k FROM ev GROUP BY 1, 2) SELECT session_id, project_id, n FROM c WHERE k = 1")
def session_project_mode(spark, sf_dir):
    return derive.session_projects(testbed.events(spark, sf_dir))


def _chains(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    at = [F.col("session_id"), F.col("source_id"), F.col("timestamp").alias("ts"), F.col("raw_seq").alias("seq")]
    return events.where("type = 'error'").select(F.col("id").alias("chain_id"), *at), events.where("type = 'tool.start'").select("id", F.col("id").alias("call_id"), *at)


_NEAREST = ", near AS (SELECT c.id AS chain_id, arg_max(s.id, s.raw_seq) AS spawn_id FROM ev c JOIN ev s ON s.session_id = c.session_id AND s.timestamp <= c.timestamp AND s.raw_seq <= c.raw_seq WHERE c.type = 'error' AND s.type = 'tool.start' GROUP BY 1)"


@register(testbed.sql() + _NEAREST + " SELECT * FROM near")
def subagent_nearest_spawn(spark, sf_dir):
    return derive.nearest_spawns(*_chains(testbed.events(spark, sf_dir)))


@register(testbed.sql() + _NEAREST + ", proof AS (SELECT id AS chain_id, parent_event_id AS spawn_id FROM ev WHERE type = 'error' AND parent_event_id IN (SELECT id FROM ev WHERE type = 'tool.start')) SELECT c.id AS chain_id, coalesce(p.spawn_id, n.spawn_id) AS spawn_id, CASE WHEN p.spawn_id IS NOT NULL THEN 'proof' WHEN n.spawn_id IS NOT NULL THEN 'nearest' END AS how FROM ev c LEFT JOIN proof p ON p.chain_id = c.id LEFT JOIN near n ON n.chain_id = c.id WHERE c.type = 'error'")
def subagent_proof(spark, sf_dir):
    events = testbed.events(spark, sf_dir)
    chains, spawns = _chains(events)
    closings = events.where("type = 'error'").select(F.col("id").alias("chain_id"), F.col("parent_event_id").alias("call_id"))
    return derive.subagent_links(chains, closings, spawns)


@register("""WITH RECURSIVE n AS (SELECT user_id AS id, CASE WHEN user_id % 10 = 0 THEN NULL ELSE user_id - 1 END AS parent FROM (SELECT DISTINCT user_id FROM events)),
p AS (SELECT n.id, m.id AS parent FROM n LEFT JOIN n m ON m.id = n.parent), t AS (SELECT id, id AS root, 0 AS depth FROM p WHERE parent IS NULL UNION ALL SELECT p.id, t.root, t.depth + 1 FROM p JOIN t ON p.parent = t.id) SELECT id, root, depth FROM t""")
def parent_forest_depth(spark, sf_dir):
    ids = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("id")).distinct()
    return derive.roots(ids.withColumn("parent", F.when(F.col("id") % 10 != 0, F.col("id") - 1)))


@register(testbed.sql() + "SELECT agent_id AS agent, count(*) AS n FROM ev WHERE type <> 'session.start' AND parent_event_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ev p WHERE p.session_id = ev.session_id AND p.id = ev.parent_event_id AND p.type <> 'session.start') GROUP BY 1")
def orphan_links(spark, sf_dir):
    events = testbed.events(spark, sf_dir).where("type <> 'session.start'")
    return derive.orphans(events).groupBy(F.col("agent_id").alias("agent")).agg(F.count("*").alias("n"))


@register(testbed.sql() + ", cat AS (SELECT t.c AS capability_type, 'c-' || n AS capability_name FROM (SELECT unnest(['tool','skill','mcp','plugin','connector','command','subagent','hook','other']) AS c) t, range(8) r(n)) SELECT * FROM cat WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.capability_type = cat.capability_type AND ev.capability_name = cat.capability_name)")
def never_used_anti(spark, sf_dir):
    catalog = spark.createDataFrame([(c, f"c-{n}") for c in [*model.CAPABILITY_TYPES, "other"] for n in range(8)], "capability_type string, capability_name string")
    return reports.never_used(testbed.events(spark, sf_dir), catalog)


@register(testbed.sql() + ", have AS (SELECT DISTINCT agent_id, capability_type FROM ev WHERE capability_type IS NOT NULL), a AS (SELECT DISTINCT agent_id FROM ev), c AS (SELECT unnest(['tool','skill','mcp','plugin','connector','command','subagent','hook']) AS t) SELECT a.agent_id AS agent, string_agg(c.t, ',' ORDER BY c.t) AS missing FROM a, c WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.agent_id = a.agent_id AND h.capability_type = c.t) GROUP BY 1")
def missing_capabilities(spark, sf_dir):
    return reports.missing_capabilities(testbed.events(spark, sf_dir)).select("agent", F.array_join(F.array_sort("missing"), ",").alias("missing"))


@register(testbed.sql() + f""", n AS (SELECT agent_id AS agent, CAST(sum(coalesce(input_tokens,0)+coalesce(output_tokens,0)+coalesce(cache_read_tokens,0)+coalesce(cache_write_tokens,0)+coalesce(reasoning_tokens,0)) AS BIGINT) AS naive,
 count(CASE WHEN usage_source = 'reported' THEN 1 END) AS reported, count(CASE WHEN usage_source = 'missing' THEN 1 END) AS missing, count(CASE WHEN type = 'generation.end' THEN 1 END) AS generations FROM ev GROUP BY 1),
d AS (SELECT agent_key AS agent, CAST({_TOTAL} AS BIGINT) AS deduped FROM fold GROUP BY 1) SELECT n.*, d.deduped, round(CASE WHEN d.deduped = 0 THEN 1 ELSE n.naive / d.deduped END, 9) AS inflation FROM n JOIN d USING (agent)""")
def usage_quality(spark, sf_dir):
    return reports.usage_quality(context(spark, sf_dir)).withColumn("inflation", F.round("inflation", 9))


@register(testbed.sql() + f", n AS (SELECT sum(coalesce(input_tokens,0)+coalesce(output_tokens,0)+coalesce(cache_read_tokens,0)+coalesce(cache_write_tokens,0)+coalesce(reasoning_tokens,0)) AS naive FROM ev), d AS (SELECT {_TOTAL} AS deduped FROM fold) SELECT round(naive / deduped, 9) AS inflation FROM n, d")
def inflation_ratio(spark, sf_dir):
    rows = reports.usage_quality(context(spark, sf_dir)).agg(F.sum("naive").alias("a"), F.sum("deduped").alias("b"))
    return rows.select(F.round(F.when(F.col("b") == 0, F.lit(1.0)).otherwise(F.col("a") / F.col("b")), 9).alias("inflation"))


@register(testbed.sql() + "SELECT agent_id AS agent, count(*) AS events, count(CASE WHEN sub THEN 1 END) AS flagged FROM ev GROUP BY 1")
def timestamp_guess_counts(spark, sf_dir):
    return reports.flagged(testbed.events(spark, sf_dir), "$.subagentThread")


@register(testbed.sql() + "SELECT coalesce(subtype, '') AS subtype, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, coalesce(subtype, '')) AS position FROM ev WHERE type = 'message.user' GROUP BY 1 ORDER BY 3 LIMIT 5")
def unknown_types_top5(spark, sf_dir):
    return reports.top_subtypes(testbed.events(spark, sf_dir), "message.user", 5)


@register(testbed.sql() + "SELECT agent_id AS agent, parser_version, count(*) AS events, parser_version <> 'v3' AS drifted FROM ev GROUP BY 1, 2")
def parser_drift(spark, sf_dir):
    return reports.parser_drift(testbed.events(spark, sf_dir), {a: "v3" for a in ("alpha", "beta", "gamma", "delta")})


@register(testbed.sql() + "SELECT day, " + ", ".join(f"count(CASE WHEN agent_id = '{a}' THEN 1 END) AS {a}" for a in ("alpha", "beta", "gamma", "delta")) + " FROM ev GROUP BY 1")
def trend_pivot(spark, sf_dir):
    return reports.pivoted(cube.query(Spec(("events",), ("day", "agent")), context(spark, sf_dir)).rows, "day", "agent", "events", ["alpha", "beta", "gamma", "delta"])


@register(testbed.sql() + ", s AS (SELECT day, count(*) AS v, row_number() OVER (ORDER BY day) AS i, count(*) OVER () AS n FROM ev GROUP BY day) SELECT CAST(round((sum(CASE WHEN i > n - n // 2 THEN v END) - sum(CASE WHEN i <= n // 2 THEN v END)) / sum(CASE WHEN i <= n // 2 THEN v END), 9) AS DOUBLE) AS change FROM s")
def half_over_half(spark, sf_dir):
    rows = cube.query(Spec(("events",), ("day",)), context(spark, sf_dir)).rows
    return derive.half_over_half(rows, "day", "events").select(F.round("change", 9).alias("change"))


@register("SELECT 'materialised' AS fresh, 'drifted' AS partial, 'policyMismatch' AS moved, 'absent' AS never")
def fold_health(spark, sf_dir):
    events = testbed.events(spark, sf_dir)
    whole, part = fold.folded(events, testbed.POLICIES, True), fold.folded(events.where("type <> 'error'"), testbed.POLICIES, True)
    p = testbed.POLICIES
    return spark.createDataFrame([(fold.health(whole, events, p, p), fold.health(part, events, p, p), fold.health(whole, events, {}, p), fold.health(None, events, p, p))], "fresh string, partial string, moved string, never string")


@register(testbed.sql() + f"SELECT project_id AS project, CASE WHEN project_id = 'p-3' THEN 'Third' WHEN project_id IN ('p-1', 'p-2') THEN 'repo-' || project_id ELSE project_id END AS label, CAST({_TOTAL} AS BIGINT) AS tokens_total FROM req GROUP BY 1")
def project_label_join(spark, sf_dir):
    projects = spark.createDataFrame([("p-1", None, "/home/x/repo-p-1"), ("p-2", " ", "/home/x/repo-p-2/"), ("p-3", "Third", "/y")], "project string, display string, root string")
    rows = cube.query(Spec(("tokens_total",), ("project",)), context(spark, sf_dir)).rows.join(projects, "project", "left")
    return rows.select("project", derive.label(F.col("display"), F.col("root"), F.col("project")).alias("label"), "tokens_total")


@register("SELECT p_partkey, trim(regexp_extract(regexp_replace(lower(p_brand || '[x:y] ' || p_type || '@' || p_size), '\\[[^\\]]*\\]', '', 'g'), '^([^:@]*)', 1)) AS name FROM part")
def model_name_normalize(spark, sf_dir):
    raw = F.concat(F.col("p_brand"), F.lit("[x:y] "), F.col("p_type"), F.lit("@"), F.col("p_size").cast("string"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", pricing.model_name(raw).alias("name"))


@register("SELECT o_orderkey, sha256('error' || chr(0) || lower(trim(regexp_replace(regexp_replace(regexp_replace('Failed at 0x' || o_custkey || '.. in  ' || o_orderpriority, '[0-9]+', 'N', 'g'), '0x[0-9a-fA-F]+', '0xADDR', 'g'), '[\\s.]+', ' ', 'g')))) AS fingerprint FROM orders")
def error_fingerprint(spark, sf_dir):
    raw = F.concat(F.lit("Failed at 0x"), F.col("o_custkey").cast("string"), F.lit(".. in  "), F.col("o_orderpriority"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", model.error_fingerprint(raw).alias("fingerprint"))


_ID = "sha256({} || chr(0) || coalesce({}, ''))"


@register(testbed.sql() + f"SELECT id, {_ID.format('agent_id', 'source_id')} AS source, sha256('project' || chr(0) || project_id) AS project, CASE WHEN coalesce(request_id, '') = '' THEN sha256('session-from-bucket' || chr(0) || source_id || chr(0) || CAST(timestamp // 1800000 AS VARCHAR)) ELSE sha256('session' || chr(0) || agent_id || chr(0) || request_id) END AS session, sha256(source_id || chr(0) || CAST(raw_seq AS VARCHAR) || chr(0) || type || chr(0) || CAST(timestamp AS VARCHAR) || chr(0) || coalesce(thread_id, '')) AS event FROM ev")
def deterministic_ids(spark, sf_dir):
    c = F.col
    return testbed.events(spark, sf_dir).select("id", model.source_id(c("agent_id"), c("source_id")).alias("source"), model.project_id(c("project_id")).alias("project"), model.session_id(c("agent_id"), c("request_id"), c("source_id"), F.lit(None).cast("string"), c("timestamp")).alias("session"), model.event_id(c("source_id"), c("raw_seq"), c("type"), c("timestamp"), c("thread_id")).alias("event"))


@register(testbed.sql() + "SELECT id, CASE WHEN type = 'generation.end' THEN 'chat ' || model WHEN type = 'tool.start' THEN 'execute_tool ' || capability_name ELSE type END AS span_name, CASE WHEN type = 'generation.end' THEN 'chat' WHEN type = 'tool.start' THEN 'execute_tool' END AS operation, CAST(input_tokens AS VARCHAR) AS input_tokens, model FROM ev")
def otel_attributes(spark, sf_dir):
    rows = testbed.events(spark, sf_dir)
    rows = rows.withColumn("a", export.attributes(rows.columns))
    return rows.select("id", export.span_name().alias("span_name"), F.col("a")["gen_ai.operation.name"].alias("operation"), F.col("a")["gen_ai.usage.input_tokens"].alias("input_tokens"), F.col("a")["gen_ai.request.model"].alias("model"))


@register(testbed.sql() + "SELECT id, agent_id, session_id, type, timestamp, row_number() OVER (ORDER BY timestamp, raw_seq, id) AS line FROM ev ORDER BY timestamp, raw_seq, id LIMIT 500")
def export_csv_rows(spark, sf_dir):
    rows = export.first_rows(testbed.events(spark, sf_dir), 500)
    return rows.select("id", "agent_id", "session_id", "type", "timestamp", F.row_number().over(Window.orderBy(*derive.canonical_order(rows))).alias("line"))


@register("SELECT conv_id, turn, strlen(text) AS n_bytes, strlen(text) > 64 AS truncated, CASE WHEN strlen(text) <= 64 THEN text END AS whole FROM conversations")
def payload_truncate(spark, sf_dir):
    cut = text.truncated(F.col("text"), 64)
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.octet_length("text").alias("n_bytes"), (F.octet_length(cut) < F.octet_length("text")).alias("truncated"), F.when(cut == F.col("text"), cut).alias("whole"))


@register("SELECT days, round(20.0::DOUBLE * days / (365.25::DOUBLE / 12), 9) AS fee FROM (VALUES (7.0::DOUBLE), (30.0), (NULL)) t(days)")
def plan_fee_proration(spark, sf_dir):
    return spark.createDataFrame([(7.0,), (30.0,), (None,)], "days double").select("days", F.round(pricing.plan_fee(F.lit(20.0), F.col("days")), 9).alias("fee"))


# Reports that are made of several tables: a query for each table.

_MONTH = {"since": testbed.START}
_BILLED = "CASE WHEN {0} = 'beta' THEN 'subscription' WHEN {0} = 'delta' AND provider = 'prov-0' AND model = 'm-0' THEN 'local' ELSE 'api' END"


def _asked(metrics: str, dims: str, **chosen) -> str:
    return f"({cube_sql(Spec(tuple(metrics.split()), tuple(dims.split()), chosen))})"


def _part(name: str, sql: str, report: Callable[..., dict[str, DataFrame]], part: str, **given) -> None:
    _FOUND[name] = (lambda spark, sf_dir: _rounded(report(context(spark, sf_dir), only=(part,), **given)[part]), sql)


for _p, _m, _d, _more in (
    ("totals", "events sessions tokens_total duration credits cost_total cost_api_equiv", "", {}), ("trend", "events tokens_total", "day", {}), ("trend_by_host", "tokens_total", "day host", {}), ("agents", "events sessions tokens_total cost_total", "agent", {}),
    ("hosts", "events sessions", "host", {}), ("capabilities", "events", "capability_type", {}), ("errors", "events", "agent", {"status": ["error"]}), ("compacts", "events", "agent", {"type": ["context.compact"]}),
):
    _part(f"overview_{_p}", f"SELECT * FROM {_asked(_m, _d, **_MONTH, **_more)} q", reports.overview, _p)
_part("overview_projects", f"SELECT * FROM {_asked('tokens_total events', 'project', **_MONTH)} q ORDER BY tokens_total DESC, project LIMIT 12", reports.overview, "projects")


@register(testbed.sql(f"timestamp >= {testbed.START}") + f""", s AS (SELECT agent_key AS agent, sum(usd) AS api, CAST(sum(CASE WHEN cash OR usd IS NULL THEN usd ELSE 0 END) AS DOUBLE) AS marginal, bool_or(usd IS NULL) AS partial, min(mode) <> max(mode) AS mixed, bool_or(mode = 'subscription') AS plan
 FROM (SELECT *, {_BILLED.format('agent_key')} AS mode FROM priced) GROUP BY 1), k AS (SELECT agent_id AS agent, sum(CAST(cost_reported AS DECIMAL(24,12))) AS reported FROM keyed GROUP BY 1),
j AS (SELECT k.agent, s.*, k.reported, CASE WHEN plan AND k.agent = 'beta' THEN 20.0::DOUBLE * 30 / (365.25::DOUBLE / 12) END AS fee FROM k LEFT JOIN s ON s.agent = k.agent)
SELECT agent, CAST(round(api, 6) AS DOUBLE) AS api_equivalent, round(marginal + coalesce(fee, 0), 6) AS cash, coalesce(partial, false) AS partial, round(fee, 6) AS plan_fee, coalesce(mixed, false) AS mixed_billing, CAST(round(reported, 6) AS DOUBLE) AS reported FROM j""")
def cost_view(spark, sf_dir):
    rows = reports.cost_view(context(spark, sf_dir, billing=True), since="30d")
    return rows.withColumns({c: F.round(F.col(c).cast("decimal(38,12)"), _DIGITS).cast("double") for c in ("api_equivalent", "cash", "plan_fee", "reported")})


_FAILED = f"({testbed.sql()} SELECT capability_type, {{}}count(CASE WHEN status = 'error' THEN 1 END) AS errors FROM ev WHERE capability_type IS NOT NULL GROUP BY ALL)"
_CAPABLE = "events duration tokens_total cost_api_equiv"
_part("capability_types", f"SELECT q.*, e.errors FROM {_asked(_CAPABLE, 'capability_type')} q JOIN {_FAILED.format('')} e USING (capability_type)", reports.capabilities, "types")
_part("capability_names", f"""SELECT * FROM (SELECT q.*, e.errors, CAST(row_number() OVER (PARTITION BY q.capability_type ORDER BY q.events DESC, q.capability_name) AS INTEGER) AS nth
 FROM {_asked(_CAPABLE, 'capability_type capability_name')} q JOIN {_FAILED.format('capability_name, ')} e USING (capability_type, capability_name)) WHERE nth <= 4""", reports.capabilities, "names", names=4)
_part("capability_agents", f"SELECT * FROM {_asked('events sessions', 'capability_type agent')} q WHERE capability_type <> ''", reports.capabilities, "agents")


@register(testbed.sql() + ", h AS (SELECT DISTINCT agent_id AS agent, capability_type AS t FROM ev WHERE capability_type IS NOT NULL), c AS (SELECT unnest(['tool','skill','mcp','plugin','connector','command','subagent','hook']) AS t) SELECT a.agent, string_agg(h.t, ',' ORDER BY c.t) AS recorded, string_agg(CASE WHEN h.t IS NULL THEN c.t END, ',' ORDER BY c.t) AS missing FROM (SELECT DISTINCT agent FROM h) a CROSS JOIN c LEFT JOIN h ON h.agent = a.agent AND h.t = c.t GROUP BY 1")
def capability_supports(spark, sf_dir):
    return reports.supports(testbed.events(spark, sf_dir)).select("agent", *[F.nullif(F.array_join(F.array_sort(c), ","), F.lit("")).alias(c) for c in ("recorded", "missing")])


@register(testbed.sql() + "SELECT * FROM (SELECT capability_type, capability_name, count(*) AS events, CAST(row_number() OVER (PARTITION BY capability_type ORDER BY count(*) DESC, capability_name) AS INTEGER) AS position FROM ev WHERE capability_type IS NOT NULL GROUP BY 1, 2) WHERE position <= 3")
def capability_top_names(spark, sf_dir):
    return reports.top_names(testbed.events(spark, sf_dir), 3)


for _p, _m, _d in (("agents", "tokens_total events", "project agent"), ("models", "tokens_total", "project model"), ("capabilities", "events", "project capability_type")):
    _part(f"project_{_p}", f"SELECT * FROM {_asked(_m, _d)} q", reports.projects, _p)
_part("project_recent", testbed.sql() + """, s AS (SELECT session_id, count(*) AS event_count, min(timestamp) AS first_timestamp, max(timestamp) AS last_timestamp FROM ev GROUP BY 1 ORDER BY 4 DESC, 1 LIMIT 800),
c AS (SELECT session_id, project_id AS project, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, project_id) AS k FROM ev GROUP BY 1, 2)
SELECT * FROM (SELECT s.*, c.project, CAST(row_number() OVER (PARTITION BY c.project ORDER BY last_timestamp DESC, session_id) AS INTEGER) AS nth FROM s JOIN c USING (session_id) WHERE c.k = 1) WHERE nth <= 8""", reports.projects, "recent")


@register(testbed.sql() + "SELECT * FROM (SELECT project_id AS project, title AS cwd, count(*) AS events, CAST(row_number() OVER (PARTITION BY project_id ORDER BY count(*) DESC, title) AS INTEGER) AS nth FROM ev WHERE title IS NOT NULL GROUP BY 1, 2) WHERE nth <= 8")
def project_folders(spark, sf_dir):
    titled = F.to_json(F.struct(F.get_json_object("metadata", "$.value.title").alias("cwd")))
    ctx = context(spark, sf_dir)
    ctx.events = ctx.events.withColumn("metadata", titled)
    return reports.projects(ctx, only=("folders",))["folders"]


_AGENT = "events sessions tokens_total duration credits cost_reported cost_api_equiv cost_total"
_part("agents_recorded", f"SELECT *, true AS recorded FROM {_asked(_AGENT, 'agent')} q UNION ALL SELECT 'omega', {', '.join(['NULL'] * 8)}, false", reports.agents, "agents", known=["alpha", "omega"])
for _p, _m in (("hosts", "events sessions"), ("models", "tokens_total"), ("capabilities", "events")):
    _d = {"hosts": "agent host", "models": "agent model", "capabilities": "agent capability_type"}[_p]
    _part(f"agent_{_p}", f"SELECT * FROM {_asked(_m, _d)} q", reports.agents, _p)
_part("models_priced", f"SELECT q.*, s.price_source, s.price_source IS NOT NULL AS priced FROM {_asked('tokens_total events cost_api_equiv', 'provider model')} q LEFT JOIN (VALUES ('prov-0', 'm-0', 'litellm'), ('prov-1', 'm-1', 'override')) s(provider, model, price_source) USING (provider, model)", lambda ctx, only: reports.models(ctx), "models")


@register(testbed.sql() + "SELECT provider, model, CAST(sum(i + o + cr + cw + re) AS BIGINT) AS tokens, CAST(max(dayno) AS BIGINT) AS last_day, concat_ws(',', CASE WHEN sum(cr) > 0 THEN 'cache_read_tokens' END, CASE WHEN sum(cw) > 0 THEN 'cache_write_tokens' END, CASE WHEN sum(i) > 0 THEN 'input_tokens' END, CASE WHEN sum(o) > 0 THEN 'output_tokens' END) AS missing FROM priced WHERE usd IS NULL GROUP BY 1, 2")
def model_gaps(spark, sf_dir):
    return reports.unpriced(context(spark, sf_dir)).withColumn("missing", F.array_join("missing", ","))


@register(testbed.sql() + """SELECT 'empty' AS kind, 'src-' || n_nationkey AS id FROM nation WHERE 'src-' || n_nationkey NOT IN (SELECT source_id FROM ev) UNION ALL SELECT 'unreachable', 'src-' || n_nationkey FROM nation WHERE n_regionkey = 1
 UNION ALL SELECT 'idle_projects', 'p-' || n_nationkey FROM nation WHERE 'p-' || n_nationkey NOT IN (SELECT project_id FROM ev) UNION ALL SELECT 'eventless', 's-' || c_custkey FROM customer WHERE 's-' || c_custkey NOT IN (SELECT session_id FROM ev)""")
def coverage_gaps(spark, sf_dir):
    nation, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "customer"))
    named = lambda df, prefix, key: df.withColumn("id", F.concat(F.lit(prefix), F.col(key).cast("string")))
    sources = named(nation, "src-", "n_nationkey").withColumn("status", F.when(F.col("n_regionkey") == 1, "gone").otherwise("ok"))
    found = reports.coverage(sources, named(customer, "s-", "c_custkey"), testbed.events(spark, sf_dir), named(nation, "p-", "n_nationkey"))
    parts = [df.select(F.lit(kind).alias("kind"), "id") for kind, df in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@register(testbed.sql() + "SELECT 's-' || c_custkey AS native_id, 's-' || (c_custkey + 3) AS derived_id FROM customer WHERE c_custkey % 3 <> 0 AND 's-' || c_custkey NOT IN (SELECT session_id FROM ev) AND 's-' || (c_custkey + 3) NOT IN (SELECT session_id FROM ev)")
def history_coverage(spark, sf_dir):
    key = F.col("c_custkey")
    index = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("s-"), key.cast("string")).alias("native_id"), F.concat(F.lit("s-"), (key + 3).cast("string")).alias("derived_id"), (key % 3 == 0).alias("readable"))
    seen = testbed.events(spark, sf_dir).select(F.col("session_id").alias("id")).distinct()
    return reports.history_coverage(index.drop("readable"), index.where("readable"), seen)


@register(testbed.sql() + "SELECT capability_name, count(*) AS fired, count(CASE WHEN raw_seq % 3 = 0 THEN 1 END) AS failed FROM ev WHERE capability_type = 'hook' GROUP BY 1")
def hook_failures(spark, sf_dir):
    fired = testbed.events(spark, sf_dir).where("capability_type = 'hook'").withColumn("type", F.lit("hook.fire"))
    return reports.hooks(fired.withColumn("status", F.when(F.col("raw_seq") % 3 == 0, "error").otherwise("ok")))


@register(testbed.sql() + """, h AS (SELECT capability_name AS name, count(*) AS fired, count(CASE WHEN raw_seq % 3 = 0 THEN 1 END) AS failed FROM ev WHERE capability_type = 'hook' GROUP BY 1)
SELECT CAST(sum(fired) AS BIGINT) AS fired, CAST(sum(failed) AS BIGINT) AS failed, (SELECT name FROM h WHERE failed > 0 ORDER BY failed DESC, name LIMIT 1) AS top_failing FROM h""")
def hook_totals(spark, sf_dir):
    return reports.hook_totals(testbed.events(spark, sf_dir).withColumn("status", F.when(F.col("raw_seq") % 3 == 0, "error").otherwise("ok")))


@register(testbed.sql() + "SELECT agent_id AS agent, count(*) AS total, count(CASE WHEN parent_event_id IS NULL THEN 1 END) AS orphan FROM ev WHERE type IN ('subagent.start', 'subagent.end') OR capability_type = 'subagent' OR sub GROUP BY 1")
def subagent_linkage(spark, sf_dir):
    return reports.linkage(testbed.events(spark, sf_dir))


@register(testbed.sql() + f"SELECT DISTINCT agent_id AS agent, provider, model, {_BILLED.format('agent_id')} AS mode FROM ev")
def billing_settings(spark, sf_dir):
    return reports.billing_settings(context(spark, sf_dir, billing=True))


_TODAY = testbed.START + 29 * testbed.DAY


@register(f"SELECT * FROM {_asked('events sessions tokens_total cost_total', '', since=_TODAY)} q")
def status_today(spark, sf_dir):
    ctx = context(spark, sf_dir)
    ctx.now = _TODAY + testbed.DAY // 2
    return _rounded(reports.status(ctx, spark.createDataFrame([], "agent_id string"))["today"])


@register(testbed.sql() + "SELECT eff IS NOT NULL AS priced, count(*) AS buckets FROM priced GROUP BY 1")
def pricing_report(spark, sf_dir):
    return reports.pricing_report(context(spark, sf_dir))["priced"].select(F.col("_priced").alias("priced"), F.col("count").alias("buckets"))


@register(testbed.sql() + """, s AS (SELECT session_id AS session, max(timestamp) AS last_timestamp, count(*) AS event_count FROM ev GROUP BY 1), p AS (SELECT ev.session_id AS session, count(*) AS payloads FROM conversations c JOIN ev ON ev.id = lpad(CAST(c.conv_id AS VARCHAR), 12, '0') GROUP BY 1)
SELECT session, event_count, coalesce(payloads, 0) AS payloads FROM s LEFT JOIN p USING (session) ORDER BY last_timestamp DESC, session LIMIT 20""")
def session_payloads(spark, sf_dir):
    kept = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.lpad(F.col("conv_id").cast("string"), 12, "0").alias("event_id"))
    return reports.sessions(context(spark, sf_dir), 20, kept).select("session", "event_count", "payloads")


_ALL = "coalesce(input_tokens,0)+coalesce(output_tokens,0)+coalesce(cache_read_tokens,0)+coalesce(cache_write_tokens,0)+coalesce(reasoning_tokens,0)"
_USED = "coalesce(input_tokens, output_tokens, cache_read_tokens, cache_write_tokens, reasoning_tokens) IS NOT NULL"


@register(testbed.sql() + f""", n AS (SELECT agent_id AS agent, count(*) AS events, count(CASE WHEN usage_source = 'reported' THEN 1 END) AS reported, count(CASE WHEN usage_source = 'estimated' THEN 1 END) AS estimated, count(CASE WHEN usage_source NOT IN ('reported', 'estimated') THEN 1 END) AS missing,
 count(CASE WHEN type = 'generation.end' THEN 1 END) AS generations, count(CASE WHEN type = 'generation.end' AND usage_source IN ('reported', 'estimated') THEN 1 END) AS generations_with_usage, count(CASE WHEN coalesce(request_id, '') = '' THEN 1 END) AS no_request,
 count(CASE WHEN coalesce(request_id, '') = '' AND {_USED} THEN 1 END) AS no_request_with_usage, count(CASE WHEN {_USED} THEN 1 END) AS usage_rows, CAST(sum({_ALL}) AS BIGINT) AS naive FROM ev GROUP BY 1),
o AS (SELECT agent_key AS agent, CAST({_TOTAL} AS BIGINT) AS folded FROM fold GROUP BY 1),
g AS (SELECT agent_id, req_key, coalesce(nullif(request_id, ''), id) AS one, input_tokens, output_tokens, cache_read_tokens, cache_write_tokens, reasoning_tokens FROM keyed WHERE {_USED}),
m AS (SELECT agent_id AS agent, count(DISTINCT req_key) AS groups FROM g GROUP BY 1),
w AS (SELECT agent_id AS agent, CAST({_TOTAL} AS BIGINT) AS global_folded FROM (SELECT agent_id, one, {', '.join(f'max(coalesce({t}, 0)) AS {t}' for t in TOKENS)} FROM g GROUP BY 1, 2) GROUP BY 1)
SELECT n.*, o.folded, o.folded AS model_folded, coalesce(m.groups, 0) AS groups, coalesce(w.global_folded, 0) AS global_folded FROM n JOIN o USING (agent) LEFT JOIN m USING (agent) LEFT JOIN w USING (agent)""")
def usage_audit(spark, sf_dir):
    return reports.usage_audit(context(spark, sf_dir))


@register(testbed.sql() + f""", c AS (SELECT day, session_id, {_TOTAL} AS v FROM req GROUP BY 1, 2), t AS (SELECT session_id, row_number() OVER (ORDER BY sum(v) DESC, session_id) AS r FROM c GROUP BY 1 HAVING sum(v) > 0)
SELECT day, {', '.join(f'CAST(coalesce(sum(CASE WHEN least(t.r, 6) = {n} THEN v END), 0) AS BIGINT) AS v{n}' for n in range(1, 7))} FROM c LEFT JOIN t USING (session_id) GROUP BY 1""")
def trend_pivot_top(spark, sf_dir):
    rows = cube.query(Spec(("tokens_total",), ("day", "session")), context(spark, sf_dir)).rows
    return reports.pivoted_top(rows, "day", "session", "tokens_total")["rows"]


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _FOUND.items() if s}
