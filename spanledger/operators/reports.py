"""Reports: compositions of the cube and the derived tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanledger.functions import pricing
from spanledger.functions.model import CAPABILITY_TYPES, TOKENS
from spanledger.functions.periods import granularity, resolve, window_days
from spanledger.operators import derive
from spanledger.plans import cube, fold
from spanledger.plans.spec import Spec


def _tokens() -> Column:
    return sum((F.coalesce(F.col(t), F.lit(0)) for t in TOKENS), F.lit(0))


def ask(ctx: cube.Context, metrics: str, dims: str = "", limit: int | None = None, order: str | None = None, **chosen) -> DataFrame:
    found = cube.query(Spec(tuple(metrics.split()), tuple(dims.split()), chosen, order, limit), ctx).rows
    return found if limit is None else found.limit(limit)


def _chosen(tables: dict[str, Callable[[], DataFrame]], only: tuple[str, ...]) -> dict[str, DataFrame]:
    """The tables of a report, or those of them that are asked for; the others are not planned."""
    return {name: make() for name, make in tables.items() if not only or name in only}


def overview(ctx: cube.Context, since: str = "30d", only: tuple[str, ...] = (), **chosen) -> dict[str, DataFrame]:
    """Totals, trend, agents, hosts, top projects, capabilities, errors, compactions and cost."""
    chosen = {"since": since, **chosen}
    days = window_days(resolve(since, ctx.clock()), None, ctx.clock())
    unit = granularity(days)
    return _chosen({
        "totals": lambda: ask(ctx, "events sessions tokens_total duration credits cost_total cost_api_equiv", **chosen),
        "trend": lambda: ask(ctx, "events tokens_total", unit, **chosen),
        "trend_by_host": lambda: ask(ctx, "tokens_total", f"{unit} host", **chosen),
        "agents": lambda: ask(ctx, "events sessions tokens_total cost_total", "agent", **chosen),
        "hosts": lambda: ask(ctx, "events sessions", "host", **chosen),
        "projects": lambda: ask(ctx, "tokens_total events", "project", limit=12, **chosen),
        "capabilities": lambda: ask(ctx, "events", "capability_type", **chosen),
        "errors": lambda: ask(ctx, "events", "agent", **(chosen | {"status": ["error"]})),
        "compacts": lambda: ask(ctx, "events", "agent", **(chosen | {"type": ["context.compact"]})),
        "cost": lambda: cost_view(ctx, **chosen),
    }, only)


def sessions(ctx: cube.Context, limit: int = 50, payloads: DataFrame | None = None, prefix: str | None = None) -> DataFrame:
    """Newest sessions with counts, tokens, position, and with payloads whether any is kept. prefix is literal."""
    events = ctx.events if prefix is None else ctx.events.where(F.col("session_id").startswith(prefix))
    newest = derive.session_summary(events).orderBy(F.desc("last_timestamp"), "session_id").limit(limit)
    requests = fold.folded(events, ctx.policies)
    tokens = requests.groupBy("session_id").agg(F.sum(_tokens()).alias("tokens_total"))
    rows = newest.join(tokens, "session_id", "left")
    if payloads is not None:
        kept = events.select("id", "session_id").join(payloads.select(F.col("event_id").alias("id")), "id").groupBy("session_id").agg(F.count("*").alias("payloads"))
        rows = rows.join(kept, "session_id", "left").withColumn("payloads", F.coalesce("payloads", F.lit(0)))
    position = F.row_number().over(Window.orderBy(F.desc("last_timestamp"), "session_id")).cast("long")  # over ``limit`` rows
    extra = ["payloads"] if payloads is not None else []
    return rows.select(F.col("session_id").alias("session"), "event_count", "last_timestamp", F.coalesce("tokens_total", F.lit(0)).alias("tokens_total"), *extra, position.alias("position"))


def session_detail(ctx: cube.Context, session: str, offset: int = 0, limit: int = 500, payloads: DataFrame | None = None) -> dict[str, DataFrame]:
    rows = derive.timeline(ctx.events, session, offset, limit)
    if payloads is not None:
        rows = rows.join(payloads.select(F.col("event_id").alias("id"), "kind", "role", F.substring("text", 1, 20_000).alias("text")), "id", "left")
    return {"totals": ask(ctx, "events tokens_total duration cost_total", session=[session]), "timeline": rows}


def node_payloads(ctx: cube.Context, payloads: DataFrame, session: str, node: str) -> DataFrame:
    """Payloads of an event, if it belongs to the session."""
    own = ctx.events.where((F.col("session_id") == session) & (F.col("id") == node)).select(F.col("id").alias("event_id"))
    return payloads.join(own, "event_id", "left_semi")


def resolve_session(events: DataFrame, given: str) -> str | None:
    """A session by its id, or by a prefix that only one has; more than one is an error."""
    if events.where(F.col("session_id") == given).limit(1).count():
        return given
    found = [r[0] for r in events.where(F.col("session_id").startswith(given)).select("session_id").distinct().limit(2).collect()]
    if len(found) > 1:
        raise ValueError(f"more than one session begins with {given!r}")
    return found[0] if found else None


def resolve_names(given: list[str], dimension: DataFrame) -> list[str]:
    """Ids of a dimension (id, and other columns that name it), whatever case; what none has passes through."""
    lower = [g.lower() for g in given]
    names = [c for c, t in dimension.dtypes if t == "string"]
    hits = dimension.select("id", F.explode(F.array_compact(F.array(*[F.lower(c) for c in names]))).alias("_n")).where(F.col("_n").isin(lower)).distinct().collect()
    by = {}
    for r in hits:
        by.setdefault(r["_n"], []).append(r["id"])
    return [x for g in given for x in sorted(by.get(g.lower(), [g]))]


def capabilities(ctx: cube.Context, catalog: DataFrame | None = None, names: int = 25, only: tuple[str, ...] = (), **chosen) -> dict[str, DataFrame]:
    """Types and their ``names`` most used names with duration, tokens, cost and errors; agents of each type; what each
    agent records and what it lacks; with a catalog, what is installed and was never used."""
    events = cube.filtered(ctx.events, chosen, ctx.clock())
    failed = lambda *by: events.where("capability_type is not null").groupBy(*by).agg(F.count_if(F.col("status") == "error").alias("errors"))
    figures = lambda dims, errors: ask(ctx, "events duration tokens_total cost_api_equiv", dims, **chosen).where("capability_type <> ''").join(errors, dims.split(), "left").na.fill(0, ["errors"])
    nth = F.row_number().over(Window.partitionBy("capability_type").orderBy(F.desc("events"), "capability_name"))
    tables = {
        "types": lambda: figures("capability_type", failed("capability_type")),
        "names": lambda: figures("capability_type capability_name", failed("capability_type", F.coalesce("capability_name", F.lit("")).alias("capability_name"))).withColumn("nth", nth).where(F.col("nth") <= names),
        "agents": lambda: ask(ctx, "events sessions", "capability_type agent", **chosen).where("capability_type <> ''"),
        "supports": lambda: supports(events),
    }
    return _chosen(tables | ({"never_used": lambda: never_used(events, catalog)} if catalog is not None else {}), only)


def supports(events: DataFrame) -> DataFrame:
    """For each agent with capabilities the types it records and those it lacks."""
    every = F.array(*map(F.lit, CAPABILITY_TYPES))
    seen = events.where("capability_type is not null").groupBy(F.col("agent_id").alias("agent")).agg(F.array_sort(F.collect_set("capability_type")).alias("recorded"))
    return seen.withColumn("missing", F.array_except(every, "recorded"))


def top_names(events: DataFrame, n: int = 10) -> DataFrame:
    """The n most used names of each capability type."""
    counts = events.where("capability_type is not null").groupBy("capability_type", "capability_name").agg(F.count("*").alias("events"))
    order = Window.partitionBy("capability_type").orderBy(F.desc("events"), "capability_name")
    return counts.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)


def never_used(events: DataFrame, catalog: DataFrame) -> DataFrame:
    used = events.select("capability_type", "capability_name").distinct()
    return catalog.join(used, ["capability_type", "capability_name"], "left_anti")


def missing_capabilities(events: DataFrame) -> DataFrame:
    every = F.array(*map(F.lit, CAPABILITY_TYPES))
    return events.groupBy(F.col("agent_id").alias("agent")).agg(F.collect_set("capability_type").alias("_s")).select("agent", F.array_except(every, "_s").alias("missing"))


def projects(ctx: cube.Context, labels: DataFrame | None = None, limit: int = 50, only: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Top projects, their mixes of agents, models and capabilities, working folders and recent sessions.

    Labels (project, display, root) join last, so two projects of one label stay two.
    """
    def top() -> DataFrame:
        rows = ask(ctx, "tokens_total events sessions cost_total", "project", limit=limit)
        if labels is None:
            return rows
        return rows.join(labels, "project", "left").withColumn("label", derive.label(F.col("display"), F.col("root"), F.col("project"))).drop("display", "root")

    cwd = F.get_json_object("metadata", "$.cwd")
    folders = ctx.events.where(cwd.isNotNull()).groupBy(F.col("project_id").alias("project"), cwd.alias("cwd")).agg(F.count("*").alias("events"))
    nth = lambda by, *order: F.row_number().over(Window.partitionBy(by).orderBy(*order))
    recent = derive.session_summary(ctx.events).orderBy(F.desc("last_timestamp"), "session_id").limit(800).join(derive.session_projects(ctx.events).select("session_id", F.col("project_id").alias("project")), "session_id")
    return _chosen({
        "projects": top,
        "agents": lambda: ask(ctx, "tokens_total events", "project agent"),
        "models": lambda: ask(ctx, "tokens_total", "project model"),
        "capabilities": lambda: ask(ctx, "events", "project capability_type"),
        "folders": lambda: folders.withColumn("nth", nth("project", F.desc("events"), "cwd")).where("nth <= 8"),
        "recent": lambda: recent.withColumn("nth", nth("project", F.desc("last_timestamp"), "session_id")).where("nth <= 8"),
    }, only)


def agents(ctx: cube.Context, known: list[str] | None = None, only: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Per agent, with mixes; known agents without events are listed as not recorded."""
    def each() -> DataFrame:
        rows = ask(ctx, "events sessions tokens_total duration credits cost_reported cost_api_equiv cost_total", "agent").withColumn("recorded", F.lit(True))
        if not known:
            return rows
        listed = ctx.events.sparkSession.createDataFrame([(a,) for a in known], "agent string")
        return rows.join(listed, "agent", "full").withColumn("recorded", F.coalesce("recorded", F.lit(False)))

    return _chosen({"agents": each, "hosts": lambda: ask(ctx, "events sessions", "agent host"), "models": lambda: ask(ctx, "tokens_total", "agent model"), "capabilities": lambda: ask(ctx, "events", "agent capability_type")}, only)


def models(ctx: cube.Context) -> dict[str, DataFrame]:
    rows = ask(ctx, "tokens_total events cost_api_equiv", "provider model")
    names = pricing.keyed(ctx.prices).groupBy("provider", "model").agg(F.max("price_source").alias("price_source"))
    return {"models": rows.join(names, ["provider", "model"], "left").withColumn("priced", F.col("price_source").isNotNull()), "gaps": unpriced(ctx)}


def unpriced(ctx: cube.Context) -> DataFrame:
    """Models with spend that has no price: tokens, last day, and which kinds lack one."""
    rows = cube.cost_buckets(fold.folded(ctx.events, ctx.policies), {}, ctx.prices).withColumn("_missing", pricing.missing_prices()).where("_usd is null")
    return rows.groupBy("provider", "model").agg(F.sum(_tokens()).alias("tokens"), F.max("_day").alias("last_day"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("_missing")))).alias("missing"))


def cost_view(ctx: cube.Context, **chosen) -> DataFrame:
    """Per agent: API equivalent and cash, as floors with a flag if a price is missing, its plan's fee, whether modes are mixed.

    Modes are those of the models seen. Cash is what is paid for tokens under them and, if one of them is a
    subscription, the fee of the window, once an agent; a window without an end or a start has no fee.
    """
    strict = ask(ctx, "cost_api_equiv cost_total cost_reported", "agent", **chosen)
    known = cube.portions(ctx, chosen, modes=True)
    fees = {a: o["planUsdPerMonth"] for a, o in (ctx.billing or {}).items() if o.get("planUsdPerMonth") is not None}
    days = window_days(resolve(chosen.get("since"), ctx.clock()), resolve(chosen.get("until"), ctx.clock()), ctx.clock())
    per_month = F.coalesce(*[F.when(F.col("agent") == a, F.lit(float(v))) for a, v in fees.items()], F.lit(None).cast("double"))
    rows = strict.join(known, "agent", "left").withColumn("plan_fee", F.when(F.col("on_plan"), pricing.plan_fee(per_month, F.lit(days).cast("double"))))
    return rows.select(
        "agent", F.coalesce("cost_api_equiv", "api_equivalent").alias("api_equivalent"), (F.col("cash") + F.coalesce("plan_fee", F.lit(0.0))).alias("cash"),
        F.coalesce("partial", F.lit(False)).alias("partial"), "plan_fee", F.coalesce("mixed_billing", F.lit(False)).alias("mixed_billing"), F.col("cost_reported").alias("reported"))


def usage_quality(ctx: cube.Context) -> DataFrame:
    """Naive and folded tokens of each agent, their ratio, and where usage comes from."""
    naive = ctx.events.groupBy(F.col("agent_id").alias("agent")).agg(
        F.sum(_tokens()).alias("naive"), F.count_if(F.col("usage_source") == "reported").alias("reported"), F.count_if(~F.coalesce(F.col("usage_source").isin("reported", "estimated"), F.lit(False))).alias("missing"), F.count_if(F.col("type") == "generation.end").alias("generations"))
    deduped = fold.folded(ctx.events, ctx.policies).groupBy(F.col("agent_key").alias("agent")).agg(F.sum(_tokens()).alias("deduped"))
    return naive.join(deduped, "agent").withColumn("inflation", F.when(F.col("deduped") == 0, F.lit(1.0)).otherwise(F.col("naive") / F.col("deduped")))


def usage_audit(ctx: cube.Context, stored_policies: dict[str, str] | None = None) -> DataFrame:
    """Where each agent's usage comes from, and its tokens unfolded, under its own rule, under the rules a store was
    written with, and under one rule for all; own and stored differ if a fold went wrong."""
    used = F.coalesce(*TOKENS).isNotNull()
    said, alone = F.coalesce(F.col("usage_source").isin("reported", "estimated"), F.lit(False)), F.coalesce("request_id", F.lit("")) == ""
    kind = F.col("type") == "generation.end"
    counts = ctx.events.groupBy(F.coalesce("agent_id", F.lit("")).alias("agent")).agg(
        F.count("*").alias("events"), F.count_if(F.col("usage_source") == "reported").alias("reported"), F.count_if(F.col("usage_source") == "estimated").alias("estimated"), F.count_if(~said).alias("missing"),
        F.count_if(kind).alias("generations"), F.count_if(kind & said).alias("generations_with_usage"), F.count_if(alone).alias("no_request"), F.count_if(alone & used).alias("no_request_with_usage"),
        F.count_if(used).alias("usage_rows"), F.sum(_tokens()).alias("naive"))
    total = lambda rows, policies, name, *more: fold.folded(rows, policies).groupBy(F.col("agent_key").alias("agent")).agg(F.sum(_tokens()).alias(name), *more)
    own = total(ctx.events, ctx.policies, "folded")
    rows = ctx.events.where(used)
    model = total(rows, ctx.policies if stored_policies is None else stored_policies, "model_folded", F.count("*").alias("groups"))
    out = counts.join(own, "agent").join(model, "agent", "left").join(total(rows, {}, "global_folded"), "agent", "left")
    return out.na.fill(0, ["model_folded", "global_folded", "groups"])


def flagged(events: DataFrame, path: str) -> DataFrame:
    """Events of each agent whose metadata flag is set (guessed timestamps, side threads)."""
    flag = F.coalesce(F.get_json_object("metadata", path).isin("true", "1"), F.lit(False))
    return events.groupBy(F.col("agent_id").alias("agent")).agg(F.count("*").alias("events"), F.count_if(flag).alias("flagged"))


def top_subtypes(events: DataFrame, kind: str = "unknown", n: int = 5) -> DataFrame:
    counts = events.where(F.col("type") == kind).groupBy(F.coalesce("subtype", F.lit("")).alias("subtype")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "subtype").limit(n)
    return counts.withColumn("position", F.row_number().over(Window.orderBy(F.desc("n"), "subtype")).cast("long"))


def parser_drift(events: DataFrame, current: dict[str, str]) -> DataFrame:
    now = F.coalesce(*[F.when(F.col("agent_id") == a, F.lit(v)) for a, v in current.items()])
    return events.groupBy(F.col("agent_id").alias("agent"), "parser_version", (F.col("parser_version") != now).alias("drifted")).agg(F.count("*").alias("events"))


def pivoted(rows: DataFrame, by: str, series: str, value: str, names: list[str]) -> DataFrame:
    """One column a name, zero where there is nothing. Names are given, so no extra pass finds them."""
    return rows.groupBy(by).pivot(series, names).agg(F.sum(value)).na.fill(0, names)


def pivoted_top(rows: DataFrame, by: str, series: str, value: str, top: int = 6) -> dict[str, DataFrame]:
    """Buckets with a column for each of the largest series (v1 is the largest), zero where there is nothing.

    Only series with a name and a total above zero count. If there are more than ``top``, the last column holds all
    that are not among the first. ``series`` names the columns: rank, name, total. No name comes to the driver.
    """
    named = rows.where((F.col(by) != "") & (F.col(series) != ""))
    totals = named.groupBy(series).agg(F.sum(value).alias("total")).where("total > 0")
    largest = derive.top_n_other(totals, series, "total", top)
    ranks = totals.select(series).join(largest.where(F.col("rank") < top).select(series, "rank"), series, "left").select(series, F.coalesce("rank", F.lit(top)).alias("_rank"))
    columns = [F.coalesce(F.sum(F.when(F.col("_rank") == n, F.col(value))), F.lit(0)).alias(f"v{n}") for n in range(1, top + 1)]
    return {"series": largest, "rows": rows.where(F.col(by) != "").join(ranks, series, "left").groupBy(by).agg(*columns)}


def coverage(sources: DataFrame, sessions_: DataFrame, events: DataFrame, projects_: DataFrame) -> dict[str, DataFrame]:
    """Sources that are gone, sources without events, projects without sessions, sessions without events."""
    return {
        "unreachable": sources.where("status = 'gone'"),
        "empty": sources.join(events.select(F.col("source_id").alias("id")).distinct(), "id", "left_anti"),
        "idle_projects": projects_.join(events.select(F.col("project_id").alias("id")).distinct(), "id", "left_anti"),
        "eventless": sessions_.join(events.select(F.col("session_id").alias("id")).distinct(), "id", "left_anti"),
    }


def history_coverage(index: DataFrame, files: DataFrame, sessions_: DataFrame) -> DataFrame:
    """Index entries (native_id, derived_id) without a readable file whose session was never ingested under either id."""
    left = index.join(files.select("native_id").distinct(), "native_id", "left_anti")
    return left.join(sessions_.select(F.col("id").alias("native_id")), "native_id", "left_anti").join(sessions_.select(F.col("id").alias("derived_id")), "derived_id", "left_anti")


def hooks(events: DataFrame) -> DataFrame:
    """Firings and failures of each hook; the one that fails most comes first."""
    return events.where("capability_type = 'hook'").groupBy("capability_name").agg(F.count("*").alias("fired"), F.count_if(F.col("status") == "error").alias("failed")).orderBy(F.desc("failed"), "capability_name")


def hook_totals(events: DataFrame) -> DataFrame:
    """One row: firings, failures, and the hook that fails most (ties to the smaller name; null if none fails)."""
    worst = F.min_by(F.when(F.col("failed") > 0, F.col("capability_name")), F.when(F.col("failed") > 0, F.struct(-F.col("failed"), "capability_name")))
    return hooks(events).agg(F.coalesce(F.sum("fired"), F.lit(0)).alias("fired"), F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"), worst.alias("top_failing"))


def server_states(events: DataFrame, installed: DataFrame) -> DataFrame:
    """name, state of every server seen: sightings add up, none takes another back.

    Installed and used servers are attached unless one sighting says that they failed or need authorization.
    """
    told = events.where("type = 'unknown' and subtype = 'attachment:deferred_tools_delta'")
    lists = F.map_from_arrays(F.array(*map(F.lit, ("pending", "needs_auth", "failed"))), F.array(*[F.from_json(F.get_json_object("metadata", f"$.{k}_mcp_servers"), "array<string>") for k in ("pending", "needs_auth", "failed")]))
    seen = told.select(F.explode(lists).alias("state", "_names")).select(F.explode("_names").alias("name"), "state").where("name is not null").distinct()
    used = events.where("capability_type = 'mcp' and capability_name is not null").select(F.col("capability_name").alias("name"))
    attached = installed.select("name").union(used).distinct().join(seen.where("state <> 'pending'"), "name", "left_anti")
    return seen.unionByName(attached.withColumn("state", F.lit("attached")))


def linkage(events: DataFrame) -> DataFrame:
    """Events of subagents and side threads of each agent, and those of them without a parent."""
    side = F.get_json_object("metadata", "$.subagentThread").isin("true", "1")
    mine = F.coalesce(F.col("type").isin("subagent.start", "subagent.end"), F.lit(False)) | F.coalesce(F.col("capability_type") == "subagent", F.lit(False)) | F.coalesce(side, F.lit(False))
    return events.where(mine).groupBy(F.coalesce("agent_id", F.lit("")).alias("agent")).agg(F.count("*").alias("total"), F.count_if(F.col("parent_event_id").isNull()).alias("orphan"))


def retention(sources: DataFrame) -> DataFrame:
    """One row: sources that are gone, that were rotated out, and that are read to their end."""
    return sources.agg(F.count_if(F.col("status") == "gone").alias("gone"), F.count_if(F.col("status") == "rotated").alias("rotated"), F.count_if(F.col("status").isin("ok", "active")).alias("active"))


def status(ctx: cube.Context, sources: DataFrame) -> dict[str, DataFrame]:
    today = ctx.clock() // 86_400_000 * 86_400_000
    return {"sources": sources.groupBy("agent_id").count(), "events": ask(ctx, "events", "agent"), "today": ask(ctx, "events sessions tokens_total cost_total", since=str(today))}


def parse_errors(failures: DataFrame, n: int = 3) -> DataFrame:
    return failures.groupBy("agent_id", "reason").count().orderBy(F.desc("count"), "agent_id", "reason").limit(n)


def billing_settings(ctx: cube.Context) -> DataFrame:
    """Every agent and model seen, with the billing mode in effect."""
    seen = ctx.events.select(F.col("agent_id").alias("_agent"), "provider", "model").distinct()
    return seen.select(F.col("_agent").alias("agent"), "provider", "model", cube.billing_mode(ctx.billing).alias("mode"))


def pricing_report(ctx: cube.Context) -> dict[str, DataFrame]:
    return {"gaps": unpriced(ctx), "undated": ctx.prices.where("effective_from = 0"), "priced": cube.cost_buckets(fold.folded(ctx.events, ctx.policies), {}, ctx.prices).groupBy("_priced").count()}


def doctor(ctx: cube.Context, current: dict[str, str], failures: DataFrame, stored: DataFrame | None = None, stored_policies: dict | None = None, sources: DataFrame | None = None, installed: DataFrame | None = None) -> dict:
    """Tables on the health of a store. With its sources also retention, with the installed servers (name) their states."""
    return {
        "parse_errors": parse_errors(failures), "unknown": top_subtypes(ctx.events), "quality": usage_quality(ctx), "drift": parser_drift(ctx.events, current), "guessed": flagged(ctx.events, "$.timestampGuess"),
        "orphans": derive.orphans(ctx.events).groupBy("agent_id").count(), "fold": fold.health(stored, ctx.events, stored_policies or {}, ctx.policies), "hosts": ask(ctx, "events sessions", "agent host"), "hooks": hooks(ctx.events), "hook_totals": hook_totals(ctx.events), "links": linkage(ctx.events),
    } | ({"retention": retention(sources)} if sources is not None else {}) | ({"servers": server_states(ctx.events, installed)} if installed is not None else {}) | ({"pricing": pricing_report(ctx)} if ctx.prices is not None else {})
