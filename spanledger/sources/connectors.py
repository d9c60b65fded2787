"""Connectors: one description an agent, from which columns are built that turn its records into events."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.functions import model
from spanledger.functions.model import EVENT_SCHEMA
from spanledger.functions.shared import stored
from spanledger.functions.text import host_slug
from spanledger.operators import derive
from spanledger.sources.scan import json_at, record_time, split_malformed


@dataclass(frozen=True)
class Connector:
    """What differs between agents. Usage paths are tried in order; ``includes_cache``: input counts cached tokens too."""

    agent: str
    policy: str
    parser_version: str
    glob: str = "*.jsonl"
    kind: tuple[str, ...] = ("$.type",)
    record: tuple[str, ...] = ("$.uuid", "$.id")
    session: tuple[str, ...] = ("$.sessionId", "$.session_id", "$.sessionID")
    request: tuple[str, ...] = ("$.requestId",)
    fallback_request: bool = False
    provider: str | None = None
    provider_paths: tuple[str, ...] = ()
    model: tuple[str, ...] = ("$.message.model", "$.model")
    usage: dict[str, tuple[str, ...]] = field(default_factory=dict)
    includes_cache: str = ""  # "read" or "both"
    credits: tuple[str, ...] = ()
    cost: tuple[str, ...] = ()
    host: tuple[str, ...] = ()
    default_host: str = "cli"
    content: str = "$.message.content"
    types: dict[str, str] = field(default_factory=dict)  # record type to event type
    subagent: str | None = None
    chain: str | None = None  # id of the side chain that a record belongs to
    closing: tuple[str, ...] = ()  # id of the side chain whose end a record tells
    zero_is_missing: bool = False
    placeholder: str | None = None  # model of records whose usage does not count


_MESSAGE_USAGE = {
    "input_tokens": ("$.message.usage.input_tokens",), "output_tokens": ("$.message.usage.output_tokens",), "cache_read_tokens": ("$.message.usage.cache_read_input_tokens",),
    "cache_write_tokens": ("$.message.usage.cache_creation_input_tokens",), "reasoning_tokens": ("$.message.usage.reasoning_tokens", "$.message.usage.thinking_tokens", "$.message.usage.output_tokens_details.thinking_tokens"),
}
_MESSAGES = {"assistant": "message.assistant", "user": "message.user", "attachment": "hook.fire", "summary": "unknown"}
_STEPS = {"session": "session.start", "step-start": "generation.start", "step-finish": "generation.end", "tool": "tool.start", "text": "message.assistant", "patch": "unknown"}

CONNECTORS = {c.agent: c for c in (
    Connector("claude-code", "request_max", "3", fallback_request=True, provider="anthropic", usage=_MESSAGE_USAGE, host=("$.entrypoint",), types=_MESSAGES, subagent="$.isSidechain", chain="$.agentId", closing=("$.toolUseResult.agentId", "$.toolUseResult.agent_id"), placeholder="<synthetic>"),
    Connector("qoder", "request_max", "2", fallback_request=True, provider="qoder", usage=_MESSAGE_USAGE, request=("$.requestTokenAnchor", "$.requestId"), credits=("$.message.usage.credits", "$.usage.credits"), types=_MESSAGES, subagent="$.isSidechain", zero_is_missing=True),
    Connector(
        "codex", "last_call_sum", "2", glob="rollout-*.jsonl", kind=("$.payload.type", "$.type"), record=("$.payload.id",), session=("$.payload.session_id",), request=("$.payload.response_id",), provider="openai", model=("$.payload.model", "$.payload.info.model"),
        usage={"input_tokens": ("$.payload.info.last_token_usage.input_tokens", "$.payload.usage.input_tokens"), "output_tokens": ("$.payload.info.last_token_usage.output_tokens", "$.payload.usage.output_tokens"), "cache_read_tokens": ("$.payload.info.last_token_usage.cached_input_tokens", "$.payload.usage.cached_input_tokens"), "cache_write_tokens": ("$.payload.info.last_token_usage.cache_write_input_tokens", "$.payload.usage.cache_write_input_tokens"), "reasoning_tokens": ("$.payload.info.last_token_usage.reasoning_output_tokens", "$.payload.usage.reasoning_output_tokens")},
        includes_cache="read", host=("$.payload.originator",), content="$.payload.content", types={"session_meta": "session.start", "message": "message.assistant", "user_message": "message.user", "function_call": "tool.start", "function_call_output": "tool.result", "token_count": "generation.end", "token_usage_record": "generation.end", "error": "error", "compacted": "context.compact"}),
    Connector(
        "workbuddy", "request_max", "2", record=("$.id",), request=("$.providerData.requestId",), provider="workbuddy", model=("$.providerData.model",), content="$.content",
        usage={"input_tokens": ("$.providerData.usage.input_tokens",), "output_tokens": ("$.providerData.usage.output_tokens",), "cache_read_tokens": ("$.providerData.usage.cache_read_input_tokens",)},
        types={"function_call": "tool.start", "function_call_result": "tool.result", "message": "message.assistant", "reasoning": "message.assistant"}),
    Connector(
        "pi", "request_max", "2", record=("$.id",), request=("$.message.responseId",), provider_paths=("$.message.provider",), cost=("$.message.usage.cost.total", "$.message.cost"),
        usage={"input_tokens": ("$.message.usage.input",), "output_tokens": ("$.message.usage.output",), "cache_read_tokens": ("$.message.usage.cacheRead",), "cache_write_tokens": ("$.message.usage.cacheWrite",)},
        types={"session": "session.start", "message": "message.assistant", "toolResult": "tool.result"}),
    Connector(
        "opencode", "per_record_sum", "2", kind=("$.data.type", "$.type"), record=("$.id",), session=("$.session_id",), request=("$.id",), provider_paths=("$.data.providerID",), model=("$.data.modelID",), cost=("$.data.cost",), content="$.data.content",
        usage={"input_tokens": ("$.data.tokens.input",), "output_tokens": ("$.data.tokens.output",), "reasoning_tokens": ("$.data.tokens.reasoning",), "cache_read_tokens": ("$.data.tokens.cache.read",), "cache_write_tokens": ("$.data.tokens.cache.write",)}, types=_STEPS),
    Connector(
        "zcode", "per_record_sum", "4", kind=("$.data.type", "$.type"), record=("$.id",), session=("$.session_id",), request=("$.logical_request_id",), provider_paths=("$.provider_id",), model=("$.model_id",), content="$.data.content",
        usage={"input_tokens": ("$.input_tokens",), "output_tokens": ("$.output_tokens",), "reasoning_tokens": ("$.reasoning_tokens",), "cache_read_tokens": ("$.cache_read_input_tokens",), "cache_write_tokens": ("$.cache_creation_input_tokens",)}, includes_cache="both",
        types=_STEPS | {"step-finish": "unknown", "model_usage": "generation.end", "tool_usage": "tool.end"}),
)}


#: Lists of servers in an attachment, by their names in the metadata.
SERVER_STATES = {"pending_mcp_servers": "pendingMcpServers", "needs_auth_mcp_servers": "needsAuthMcpServers", "failed_mcp_servers": "failedMcpServers"}
CALLS = ["tool.start", "mcp.invoke", "plugin.invoke", "skill.invoke"]


def json_number(x: Column) -> Column:
    """A number as JSON writes it: whole ones without a fraction."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def first_of(paths: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.nullif(json_at(p), F.lit("")) for p in paths]) if paths else F.lit(None).cast("string")


def tokens(c: Connector) -> dict[str, Column]:
    """Token columns: whole, not negative; null where the record has no usage at all."""
    raw = {t: first_of(c.usage.get(t, ())).try_cast("double") for t in model.TOKENS}
    used = F.coalesce(*raw.values()).isNotNull()
    if c.placeholder:
        used = used & (F.coalesce(first_of(c.model), F.lit("")) != c.placeholder)
    own = {t: F.floor(F.greatest(F.lit(0.0), F.coalesce(v, F.lit(0.0)))) for t, v in raw.items()}
    if c.zero_is_missing:
        used = used & (sum(own.values(), F.lit(0)) > 0)
    if c.includes_cache:
        cached = own["cache_read_tokens"] + (own["cache_write_tokens"] if c.includes_cache == "both" else F.lit(0))
        own["input_tokens"] = F.greatest(F.lit(0), own["input_tokens"] - cached)
    return {t: F.when(used, v).cast("long") for t, v in own.items()}


def capability(name: Column, given: Column | None = None) -> tuple[Column, Column, Column]:
    """Type, name and provider of what a tool call uses, by the shape of the tool's name and its input (JSON).

    A server's tool is named without its server, which is the provider; skills and subagents by what the input says.
    """
    given = F.lit(None).cast("string") if given is None else given
    server, tool = (F.nullif(F.regexp_extract(name, "^mcp__(.+?)__(.+)$", n), F.lit("")) for n in (1, 2))
    entry = name.isin("Task", "Agent", "spawn_agent")
    kind = F.when(server.isNotNull() & server.rlike("^plugin[_-]"), "plugin").when(server.isNotNull(), "mcp").when(entry, "subagent").when(name == "Skill", "skill").when(name.isNotNull(), "tool")
    said = lambda *keys: F.coalesce(*[F.nullif(F.get_json_object(given, f"$.{k}"), F.lit("")) for k in keys])
    named = F.when(server.isNotNull(), tool).when(entry, F.coalesce(said("subagent_type"), name)).when(name == "Skill", F.coalesce(said("skill", "command"), name)).otherwise(name)
    return kind, named, F.when(server.isNotNull(), server).when(entry, name)


def event_of_kind(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in {"mcp": "mcp.invoke", "plugin": "plugin.invoke", "skill": "skill.invoke"}.items()], F.lit("tool.start"))


def normalized(scanned: DataFrame, c: Connector, clock: int) -> tuple[DataFrame, DataFrame]:
    """Events and failures of framed lines (path, modified, seq, offset, line, oversized).

    A record makes one primary event, and each tool block in its content one more, below the primary one. A record of
    no known type becomes ``unknown`` with its type as the subtype, and so does an attachment that tells of no hook:
    nothing vanishes. The first record of a side chain also starts it, and the one that brings its result ends it;
    ``linked`` gives starts, ends, results and hooks the event that they belong to.
    """
    good, failures = split_malformed(scanned)
    at, origin = record_time(F.col("modified"), clock)
    kind = first_of(c.kind)
    good = good.withColumns({"_ts": at, "_origin": origin, "_kind": kind, "_source": model.source_id(F.lit(c.agent), F.col("path"))})
    native, record = first_of(c.session), first_of(c.record)
    good = good.withColumn("_session", model.session_id(F.lit(c.agent), native, F.col("_source"), record, F.col("_ts")))
    request = first_of(c.request)
    if c.fallback_request:
        request = F.coalesce(request, F.when(native.isNotNull() & record.isNotNull(), F.concat(F.lit("req#"), native, F.lit("/"), record)))
    own = tokens(c)
    used = own["output_tokens"].isNotNull()
    mapped = F.coalesce(*[F.when(F.col("_kind") == k, F.lit(v)) for k, v in c.types.items()], F.lit("unknown"))
    role = F.coalesce(json_at("$.message.role"), json_at("$.payload.role"), json_at("$.role"))
    attached = F.when(mapped == "hook.fire", F.coalesce(json_at("$.attachment.type"), F.lit("unknown")))
    mapped = F.when(attached.isNotNull() & ~attached.startswith("hook"), F.lit("unknown")).otherwise(mapped)
    primary = F.when(used, F.lit("generation.end")).when((mapped == "message.assistant") & (role == "user"), F.lit("message.user")).otherwise(mapped)
    failed = F.coalesce(json_at("$.is_error") == "true", json_at("$.error").isNotNull() | (mapped == "error"), F.lit(False))
    side = F.coalesce(json_at(c.subagent) == "true", F.lit(False)) if c.subagent else F.lit(False)
    cwd = F.coalesce(json_at("$.cwd"), json_at("$.payload.cwd"), json_at("$.directory"))
    # columns of their own, so that events, blocks and edges don't each repeat what gives them
    good = good.withColumns({"_used": used, "_mapped": mapped, "_attached": attached, "_primary": primary})
    used, mapped, attached, primary = (F.col(n) for n in ("_used", "_mapped", "_attached", "_primary"))
    chain = F.when(side, first_of((c.chain,))) if c.chain else F.lit(None).cast("string")
    about = [cwd.alias("cwd"), F.when(side, F.lit(True)).alias("subagentThread"), F.when(F.col("_origin") != "record", F.lit(True)).alias("timestampGuess"), F.col("_kind").alias("recordType"), F.struct(F.coalesce(json_at("$.title"), json_at("$.value.title")).alias("title")).alias("value")]
    metadata = lambda **more: F.to_json(F.struct(*about, *[v.alias(k) for k, v in ({"agent_id": chain} | more).items()]))
    host = F.coalesce(host_slug(first_of(c.host)), F.lit(c.default_host))
    provider = F.coalesce(first_of(c.provider_paths), F.lit(c.provider).cast("string"))
    common = {
        "agent_id": F.lit(c.agent), "host_id": F.concat(F.lit(f"{c.agent}-"), host), "source_id": F.col("_source"), "session_id": F.col("_session"), "project_id": F.when(cwd.isNotNull(), model.project_id(cwd)),
        "thread_id": F.when(side, first_of(("$.agentId", "$.uuid"))), "request_id": request, "timestamp": F.col("_ts"), "ingested_at": F.lit(clock), "schema_version": F.lit(1), "raw_seq": F.col("seq"), "raw_offset": F.col("offset"),
        "parser_version": F.lit(c.parser_version), "provider": F.when(first_of(c.model).isNotNull(), provider), "model": first_of(c.model),
    }
    discriminator = lambda x: model.event_id(F.col("_source"), F.col("seq"), F.col("type"), F.col("_ts"), x)
    fires = mapped == "hook.fire"
    code = F.coalesce(json_at("$.attachment.exitCode"), json_at("$.exitCode")).try_cast("double")
    hook = F.coalesce(json_at("$.attachment.hookName"), json_at("$.hookName"), attached)
    state = F.when(fires, F.when(code.isNull(), "unknown").when(code == 0, "ok").otherwise("error")).when(failed, "error").otherwise("ok")
    told = F.when(fires, F.concat(F.lit("hook exit "), json_number(code), F.lit(" "), hook)).otherwise(F.coalesce(json_at("$.error.message"), json_at("$.error"), F.lit("")))
    servers = {k: F.when(attached == "deferred_tools_delta", F.from_json(json_at(f"$.attachment.{v}"), "array<string>")) for k, v in SERVER_STATES.items()}
    hooked = {"hook_event": F.when(fires, F.coalesce(json_at("$.attachment.hookEvent"), json_at("$.hookEvent"))), "exit_code": F.when(fires, code), "tool_use_id": F.when(fires, F.coalesce(json_at("$.attachment.toolUseID"), json_at("$.attachment.tool_use_id"), json_at("$.toolUseID")))}
    main = good.withColumns({"type": primary, "subtype": F.when(fires, attached).when(mapped == "unknown", F.when(attached.isNotNull(), F.concat(F.lit("attachment:"), attached)).otherwise(F.col("_kind"))), "status": state, "usage_source": F.when(used, "reported").otherwise("missing"), **own, "credits": first_of(c.credits).try_cast("double"), "cost_reported": first_of(c.cost).try_cast("double"), "duration_ms": F.coalesce(json_at("$.durationMs"), json_at("$.attachment.durationMs"), json_at("$.duration_ms")).try_cast("long")})
    tool = F.coalesce(json_at("$.payload.name"), json_at("$.name"), json_at("$.data.tool"))
    of, name, by = capability(F.when(F.col("type").isin("tool.start", "tool.end"), tool))
    main = main.withColumns({"capability_type": F.when(fires, F.lit("hook")).otherwise(of), "capability_name": F.when(fires, hook).when(of.isNotNull(), name), "capability_provider": by, "error_fingerprint": F.when(state == "error", model.error_fingerprint(told)), "metadata": metadata(**hooked, **servers), **common})
    main = main.withColumn("id", discriminator(F.lit("")))
    blocks = F.from_json(json_at(c.content), "array<struct<type:string,id:string,name:string,tool_use_id:string,is_error:boolean,input:string>>")
    parts = good.select("*", F.posexplode(blocks).alias("_at", "_b")).where(F.col("_b.type").isin("tool_use", "tool_result", "toolCall"))
    result = F.col("_b.type") == "tool_result"
    of, name, by = capability(F.when(~result, F.col("_b.name")), F.col("_b.input"))
    above = F.when(~result, model.event_id(F.col("_source"), F.col("seq"), primary, F.col("_ts"), F.lit("")))
    parts = parts.withColumns({"parent_event_id": above, "capability_type": of, "capability_name": name, "capability_provider": by, "type": F.when(result, "tool.result").otherwise(event_of_kind(of)), "subtype": F.coalesce("_b.id", "_b.tool_use_id"), "status": F.when(F.col("_b.is_error"), "error").otherwise("ok"), "usage_source": F.lit("missing")})
    parts = parts.withColumns(common | {"metadata": metadata(subagent_type=F.get_json_object("_b.input", "$.subagent_type")), "request_id": F.when(~result, request)}).withColumn("id", discriminator(F.concat(F.lit("block"), F.col("_at").cast("string"))))
    shaped = lambda df: df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in EVENT_SCHEMA.fields])
    events = shaped(main).unionByName(shaped(parts))
    edge = lambda rows, kind, of, calls: shaped(rows.withColumns({"type": F.lit(kind), "capability_type": F.lit("subagent"), "capability_name": of, "status": F.when(kind_failed, "error").otherwise("ok") if kind == "subagent.end" else F.lit("ok"), "usage_source": F.lit("missing")} | common | {"request_id": F.lit(None).cast("string"), "provider": F.lit(None).cast("string"), "model": F.lit(None).cast("string"), "metadata": metadata(agent_id=of, tool_use_id=calls)}).withColumn("id", discriminator(F.concat(F.lit(kind + ":"), of))))
    kind_failed = F.coalesce(json_at("$.toolUseResult.isError"), json_at("$.toolUseResult.is_error")) == "true"
    if c.chain:
        # the first record of a chain, found by a grouped least number, so that no chain is sorted
        inside = good.withColumn("_chain", chain).where("_chain is not null")
        first = inside.groupBy("_source", "_session", "_chain").agg(F.min("seq").alias("seq"))
        events = events.unionByName(edge(inside.join(first, ["_source", "_session", "_chain", "seq"], "left_semi"), "subagent.start", chain, F.lit(None).cast("string")))
    if c.closing:
        answered = F.element_at(F.filter(F.transform(F.filter(blocks, lambda b: b["type"] == "tool_result"), lambda b: b["tool_use_id"]), lambda x: x.isNotNull()), 1)
        events = events.unionByName(edge(good.where(first_of(c.closing).isNotNull()), "subagent.end", first_of(c.closing), F.when(F.size(F.filter(blocks, lambda b: (b["type"] == "tool_result") & b["tool_use_id"].isNotNull())) > 0, answered)))
    return events, failures.withColumn("agent_id", F.lit(c.agent))


def paired(events: DataFrame) -> DataFrame:
    """Tool results with the call that they answer: the same call id within a source."""
    calls = events.where(F.col("type").isin(CALLS) & F.col("subtype").isNotNull()).select("source_id", "subtype", F.col("id").alias("_call"), F.col("timestamp").alias("_from")).dropDuplicates(["source_id", "subtype"])
    results = events.where("type = 'tool.result'").join(calls, ["source_id", "subtype"], "left")
    return results.select("id", F.col("_call").alias("parent_event_id"), (F.col("timestamp") - F.col("_from")).alias("duration_ms"))


def linked(events: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """events whose results, hooks, chain starts and chain ends name the event that they belong to.

    Results and hooks belong to the call of their id in their source, and results take over its capability. A side
    chain belongs to the call that its end proves, else to the last subagent call of its session before it, and takes
    its name from that call. ``known`` are earlier events of the same sources, which are looked at but not returned.
    Events without an id to go by are not shuffled; what finds nothing stays as it is, with no parent.
    """
    of = lambda key: F.get_json_object("metadata", f"$.{key}")
    edge = F.col("type").isin("subagent.start", "subagent.end") & of("agent_id").isNotNull()
    called = F.col("type").isin(CALLS) & F.col("subtype").isNotNull()
    key = F.when(F.col("type") == "tool.result", F.col("subtype")).when(F.col("type") == "hook.fire", of("tool_use_id"))
    if events.where(key.isNotNull() | edge).isEmpty():
        return events
    narrow = lambda rows: rows.where(called | edge).select("id", "type", "subtype", "session_id", "source_id", "timestamp", "raw_seq", "metadata", "capability_type", "capability_name", "capability_provider")
    every = narrow(events) if known is None else narrow(events).unionByName(narrow(known).join(events.select("id"), "id", "left_anti"))
    every = stored(every)
    calls = every.where(called)
    last = calls.groupBy("source_id", F.col("subtype").alias("_call")).agg(F.max(F.struct("raw_seq", "id", "capability_type", "capability_name", "capability_provider")).alias("_c"))
    given = events.withColumns({"_call": key, "_edge": edge})
    answers = given.where("_call is not null").join(last, ["source_id", "_call"], "left")
    taken = {c: F.when((F.col("type") == "tool.result") & F.col("_c").isNotNull(), F.col(f"_c.{c}")).otherwise(F.col(c)) for c in ("capability_type", "capability_name", "capability_provider")}
    answers = answers.withColumns({"parent_event_id": F.coalesce("_c.id", "parent_event_id"), **taken}).select(events.columns)
    named = F.concat_ws("\u0000", "session_id", of("agent_id"))
    begun = every.where((F.col("type") == "subagent.start") & edge).groupBy("session_id", named.alias("chain_id")).agg(F.min(F.struct(F.col("timestamp").alias("ts"), F.col("raw_seq").alias("seq"), "source_id")).alias("_f")).select("session_id", "chain_id", "_f.*")
    spawns = calls.where("capability_type = 'subagent'").select("id", "session_id", "source_id", F.col("timestamp").alias("ts"), F.col("raw_seq").alias("seq"), F.col("subtype").alias("call_id"), of("subagent_type").alias("_named"))
    ended = every.where((F.col("type") == "subagent.end") & edge).select(named.alias("chain_id"), of("tool_use_id").alias("call_id"))
    # a chain that is known by its end alone still has its proof
    chains = derive.subagent_links(begun, ended, spawns).unionByName(derive.proven_spawns(ended, spawns).join(begun, "chain_id", "left_anti").withColumn("how", F.lit("proof")))
    chains = stored(chains).join(spawns.select(F.col("id").alias("spawn_id"), "_named"), "spawn_id", "left").withColumnRenamed("chain_id", "_chain")
    edges = given.where("_edge").withColumn("_chain", named).join(chains, "_chain", "left")
    edges = edges.withColumns({"parent_event_id": F.col("spawn_id"), "capability_name": F.coalesce("_named", "capability_name"), "capability_provider": F.when(F.col("_named").isNotNull(), "Agent").otherwise("agent"), "subtype": F.col("how")}).select(events.columns)
    return given.where("_call is null and not _edge").select(events.columns).unionByName(answers).unionByName(edges)
