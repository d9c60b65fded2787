"""The event model: enums, schema, deterministic ids and the conformance check, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of the data model.
EVENT_TYPES = [
    "session.start", "session.end", "message.user", "message.assistant", "generation.start", "generation.end", "tool.start", "tool.end", "tool.result", "mcp.invoke",
    "plugin.invoke", "connector.invoke", "skill.invoke", "command.execute", "subagent.start", "subagent.end", "hook.fire", "context.compact", "error", "unknown",
]
CAPABILITY_TYPES = ["tool", "skill", "mcp", "plugin", "connector", "command", "subagent", "hook"]
USAGE_SOURCES = ["reported", "estimated", "missing"]
STATUSES = ["ok", "error", "unknown"]
FOLD_MODES = ["request_max", "per_record_sum", "last_call_sum"]
BILLING_MODES = ["api", "subscription", "local"]
TOKENS = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens"]

_STRINGS = ["id", "agent_id", "host_id", "source_id", "session_id", "project_id", "thread_id", "request_id", "parent_event_id", "type", "subtype", "provider", "model", "tier", "usage_source", "status", "cost_source", "capability_type", "capability_name", "capability_provider", "error_fingerprint", "parser_version", "metadata"]
_LONGS = ["schema_version", "timestamp", "ingested_at", *TOKENS, "duration_ms", "raw_seq", "raw_offset"]
EVENT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in _STRINGS] + [T.StructField(c, T.LongType()) for c in _LONGS] + [T.StructField(c, T.DoubleType()) for c in ("cost_reported", "credits")])

HALF_HOUR_MS = 1_800_000


def digest(*parts: Column) -> Column:
    """Lower-case SHA-256 over parts joined by NUL; a null part is an empty slot, not a missing one."""
    return F.sha2(F.concat_ws("\u0000", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def source_id(agent: Column, path: Column) -> Column:
    return digest(agent, path)


def project_id(root: Column) -> Column:
    return digest(F.lit("project"), root)


def session_id(agent: Column, native: Column, source: Column, record: Column, ts: Column) -> Column:
    """Of agent and native id, so that two agents' ids cannot collide; else of source and record; else of source and
    half-hour of the epoch (not of gaps)."""
    usable = lambda c: F.nullif(c, F.lit(""))
    own = F.when(usable(native).isNotNull(), digest(F.lit("session"), agent, native))
    return F.coalesce(own, F.when(usable(record).isNotNull(), digest(F.lit("session-from-source"), source, record)), digest(F.lit("session-from-bucket"), source, F.floor(ts / HALF_HOUR_MS)))


def event_id(source: Column, seq: Column, kind: Column, ts: Column, discriminator: Column) -> Column:
    return digest(source, seq, kind, ts, discriminator)


def error_fingerprint(message: Column) -> Column:
    """Digest of a message without its numbers. Digits go first, so an address keeps its letters."""
    text = F.regexp_replace(F.regexp_replace(message, r"\d+", "N"), r"0x[0-9a-fA-F]+", "0xADDR")
    return digest(F.lit("error"), F.lower(F.trim(F.regexp_replace(text, r"[\s.]+", " "))))


def problems(known_types: list[str] | None = None) -> Column:
    """What is wrong with an event, as an array of messages; empty if it conforms."""
    c = F.col
    bad = [(c("id").isNull() | ~c("id").rlike("^[0-9a-f]{64}$"), "id: not 64 hex digits")]
    bad += [(F.coalesce(c(x), F.lit("")) == "", f"{x}: missing") for x in ("agent_id", "source_id", "session_id")]
    bad += [(c("timestamp").isNull() | (c("timestamp") <= 0), "timestamp: not positive")]
    bad += [(c(x) < 0, f"{x}: negative") for x in (*TOKENS, "duration_ms", "raw_seq", "raw_offset")]
    enums = [("type", known_types or EVENT_TYPES), ("usage_source", USAGE_SOURCES), ("status", STATUSES)]
    bad += [(c(x).isNull() | ~c(x).isin(allowed), f"{x}: not known") for x, allowed in enums]
    bad += [(c("capability_type").isNotNull() & ~c("capability_type").isin(CAPABILITY_TYPES), "capability_type: not known")]
    used = F.coalesce(*[c(t) for t in TOKENS]).isNotNull()
    bad += [(used & (c("usage_source") == "missing"), "usage: present but called missing"), (~used & (c("usage_source") == "reported"), "usage: called reported but absent")]
    return F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(text)) for cond, text in bad]))
