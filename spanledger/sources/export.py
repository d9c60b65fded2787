"""Sinks: JSONL, CSV and OpenTelemetry spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanledger.operators.derive import canonical_order

# The columns of the CSV export in their order, span attributes with the event columns that they hold, and
# operations of event types. Attributes that no convention names have a prefix of our own.
CSV_COLUMNS = [
    "id", "schema_version", "agent_id", "host_id", "source_id", "session_id", "project_id",
    "request_id", "timestamp", "type", "subtype", "model", "provider",
    "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens",
    "usage_source", "capability_type", "capability_name", "duration_ms", "status", "metadata",
    "thread_id", "cost_reported", "cost_source",
]
ATTRIBUTES = {
    "gen_ai.provider.name": "provider", "gen_ai.request.model": "model", "gen_ai.response.model": "model",
    "gen_ai.usage.input_tokens": "input_tokens", "gen_ai.usage.output_tokens": "output_tokens", "gen_ai.usage.cache_read.input_tokens": "cache_read_tokens", "gen_ai.usage.cache_creation.input_tokens": "cache_write_tokens",
    "spanledger.cost_reported": "cost_reported", "spanledger.cost_source": "cost_source", "spanledger.host_id": "host_id",
    "spanledger.capability.type": "capability_type", "spanledger.capability.name": "capability_name", "spanledger.capability.provider": "capability_provider",
    "spanledger.request_id": "request_id", "spanledger.thread_id": "thread_id", "spanledger.source_id": "source_id", "spanledger.raw_seq": "raw_seq", "spanledger.project_id": "project_id", "spanledger.event.type": "type",
}
OPERATIONS = {
    "generation.start": "chat", "generation.end": "chat", "tool.start": "execute_tool", "tool.end": "execute_tool", "tool.result": "execute_tool",
    "subagent.start": "invoke_agent", "subagent.end": "invoke_agent", "skill.invoke": "invoke_agent",
}
BATCH = 500


def operation() -> Column:
    return F.coalesce(*[F.when(F.col("type") == k, F.lit(v)) for k, v in OPERATIONS.items()])


def span_name() -> Column:
    subject = F.when(operation() == "chat", F.col("model")).otherwise(F.col("capability_name"))
    return F.when(operation().isNotNull() & subject.isNotNull(), F.concat_ws(" ", operation(), subject)).otherwise(F.col("type"))


def attributes(columns: list[str]) -> Column:
    """Attributes of a span of events with these columns, without those that are null."""
    pairs = {k: v for k, v in ATTRIBUTES.items() if v in columns}
    every = F.map_from_arrays(F.array(*map(F.lit, [*pairs, "gen_ai.operation.name"])), F.array(*[F.col(v).cast("string") for v in pairs.values()], operation()))
    return F.map_filter(every, lambda _, v: v.isNotNull())


def first_rows(events: DataFrame, limit: int | None = None) -> DataFrame:
    rows = events.orderBy(*canonical_order(events))
    return rows if limit is None else rows.limit(limit)


def csv_rows(events: DataFrame, limit: int | None = None) -> DataFrame:
    rows = first_rows(events, limit)
    return rows.select(*[F.col(c) if c in events.columns else F.lit(None).cast("string").alias(c) for c in CSV_COLUMNS])


def write_csv(events: DataFrame, path: str, limit: int | None = None) -> None:
    csv_rows(events, limit).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def write_jsonl(events: DataFrame, path: str, limit: int | None = None) -> None:
    first_rows(events, limit).write.mode("overwrite").json(path)


def spans(events: DataFrame) -> DataFrame:
    """One span an event: ids from digests, nanosecond times, attributes."""
    start = F.col("timestamp") * 1_000_000
    return events.select(
        "agent_id", "host_id", "timestamp", "raw_seq", "id", F.substring(F.sha2(F.coalesce("session_id", F.lit("")), 256), 1, 32).alias("trace_id"), F.substring(F.sha2("id", 256), 1, 16).alias("span_id"),
        F.when(F.col("parent_event_id").isNotNull(), F.substring(F.sha2("parent_event_id", 256), 1, 16)).alias("parent_span_id"), span_name().alias("name"), start.cast("string").alias("start_ns"), (start + F.coalesce("duration_ms", F.lit(0)) * 1_000_000).cast("string").alias("end_ns"), attributes(events.columns).alias("attributes"))


def otlp_batches(events: DataFrame, batch: int = BATCH) -> DataFrame:
    """JSON bodies of ``batch`` spans at most, a resource (agent, host) each, in time order. Sending them is not Spark's.

    Spans are dealt into ranges of (agent, host, time) and cut into batches where they lie, so a resource of any size is
    the work of many tasks; a batch ends where a range does.
    """
    rows = spans(events).repartitionByRange("agent_id", "host_id", "timestamp", "raw_seq", "id").withColumn("_part", F.spark_partition_id())
    w = Window.partitionBy("_part", "agent_id", "host_id").orderBy("timestamp", "raw_seq", "id")
    rows = rows.withColumn("_batch", F.floor((F.row_number().over(w) - 1) / batch))
    body = F.to_json(F.struct(F.struct("agent_id", "host_id").alias("resource"), F.col("spans")))
    order = F.struct("timestamp", "raw_seq", "id", F.struct("trace_id", "span_id", "parent_span_id", "name", "start_ns", "end_ns", "attributes").alias("span"))
    lists = rows.withColumn("_span", order).groupBy("agent_id", "host_id", "_part", "_batch").agg(F.array_sort(F.collect_list("_span"), lambda a, b: F.when(F.struct(a["timestamp"], a["raw_seq"], a["id"]) < F.struct(b["timestamp"], b["raw_seq"], b["id"]), -1).otherwise(1)).alias("_spans"))
    lists = lists.withColumn("spans", F.transform("_spans", lambda x: x["span"]))
    return lists.select("agent_id", "host_id", F.concat_ws("-", "_part", "_batch").alias("batch"), F.size("spans").alias("n"), body.alias("body"))


def table_dump(table: DataFrame, *key: str) -> DataFrame:
    """All rows of a table in the order of its key, as comparisons of two stores need it."""
    return table.orderBy(*key) if key else table.orderBy(*table.columns)
