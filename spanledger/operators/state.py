"""What a reader of a source's records in order would remember: first occurrences, and the latest state of an id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanledger.functions.model import TOKENS


def runs_of(rows: DataFrame) -> DataFrame:
    """rows (source_id, arrival, seq) with run: a source whose number does not rise is read anew, and nothing is remembered."""
    order = Window.partitionBy("source_id").orderBy("arrival")
    again = F.when(F.col("seq") <= F.lag("seq").over(order), 1).otherwise(0)
    return rows.withColumn("_again", again).withColumn("run", F.sum("_again").over(order)).drop("_again")


def first_marked(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with first: whether the row is the first of its keys by (seq, id)."""
    order = Window.partitionBy(*keys).orderBy("seq", "id")
    return rows.withColumn("first", F.row_number().over(order) == 1)


def latest_state(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """A row for each key, with the columns of its last row by seq: a greatest struct, so nothing is sorted."""
    last = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct("seq", *columns)).alias("_s"))
    return last.select(key, *[F.col(f"_s.{c}").alias(c) for c in columns])


def rehydrated(rows: DataFrame) -> DataFrame:
    """Rows as nested events: no usage where all its parts are null, else zeros for those that are; no model without a name."""
    used = F.coalesce(*[F.col(t) for t in TOKENS]).isNotNull()
    usage = F.when(used, F.struct(*[F.coalesce(t, F.lit(0).cast("long")).alias(t) for t in TOKENS]))
    model = F.when(F.col("model").isNotNull(), F.struct(F.coalesce("provider", F.lit("")).alias("provider"), F.col("model").alias("name")))
    capability = F.when(F.col("capability_type").isNotNull(), F.struct(F.col("capability_type").alias("type"), F.coalesce("capability_name", F.lit("")).alias("name")))
    flat = [c for c in rows.columns if c not in (*TOKENS, "provider", "model", "tier", "capability_type", "capability_name", "capability_provider")]
    return rows.select(*flat, usage.alias("usage"), model.alias("model"), capability.alias("capability"))


def store_rows(part: DataFrame, message: DataFrame, session: DataFrame) -> DataFrame:
    """Parts of a row store (id, message_id, session_id, data) with what their message and session say of them.

    A part without a session takes that of its message. Missing messages and sessions leave nulls, never a part out.
    """
    of = lambda path: F.get_json_object("data", path)
    m = message.select(F.col("id").alias("message_id"), F.col("session_id").alias("_of"), of("$.role").alias("role"), of("$.modelID").alias("model"), of("$.providerID").alias("provider"))
    s = session.select(F.col("id").alias("session_id"), F.col("parent_id").alias("parent_session"), "directory", "title")
    return part.join(m, "message_id", "left").withColumn("session_id", F.coalesce("session_id", "_of")).drop("_of").join(s, "session_id", "left")


def hooked(hooks: DataFrame, calls: DataFrame) -> DataFrame:
    """Hook firings (id, source_id, tool_use_id, hook, exit_code) with the call that they hook, the latest one of that
    id in their source, and their status: unknown without an exit code, ok for 0, else error."""
    last = calls.where("call_id is not null").groupBy("source_id", "call_id").agg(F.max_by("id", "seq").alias("parent_event_id"))
    status = F.when(F.col("exit_code").isNull(), "unknown").when(F.col("exit_code") == 0, "ok").otherwise("error")
    return hooks.join(last.withColumnRenamed("call_id", "tool_use_id"), ["source_id", "tool_use_id"], "left").withColumn("status", status)
