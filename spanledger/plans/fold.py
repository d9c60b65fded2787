"""The two-level request fold: usage that an agent reports several times for one request counts once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.functions.model import TOKENS

#: Columns of the representative row, that of the greatest id, which later stages group by.
CARRIED = ["host_id", "project_id", "session_id", "thread_id", "model", "provider", "capability_type", "capability_name", "status", "usage_source", "timestamp"]

#: Column of a stored event that says which part of the store holds it; a fold of such events lists them by group.
BUCKET = "bucket"


def mode(policies: dict[str, str]) -> Column:
    """Fold mode of a row's agent; policies are configuration, so they become a CASE and need no join."""
    out = F.lit("request_max")
    for agent, name in sorted(policies.items()):
        out = F.when(F.col("agent_id") == agent, F.lit(name)).otherwise(out)
    return out


def request_key(policies: dict[str, str]) -> Column:
    """The request's id under request_max if it has one, else the row's own id."""
    return F.when(mode(policies) == "request_max", F.coalesce(F.nullif(F.col("request_id"), F.lit("")), F.col("id"))).otherwise(F.col("id"))


def keyed(events: DataFrame, policies: dict[str, str]) -> DataFrame:
    return events.withColumn("agent_key", F.coalesce("agent_id", F.lit(""))).withColumn("req_key", request_key(policies))


def folded(events: DataFrame, policies: dict[str, str], certificate: bool = False) -> DataFrame:
    """A row for each (agent_key, req_key): greatest tokens and duration, reported cost and credits (null if none has
    any), and the columns of the row with the greatest id. With certificate, also counts and times of the members.

    One hash aggregation with partial sums; the representative is the greatest struct, so there is no join back. Rows
    without a request id key on their own id, so that null is no hot key.
    """
    aggs = [F.max(F.coalesce(t, F.lit(0))).alias(t) for t in TOKENS]
    aggs += [F.max(F.coalesce("duration_ms", F.lit(0))).alias("duration_ms"), F.max("cost_reported").alias("rep_cost"), F.max("credits").alias("credits"), F.max(F.struct("id", *CARRIED)).alias("_rep")]
    if certificate:
        aggs += [F.count("*").alias("member_count"), F.count("timestamp").alias("ts_count"), F.min("timestamp").alias("min_ts"), F.max("timestamp").alias("max_ts")]
    if BUCKET in events.columns:
        aggs.append(F.array_sort(F.collect_set(BUCKET)).alias("member_buckets"))
    rows = keyed(events, policies).groupBy("agent_key", "req_key").agg(*aggs)
    return rows.select("*", F.col("_rep")["id"].alias("rep_id"), *[F.col("_rep")[c].alias(c) for c in CARRIED]).drop("_rep").withColumn("agent_id", F.col("agent_key"))


def refolded(fold: DataFrame, events: DataFrame, touched: DataFrame, policies: dict[str, str]) -> DataFrame:
    """The fold after a change of events: groups of touched keys (agent_key, req_key) are read anew and whole."""
    keys = touched.select("agent_key", "req_key").distinct()
    again = keyed(events, policies).join(keys, ["agent_key", "req_key"], "left_semi").drop("agent_key", "req_key")
    kept = fold.join(keys, ["agent_key", "req_key"], "left_anti")
    return kept.unionByName(folded(again, policies, certificate="member_count" in fold.columns))


def windowed(fold: DataFrame, events: DataFrame, since: int | None, until: int | None, policies: dict[str, str]) -> DataFrame:
    """The fold of a window from a materialized one: groups wholly inside are taken, only those that straddle an edge
    (or hold rows without a time) are folded from their events. Needs the certificate columns."""
    low, high = F.lit(since if since is not None else -(1 << 62)), F.lit(until if until is not None else 1 << 62)
    inside = (F.col("min_ts") >= low) & (F.col("max_ts") <= high) & (F.col("ts_count") == F.col("member_count"))
    touching = (F.col("max_ts") >= low) & (F.col("min_ts") <= high)
    straddling = fold.where(touching & ~inside).select("agent_key", "req_key")
    members = keyed(events.where((F.col("timestamp") >= low) & (F.col("timestamp") <= high)), policies).join(straddling, ["agent_key", "req_key"], "left_semi").drop("agent_key", "req_key")
    return fold.where(inside).unionByName(folded(members, policies, certificate=True))


def health(fold: DataFrame | None, events: DataFrame, stored_policies: dict[str, str], policies: dict[str, str]) -> str:
    """absent, policyMismatch, drifted, or materialised."""
    if fold is None:
        return "absent"
    if stored_policies != policies:
        return "policyMismatch"
    return "materialised" if (fold.agg(F.sum("member_count")).first()[0] or 0) == events.count() else "drifted"
