"""The cube: metrics by dimensions over filtered events, as one DataFrame plan."""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.functions import pricing
from spanledger.functions.model import TOKENS
from spanledger.functions.periods import bucket, resolve
from spanledger.plans import fold as folds
from spanledger.plans.spec import FOLDED, LISTS, PRICED, Spec

_PLAIN = {"agent": "agent_id", "host": "host_id", "project": "project_id", "session": "session_id", "thread": "thread_id", "status": "status", "usage_source": "usage_source", "model": "model", "provider": "provider", "capability_type": "capability_type"}
_SUMS = {"tokens_input": "input_tokens", "tokens_output": "output_tokens", "tokens_cache_read": "cache_read_tokens", "tokens_cache_write": "cache_write_tokens", "tokens_reasoning": "reasoning_tokens", "duration": "duration_ms"}


@dataclass
class Context:
    """What a query reads besides its spec. prices and billing may be absent; now is pinned once a request."""

    events: DataFrame
    policies: dict[str, str]
    prices: DataFrame | None = None
    billing: dict[str, dict] | None = None
    now: int | None = None

    def clock(self) -> int:
        if self.now is None:
            self.now = int(time.time() * 1000)
        return self.now


@dataclass
class Result:
    rows: DataFrame
    totals: DataFrame | None
    spec: Spec

    def collect(self) -> tuple[list, bool]:
        """Rows, and whether the limit cut any."""
        if self.spec.limit is None:
            return self.rows.collect(), False
        found = self.rows.limit(self.spec.limit + 1).collect()
        return found[: self.spec.limit], len(found) > self.spec.limit


def dim(name: str) -> Column:
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    if name in ("time", "day", "week", "month"):
        return bucket(F.col("timestamp"), "day" if name == "time" else name)
    if name in _PLAIN:
        return text(_PLAIN[name])
    if name == "capability_name":
        return F.when(F.col("capability_type").isNull(), F.lit("")).otherwise(text("capability_name"))
    return F.when(F.col("capability_type") == name, text("capability_name")).otherwise(F.lit(""))


def filtered(events: DataFrame, chosen: dict, now: int) -> DataFrame:
    """Events under all filters. An empty list filters nothing; both ends of a window are inside."""
    keep: list[Column] = []
    if (since := resolve(chosen.get("since"), now)) is not None:
        keep.append(F.col("timestamp") >= since)
    if (until := resolve(chosen.get("until"), now)) is not None:
        keep.append(F.col("timestamp") <= until)
    keep += [F.col(c).isin(list(chosen[k])) for k, c in LISTS.items() if chosen.get(k)]
    if chosen.get("include_subagent_threads") is False:
        keep.append(~F.coalesce(F.get_json_object("metadata", "$.subagentThread").isin("true", "1"), F.lit(False)))
    return events.where(reduce(lambda a, b: a & b, keep)) if keep else events


def exact(c: str) -> Column:
    """A sum of reported amounts that does not depend on their order."""
    return F.sum(F.col(c).cast("decimal(24,12)"))


def _parts(fold: DataFrame, dims: dict[str, Column], more: list[Column]) -> DataFrame:
    """Sums of the fold by dims, agent, model, day and whether the request reports its own cost."""
    day = F.floor(F.col("timestamp") / pricing.DAY_MS)
    rows = fold.select("*", *[c.alias(f"_d_{n}") for n, c in dims.items()], F.col("agent_key").alias("_agent"), day.alias("_day"), F.col("rep_cost").isNull().alias("_unreported"))
    return rows.groupBy(*[f"_d_{n}" for n in dims], "_agent", "provider", "model", "_day", "_unreported").agg(*[F.sum(t).alias(t) for t in TOKENS], *more)


def _priced(parts: DataFrame, prices: DataFrame) -> DataFrame:
    return pricing.lookup(parts, prices, F.col("_day") * pricing.DAY_MS + pricing.NOON_MS).withColumn("_usd", pricing.usd())


def cost_buckets(fold: DataFrame, dims: dict[str, Column], prices: DataFrame) -> DataFrame:
    """Priced sums by dims, agent, model, day and whether the request reports its own cost.

    Tokens are summed before prices are looked up, so the lookup sees buckets, not requests. Buckets without tokens
    are none: they can neither cost nor be unknown.
    """
    return _priced(_parts(fold, dims, []).where(sum((F.col(t) for t in TOKENS), F.lit(0)) > 0), prices)


def _aggregate(spec: Spec, dims: dict[str, Column], events: DataFrame, fold: DataFrame | None, ctx: Context, mode: Column | None) -> DataFrame:
    """The metrics by dims. The fold is read once: its sums by dims, and where costs are asked for by price bucket too,
    are summed on, so that a cost query shuffles requests, buckets and rows of the result once each."""
    names = [f"_d_{n}" for n in dims]
    base = events.select("*", *[c.alias(f"_d_{n}") for n, c in dims.items()]).groupBy(*names).agg(F.count("*").alias("events"), F.count_distinct("session_id").alias("sessions"), exact("cost_reported").cast("double").alias("cost_reported"))
    join = lambda a, b: a.join(b, names, "left") if names else a.join(b, how="full")  # noqa: E731  without dims each side is one row
    if fold is not None:
        more = [exact("credits").alias("credits"), exact("rep_cost").alias("_reported"), F.sum("duration_ms").alias("duration_ms")]
        sums = [F.sum(c).alias(m) for m, c in _SUMS.items()]
        if PRICED & set(spec.metrics) and ctx.prices is not None:
            parts = _priced(_parts(fold, dims, more), ctx.prices)
            spent = sum((F.col(t) for t in TOKENS), F.lit(0)) > 0
            parts = parts.withColumn("_cash", pricing.cash(F.col("_usd"), mode if mode is not None else F.lit("api"))).withColumns({"_spent": spent, "_owes": spent & F.col("_unreported")})
            whole = lambda flag, value: F.when((F.count_if(F.col(flag)) > 0) & (F.count_if(F.col(flag)) == F.count(F.when(F.col(flag), F.col(value)))), F.sum(F.when(F.col(flag), F.col(value))))  # noqa: E731  null as soon as one is
            stage = parts.groupBy(*names).agg(*sums, F.sum("credits").cast("double").alias("credits"), F.sum("_reported").alias("_reported"), whole("_spent", "_usd").cast("double").alias("cost_api_equiv"), F.count_if(F.col("_owes")).alias("_n_own"), whole("_owes", "_cash").alias("_own"))
            base = join(base, stage)
            n = F.coalesce("_n_own", F.lit(0))
            zero = F.lit(0).cast(pricing.AMOUNT)
            total = F.when((n > 0) & F.col("_own").isNull(), F.lit(None)).when((n == 0) & F.col("_reported").isNull(), F.lit(None)).otherwise(F.coalesce(F.col("_reported").cast(pricing.AMOUNT), zero) + F.coalesce(F.col("_own").cast(pricing.AMOUNT), zero))
            base = base.withColumn("cost_total", total.cast("double"))
        else:
            stage = fold.select("*", *[c.alias(f"_d_{n}") for n, c in dims.items()]).groupBy(*names).agg(*sums, exact("credits").cast("double").alias("credits"))
            base = join(base, stage).withColumns({m: F.lit(None).cast("double") for m in PRICED})
        base = base.withColumns({m: F.coalesce(m, F.lit(0)) for m in _SUMS}).withColumn("tokens_total", sum((F.col(m) for m in list(_SUMS)[:5]), F.lit(0)))
    return base.select(*[F.col(f"_d_{n}").alias(n) for n in dims], *spec.metrics)


def billing_mode(billing: dict[str, dict] | None) -> Column:
    """Mode of a bucket's agent and provider/model: the model's own, else the agent's, else api."""
    out = F.lit("api")
    for agent, own in sorted((billing or {}).items()):
        here = F.lit(own.get("mode") or "api")
        for model, m in sorted((own.get("models") or {}).items()):
            here = F.when(F.concat_ws("/", F.coalesce("provider", F.lit("")), F.coalesce("model", F.lit(""))) == model, F.lit(m)).otherwise(here)
        out = F.when(F.col("_agent") == agent, here).otherwise(out)
    return out


def ordered(df: DataFrame, spec: Spec) -> DataFrame:
    """Rows in the spec's order: null is smallest, text by the Unicode collation, then all dims ascending, so that equal
    rows have one order."""
    column, ascending = spec.ordering()
    if column not in df.columns:
        return df
    by = lambda c: F.collate(F.col(c), "UNICODE") if df.schema[c].dataType.simpleString() == "string" else F.col(c)
    first = by(column).asc_nulls_first() if ascending else by(column).desc_nulls_last()
    return df.orderBy(first, *[by(d).asc() for d in spec.dims if d != column])


def query(spec: Spec, ctx: Context, fold: DataFrame | None = None) -> Result:
    """The cube's answer. ``fold`` may be a shared one of the same events, filter and policies."""
    events = filtered(ctx.events, spec.filter, ctx.clock())
    if FOLDED & set(spec.metrics):
        fold = fold if fold is not None else folds.folded(events, ctx.policies)
    else:
        fold = None
    dims = {n: dim(n) for n in spec.dims}
    mode = billing_mode(ctx.billing)
    totals = _aggregate(spec, {}, events, fold, ctx, mode) if spec.totals or not dims else None
    if not dims:
        return Result(totals, totals, spec)
    return Result(ordered(_aggregate(spec, dims, events, fold, ctx, mode), spec), totals, spec)


def portions(ctx: Context, chosen: dict | None = None, by: tuple[str, ...] = ("agent",), modes: bool = False) -> DataFrame:
    """Known spend: priced buckets alone, by agent or more; api only under api billing, and in all modes; partial flags.
    With modes, also whether the billing modes of what was spent differ, and whether one is a subscription."""
    events = filtered(ctx.events, chosen or {}, ctx.clock())
    mode = billing_mode(ctx.billing)
    buckets = cost_buckets(folds.folded(events, ctx.policies), {n: dim(n) for n in by}, ctx.prices).withColumn("_mode", mode)
    names = [F.col(f"_d_{n}").alias(n) for n in by]
    paid = pricing.cash(F.col("_usd"), F.col("_mode"))
    more = [(F.min("_mode") != F.max("_mode")).alias("mixed_billing"), F.bool_or(F.col("_mode") == "subscription").alias("on_plan")] if modes else []
    return buckets.groupBy(*names).agg(F.sum("_usd").cast("double").alias("api_equivalent"), F.sum(paid).cast("double").alias("cash"), F.bool_or(F.col("_usd").isNull()).alias("partial"), *more)
