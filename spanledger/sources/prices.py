"""Price sources, overrides and the billing declaration."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanledger.functions.pricing import PER_MTOK, PRICE_COLUMNS, invalid_prices

PRICE_SCHEMA = "provider string, model string, effective_from long, " + ", ".join(f"{c} double" for c in PER_MTOK) + ", price_source string"


def _split(full: Column, provider: Column) -> tuple[Column, Column]:
    """Provider and model of an id: what stands before and behind its first slash, else the provider given and all of it."""
    cut = full.rlike("^[^/]+/")
    return F.when(cut, F.regexp_extract(full, "^([^/]+)/", 1)).otherwise(F.coalesce(provider, F.lit("unknown"))), F.when(cut, F.regexp_replace(full, "^[^/]+/", "")).otherwise(full)


def _per_mtok(raw: Column) -> Column:
    """Dollars a token to dollars a million; what is no number, or negative, is missing and not NaN."""
    x = raw.try_cast("double")
    return F.when((x >= 0) & ~F.isnan(x), x * 1e6)


def litellm(text: DataFrame) -> DataFrame:
    """text (value): one JSON map of model to record. Models are rows from the start, not a wide struct."""
    entries = text.select(F.explode(F.from_json("value", "map<string, string>")).alias("model", "record"))
    at = lambda k: F.get_json_object("record", f"$.{k}")
    prices = [_per_mtok(at(k)) for k in ("input_cost_per_token", "output_cost_per_token", "cache_read_input_token_cost", "cache_creation_input_token_cost", "input_cost_per_reasoning_token")]
    provider, name = _split(F.col("model"), at("litellm_provider"))
    budget = F.col("model").rlike(r"(?i)[-_]budget\b")  # duplicates under another budget
    return entries.where((F.col("model") != "") & ~budget).select(provider.alias("provider"), name.alias("model"), F.coalesce(at("effective_from").try_cast("long"), F.lit(0)).alias("effective_from"), *[p.alias(c) for p, c in zip(prices, PER_MTOK)], F.lit("litellm").alias("price_source")).where("input_per_mtok is not null or output_per_mtok is not null")


def openrouter(text: DataFrame) -> DataFrame:
    """text (value): {"data": [{"id": "provider/model", "pricing": {...}}]}."""
    entries = text.select(F.explode(F.from_json(F.coalesce(F.get_json_object("value", "$.data"), F.col("value")), "array<struct<id:string,model:string,effective_from:long,pricing:map<string,string>>>")).alias("e"))
    full = F.coalesce("e.id", "e.model")
    prices = [_per_mtok(F.try_element_at("e.pricing", F.lit(k))) for k in ("prompt", "completion", "input_cache_read", "input_cache_write", "internal_reasoning")]
    provider, name = _split(full, F.lit(None).cast("string"))
    routes = full.contains(":") | full.rlike("^[~^]")  # variants of a route, and aliases that roll
    return entries.where(full.isNotNull() & (full != "") & ~routes).select(provider.alias("provider"), name.alias("model"), F.coalesce("e.effective_from", F.lit(0).cast("long")).alias("effective_from"), *[p.alias(c) for p, c in zip(prices, PER_MTOK)], F.lit("openrouter").alias("price_source"))


def overrides(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of prices. One bad line makes all of them void: the error lists every one."""
    rows = spark.read.schema(PRICE_SCHEMA + ", _corrupt_record string").json(path).withColumn("price_source", F.coalesce("price_source", F.lit("override"))).withColumn("line", F.monotonically_increasing_id())
    bad = invalid_prices(rows).orderBy("line").select("reasons", F.to_json(F.struct("provider", "model")).alias("which")).collect()  # written by hand
    if bad:
        raise ValueError("; ".join(f"{r['which']}: {', '.join(r['reasons'])}" for r in bad))
    return rows.select(*PRICE_COLUMNS)


def billing(text: str) -> dict[str, dict]:
    """The declaration by agent. What is malformed declares nothing, so an agent without one is billed by api."""
    try:
        declared = json.loads(text).get("billing", {})
    except (ValueError, AttributeError):
        return {}
    modes, out = ("api", "subscription", "local"), {}
    for agent, own in declared.items() if isinstance(declared, dict) else ():
        own = {"mode": own} if isinstance(own, str) else own if isinstance(own, dict) else {}
        fee = own.get("planUsdPerMonth")
        kept = {
            "mode": own["mode"] if own.get("mode") in modes else None,
            "planUsdPerMonth": float(fee) if isinstance(fee, (int, float)) and not isinstance(fee, bool) and fee >= 0 else None,
            "models": {m: v for m, v in (own.get("models") or {}).items() if v in modes} if isinstance(own.get("models") or {}, dict) else {},
        }
        if any(kept.values()) or kept["planUsdPerMonth"] is not None:
            out[agent] = kept
    return out


def billing_edited(declared: dict[str, dict], agent: str, *, mode: str | None = "", fee: float | None = -1.0, model: str | None = None, model_mode: str | None = None) -> dict[str, dict]:
    """The declaration after one change; null takes a mode, a fee or a model's mode back."""
    own = {"mode": None, "planUsdPerMonth": None, "models": {}} | declared.get(agent, {})
    own["models"] = dict(own["models"])
    if mode != "":
        own["mode"] = mode
    if fee is None or fee >= 0:
        own["planUsdPerMonth"] = fee
    if model is not None:
        own["models"].pop(model, None)
        if model_mode is not None:
            own["models"][model] = model_mode
    return declared | {agent: own}
