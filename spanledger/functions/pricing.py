"""Prices: model names, effective-dated lookup, validity and cost, as columns and joins. Unknown stays null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PER_MTOK = ["input_per_mtok", "output_per_mtok", "cache_read_per_mtok", "cache_write_per_mtok", "reasoning_per_mtok"]
PRICE_COLUMNS = ["provider", "model", "effective_from", *PER_MTOK, "price_source"]
#: Which source wins between entries of one date.
PRIORITY = {"litellm": 1, "openrouter": 2, "manual": 3, "override": 4}
DAY_MS, NOON_MS = 86_400_000, 43_200_000
MONTH_DAYS = 365.25 / 12
#: Price entries up to which their intervals are made once and sent to every task.
FEW_PRICES = 100_000
#: Before a model's name, which is matched only where provider and model are not listed.
NAMED = "\u0001"
#: Dollars are summed exactly: a price of a million tokens, of one token, and an amount.
_PER_MILLION, _PER_TOKEN, AMOUNT = "decimal(18,6)", "decimal(20,12)", "decimal(38,12)"


def model_name(name: Column) -> Column:
    """Lower case, without bracketed parts, up to the first colon or at sign, trimmed."""
    return F.trim(F.regexp_extract(F.regexp_replace(F.lower(name), r"\[[^\]]*\]", ""), r"^([^:@]*)", 1))


def _key(provider: Column, model: Column) -> Column:
    return F.concat_ws("\u0000", F.lower(F.coalesce(provider, F.lit(""))), model_name(F.coalesce(model, F.lit(""))))


def keyed(prices: DataFrame) -> DataFrame:
    rank = F.coalesce(*[F.when(F.col("price_source") == k, F.lit(v)) for k, v in PRIORITY.items()], F.lit(0))
    ordinal = F.col("ordinal") if "ordinal" in prices.columns else F.lit(0)
    return prices.withColumn("_key", _key(F.col("provider"), F.col("model"))).withColumn("_name", model_name(F.col("model"))).withColumn("_rank", rank).withColumn("_ord", ordinal)


def intervals(prices: DataFrame) -> DataFrame:
    """match, from, until, and the price in force between them: for each (provider, model) that has entries, and for
    each model's name that one provider alone lists. Before its first entry a model is listed without a price.
    """
    table = keyed(prices).where("effective_from is not null")
    best = table.groupBy("_key", "_name", F.col("effective_from").alias("_from")).agg(F.max(F.struct("_rank", "_ord", F.struct("effective_from", "price_source", *PER_MTOK).alias("p")))["p"].alias("_price"))
    names = table.groupBy("_name").agg(F.count_distinct(F.lower("provider")).alias("_n"))
    first = best.select("_key", "_name").distinct().select("_key", "_name", F.lit(-(1 << 62)).alias("_from"), F.lit(None).cast(best.schema["_price"].dataType).alias("_price"))
    every = best.where(F.col("_from") > -(1 << 62)).unionByName(first).join(names, "_name")
    until = F.coalesce(F.lead("_from").over(Window.partitionBy("_key").orderBy("_from")), F.lit(1 << 62))
    every = every.withColumn("_until", until)
    by_name = every.where("_n = 1").select(F.concat(F.lit(NAMED), "_name").alias("_match"), "_from", "_until", "_price")
    return every.select(F.col("_key").alias("_match"), "_from", "_until", "_price").unionByName(by_name)


def lookup(wanted: DataFrame, prices: DataFrame, at: Column) -> DataFrame:
    """wanted (provider, model, ...) with the price in force ``at`` a time, or nulls.

    A (provider, model) that has entries takes the last one effective by then; it never falls back. One without takes
    those of the only provider that lists the model's name, if there is exactly one. Ties of a date go by the source's
    priority, then by the later entry. Prices become intervals, of which a time lies in one: two joins of wanted with a
    table that is broadcast while it has FEW_PRICES entries, and left to Spark beyond.
    """
    table = intervals(prices)
    if prices.limit(FEW_PRICES + 1).count() <= FEW_PRICES:
        table = F.broadcast(wanted.sparkSession.createDataFrame(table.collect(), table.schema))  # 4 rows an entry at most
    own = lambda n: table.select(*[F.col(c).alias(f"{c}{n}") for c in table.columns])
    holds = lambda n, match: (F.col(f"_match{n}") == match) & (F.col(f"_from{n}") <= F.col("_at")) & (F.col("_at") < F.col(f"_until{n}"))
    rows = wanted.withColumn("_key", _key(F.col("provider"), F.col("model"))).withColumn("_at", at.cast("long"))
    rows = rows.join(own(1), holds(1, F.col("_key")), "left")
    name = F.when(F.col("_match1").isNull(), F.concat(F.lit(NAMED), model_name(F.coalesce("model", F.lit("")))))
    rows = rows.withColumn("_name", name).join(own(2), holds(2, F.col("_name")), "left").withColumn("_found", F.coalesce("_price1", "_price2"))
    return rows.select(*wanted.columns, *[F.col(f"_found.{c}").alias(c) for c in ("effective_from", "price_source", *PER_MTOK)], F.col("_found").isNotNull().alias("_priced"))


def usd(tokens: dict[str, Column] | None = None) -> Column:
    """API price of a row's tokens under its price columns, exactly; null if no price is in force or a needed one is missing.

    Input and output prices are always needed, cache prices only for cache tokens; a missing reasoning price adds nothing.
    """
    t = tokens or {}
    amount = lambda n: F.coalesce(t.get(n, F.col(n)), F.lit(0)).cast("decimal(17,0)")
    each = lambda p: (F.col(p).cast(_PER_MILLION) * F.lit("0.000001").cast("decimal(7,6)")).cast(_PER_TOKEN)
    price = dict(zip(["input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens"], map(each, PER_MTOK)))
    nothing = F.lit(0).cast(AMOUNT)
    term = lambda n: F.when(amount(n) > 0, (amount(n) * price[n]).cast(AMOUNT)).otherwise(nothing)
    needed = F.col(PER_MTOK[0]).isNotNull() & F.col(PER_MTOK[1]).isNotNull()
    total = term("input_tokens") + term("output_tokens") + term("cache_read_tokens") + term("cache_write_tokens") + F.coalesce(term("reasoning_tokens"), nothing)
    return F.when(F.col("_priced") & needed, total.cast(AMOUNT))


def cash(price: Column, mode: Column) -> Column:
    """What is paid for it: the price under ``api``, nothing under other modes; unknown stays unknown."""
    return F.when(price.isNull() | (mode == "api"), price).otherwise(F.lit(0).cast(AMOUNT))


def missing_prices() -> Column:
    """Names of token kinds that were spent without a price."""
    kinds = list(zip(["input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens"], PER_MTOK))
    return F.array_compact(F.array(*[F.when((F.coalesce(F.col(t), F.lit(0)) > 0) & F.col(p).isNull(), F.lit(t)) for t, p in kinds]))


def plan_fee(per_month: Column, days: Column) -> Column:
    return per_month * days / F.lit(MONTH_DAYS)


def gap_filled(prices: DataFrame, fallback: DataFrame) -> DataFrame:
    """prices and those fallback entries whose model name no price has."""
    names = prices.select(model_name(F.col("model")).alias("_name")).distinct()
    added = fallback.withColumn("_name", model_name(F.col("model"))).join(names, "_name", "left_anti").drop("_name")
    return prices.unionByName(added)


def invalid_prices(prices: DataFrame) -> DataFrame:
    """Override entries that are not usable, with the reasons."""
    reasons = F.array_compact(F.array(
        F.when(F.coalesce("provider", F.lit("")) == "", F.lit("provider")), F.when(F.coalesce("model", F.lit("")) == "", F.lit("model")),
        *[F.when(F.col(c).isNull() | F.isnan(c) | (F.col(c) < 0), F.lit(c)) for c in PER_MTOK[:2]], *[F.when(F.isnan(c) | (F.col(c) < 0), F.lit(c)) for c in PER_MTOK[2:]],
        F.when(F.col("effective_from").isNull() | (F.col("effective_from") < 0), F.lit("effective_from"))))
    return prices.withColumn("reasons", reasons).where(F.size("reasons") > 0)
