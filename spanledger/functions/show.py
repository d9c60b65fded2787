"""Amounts as text: dollars, tokens, times and counts; what is not known is n/a."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NONE = "n/a"


def usd(v: Column) -> Column:
    """Two decimals, four under a dollar; thousands by comma and the sign behind the dollar."""
    return F.when(v.isNull(), _NONE).when(v == 0, "$0.00").when(F.abs(v) < 1, F.concat(F.lit("$"), F.format_number(v, 4))).otherwise(F.concat(F.lit("$"), F.format_number(v, 2)))


def tokens(n: Column) -> Column:
    """One decimal, none if it is 0, of the largest unit that fits."""
    out = F.when(n.isNull(), _NONE)
    for size, unit in ((1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "k")):
        out = out.when(F.abs(n) >= size, F.concat(F.regexp_replace(F.format_string("%.1f", n.cast("double") / size), r"\.0$", ""), F.lit(unit)))
    return out.otherwise(n.cast("string"))


def millis(ms: Column) -> Column:
    s = F.floor(ms / 1000 + 0.5).cast("long")
    pad = lambda x: F.lpad(x.cast("string"), 2, "0")
    minutes, hours = F.floor(s / 60), F.floor(s / 3600)
    return F.when(ms.isNull(), _NONE).when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, F.concat(minutes.cast("string"), F.lit("m"), pad(s % 60), F.lit("s"))).otherwise(F.concat(hours.cast("string"), F.lit("h"), pad(minutes % 60), F.lit("m")))


def count(n: Column) -> Column:
    return F.when(n.isNull(), _NONE).otherwise(F.format_number(n, 0))
