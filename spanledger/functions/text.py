"""Payload truncation, redaction and slugs."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PAYLOAD_BYTES = 32 * 1024
#: Redaction: longest string, most items of a list, deepest nesting.
STRING, ITEMS, DEPTH = 240, 12, 2


def truncated(text: Column, most: int = PAYLOAD_BYTES) -> Column:
    """The longest prefix of whole characters within ``most`` bytes of UTF-8."""
    raw = F.substring(text.cast("binary"), 1, most)
    # A cut inside a character leaves it broken at the end: decode without replacement by dropping up to three bytes.
    tries = [F.substring(raw, 1, most - k) for k in range(4)]
    whole = lambda b: F.is_valid_utf8(b.cast("string"))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.coalesce(*[F.when(whole(b), b.cast("string")) for b in tries]))


def transported(text: Column, most: int = 20_000) -> Column:
    return F.substring(text, 1, most)


def home_redacted(metadata: Column, home: str) -> Column:
    """JSON text with the home folder as a tilde."""
    escaped = json.dumps(home)[1:-1]
    return F.regexp_replace(metadata, rf"\Q{escaped}\E(?=[/\\\"]|$)", "~")


def host_slug(name: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one hyphen, none at the ends."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(""))


def _bounded(value, omit: frozenset, depth: int = 0):
    if isinstance(value, str):
        return value if len(value) <= STRING else value[:STRING] + "…"
    if isinstance(value, list):
        return [_bounded(x, omit, depth + 1) for x in value[:ITEMS]] if depth < DEPTH else "[list]"
    if isinstance(value, dict):
        return {k: _bounded(v, omit, depth + 1) for k, v in value.items() if k not in omit} if depth < DEPTH else "{object}"
    return value


def redacted(metadata: Column, omit: tuple[str, ...] = ()) -> Column:
    """JSON text with long strings cut, lists and nesting bounded and keys left out. Text that is no JSON becomes null.

    Nesting of unknown depth is the one thing that column functions cannot walk, so this is a pandas UDF.
    """
    gone = frozenset(omit)

    def one(text):
        try:
            return json.dumps(_bounded(json.loads(text), gone), ensure_ascii=False)
        except (TypeError, ValueError):
            return None

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        return column.map(one)

    return run(metadata)


def prose_tokens(text: Column) -> Column:
    """A token count that a sentence names ("12,345 tokens"); the pattern cannot backtrack."""
    return F.regexp_replace(F.nullif(F.regexp_extract(text, r"(?i)(?<![\d,])(\d++(?:,\d{3}+)*+)\s*+tokens?\b", 1), F.lit("")), ",", "").try_cast("long")
