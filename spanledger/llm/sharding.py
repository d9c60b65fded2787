"""Sharding by histogram sort: texts in the order of their hash are cut into shards of nearly equal bytes.

Equal texts have equal keys and so share a shard. The cuts are found by counting: probes lie between the bounds of
every cut, one pass over a narrow table counts exact bytes and rows between neighbouring probes, and the bounds close
in until every cut meets its target within the tolerance or nothing lies between its bounds. Rows move once, after
that. Groups of copies that are large against a shard are placed first, each into the shard with most room; the cuts
then share the rest out to what room is left.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanledger.llm.common import stored

LOW, HIGH = -(1 << 63), 1 << 63
#: A group counts as large from this part of a shard's even share on, so there are at most SHARDS / HEAVY of them.
HEAVY = 0.005
#: Bytes by which a cut may miss its target, as part of a shard's even share.
TOLERANCE = 0.001
PROBES = 63
#: Numbering in a shard is done by stretches of keys, this many a shard and partition.
STRETCH_ROWS = 20_000


def text_key(text: Column) -> Column:
    """A text's place in the order: 64 bits of its hash; null comes with the empty text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def histogram(rows: DataFrame, edges: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows whose _key lies below each edge; edges must ascend. Each task returns a sum for each gap."""
    ends = np.array(edges, dtype=np.int64)

    def run(batches):
        size, count = np.zeros(len(ends) + 1, np.int64), np.zeros(len(ends) + 1, np.int64)
        for b in batches:
            at = np.searchsorted(ends, b.column(0).to_numpy(zero_copy_only=False), side="right")
            np.add.at(size, at, b.column(1).to_numpy(zero_copy_only=False))
            np.add.at(count, at, 1)
        full = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(size[full]), pa.array(count[full])], ["gap", "size", "n"])

    found = rows.select("_key", "_size").mapInArrow(run, "gap int, size long, n long").groupBy("gap").agg(F.sum("size"), F.sum("n")).collect()  # one row for each gap
    size, count = np.zeros(len(ends) + 1, np.int64), np.zeros(len(ends) + 1, np.int64)
    for gap, a, b in found:
        size[gap], count[gap] = a, b
    return np.cumsum(size)[:-1], np.cumsum(count)[:-1]


def splitters(rows: DataFrame, targets: list[int], tolerance: float) -> list[int]:
    """For each target a key below which, as nearly as the keys allow, that many bytes lie."""
    bounds = [(LOW, HIGH, 0, None) for _ in targets]  # keys, and bytes below them
    best: list[tuple[int, int]] = [(abs(t), LOW) for t in targets]
    while True:
        probes: set[int] = set()
        for (low, high, _, _), (miss, _) in zip(bounds, best):
            if miss > tolerance and high - low > 1:
                step = max(1, (high - low) // (PROBES + 1))
                probes |= {p for p in range(low + step, min(high, low + step * (PROBES + 1)), step)}
        if not probes:
            return [key for _, key in best]
        edges = sorted(probes)
        below = histogram(rows, edges)[0].tolist()
        for i, target in enumerate(targets):
            low, high, under, over = bounds[i]
            if best[i][0] <= tolerance or high - low <= 1:
                continue
            a, b = bisect.bisect_right(edges, low), bisect.bisect_left(edges, high)
            for key, got in zip(edges[a:b], below[a:b]):
                best[i] = min(best[i], (abs(got - target), key))
                if got <= target:
                    low, under = key, got
                else:
                    high, over = key, got
                    break
            bounds[i] = (low, high, under, over)
            if over is not None and under == over:  # nothing lies between
                bounds[i] = (low, low + 1, under, over)


def sharded(docs: DataFrame, shards: int = 8, tolerance: float = TOLERANCE) -> DataFrame:
    """docs (with _key and _size, a stored table) with shard and slot.

    Sizes of shards differ by the tolerance and by what the groups of equal texts impose: one that is larger than an
    even share fills a shard alone. Null and empty texts are one group, repeated rows are copies, an empty table
    gives none. Slots ascend without a gap in each shard.
    """
    total, n = docs.agg(F.coalesce(F.sum("_size"), F.lit(0)), F.count("*")).first()
    limit = max(1, int(HEAVY * total / shards))
    groups = docs.groupBy("_key").agg(F.sum("_size").alias("size"), F.count("*").alias("n"))
    heavy = sorted(((r[1], r[0], r[2]) for r in groups.where((F.col("size") > limit) & (F.col("n") > 1)).collect()), reverse=True)  # at most shards / HEAVY
    room = [total / shards] * shards
    place: dict[int, int] = {}
    for size, key, _ in heavy:
        place[key] = max(range(shards), key=lambda s: room[s])
        room[place[key]] -= size
    rest = total - sum(x[0] for x in heavy)
    open_room = [max(0.0, x) for x in room]
    scale = rest / sum(open_room) if sum(open_room) else 0.0
    targets = np.cumsum([x * scale for x in open_room])[:-1].round().astype(int).tolist()

    homes = docs.sparkSession.createDataFrame([(k, s) for k, s in place.items()], "_key long, _home int")
    rows = docs.join(F.broadcast(homes), "_key", "left")  # at most shards / HEAVY rows
    light = stored(rows.where("_home is null").select("_key", "_size")) if heavy else docs.select("_key", "_size")
    cuts = sorted(splitters(light, targets, tolerance * total / shards))
    shard = F.coalesce("_home", sum((F.when(F.col("_key") >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0)))

    # A shard's rows are numbered by stretches: an even part of the keys' range, or of a large group's rows by id.
    # Large groups come first.
    bits = max(0, (max(1, n) // STRETCH_ROWS).bit_length())
    spread = F.when(F.col("_home").isNotNull(), F.xxhash64("doc_id")).otherwise(F.col("_key"))
    stretch = F.struct(F.col("_home").isNull().alias("light"), F.when(F.col("_home").isNotNull(), F.col("_key")).alias("group"), F.shiftright(spread, 63 - bits).alias("part"))
    rows = stored(rows.withColumn("shard", shard.cast("int")).withColumn("_stretch", stretch).drop("_home"))
    before = Window.partitionBy("shard").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("shard", "_stretch").agg(F.count("*").alias("_n")).select("shard", "_stretch", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy("shard", "_stretch").orderBy("_key", "doc_id")
    keys = ["shard", F.col("_stretch")["light"].alias("_a"), F.coalesce(F.col("_stretch")["group"], F.lit(0)).alias("_b"), F.col("_stretch")["part"].alias("_c")]
    out = rows.withColumn("_own", F.row_number().over(own)).select("*", *keys[1:])
    base = base.select(*keys, "_base")
    return out.join(base, ["shard", "_a", "_b", "_c"]).withColumn("slot", F.col("_base") + F.col("_own") - 1).drop("_a", "_b", "_c", "_base", "_own", "_stretch", "_key")


def reports(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Shard and slot of every document under the law ``bytes``; see sharded."""
    text = F.coalesce("text", F.lit(""))
    rows = stored(docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("_size"), F.crc32(text.cast("binary")).alias("text_crc32"), text_key(F.col("text")).alias("_key")))
    out = sharded(rows, shards)
    return out.select("doc_id", F.col("_size").alias("size"), "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
