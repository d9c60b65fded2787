"""Incremental ingest: an idempotent store of events in key-hashed buckets, its fold, and a stream that feeds both."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanledger.functions.model import EVENT_SCHEMA
from spanledger.functions.text import truncated
from spanledger.plans import fold as folds

#: Columns that name where a row came from; a replay never rewrites them.
PROVENANCE = ["id", "source_id", "raw_seq", "raw_offset", "ingested_at", "schema_version", "agent_id"]
#: Parts of a store; a batch rewrites those that it touches.
BUCKETS = 64
DERIVED = [f.name for f in EVENT_SCHEMA.fields if f.name not in PROVENANCE]


def latest(batch: DataFrame) -> DataFrame:
    """One row an id: the last to arrive by (ingested_at, raw_seq, raw_offset)."""
    order = Window.partitionBy("id").orderBy(F.desc("ingested_at"), F.desc("raw_seq"), F.desc("raw_offset"))
    return batch.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def upserted(events: DataFrame, batch: DataFrame) -> DataFrame:
    """events after a batch, with _change: new, changed (some derived column differs, null-safely) or same."""
    new = latest(batch).select(F.struct(*[F.col(f.name) for f in EVENT_SCHEMA.fields]).alias("_n"), "id")
    both = events.select(F.struct(*[F.col(f.name) for f in EVENT_SCHEMA.fields]).alias("_o"), "id").join(new, "id", "full")
    same = F.lit(True)
    for c in DERIVED:
        same = same & F.col(f"_o.{c}").eqNullSafe(F.col(f"_n.{c}"))
    change = F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull() | same, "same").otherwise("changed")
    pick = [F.when(F.col("_o").isNull(), F.col(f"_n.{c}")).when(F.col("_n").isNotNull() & F.lit(c in DERIVED), F.col(f"_n.{c}")).otherwise(F.col(f"_o.{c}")).alias(c) for c in EVENT_SCHEMA.fieldNames()]
    return both.select(*pick, change.alias("_change"))


def payloads_added(payloads: DataFrame, batch: DataFrame) -> DataFrame:
    """Payload rows (event_id, kind, role, text, at) of a batch that are not kept yet, cut to their most bytes."""
    fresh = batch.dropDuplicates(["event_id"]).join(payloads.select("event_id"), "event_id", "left_anti")
    return fresh.withColumn("text", truncated(F.col("text")))


def pruned(events: DataFrame, payloads: DataFrame, now: int, days: int = 30, events_too: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events and payloads after retention, and the events that went (their groups must be folded again)."""
    edge = now - days * 86_400_000
    old = F.coalesce(F.col("timestamp") < edge, F.lit(False))
    gone = events.where(old) if events_too else events.limit(0)
    left = events.where(~old) if events_too else events
    kept = payloads.where(F.col("at") >= edge)
    return left, kept.join(gone.select(F.col("id").alias("event_id")), "event_id", "left_anti") if events_too else kept, gone


def joined(spans: list[list[int]]) -> list[list[int]]:
    """Spans of whole numbers, ascending and without neighbours: batch ids that follow each other are one span."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


class Store:
    """Events and their fold below one path, in buckets: events by source, groups by key.

    A batch writes new versions of the buckets that it touches and then adds one small pointer file, which maps
    buckets to versions; the greatest number counts. So a reader sees one state whole, and a batch that fails or comes
    twice leaves nothing that anyone reads. ``sweep`` removes what no pointer names any more, ``grow`` deals a store into
    more buckets. Groups that a batch touches are folded from all their events, since a running maximum could not go
    down when a record is repaired; a group lists the buckets of its members, so only those are read. No watermark:
    late data is data.
    """

    def __init__(self, spark: SparkSession, path: str, policies: dict[str, str], buckets: int = BUCKETS):
        self.spark, self.path, self.policies = spark, path.rstrip("/"), policies
        self.buckets = self.pointer().get("buckets", buckets)

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _pointers(self) -> list[str]:
        p, fs = self._fs(f"{self.path}/pointer")
        return sorted(n for x in fs.listStatus(p) if (n := x.getPath().getName()).endswith(".json")) if fs.exists(p) else []

    def pointer(self) -> dict:
        names = self._pointers()
        if not names:
            return {"number": 0, "version": 0, "batches": [], "policies": {}, "events": {}, "fold": {}, "tables": {}}
        return json.loads(self.spark.read.text(f"{self.path}/pointer/{names[-1]}", wholetext=True).first()[0])

    def _point(self, state: dict) -> None:
        """Writes the next pointer aside and gives it its number: it is there whole or not at all."""
        state |= {"number": state["number"] + 1, "buckets": self.buckets}
        aside, fs = self._fs(f"{self.path}/pointer/{state['number']:012d}.tmp")
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not fs.rename(aside, self._fs(f"{self.path}/pointer/{state['number']:012d}.json")[0]):
            raise RuntimeError(f"another writer has moved the pointer of {self.path}")

    def table(self, name: str, schema: str) -> DataFrame:
        """A further table as it was last committed."""
        version = self.pointer()["tables"].get(name)
        return self.spark.createDataFrame([], schema) if version is None else self.spark.read.parquet(f"{self.path}/tables/{name}/v{version}")

    def commit(self, tables: dict[str, DataFrame]) -> None:
        """New versions of further tables, which become visible together."""
        state = self.pointer()
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{self.path}/tables/{name}/v{state['number'] + 1}")
            state["tables"] = state["tables"] | {name: state["number"] + 1}
        self._point(state)

    def sweep(self) -> int:
        """Deletes the buckets and pointers that the current state does not name; for when no reader is at an older one."""
        state, gone = self.pointer(), 0
        for what in ("events", "fold"):
            named = {f"v{v}/bucket={b}" for b, v in state[what].items()}
            top, fs = self._fs(f"{self.path}/{what}")
            for version in fs.listStatus(top) if fs.exists(top) else []:
                for bucket in fs.listStatus(version.getPath()):
                    name = bucket.getPath().getName()
                    if "=" in name and f"{version.getPath().getName()}/{name}" not in named:
                        fs.delete(bucket.getPath(), True)
                        gone += 1
        for name in self._pointers()[:-1]:
            p, fs = self._fs(f"{self.path}/pointer/{name}")
            fs.delete(p, False)
        return gone

    def grow(self, buckets: int) -> None:
        """Deals events and fold into another number of buckets, as one new version."""
        state = self.pointer()
        rows = self._read("events", state)
        self.buckets = buckets
        if rows is not None:
            version, every = state["version"] + 1, set(range(max(buckets, *map(int, state["events"]), *map(int, state["fold"] or ["0"])) + 1))
            self._write("events", version, rows.withColumn(folds.BUCKET, self._of_source()), every, state)
            self._refold(state, version, None, every)
            state["version"] = version
        self._point(state)

    def _read(self, what: str, state: dict, only: set[int] | None = None) -> DataFrame | None:
        """The current buckets of events or fold, or some of them; null if there are none."""
        paths = [f"{self.path}/{what}/v{v}/bucket={b}" for b, v in state[what].items() if only is None or int(b) in only]
        if not paths:
            return None
        return self.spark.read.parquet(*paths).withColumn(folds.BUCKET, F.regexp_extract(F.col("_metadata.file_path"), r"bucket=(\d+)/", 1).cast("int"))

    def _write(self, what: str, version: int, rows: DataFrame, hit: set[int], state: dict) -> None:
        """The next version of the buckets in hit. Those that have become empty leave the pointer."""
        rows.repartition(folds.BUCKET).write.mode("overwrite").partitionBy(folds.BUCKET).parquet(f"{self.path}/{what}/v{version}")
        p, fs = self._fs(f"{self.path}/{what}/v{version}")
        there = {int(x.getPath().getName().partition("=")[2]) for x in fs.listStatus(p) if x.isDirectory() and "=" in x.getPath().getName()}
        state[what] = {b: v for b, v in state[what].items() if int(b) not in hit} | {str(b): version for b in sorted(there)}

    def _of_source(self) -> Column:
        return F.pmod(F.xxhash64(F.coalesce("source_id", F.lit(""))), F.lit(self.buckets)).cast("int")

    def _of_key(self) -> Column:
        return F.pmod(F.xxhash64("agent_key", "req_key"), F.lit(self.buckets)).cast("int")

    def _distinct(self, column: DataFrame) -> set[int]:
        return {r[0] for r in column.distinct().collect()}  # as many as buckets at most

    def events(self) -> DataFrame:
        found = self._read("events", self.pointer())
        return self.spark.createDataFrame([], EVENT_SCHEMA) if found is None else found.drop(folds.BUCKET)

    def beside(self, batch: DataFrame) -> DataFrame:
        """Stored events of the sources in a batch; only their buckets are read."""
        found = self._read("events", self.pointer(), self._distinct(batch.select(self._of_source())))
        if found is None:
            return self.spark.createDataFrame([], EVENT_SCHEMA)
        return found.drop(folds.BUCKET).join(batch.select("source_id").distinct(), "source_id", "left_semi").select(*EVENT_SCHEMA.fieldNames())

    def fold(self) -> DataFrame:
        found = self._read("fold", self.pointer())
        return folds.folded(self.events(), self.policies, certificate=True) if found is None else found.drop(folds.BUCKET)

    def apply(self, batch: DataFrame, batch_id: int | None = None) -> dict[str, int]:
        """Writes a batch; a batch id that was applied before changes nothing. Returns how many rows were new or changed."""
        state = self.pointer()
        if batch_id is not None and any(a <= batch_id <= b for a, b in state["batches"]):
            return {"new": 0, "changed": 0}
        version = state["version"] + 1
        hit = self._distinct(batch.select(self._of_source()))
        old = self._read("events", state, hit)
        old = self.spark.createDataFrame([], EVENT_SCHEMA) if old is None else old.drop(folds.BUCKET)
        path = f"{self.path}/merged/v{version}"
        upserted(old, batch).write.mode("overwrite").parquet(path)
        merged = self.spark.read.parquet(path)
        counts = {r[0]: r[1] for r in merged.groupBy("_change").count().collect()}
        done = {"new": counts.get("new", 0), "changed": counts.get("changed", 0)}
        if batch_id is not None:
            state["batches"] = joined([*state["batches"], [batch_id, batch_id]])
        moved = state["policies"] != self.policies and state["version"] > 0
        if any(done.values()) or moved:
            changed = merged.where("_change <> 'same'").drop("_change")
            touched = folds.keyed(changed, self.policies).unionByName(folds.keyed(old.join(changed.select("id"), "id", "left_semi"), self.policies)).select("agent_key", "req_key").distinct()
            self._write("events", version, merged.drop("_change").withColumn(folds.BUCKET, self._of_source()), hit, state)
            self._refold(state, version, None if moved else touched, hit)
            state |= {"version": version, "policies": self.policies}
        self._point(state)
        p, fs = self._fs(path)
        fs.delete(p, True)
        return done

    def _refold(self, state: dict, version: int, touched: DataFrame | None, hit: set[int]) -> None:
        """New versions of the fold's buckets that hold touched groups; without them, of all."""
        if touched is None:
            rows = self._read("events", state)
            if rows is None:
                state["fold"] = {}
                return
            self._write("fold", version, folds.folded(rows, self.policies, certificate=True).withColumn(folds.BUCKET, self._of_key()), set(range(self.buckets)), state)
            return
        of = self._distinct(touched.select(self._of_key()))
        kept = self._read("fold", state, of)
        if kept is not None:
            kept = kept.drop(folds.BUCKET)
            hit = hit | self._distinct(kept.join(touched, ["agent_key", "req_key"], "left_semi").select(F.explode("member_buckets")))
            kept = kept.join(touched, ["agent_key", "req_key"], "left_anti")
        members = self._read("events", state, hit)
        if members is not None:
            members = folds.keyed(members, self.policies).join(touched, ["agent_key", "req_key"], "left_semi").drop("agent_key", "req_key")
            new = folds.folded(members, self.policies, certificate=True)
            kept = new if kept is None else kept.unionByName(new)
        if kept is not None:
            self._write("fold", version, kept.withColumn(folds.BUCKET, self._of_key()), of, state)

    def prune(self, now: int, days: int) -> int:
        """Drops events older than ``days`` and folds their groups again; returns how many went."""
        state = self.pointer()
        rows = self._read("events", state)
        if rows is None:
            return 0
        left, _, gone = pruned(rows, self.spark.createDataFrame([], "event_id string, at long"), now, days, events_too=True)
        n = gone.count()
        if n:
            version, hit = state["version"] + 1, self._distinct(gone.select(folds.BUCKET))
            touched = folds.keyed(gone, self.policies).select("agent_key", "req_key").distinct()
            self._write("events", version, left.where(F.col(folds.BUCKET).isin(sorted(hit))), hit, state)
            self._refold(state, version, touched, hit)
            state["version"] = version
            self._point(state)
        return n


def stream(spark: SparkSession, incoming: str, store: Store, checkpoint: str, interval: str | None = None):
    """A query that feeds Parquet files of normalized events below ``incoming`` to the store, batch by batch.

    The store remembers batch ids, so a batch that Spark repeats after a failure is applied once.
    """
    source = spark.readStream.schema(EVENT_SCHEMA).parquet(incoming)
    writer = source.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: store.apply(df, int(n)) and None)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
