"""Reading logs: framing of append-only files, rescan decisions, row stores, and time stamps."""

from __future__ import annotations

import os
import shutil
import sqlite3
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LONGEST_LINE = 8 * 1024 * 1024
LINE_SCHEMA = "path string, modified long, seq long, offset long, end long, line string, oversized boolean"
#: Names that a record's time may have, first usable one first.
TIME_FIELDS = ["timestamp", "created_at", "createdAt", "time", "ts", "created"]


def frames(content: bytes, start: int = 0, seq: int = 1):
    """(seq, offset, end, line or None if oversized) of each line that ends; a fragment behind the last is left alone.

    Every line counts, from 1 on; blank ones are left out."""
    at = start
    while (stop := content.find(b"\n", at)) >= 0:
        raw = content[at:stop]
        raw = raw[:-1] if raw.endswith(b"\r") else raw
        if raw.strip():
            yield seq, at, stop + 1, raw if len(raw) <= LONGEST_LINE else None
        seq += 1
        at = stop + 1


def decision(saved: dict | None, inode: int, size: int, modified: int, parser_version: str | None = None) -> str:
    """skip, append, rotated, new, or drift (the parser has changed since the source was read)."""
    if saved is None:
        return "new"
    if parser_version is not None and saved.get("parser_version") not in (None, parser_version):
        return "drift"
    if saved.get("inode") != inode or size < saved["offset"]:
        return "rotated"
    if size == saved["offset"] and modified == saved.get("modified"):
        return "skip"
    return "append"


def lines(spark: SparkSession, root: str, glob: str = "*.jsonl", progress: DataFrame | None = None, modified_after: str | None = None) -> DataFrame:
    """Complete lines of all files below root, from the offset and number in progress (path, offset, seq) on.

    A file is one row of work: files grow by appending and are read by executors, wherever they lie.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    files = reader.load(root).select("path", F.unix_millis("modificationTime").alias("modified"), "content")
    if progress is not None:
        files = files.join(progress.select("path", "offset", "seq"), "path", "left")
    else:
        files = files.withColumn("offset", F.lit(0).cast("long")).withColumn("seq", F.lit(1).cast("long"))

    def run(batches):
        for b in batches:
            for path, modified, content, offset, seq in zip(*(c.to_pylist() for c in b.columns)):
                offset = offset or 0
                fresh = offset > len(content)  # shorter than before: rotated, so it is read from the start
                rows = [(path, modified, n, at, end, (raw or b"").decode("utf-8", "replace") if raw is not None else None, raw is None) for n, at, end, raw in frames(content, 0 if fresh else offset, 1 if fresh else seq or 1)]
                if rows:
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["path", "modified", "seq", "offset", "end", "line", "oversized"])

    return files.select("path", "modified", "content", "offset", "seq").mapInArrow(run, LINE_SCHEMA)


def progress_of(scanned: DataFrame) -> DataFrame:
    """Where the next scan goes on: behind the last complete line of each file."""
    return scanned.groupBy("path").agg(F.max("end").alias("offset"), (F.max("seq") + 1).alias("seq"))


def split_malformed(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines that are JSON objects, and failures: what is malformed or oversized is data, not an exception."""
    kind = F.expr("schema_of_variant(try_parse_json(line))")
    reason = F.when(F.col("oversized"), "oversized-line").when(kind.isNull(), "malformed-json").when(~kind.startswith("OBJECT"), "not-an-object")
    marked = scanned.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null").select("path", "seq", "offset", "reason", F.substring("line", 1, 240).alias("excerpt"))


def json_at(path: str, column: str = "line") -> Column:
    return F.get_json_object(column, path)


def record_time(modified: Column, clock: int, fields: list[str] | None = None) -> tuple[Column, Column]:
    """Milliseconds of a record and where they come from: its first usable field, the file, or the scan's clock.

    Numbers under 1e11 are seconds; text is a date or nothing, so digits in quotes are no time.
    """
    def usable(name: str) -> Column:
        raw = json_at(f"$.{name}")
        kind = F.expr(f"schema_of_variant(try_variant_get(try_parse_json(line), '$.{name}', 'variant'))")
        n = F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), raw.try_cast("double"))
        date = F.when((kind == "STRING") & ~raw.rlike(r"^\s*[0-9.]+\s*$"), F.unix_millis(F.try_to_timestamp(raw)))
        return F.coalesce(F.when(n < 1e11, n * 1000).otherwise(n).cast("long"), date)

    own = F.coalesce(*[usable(f) for f in fields or TIME_FIELDS])
    return F.coalesce(own, modified, F.lit(clock)), F.when(own.isNotNull(), "record").when(modified.isNotNull(), "file").otherwise("clock")


# Row stores (SQLite files of other programs) are read on the driver: they are small and live beside it.


def is_wal(path: str) -> bool:
    """Whether a SQLite file is in write-ahead mode: bytes 18 and 19 of its header."""
    with open(path, "rb") as f:
        head = f.read(20)
    return len(head) == 20 and head[18] == 2 and head[19] == 2


def snapshot(path: str, tries: int = 5) -> str:
    """A copy of a SQLite file and its log that did not change while it was made, folded into one file."""
    sign = lambda: [(os.stat(p).st_size, os.stat(p).st_mtime_ns) if os.path.exists(p) else None for p in (path, path + "-wal")]
    folder = tempfile.mkdtemp(prefix="snapshot-")
    copy = os.path.join(folder, "copy.db")
    for _ in range(tries):
        before = sign()
        for suffix in ("", "-wal"):
            if os.path.exists(copy + suffix):
                os.remove(copy + suffix)
            if os.path.exists(path + suffix):
                shutil.copyfile(path + suffix, copy + suffix)
        if sign() == before:
            with sqlite3.connect(copy) as db:
                db.execute("PRAGMA journal_mode=DELETE")
            return copy
    raise RuntimeError(f"{path} changes faster than it can be copied")


def sqlite_rows(spark: SparkSession, path: str, table: str, after: int = 0) -> DataFrame:
    """Rows of a table behind a rowid, as rowid and a JSON object of the rest."""
    import json

    own = snapshot(path) if is_wal(path) else path
    with sqlite3.connect(f"file:{own}?mode=ro", uri=True) as db:
        if not table.isidentifier():
            raise ValueError(f"not a table name: {table!r}")
        found = db.execute(f'SELECT rowid AS _rowid, * FROM "{table}" WHERE rowid > ? ORDER BY rowid', (after,))
        names = [c[0] for c in found.description]
        rows = [(r[0], json.dumps(dict(zip(names[1:], (v.decode("utf-8", "replace") if isinstance(v, bytes) else v for v in r[1:]))))) for r in found]
    return spark.createDataFrame(rows, "seq long, line string")


def variant_roots(parent: str, prefix: str, markers: list[str], override: str | None = None) -> list[str]:
    """Folders beside each other that begin alike and hold a marker; an override stands for all."""
    if override:
        return [override] if os.path.isdir(override) else []
    if not os.path.isdir(parent):
        return []
    return sorted(p for n in os.listdir(parent) if n.startswith(prefix) and os.path.isdir(p := os.path.join(parent, n)) and any(os.path.exists(os.path.join(p, m)) for m in markers))


def gone(sources: DataFrame, paths: DataFrame) -> DataFrame:
    """sources with status gone where the file is missing; their offsets and history stay."""
    here = paths.select("path", F.lit(True).alias("_here")).distinct()
    return sources.join(here, "path", "left").withColumn("status", F.when(F.col("_here").isNull(), F.lit("gone")).otherwise(F.col("status"))).drop("_here")
