"""The ingest loop: files to lines to events to the store, with offsets committed last, and what follows a scan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanledger.functions.shared import stored
from spanledger.operators import derive
from spanledger.sources import connectors, scan
from spanledger.streaming.ingest import Store

SOURCES = "path string, agent_id string, offset long, seq long, modified long, parser_version string, status string"
FAILURES = "path string, seq long, offset long, reason string, excerpt string, agent_id string"
#: Consecutive failures of a target after which it is left alone until it is found anew.
MOST_FAILURES = 5


@dataclass
class Target:
    """Files of one agent below a root."""

    connector: connectors.Connector
    root: str
    failures: int = 0

    @property
    def quarantined(self) -> bool:
        return self.failures >= MOST_FAILURES


@dataclass
class Loop:
    """Scans targets into a store. A crash at any point loses nothing: events are upserted before their offsets are
    committed, so lines that are read again change nothing."""

    spark: SparkSession
    store: Store
    targets: list[Target]
    clock: Callable[[], int]
    told: list[tuple[str, str]] = field(default_factory=list)  # (root, error) of failures

    def sources(self) -> DataFrame:
        return self.store.table("sources", SOURCES)

    def failures(self) -> DataFrame:
        return self.store.table("failures", FAILURES)

    def rediscovered(self, root: str) -> None:
        """A target that is found again is no longer in quarantine."""
        for t in self.targets:
            if t.root == root:
                t.failures = 0

    def scan(self) -> dict[str, int]:
        """One pass over all targets; returns how many events were new or changed. A target that fails is counted and
        told, and the others go on."""
        done = {"new": 0, "changed": 0}
        for t in self.targets:
            if t.quarantined:
                continue
            try:
                found = self._scan(t)
            except Exception as e:  # whatever a target's files hold must not stop the others
                t.failures += 1
                self.told.append((t.root, str(e)))
                continue
            t.failures = 0
            done = {k: v + found[k] for k, v in done.items()}
        if any(done.values()):
            self.project()
        return done

    def _scan(self, t: Target) -> dict[str, int]:
        known = self.sources()
        own = known.where(F.col("agent_id") == t.connector.agent)
        # a file that another parser version has read is read from its start
        progress = own.where(F.col("parser_version") == t.connector.parser_version).select("path", "offset", "seq")
        lines = stored(scan.lines(self.spark, t.root, t.connector.glob, progress=progress))
        events, failures = connectors.normalized(lines, t.connector, self.clock())
        done = self.store.apply(stored(events))
        read = scan.progress_of(lines).join(lines.groupBy("path").agg(F.max("modified").alias("modified")), "path")
        fresh = read.select("path", F.lit(t.connector.agent).alias("agent_id"), "offset", "seq", "modified", F.lit(t.connector.parser_version).alias("parser_version"), F.lit("ok").alias("status"))
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", t.connector.glob).load(t.root).select("path")
        kept = scan.gone(own.join(fresh.select("path"), "path", "left_anti"), files).unionByName(fresh)
        others = known.where(F.col("agent_id") != t.connector.agent)
        before = self.failures()
        again = before.join(failures.select("path", "seq"), ["path", "seq"], "left_anti")
        self.store.commit({"sources": others.unionByName(kept), "failures": again.unionByName(failures.select(*before.columns))})
        return done

    def project(self) -> None:
        """Tables that follow from the events: titles if any event says one, projects and summaries of sessions."""
        events = self.store.events()
        tables = {"session_projects": derive.session_projects(events), "session_summary": derive.session_summary(events)}
        if events.where(F.col("subtype").isin("custom-title", "ai-title")).limit(1).count():
            tables["session_titles"] = derive.session_titles(events)
        self.store.commit(tables)


@dataclass
class ChangeFeed:
    """Tells whether a store has moved since the last poll: by its version and the edges of its times, so that events
    that retention took are a change too. Rows are counted only when something has moved."""

    store: Store
    seen: tuple | None = None

    def poll(self) -> dict | None:
        version = self.store.pointer()["version"]
        if self.seen is not None and self.seen[0] == version:
            return None
        low, high, n = self.store.events().agg(F.min("timestamp"), F.max("timestamp"), F.count("*")).first()
        moved, self.seen = self.seen, (version, low, high)
        return None if moved == self.seen else {"version": version, "min_ts": low, "max_ts": high, "events": n}
