"""Derived tables: session summaries, titles, projects, subagent links, forests and project roots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanledger.functions.shared import stored


def session_summary(events: DataFrame) -> DataFrame:
    """Count, first and last time of every session."""
    return events.where("session_id is not null").groupBy("session_id").agg(F.count("*").alias("event_count"), F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp"))


def session_projects(events: DataFrame, unattributed: str = "unattributed") -> DataFrame:
    """The most frequent project of each session, ties to the smaller id; the unattributed one only if there is no other."""
    counts = events.where("session_id is not null and project_id is not null").groupBy("session_id", "project_id").agg(F.count("*").alias("n"))
    order = Window.partitionBy("session_id").orderBy((F.col("project_id") == unattributed).asc(), F.desc("n"), "project_id")
    return counts.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").select("session_id", "project_id", "n")


def session_titles(events: DataFrame) -> DataFrame:
    """Newest non-blank custom title of a session, else its newest generated one."""
    title = F.get_json_object("metadata", "$.value.title")
    rows = events.where(F.col("subtype").isin("custom-title", "ai-title")).withColumn("_title", title).where(F.trim("_title") != "")
    newest = lambda kind: F.max_by(F.when(F.col("subtype") == kind, F.col("_title")), F.when(F.col("subtype") == kind, F.struct("timestamp", "raw_seq", "id")))
    return rows.groupBy("session_id").agg(F.coalesce(newest("custom-title"), newest("ai-title")).alias("title"))


def nearest_spawns(chains: DataFrame, spawns: DataFrame) -> DataFrame:
    """For each chain (chain_id, session_id, source_id, ts, seq) the last spawn of its session before it.

    A spawn precedes if its time is not later and, within one source, its sequence number is not either. The latest of
    them by (ts, seq, id) wins. One ordered pass over chains and spawns of a session gives the latest by time; only
    chains whose own source breaks the rule with it are held against the spawns of their session one by one.
    """
    at = lambda df, id_: df.select("session_id", "source_id", "ts", "seq", F.col(id_).alias("_id"))
    both = at(spawns, "id").withColumn("_chain", F.lit(0)).unionByName(at(chains, "chain_id").withColumn("_chain", F.lit(1)))
    order = Window.partitionBy("session_id").orderBy("ts", "_chain").rowsBetween(Window.unboundedPreceding, 0)
    spawn = F.when(F.col("_chain") == 0, F.struct(F.col("ts").alias("t"), F.col("seq").alias("s"), F.col("_id").alias("i"), F.col("source_id").alias("o")))
    seen = both.withColumn("_last", F.max(spawn).over(order)).where("_chain = 1 and _last is not null")
    fits = (F.col("_last.o") != F.col("source_id")) | (F.col("_last.s") <= F.col("seq"))
    first = seen.where(F.coalesce(fits, F.lit(False))).select(F.col("_id").alias("chain_id"), F.col("_last.i").alias("spawn_id"))
    left = seen.where(~F.coalesce(fits, F.lit(False))).select(F.col("_id").alias("chain_id"), "session_id", "source_id", "ts", "seq")
    s = spawns.select("session_id", F.col("id").alias("_sid"), F.col("source_id").alias("_ssrc"), F.col("ts").alias("_sts"), F.col("seq").alias("_sseq"))
    before = (F.col("_sts") <= F.col("ts")) & ((F.col("_ssrc") != F.col("source_id")) | (F.col("_sseq") <= F.col("seq")))
    found = left.join(s, "session_id").where(before).groupBy("chain_id").agg(F.max(F.struct("_sts", "_sseq", "_sid")).alias("_best"))
    return first.unionByName(found.select("chain_id", F.col("_best")["_sid"].alias("spawn_id")))


def proven_spawns(closings: DataFrame, spawns: DataFrame) -> DataFrame:
    """Chains whose closing rows (chain_id, call_id) name exactly one spawn, and that spawn exists."""
    named = closings.where("call_id is not null").groupBy("chain_id").agg(F.count_distinct("call_id").alias("_n"), F.min("call_id").alias("call_id")).where("_n = 1")
    return named.join(spawns.select("call_id", F.col("id").alias("spawn_id")).dropDuplicates(["call_id"]), "call_id").select("chain_id", "spawn_id")


def subagent_links(chains: DataFrame, closings: DataFrame, spawns: DataFrame) -> DataFrame:
    """Proof first, then the nearest spawn, else null."""
    proof, near = proven_spawns(closings, spawns).withColumnRenamed("spawn_id", "_p"), nearest_spawns(chains, spawns).withColumnRenamed("spawn_id", "_n")
    out = chains.select("chain_id").join(proof, "chain_id", "left").join(near, "chain_id", "left")
    return out.select("chain_id", F.coalesce("_p", "_n").alias("spawn_id"), F.when(F.col("_p").isNotNull(), "proof").when(F.col("_n").isNotNull(), "nearest").alias("how"))


def roots(nodes: DataFrame) -> DataFrame:
    """id, root, depth of a forest (id, parent), however deep.

    A parent that is absent ends the chain at its child; what leads into a cycle ends at the cycle's smallest id, with
    depth null. Pointers double each round, so a chain of n needs log2(n) rounds; each is written to the shared folder
    and starts from files. Every round settles some of what can be settled, so what is left when one settles nothing
    leads into cycles; those rounds go on until a pointer has passed as many nodes as are left.
    """
    present = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("_here"))
    up = nodes.join(present, "parent", "left").select("id", F.when(F.col("_here"), F.col("parent")).alias("up"))
    end = F.col("up").isNull()
    state = stored(up.select("id", F.coalesce("up", "id").alias("root"), F.when(end, 0).otherwise(1).alias("depth"), end.alias("done"), F.least("id", F.coalesce("up", "id")).alias("least")))
    left, steps = state.where("not done").count(), 1
    while left:
        ahead = state.select(F.col("id").alias("_id"), F.col("root").alias("_root"), F.col("depth").alias("_depth"), F.col("done").alias("_done"), F.col("least").alias("_least"))
        moved = state.where("not done").join(ahead, F.col("root") == F.col("_id"))
        # a pointer's least holds what lies before it, so that on a cycle it comes to be the least of the cycle
        moved = moved.select("id", F.col("_root").alias("root"), (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_done").alias("done"), F.least("least", "_least").alias("least"))
        state = stored(state.where("done").unionByName(moved))
        steps, before, left = 2 * steps, left, state.where("not done").count()
        if left == before and steps >= left:
            break
    if left:
        on = state.where("not done").select(F.col("id").alias("_id"), F.col("least").alias("_cycle"))
        state = state.join(on, (F.col("root") == F.col("_id")) & ~F.col("done"), "left").withColumn("root", F.coalesce("_cycle", "root"))
    return state.select("id", "root", F.when(F.col("done"), F.col("depth")).cast("int").alias("depth"))


def orphans(events: DataFrame) -> DataFrame:
    """Events whose parent is not an event of their session."""
    parents = events.select(F.col("session_id"), F.col("id").alias("parent_event_id"))
    return events.where("parent_event_id is not null").join(parents, ["session_id", "parent_event_id"], "left_anti")


def canonical_order(events: DataFrame) -> list[Column]:
    return [F.col("timestamp").asc_nulls_first(), F.col("raw_seq").asc_nulls_last(), F.col("id").asc()]


def timeline(events: DataFrame, session: str, offset: int = 0, limit: int | None = None) -> DataFrame:
    """A session's events in canonical order with their position from 0."""
    w = Window.partitionBy("session_id").orderBy(*canonical_order(events))
    rows = events.where(F.col("session_id") == session).withColumn("position", F.row_number().over(w) - 1)
    keep = F.col("position") >= offset
    return rows.where(keep if limit is None else keep & (F.col("position") < offset + limit))


def waterfall(events: DataFrame) -> DataFrame:
    """Left edge and width of every event in percent of its session's span; the width is 0.4 at least.

    Spans are grouped with partial sums and joined back, so no session has to be held by one task.
    """
    spans = events.groupBy("session_id").agg(F.min("timestamp").alias("_low"), F.max(F.col("timestamp") + F.coalesce("duration_ms", F.lit(0))).alias("_high"))
    rows = events.select("session_id", "id", "timestamp", "duration_ms").join(spans, "session_id")
    span = F.greatest(F.lit(1), F.col("_high") - F.col("_low"))
    return rows.select("session_id", "id", (100.0 * (F.col("timestamp") - F.col("_low")) / span).alias("left_pct"), F.greatest(F.lit(0.4), 100.0 * F.coalesce("duration_ms", F.lit(0)) / span).alias("width_pct"))


def activations(rows: DataFrame, gap: int = 25) -> DataFrame:
    """Skill activations (session_id, skill, seq) that count: the first, and each that lies more than ``gap`` records
    behind the last that counted. The distance is not to the row before, so this is a fold over a session's numbers."""
    def step(kept: Column, x: Column) -> Column:
        return F.when((F.size(kept) == 0) | (x - F.element_at(kept, -1) > gap), F.concat(kept, F.array(x))).otherwise(kept)

    seqs = rows.groupBy("session_id", "skill").agg(F.sort_array(F.collect_list(F.col("seq").cast("long"))).alias("_s"))
    kept = F.aggregate("_s", F.expr("cast(array() as array<bigint>)"), step)
    return seqs.select("session_id", "skill", F.explode(kept).alias("seq"))


def merged_roots(paths: DataFrame, rules: DataFrame, patterns: list[tuple[str, str]] | None = None) -> DataFrame:
    """Paths with their root: a worktree's part is cut off first; then the longest rule prefix that holds the path
    whole (a rule ends at a path separator) decides, then the first of ``patterns`` (regular expression, root) that is
    found in it, else the path is its own."""
    r = rules.select(F.col("prefix").alias("_p"), F.col("root").alias("_r"))
    cut = F.regexp_replace("path", r"/(?:\.git/worktrees|\.worktrees|\.[a-z]+/worktrees)/.*$", "")
    rows = paths.select("path", cut.alias("_path"))
    holds = (F.col("_path") == F.col("_p")) | F.col("_path").startswith(F.concat(F.regexp_replace("_p", "/+$", ""), F.lit("/")))
    found = rows.join(F.broadcast(r), holds, "left")  # rules are written by hand
    by_pattern = F.coalesce(*[F.when(F.col("_path").rlike(p), F.lit(root)) for p, root in patterns or []], F.col("_path"))
    found = found.withColumn("_own", by_pattern)
    return found.groupBy("path").agg(F.coalesce(F.max_by("_r", F.when(F.col("_p").isNotNull(), F.length("_p"))), F.first("_own")).alias("root"))


def label(display: Column, root: Column, project: Column, unattributed: str = "unattributed") -> Column:
    """Display name, else the root's last part, else unattributed for that bucket, else the id."""
    base = F.nullif(F.regexp_extract(root, r"([^/\\]+)[/\\]*$", 1), F.lit(""))
    return F.coalesce(F.nullif(F.trim(display), F.lit("")), base, F.when(project == unattributed, F.lit(unattributed)), project)


def repaired_roots(projects: DataFrame, candidates: DataFrame) -> DataFrame:
    """Roots whose digest is a project's id: a candidate counts only if it reproduces the id."""
    from spanledger.functions.model import project_id

    return projects.select("id").join(candidates.select("root").distinct().withColumn("id", project_id(F.col("root"))), "id")


def top_n_other(rows: DataFrame, name: str, value: str, n: int, other: str = "Other") -> DataFrame:
    """The n largest of positive values if there are no more, else the n - 1 largest and one row for the rest, with ranks."""
    order = Window.orderBy(F.desc(value), name)
    positive = rows.where(F.col(value) > 0)
    ranked = positive.orderBy(F.desc(value), name).limit(n - 1).withColumn("_nth", F.row_number().over(order))
    rest = positive.join(ranked.select(name), name, "left_anti").agg(F.count("*").alias("_n"), F.min(name).alias("_only"), F.sum(value).alias(value)).where("_n > 0")
    last = rest.select(F.when(F.col("_n") == 1, F.col("_only")).otherwise(F.lit(other)).alias(name), value, F.lit(n).alias("rank"))
    return ranked.select(name, value, F.col("_nth").alias("rank")).unionByName(last)


def half_over_half(series: DataFrame, order: str, value: str) -> DataFrame:
    """Change of the second half against the first; null under four points, or if the first is not above zero."""
    w = Window.orderBy(order)
    both = series.withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy()))
    half = F.floor(F.col("_n") / 2)
    sums = both.agg(F.max("_n").alias("n"), F.sum(F.when(F.col("_i") <= half, F.col(value))).alias("a"), F.sum(F.when(F.col("_i") > F.col("_n") - half, F.col(value))).alias("b"))
    return sums.select(F.when((F.col("n") >= 4) & (F.col("a") > 0), (F.col("b") - F.col("a")) / F.col("a")).cast("double").alias("change"))
