import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from spanledger import testbed
from spanledger.functions import model, show, text
from spanledger.functions.shared import stored
from spanledger.operators import derive, state
from spanledger.plans import fold
from spanledger.sources import connectors, export, prices, scan
from spanledger.streaming import ingest, loop

from .test_cube import NOW, event, frame


def test_frames():
    content = b'{"a":1}\r\n\n{"b":2}\n{"c"'
    assert [(n, a, e, x) for n, a, e, x in scan.frames(content)] == [(1, 0, 9, b'{"a":1}'), (3, 10, 18, b'{"b":2}')]
    assert [x[0] for x in scan.frames(content, 10, 3)] == [3]
    assert next(scan.frames(b"x" * (scan.LONGEST_LINE + 1) + b"\n"))[3] is None


def test_rescan_decision():
    saved = {"inode": 1, "offset": 10, "modified": 5, "parser_version": "2"}
    given = [(1, 10, 5, "2"), (1, 12, 6, "2"), (1, 4, 6, "2"), (2, 10, 5, "2"), (1, 10, 5, "3")]
    assert [scan.decision(saved, *g) for g in given] == ["skip", "append", "rotated", "rotated", "drift"] and scan.decision(None, 1, 1, 1) == "new"


def test_claude_code_records(spark, tmp_path):
    usage = {"input_tokens": 10, "output_tokens": 5, "cache_read_input_tokens": 3}
    reply = {"type": "assistant", "uuid": "u1", "sessionId": "s1", "requestId": "r1", "timestamp": "2025-01-01T00:00:01Z", "cwd": "/w", "message": {"role": "assistant", "model": "m", "usage": usage, "content": [{"type": "text"}, {"type": "tool_use", "id": "t1", "name": "mcp__git__log"}, {"type": "tool_use", "id": "t2", "name": "Read"}]}}
    answer = {"type": "user", "uuid": "u2", "sessionId": "s1", "timestamp": 1735689602, "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "is_error": True}]}}
    odd = {"type": "novelty", "uuid": "u3", "sessionId": "s1"}
    synthetic = reply | {"uuid": "u4", "requestId": "r2", "message": {"model": "<synthetic>", "usage": usage}}
    lines = [json.dumps(x) for x in (reply, answer, odd, synthetic)] + ["{broken", "[1]"]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n{fragment")
    found = scan.lines(spark, str(tmp_path))
    events, failures = connectors.normalized(found, connectors.CONNECTORS["claude-code"], NOW)
    rows = events.collect()
    assert sorted(r["type"] for r in rows) == sorted(["generation.end", "mcp.invoke", "tool.start", "message.user", "tool.result", "unknown", "message.assistant"])
    main = next(r for r in rows if r["type"] == "generation.end")
    assert (main["input_tokens"], main["output_tokens"], main["cache_read_tokens"], main["request_id"], main["timestamp"], main["provider"]) == (10, 5, 3, "r1", 1735689601000, "anthropic")
    assert [(r["capability_name"], r["capability_provider"], r["parent_event_id"]) for r in rows if r["capability_type"] == "mcp"] == [("log", "git", main["id"])]
    assert sorted(r["reason"] for r in failures.collect()) == ["malformed-json", "not-an-object"]
    assert events.select("id").distinct().count() == len(rows) and events.where(F.size(model.problems()) > 0).count() == 0
    pair = {r["id"]: r["parent_event_id"] for r in connectors.paired(events).collect()}
    assert list(pair.values()) == [next(r["id"] for r in rows if r["type"] == "mcp.invoke")]
    progress = spark.createDataFrame(scan.progress_of(found).collect())  # as a store keeps it
    with (tmp_path / "a.jsonl").open("a") as f:
        f.write('"}\n' + json.dumps(odd) + "\n")
    assert [r["seq"] for r in scan.lines(spark, str(tmp_path), progress=progress).collect()] == [7, 8]


def _lines(spark, *records):
    return spark.createDataFrame([("p", 1, n, 10 * n, 1, json.dumps(r), False) for n, r in enumerate(records, 1)], scan.LINE_SCHEMA)


def test_side_chains_hooks_and_results_find_their_event(spark):
    at = lambda n, **more: {"uuid": f"u{n}", "sessionId": "s", "timestamp": 1735689600 + n, **more}
    call = lambda i, name, **given: {"type": "tool_use", "id": i, "name": name, "input": given}
    says = lambda n, *blocks, **more: at(n, type="assistant", message={"role": "assistant", "content": list(blocks)}, **more)
    hears = lambda n, i, **more: at(n, type="user", message={"role": "user", "content": [{"type": "tool_result", "tool_use_id": i}]}, **more)
    hook = lambda n, code, **more: at(n, type="attachment", attachment={"type": "hook_success", "hookName": "lint", "hookEvent": "PostToolUse", "toolUseID": "t1", "exitCode": code, **more})
    first = [
        says(1, call("t1", "Read"), call("a1", "Task", subagent_type="scout"), call("k1", "Skill", skill="draw")), says(2, call("a2", "Agent")),
        says(3, isSidechain=True, agentId="x"), says(4, isSidechain=True, agentId="x"), says(5, isSidechain=True, agentId="y"), hook(6, 0), hook(7, 2), hook(8, None),
        at(9, type="attachment", attachment={"type": "deferred_tools_delta", "failedMcpServers": ["git", 3], "pendingMcpServers": []}),
    ]
    then = [hears(10, "t1"), hears(11, "a1", toolUseResult={"agentId": "x"}), hears(12, "nowhere", toolUseResult={"agentId": "z", "isError": True})]
    claude = connectors.CONNECTORS["claude-code"]
    events = stored(connectors.normalized(_lines(spark, *first, *then), claude, NOW)[0])
    rows = {(r["type"], r["raw_seq"], r["capability_name"]): r for r in connectors.linked(events).collect()}
    ids = {k: r["id"] for k, r in rows.items()}
    spawn, later = ids["tool.start", 1, "scout"], ids["tool.start", 2, "Agent"]
    assert rows["skill.invoke", 1, "draw"]["parent_event_id"] == ids["message.assistant", 1, None]
    assert len(rows) == events.count() == len(first) + len(then) + 4 + 3 + 2 + 2
    assert events.where(F.size(model.problems()) > 0).count() == 0
    # the end of x proves its call, y has only the last call before it, z has neither
    found = {(r["type"], r["capability_name"]): (r["parent_event_id"], r["subtype"], r["capability_provider"], r["status"]) for r in rows.values() if r["type"].startswith("subagent")}
    assert found == {("subagent.start", "scout"): (spawn, "proof", "Agent", "ok"), ("subagent.end", "scout"): (spawn, "proof", "Agent", "ok"), ("subagent.start", "y"): (later, "nearest", "agent", "ok"), ("subagent.end", "z"): (None, None, "agent", "error")}
    result = rows["tool.result", 10, "Read"]
    assert (result["parent_event_id"], result["capability_type"], result["request_id"]) == (ids["tool.start", 1, "Read"], "tool", None)
    assert rows["tool.result", 12, None]["parent_event_id"] is None
    hooks = [rows["hook.fire", n, "lint"] for n in (6, 7, 8)]
    assert [h["status"] for h in hooks] == ["ok", "error", "unknown"] and {h["parent_event_id"] for h in hooks} == {ids["tool.start", 1, "Read"]}
    assert [h["error_fingerprint"] is None for h in hooks] == [True, False, True]
    odd = rows["unknown", 9, None]
    assert odd["subtype"] == "attachment:deferred_tools_delta" and json.loads(odd["metadata"])["failed_mcp_servers"] == ["git", "3"]
    # lines that come later find the calls that a store already holds
    old, new = events.where(F.col("raw_seq") <= len(first)), events.where(F.col("raw_seq") > len(first))
    again = {r["id"]: r["parent_event_id"] for r in connectors.linked(new, old).collect()}
    assert again == {r["id"]: r["parent_event_id"] for r in rows.values() if r["raw_seq"] > len(first)}


@pytest.mark.parametrize("agent,record,expected", [
    ("codex", {"type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": 10, "cached_input_tokens": 4, "output_tokens": 2}, "total_token_usage": {"input_tokens": 999}}}}, (6, 2, 4)),
    ("zcode", {"type": "model_usage", "logical_request_id": "r", "input_tokens": 10, "cache_read_input_tokens": 4, "cache_creation_input_tokens": 9, "output_tokens": 2}, (0, 2, 4)),
    ("opencode", {"id": "x", "data": {"type": "step-finish", "tokens": {"input": 7, "output": 2, "cache": {"read": 1}}, "cost": 0.5}}, (7, 2, 1)),
    ("pi", {"type": "message", "message": {"responseId": "r", "usage": {"input": 3, "output": -2, "cacheRead": 1}}}, (3, 0, 1)),
    ("workbuddy", {"type": "message", "providerData": {"requestId": "r", "usage": {"input_tokens": 3, "output_tokens": 2.9}}}, (3, 2, 0)),
    ("qoder", {"type": "assistant", "message": {"usage": {"input_tokens": 0, "output_tokens": 0, "credits": 1.5}}}, (None, None, None)),
])
def test_usage_dialects(spark, agent, record, expected):
    rows = spark.createDataFrame([("p", 1, 0, 0, 1, json.dumps(record), False)], scan.LINE_SCHEMA)
    got = connectors.normalized(rows, connectors.CONNECTORS[agent], NOW)[0].first()
    assert (got["input_tokens"], got["output_tokens"], got["cache_read_tokens"]) == expected
    assert got["credits"] == (1.5 if agent == "qoder" else None) and got["cost_reported"] == (0.5 if agent == "opencode" else None)


def test_row_stores(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE part (id TEXT, data TEXT)")
        db.executemany("INSERT INTO part VALUES (?, ?)", [("a", "1"), ("b", "2")])
    assert not scan.is_wal(path) and [r["seq"] for r in scan.sqlite_rows(spark, path, "part", 1).collect()] == [2]
    with sqlite3.connect(path) as db:
        db.execute("PRAGMA journal_mode=WAL")
        db.execute("INSERT INTO part VALUES ('c', '3')")
        db.commit()
        assert scan.is_wal(path) and scan.sqlite_rows(spark, path, "part").count() == 3
    with pytest.raises(ValueError):
        scan.sqlite_rows(spark, path, "part; drop")


def test_store_replay_repair_and_order(spark, tmp_path):
    policies = {}
    rows = [event(i, request_id=f"r{i // 3}", output_tokens=i, parser_version="1") for i in range(9)]
    one, two = (ingest.Store(spark, f"file://{tmp_path}/{n}", policies) for n in "ab")
    assert one.apply(frame(spark, rows[:6]), 1) == {"new": 6, "changed": 0}
    assert one.apply(frame(spark, rows[:6]), 1) == {"new": 0, "changed": 0} == one.apply(frame(spark, rows[:6]), 2)
    one.apply(frame(spark, rows[6:]), 3)
    two.apply(frame(spark, rows[6:] + rows[6:]), 1)
    two.apply(frame(spark, rows[:6]), 2)
    key = lambda s: sorted((r["req_key"], r["output_tokens"], r["member_count"]) for r in s.fold().collect())
    assert key(one) == key(two) == [("r0", 2, 3), ("r1", 5, 3), ("r2", 8, 3)]
    # a repaired record lowers a maximum and leaves its old group
    assert one.apply(frame(spark, [rows[8] | {"output_tokens": 1, "request_id": "r9"}]), 4) == {"new": 0, "changed": 1}
    assert key(one) == [("r0", 2, 3), ("r1", 5, 3), ("r2", 7, 2), ("r9", 1, 1)]
    assert fold.health(one.fold(), one.events(), policies, policies) == "materialised"
    assert one.prune(NOW + 4 + 86_400_000, 1) == 4 and key(one) == [("r1", 5, 2), ("r2", 7, 2), ("r9", 1, 1)]


def test_stream_equals_batch(spark, tmp_path):
    rows = [event(i, request_id=f"r{i // 2}", output_tokens=i) for i in range(8)]
    for n, part in enumerate((rows[:4], rows[2:])):
        frame(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        store = ingest.Store(spark, f"file://{tmp_path}/store", {})
        ingest.stream(spark, f"{tmp_path}/in", store, f"{tmp_path}/check").awaitTermination()
    got = sorted((r["req_key"], r["output_tokens"], r["member_count"]) for r in store.fold().collect())
    assert got == [("r0", 1, 2), ("r1", 3, 2), ("r2", 5, 2), ("r3", 7, 2)] and store.events().count() == 8


def test_payloads_and_text(spark):
    rows = spark.createDataFrame([("aé" * 3, "/home/x/y"), (None, "/home/xy")], "t string, m string")
    got = rows.select(text.truncated(F.col("t"), 4).alias("t"), text.home_redacted(F.col("m"), "/home/x").alias("m")).collect()
    assert [r["t"] for r in got] == ["aéa", None] and [r["m"] for r in got] == ["~/y", "/home/xy"]
    deep = json.dumps({"a": "x" * 300, "b": list(range(20)), "c": {"d": {"e": 1}}, "secret": 1})
    out = json.loads(spark.createDataFrame([(deep,)], "m string").select(text.redacted(F.col("m"), ("secret",)).alias("m")).first()[0])
    assert len(out["a"]) == 241 and len(out["b"]) == 12 and out["c"]["d"] == "{object}" and "secret" not in out
    assert spark.createDataFrame([("used 12,345 tokens today",)], "t string").select(text.prose_tokens(F.col("t"))).first()[0] == 12345


def test_price_sources(spark, tmp_path):
    lite = spark.createDataFrame([(json.dumps({"a/m1": {"litellm_provider": "a", "input_cost_per_token": 1e-6, "output_cost_per_token": "nan"}, "x-budget": {"input_cost_per_token": 1}, "m:free": {"input_cost_per_token": 1}}),)], "value string")
    assert [(r["provider"], r["model"], r["input_per_mtok"], r["output_per_mtok"]) for r in prices.litellm(lite).collect() if r["provider"] != "unknown"] == [("a", "m1", 1.0, None)]
    odd = spark.createDataFrame([(json.dumps({"data": [{"id": f"b/{m}", "pricing": {"prompt": "1"}} for m in ("m:free", "x_Budget", "x-budgets")] + [{"id": "~b/latest", "pricing": {"prompt": "1"}}, {"id": "b/a~1", "pricing": {"prompt": "1"}}]}),)], "value string")
    assert sorted(r["model"] for r in prices.openrouter(odd).collect()) == ["a~1", "x-budgets", "x_Budget"]
    opened = spark.createDataFrame([(json.dumps({"data": [{"id": "b/m2", "pricing": {"prompt": "0.000002", "completion": "-1"}}]}),)], "value string")
    assert [(r["provider"], r["model"], r["input_per_mtok"], r["output_per_mtok"]) for r in prices.openrouter(opened).collect()] == [("b", "m2", 2.0, None)]
    good = {"provider": "p", "model": "m", "effective_from": 0, "input_per_mtok": 1.0, "output_per_mtok": 1.0}
    (tmp_path / "o.jsonl").write_text(json.dumps(good) + "\n")
    assert prices.overrides(spark, str(tmp_path / "o.jsonl")).count() == 1
    (tmp_path / "p.jsonl").write_text(json.dumps(good) + "\n" + json.dumps(good | {"input_per_mtok": -1}) + "\n")
    with pytest.raises(ValueError):
        prices.overrides(spark, str(tmp_path / "p.jsonl"))
    declared = prices.billing('{"billing": {"a": "local", "b": {"planUsdPerMonth": 20, "models": {"p/m": "api", "p/x": "odd"}}, "c": 5}}')
    assert declared["a"]["mode"] == "local" and declared["b"]["models"] == {"p/m": "api"} and "c" not in declared and prices.billing("{") == {}
    assert prices.billing_edited(declared, "b", model="p/m")["b"]["models"] == {}


def test_activations_and_forest(spark):
    rows = spark.createDataFrame([("s", "k", n) for n in (1, 10, 20, 30, 54, 55)], "session_id string, skill string, seq long")
    assert sorted(r["seq"] for r in derive.activations(rows).collect()) == [1, 30]  # 55 lies just 25 behind 30
    later = spark.createDataFrame([("s", "k", n) for n in (1, 26, 27, 56)], "session_id string, skill string, seq long")
    assert sorted(r["seq"] for r in derive.activations(later).collect()) == [1, 27, 56]
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 99), (5, 6), (6, 5), (7, 5)], "id long, parent long")
    assert {r["id"]: (r["root"], r["depth"]) for r in derive.roots(nodes).collect()} == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (4, 0), 5: (5, None), 6: (5, None), 7: (5, None)}


def test_exports(spark, tmp_path):
    events = testbed.events(spark, "/root/testdata/sf0.001")
    batches = export.otlp_batches(events, 100).collect()
    assert sum(b["n"] for b in batches) == events.count() and max(b["n"] for b in batches) == 100
    export.write_csv(events, str(tmp_path / "csv"), 10)
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 10


def test_deep_chains_and_cycles(spark):
    chain = [(i, i - 1 if i else None) for i in range(300)]
    ring = [(1000 + i, 1000 + (i + 1) % 70) for i in range(70)]
    tail = [(500 + i, 501 + i if i < 39 else 1010) for i in range(40)]  # ids below the ring's that lead into it
    got = {r["id"]: (r["root"], r["depth"]) for r in derive.roots(spark.createDataFrame(chain + ring + tail, "id long, parent long")).collect()}
    assert all(got[i] == (0, i) for i in range(300)) and all(got[i] == (1000, None) for i, _ in ring + tail)


def test_nearest_spawn_by_pairs(spark):
    import random

    rng = random.Random(3)
    at = lambda: (f"s{rng.randrange(3)}", f"f{rng.randrange(3)}", rng.randrange(12), rng.randrange(30))
    spawns, chains = [(f"p{i:03d}", *at()) for i in range(120)], [(f"c{i:03d}", *at()) for i in range(120)]
    want = {}
    for c, session, source, ts, seq in chains:
        fits = [(t, q, i) for i, s, o, t, q in spawns if s == session and t <= ts and (o != source or q <= seq)]
        if fits:
            want[c] = max(fits)[2]
    columns = "session_id string, source_id string, ts long, seq long"
    got = derive.nearest_spawns(spark.createDataFrame(chains, f"chain_id string, {columns}"), spark.createDataFrame(spawns, f"id string, {columns}"))
    assert {r["chain_id"]: r["spawn_id"] for r in got.collect()} == want


def test_series(spark):
    rows = spark.createDataFrame([("a", 5), ("b", 4), ("c", 3), ("d", 0)], "k string, v long")
    top = lambda n: [(r["k"], r["v"], r["rank"]) for r in derive.top_n_other(rows, "k", "v", n).orderBy("rank").collect()]
    assert top(3) == [("a", 5, 1), ("b", 4, 2), ("c", 3, 3)] and top(2) == [("a", 5, 1), ("Other", 7, 2)]
    change = lambda v: derive.half_over_half(spark.createDataFrame(list(enumerate(v)), "i long, v double"), "i", "v").first()[0]
    assert change([1.0, 1.0, 2.0, 2.0]) == 1.0 and change([-1.0, -1.0, 2.0, 2.0]) is None and change([1.0, 2.0, 3.0]) is None


def test_times_and_ids(spark):
    import hashlib

    lines = [({"ts": 1735689602}, 1735689602000), ({"ts": "1735689602"}, 7), ({"created": "2025-01-01T00:00:02Z", "date": 5}, 1735689602000), ({"time": "soon", "ts": 1735689602000}, 1735689602000)]
    rows = spark.createDataFrame([(json.dumps(x), 7, w) for x, w in lines], "line string, modified long, want long")
    assert all(r["t"] == r["want"] for r in rows.withColumn("t", scan.record_time(F.col("modified"), NOW)[0]).collect())
    sha = lambda *p: hashlib.sha256("\0".join(p).encode()).hexdigest()
    lit = lambda x: F.lit(x).cast("string")
    ids = spark.range(1).select(model.session_id(lit("a"), lit("n"), lit("s"), lit("r"), F.lit(0)), model.session_id(lit("a"), lit(None), lit("s"), lit("r"), F.lit(0)), model.session_id(lit("a"), lit(""), lit("s"), lit(None), F.lit(3_700_000)), model.error_fingerprint(lit(" Bad 0x12ab. at 7 "))).first()
    assert tuple(ids) == (sha("session", "a", "n"), sha("session-from-source", "s", "r"), sha("session-from-bucket", "s", "2"), sha("error", "bad nxnab at n"))


def test_state_of_records(spark):
    rows = spark.createDataFrame([("f", 1, 1, "a"), ("f", 2, 2, "b"), ("f", 3, 1, "c"), ("g", 1, 5, "d")], "source_id string, arrival long, seq long, id string")
    assert {r["id"]: r["run"] for r in state.runs_of(rows).collect()} == {"a": 0, "b": 0, "c": 1, "d": 0}
    assert {r["id"] for r in state.first_marked(rows, "source_id").where("first").collect()} == {"a", "d"}
    assert {r["source_id"]: r["id"] for r in state.latest_state(rows, "source_id", "id").collect()} == {"f": "b", "g": "d"}
    events = frame(spark, [event(1, input_tokens=3, model="m"), event(2)])
    got = {r["id"]: r for r in state.rehydrated(events).collect()}
    assert got["0001"]["usage"]["output_tokens"] == 0 and got["0001"]["usage"]["input_tokens"] == 3 and got["0002"]["usage"] is None and got["0002"]["model"] is None
    hooks = spark.createDataFrame([("h1", "f", "t1", "x", 0), ("h2", "f", "t9", "x", 2), ("h3", "f", None, "x", None)], "id string, source_id string, tool_use_id string, hook string, exit_code int")
    calls = spark.createDataFrame([("c1", "f", "t1", 1), ("c2", "f", "t1", 4)], "id string, source_id string, call_id string, seq long")
    assert {r["id"]: (r["parent_event_id"], r["status"]) for r in state.hooked(hooks, calls).collect()} == {"h1": ("c2", "ok"), "h2": (None, "error"), "h3": (None, "unknown")}
    part = spark.createDataFrame([("p1", "m1", None, "{}"), ("p2", "m9", "s9", "{}")], "id string, message_id string, session_id string, data string")
    message = spark.createDataFrame([("m1", "s1", '{"role":"user","modelID":"x"}')], "id string, session_id string, data string")
    session = spark.createDataFrame([("s1", None, "/d", "T")], "id string, parent_id string, directory string, title string")
    assert {r["id"]: (r["role"], r["session_id"], r["title"]) for r in state.store_rows(part, message, session).collect()} == {"p1": ("user", "s1", "T"), "p2": (None, "s9", None)}


def test_formats(spark):
    row = spark.range(1).select(*[show.usd(F.lit(v).cast("double")) for v in (None, 0.0, 0.12345, 1234.5)], *[show.tokens(F.lit(v).cast("long")) for v in (None, 999, 1000, 2_560_000)], *[show.millis(F.lit(v).cast("long")) for v in (None, 1499, 61_000, 3_720_000)], show.count(F.lit(1234567)))
    assert tuple(row.first()) == ("n/a", "$0.00", "$0.1235", "$1,234.50", "n/a", "999", "1k", "2.6M", "n/a", "1s", "1m01s", "1h02m", "1,234,567")


def test_export_names(spark):
    got = export.csv_rows(frame(spark, [event(1)]))
    assert got.columns[:4] == ["id", "schema_version", "agent_id", "host_id"] and got.columns[-3:] == ["thread_id", "cost_reported", "cost_source"] and len(got.columns) == 27
    events = frame(spark, [event(1, type="skill.invoke", model="m", provider="p", cache_read_tokens=2), event(2, type="mcp.invoke")])
    a, b = [r["a"] for r in events.withColumn("a", export.attributes(events.columns)).orderBy("id").collect()]
    assert a["gen_ai.operation.name"] == "invoke_agent" and a["gen_ai.usage.cache_read.input_tokens"] == "2" and a["gen_ai.response.model"] == "m" and "gen_ai.operation.name" not in b


def test_project_roots(spark):
    paths = spark.createDataFrame([("/w/a/.worktrees/x/y",), ("/w/a/b/c",), ("/z/q-1",), ("/other",)], "path string")
    rules = spark.createDataFrame([("/w/a", "A"), ("/w/a/b", "B")], "prefix string, root string")
    got = {r["path"]: r["root"] for r in derive.merged_roots(paths, rules, [("q-[0-9]", "Q"), ("q", "R")]).collect()}
    assert got == {"/w/a/.worktrees/x/y": "A", "/w/a/b/c": "B", "/z/q-1": "Q", "/other": "/other"}


def test_store_crashes_sweeps_and_grows(spark, tmp_path):
    rows = [event(i, source_id=f"f{i}", request_id=f"r{i // 2}", output_tokens=i) for i in range(6)]
    store = ingest.Store(spark, f"file://{tmp_path}/s", {}, buckets=4)
    store.apply(frame(spark, rows[:4]), 1)
    point, ingest.Store._point = ingest.Store._point, lambda *_: (_ for _ in ()).throw(OSError("lost"))
    try:
        with pytest.raises(OSError):
            store.apply(frame(spark, rows[4:]), 2)
    finally:
        ingest.Store._point = point
    assert store.events().count() == 4 and store.apply(frame(spark, rows[4:]), 2) == {"new": 2, "changed": 0} and store.pointer()["batches"] == [[1, 2]]
    before = sorted(map(str, store.fold().drop("member_buckets").collect()))
    store.grow(9)
    again = ingest.Store(spark, f"file://{tmp_path}/s", {}, buckets=4)
    assert again.buckets == 9 and again.sweep() > 0 and sorted(map(str, again.fold().drop("member_buckets").collect())) == before and again.events().count() == 6


def test_loop_from_files_to_tables(spark, tmp_path):
    line = lambda i, **more: json.dumps({"type": "assistant", "uuid": f"u{i}", "sessionId": "s", "requestId": f"r{i}", "timestamp": f"2025-01-01T00:00:0{i}Z", "cwd": "/w", "message": {"model": "m", "usage": {"output_tokens": i}}} | more) + "\n"
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.jsonl").write_text(line(1) + "{broken\n" + line(2)[:20])
    store = ingest.Store(spark, f"file://{tmp_path}/store", {}, buckets=4)
    own = loop.Loop(spark, store, [loop.Target(connectors.CONNECTORS["claude-code"], str(tmp_path / "logs")), loop.Target(connectors.CONNECTORS["pi"], str(tmp_path / "nowhere"))], lambda: NOW)
    feed = loop.ChangeFeed(store)
    assert own.scan()["new"] == 1 and own.failures().count() == 1 and feed.poll()["events"] == 1 and feed.poll() is None
    (tmp_path / "logs" / "a.jsonl").write_text(line(1) + "{broken\n" + line(2))
    # a crash after the events and before their offsets: the next scan reads them again and changes nothing
    commit, ingest.Store.commit = ingest.Store.commit, lambda *_: (_ for _ in ()).throw(OSError("lost"))
    try:
        assert own.scan() == {"new": 0, "changed": 0} and own.targets[0].failures == 1
    finally:
        ingest.Store.commit = commit
    assert store.events().count() == 2 and own.scan() == {"new": 0, "changed": 0} and own.targets[0].failures == 0
    assert [(r["offset"], r["seq"], r["status"]) for r in own.sources().collect()] == [((tmp_path / "logs" / "a.jsonl").stat().st_size, 4, "ok")]
    for _ in range(2):
        own.scan()
    assert own.targets[1].quarantined and len([r for r, _ in own.told if r.endswith("nowhere")]) == 5
    own.rediscovered(own.targets[1].root)
    assert not own.targets[1].quarantined
    (tmp_path / "logs" / "a.jsonl").unlink()
    (tmp_path / "logs" / "b.jsonl").write_text(line(3))
    assert own.scan()["new"] == 1 and {r["path"].rsplit("/", 1)[1]: r["status"] for r in own.sources().collect()} == {"a.jsonl": "gone", "b.jsonl": "ok"} and feed.poll()["events"] == 3
    assert store.table("session_summary", "session_id string").first()["event_count"] == 3
