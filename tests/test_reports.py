"""Reports on small tables whose rows are worked out by hand, and the fold against one in memory."""

import json
import random

import pytest

from spanledger.functions.model import TOKENS
from spanledger.operators import reports
from spanledger.plans import fold
from spanledger.sources import scan


def _twin(rows, mode):
    """The fold of one agent in plain Python: tokens by key, groups without usage left out."""
    groups = {}
    for r in rows:
        if all(r[t] is None for t in TOKENS):
            continue
        key = (r["request_id"] or r["id"]) if mode == "request_max" else r["id"]
        groups[key] = [max(a, r[t] or 0) for a, t in zip(groups.get(key, [0] * len(TOKENS)), TOKENS)]
    return len(groups), [sum(c) for c in zip(*groups.values())] or [0] * len(TOKENS)


def _events(spark, rows):
    kinds = {"timestamp": "long", "duration_ms": "long", "cost_reported": "double", "credits": "double"} | {t: "long" for t in TOKENS}
    names = dict.fromkeys(["id", "agent_id", "request_id", *fold.CARRIED, *TOKENS, "duration_ms", "cost_reported", "credits", "type", "metadata"])
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names))


@pytest.mark.parametrize("mode", ["request_max", "per_record_sum"])
def test_the_fold_equals_one_in_memory(spark, mode):
    pick = random.Random(7)
    rows = [{"id": f"{n:03}", "agent_id": "a", "request_id": pick.choice([None, "", "r1", "r2", "r3"]), **{t: pick.choice([None, 0, 3, 9]) for t in TOKENS}} for n in range(60)]
    rows += [{"id": f"x{n}", "agent_id": "a", "request_id": "bare", **dict.fromkeys(TOKENS)} for n in range(3)]
    used = " or ".join(f"{t} is not null" for t in TOKENS)
    got = fold.folded(_events(spark, rows).where(used), {"a": mode}).select(*TOKENS).collect()
    assert (len(got), [sum(r[t] for r in got) for t in TOKENS]) == _twin(rows, mode)


def test_usage_audit_counts_every_source_once(spark):
    from spanledger.plans.cube import Context

    row = lambda i, source, request, out, kind="generation.end": {"id": i, "agent_id": "a", "usage_source": source, "request_id": request, "output_tokens": out, "type": kind}
    events = _events(spark, [row("1", "reported", "r", 5), row("2", "estimated", "r", 7), row("3", None, None, None), row("4", "odd", "", 2, "error")])
    got = reports.usage_audit(Context(events, {"a": "per_record_sum"})).first().asDict()
    assert got == {"agent": "a", "events": 4, "reported": 1, "estimated": 1, "missing": 2, "generations": 3, "generations_with_usage": 2, "no_request": 2, "no_request_with_usage": 1, "usage_rows": 3, "naive": 14, "folded": 14, "model_folded": 14, "groups": 3, "global_folded": 9}


def test_pivot_keeps_all_or_the_first_and_the_rest(spark):
    rows = spark.createDataFrame([("d1", "a", 5), ("d2", "a", 5), ("d1", "b", 4), ("d1", "c", 3), ("d2", "", 99), ("d3", "none", 0), ("", "a", 50)], "day string, name string, n long")
    found = reports.pivoted_top(rows, "day", "name", "n", 2)
    assert sorted(map(tuple, found["rows"].collect())) == [("d1", 5, 7), ("d2", 5, 0), ("d3", 0, 0)]
    assert [tuple(r) for r in found["series"].orderBy("rank").collect()] == [("a", 10, 1), ("Other", 7, 2)]
    whole = reports.pivoted_top(rows, "day", "name", "n", 3)
    assert sorted(map(tuple, whole["rows"].collect())) == [("d1", 5, 4, 3), ("d2", 5, 0, 0), ("d3", 0, 0, 0)]
    assert {r["name"] for r in whole["series"].collect()} == {"a", "b", "c"}


def test_sessions_and_names_resolve(spark):
    events = spark.createDataFrame([("abc",), ("abd",), ("x",), (None,)], "session_id string")
    assert reports.resolve_session(events, "x") == "x" and reports.resolve_session(events, "abc") == "abc" and reports.resolve_session(events, "q") is None
    with pytest.raises(ValueError):
        reports.resolve_session(events, "ab")
    names = spark.createDataFrame([("p1", "Repo", "/home/Repo"), ("p2", "other", None), ("p3", "REPO", None)], "id string, label string, root string")
    assert reports.resolve_names(["repo", "P2", "new", "/HOME/repo"], names) == ["p1", "p3", "p2", "new", "p1"]


def test_payloads_belong_to_their_session(spark):
    from spanledger.plans.cube import Context

    events = spark.createDataFrame([("1", "s"), ("2", "t")], "id string, session_id string")
    payloads = spark.createDataFrame([("1", "p"), ("2", "q")], "event_id string, text string")
    ctx = Context(events, {})
    assert [r["text"] for r in reports.node_payloads(ctx, payloads, "s", "1").collect()] == ["p"]
    assert reports.node_payloads(ctx, payloads, "s", "2").count() == 0


def test_gone_sources_and_roots_beside_each_other(spark, tmp_path):
    sources = spark.createDataFrame([("a", 5, "ok"), ("b", 7, "ok")], "path string, offset long, status string")
    here = spark.createDataFrame([("a",), ("a",)], "path string")
    assert sorted(map(tuple, scan.gone(sources, here).select("path", "offset", "status").collect())) == [("a", 5, "ok"), ("b", 7, "gone")]
    for name in ("tool", "tool-beta", "tool-empty", "else"):
        (tmp_path / name).mkdir()
    for name in ("tool", "tool-beta", "else"):
        (tmp_path / name / "logs").mkdir()
    assert scan.variant_roots(str(tmp_path), "tool", ["logs"]) == [str(tmp_path / "tool"), str(tmp_path / "tool-beta")]
    assert scan.variant_roots(str(tmp_path), "tool", ["logs"], str(tmp_path / "else")) == [str(tmp_path / "else")]
    assert scan.variant_roots(str(tmp_path / "nothing"), "tool", ["logs"]) == []


def test_servers_sources_and_links(spark):
    told = lambda **lists: ("unknown", "attachment:deferred_tools_delta", None, None, json.dumps(lists))
    rows = [told(failed_mcp_servers=["git"], pending_mcp_servers=["slow"]), told(needs_auth_mcp_servers=["mail", None]), ("mcp.invoke", None, "mcp", "log", None), ("tool.start", None, "subagent", "x", None), ("message.user", None, None, None, '{"subagentThread":true}')]
    events = spark.createDataFrame([(*r, "a", None) for r in rows], "type string, subtype string, capability_type string, capability_name string, metadata string, agent_id string, parent_event_id string")
    installed = spark.createDataFrame([("git",), ("mail",), ("slow",), ("web",)], "name string")
    got = {tuple(r) for r in reports.server_states(events, installed).select("name", "state").collect()}
    assert got == {("git", "failed"), ("slow", "pending"), ("mail", "needs_auth"), ("slow", "attached"), ("web", "attached"), ("log", "attached")}
    assert reports.server_states(events.limit(0), installed.limit(0)).count() == 0
    assert tuple(reports.linkage(events).first()) == ("a", 2, 2)
    sources = spark.createDataFrame([("ok",), ("gone",), ("rotated",), ("ok",), (None,)], "status string")
    assert tuple(reports.retention(sources).first()) == (1, 1, 2)
