import pytest
from pyspark.sql import functions as F

from spanledger import testbed
from spanledger.functions import pricing
from spanledger.functions.model import EVENT_SCHEMA
from spanledger.functions.periods import granularity, resolve, window_days
from spanledger.plans import cube, fold
from spanledger.plans.spec import Spec, explain, parse

NOW = 1_760_000_000_000


def event(i, **given):
    base = dict.fromkeys(EVENT_SCHEMA.fieldNames())
    return base | {"id": f"{i:04d}", "agent_id": "a", "session_id": "s", "timestamp": NOW + i, "type": "generation.end", "usage_source": "reported", "status": "ok", "raw_seq": i, "metadata": "{}"} | given


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[f] for f in EVENT_SCHEMA.fieldNames()) for r in rows], EVENT_SCHEMA)


def prices(spark, *rows):
    return spark.createDataFrame(list(rows), testbed.PRICE_SCHEMA)


def totals(spark, rows, metrics, policies=None, table=None, **chosen):
    ctx = cube.Context(frame(spark, rows), policies or {}, table, now=NOW)
    return cube.query(Spec(tuple(metrics.split()), (), chosen), ctx).totals.first()


def test_a_split_response_counts_once(spark):
    rows = [event(i, request_id="r1", input_tokens=5, output_tokens=7) for i in range(3)] + [event(i, request_id="r2", input_tokens=1) for i in (3, 4)]
    assert tuple(totals(spark, rows, "tokens_input tokens_output events")) == (6, 7, 5)
    assert tuple(totals(spark, rows, "tokens_input", {"a": "per_record_sum"})) == (17,)


def test_null_and_blank_requests_stand_alone(spark):
    rows = [event(0, output_tokens=2), event(1, output_tokens=3), event(2, request_id="", output_tokens=4)]
    assert totals(spark, rows, "tokens_output")[0] == 9


def test_dims_are_those_of_the_greatest_id(spark):
    rows = [event(1, request_id="r", model="old", provider="p", output_tokens=9), event(2, request_id="r", model="new", provider="p", output_tokens=1)]
    got = cube.query(Spec(("tokens_output", "events"), ("model",)), cube.Context(frame(spark, rows), {}, now=NOW)).rows.collect()
    assert {r["model"]: (r["tokens_output"], r["events"]) for r in got} == {"new": (9, 1), "old": (0, 1)}


def test_unknown_prices_are_not_zero(spark):
    table = prices(spark, ("p", "m", 0, 1.0, 2.0, None, None, None, "manual"))
    known = event(1, model="m", provider="p", input_tokens=1_000_000)
    assert tuple(totals(spark, [known], "cost_api_equiv cost_total", table=table)) == (1.0, 1.0)
    gap = event(2, model="x", provider="p", input_tokens=1)
    assert tuple(totals(spark, [known, gap], "cost_api_equiv cost_total", table=table)) == (None, None)
    cached = event(3, model="m", provider="p", cache_read_tokens=1)
    assert totals(spark, [known, cached], "cost_api_equiv", table=table)[0] is None
    paid = event(4, model="x", provider="p", input_tokens=5, cost_reported=0.5)
    assert tuple(totals(spark, [paid], "cost_total cost_api_equiv", table=table)) == (0.5, None)
    assert totals(spark, [event(5)], "cost_total", table=table)[0] is None


def test_price_in_force_at_noon(spark):
    day = NOW // pricing.DAY_MS * pricing.DAY_MS
    table = prices(spark, ("p", "m", 0, 1.0, 1.0, None, None, None, "litellm"), ("p", "m", day + 13 * 3_600_000, 9.0, 9.0, None, None, None, "override"), ("q", "M:free", 0, 4.0, 4.0, None, None, None, "manual"), ("q", "only", day + pricing.DAY_MS, 4.0, 4.0, None, None, None, "manual"))
    asked = spark.createDataFrame([("p", "m"), (None, "ONLY@2"), ("z", "m"), ("q", "m [beta]")], "provider string, model string")
    found = {r["model"]: r["input_per_mtok"] for r in pricing.lookup(asked, table, F.lit(day + pricing.NOON_MS)).collect() if r["provider"] != "z"}
    assert found == {"m": 1.0, "ONLY@2": None, "m [beta]": 4.0}


def test_whitelist_and_literals():
    for bad in ({"metrics": ("nope",)}, {"dims": ("nope",)}, {"dims": ("day", "day")}, {"filter": {"nope": 1}}, {"order": "metric:events"}, {"limit": 5001}):
        with pytest.raises(ValueError):
            Spec(**bad)
    spec = parse({"metrics": "events,tokens_total", "dims": ["day", "agent"], "agent": "a,b", "since": "7d", "subagents": "exclude", "limit": "0", "order": "dim:agent:desc"})
    assert spec.filter == {"agent": ["a", "b"], "since": "7d", "include_subagent_threads": False} and spec.limit == 0 and spec.ordering() == ("agent", False)
    assert "folded" in explain(spec)
    assert resolve("7d", NOW) == NOW - 7 * 86_400_000 and resolve("2025-01-02", 0) == resolve("20250102", 0) == 1_735_776_000_000 and resolve(NOW, 0) == NOW
    with pytest.raises(ValueError):
        resolve("yesterday", NOW)
    assert window_days(None, 1, NOW) is None and window_days(0, 86_400_000, NOW) == 1 and [granularity(x) for x in (92, 93, 367, None)] == ["day", "week", "month", "month"]


def test_order_limit_and_truncation(spark):
    rows = [event(i, agent_id=f"a{i % 3}", credits=None if i % 3 == 0 else float(i)) for i in range(7)]
    result = cube.query(Spec(("credits",), ("agent",), order="metric:credits:asc", limit=2), cube.Context(frame(spark, rows), {}, now=NOW))
    found, cut = result.collect()
    assert [r["agent"] for r in found] == ["a0", "a1"] and cut
    assert cube.query(Spec(("events",), ("agent",), {"agent": ["none"]}), cube.Context(frame(spark, rows), {}, now=NOW)).rows.count() == 0


@pytest.mark.parametrize("dims", [("agent",), ("day", "model"), ("project",)])
def test_groups_sum_to_the_total(spark, dims):
    ctx = cube.Context(testbed.events(spark, "/root/testdata/sf0.001"), testbed.POLICIES, testbed.prices(spark), now=NOW)
    spec = Spec(("events", "tokens_total", "duration"), dims)
    got = cube.query(spec, ctx)
    sums = got.rows.agg(*[F.sum(m).alias(m) for m in spec.metrics]).first()
    assert tuple(sums) == tuple(got.totals.first()) and sums["tokens_total"] > 0


def test_the_fold_has_one_shuffle_and_no_join(spark, capsys):
    fold.folded(testbed.events(spark, "/root/testdata/sf0.001").drop("raw_seq", "parent_event_id"), testbed.POLICIES).explain()
    plan = capsys.readouterr().out
    assert "Join" not in plan
