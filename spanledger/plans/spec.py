"""The query language: a whitelist of metrics, dimensions and filters."""

from __future__ import annotations

from dataclasses import dataclass, field

METRICS = ["events", "sessions", "tokens_input", "tokens_output", "tokens_cache_read", "tokens_cache_write", "tokens_reasoning", "tokens_total", "duration", "credits", "cost_reported", "cost_api_equiv", "cost_total"]
DIMS = ["time", "day", "week", "month", "agent", "host", "project", "session", "thread", "model", "provider", "capability_type", "capability_name", "tool", "skill", "mcp", "plugin", "connector", "command", "subagent", "hook", "status", "usage_source"]
LISTS = {"agent": "agent_id", "host": "host_id", "project": "project_id", "session": "session_id", "capability_type": "capability_type", "capability_name": "capability_name", "status": "status", "type": "type", "model": "model", "provider": "provider"}
FILTERS = ["since", "until", *LISTS, "include_subagent_threads"]
FOLDED = {"tokens_input", "tokens_output", "tokens_cache_read", "tokens_cache_write", "tokens_reasoning", "tokens_total", "duration", "credits", "cost_api_equiv", "cost_total"}
PRICED = {"cost_api_equiv", "cost_total"}
MOST_ROWS = 5000


@dataclass(frozen=True)
class Spec:
    metrics: tuple[str, ...] = ("events",)
    dims: tuple[str, ...] = ()
    filter: dict = field(default_factory=dict)
    order: str | None = None
    limit: int | None = None
    totals: bool = True

    def __post_init__(self):
        object.__setattr__(self, "metrics", tuple(self.metrics) or ("events",))
        object.__setattr__(self, "dims", tuple(self.dims))
        for what, given, known in (("metric", self.metrics, METRICS), ("dimension", self.dims, DIMS), ("filter", self.filter, FILTERS)):
            if unknown := [x for x in given if x not in known]:
                raise ValueError(f"unknown {what}: {', '.join(unknown)}")
            if len(set(given)) != len(list(given)):
                raise ValueError(f"a {what} twice")
        if self.limit is not None and not 0 <= self.limit <= MOST_ROWS:
            raise ValueError(f"limit must lie between 0 and {MOST_ROWS}")
        self.ordering()

    def ordering(self) -> tuple[str, bool]:
        """Column and whether it ascends."""
        if self.order is None:
            if self.dims and self.dims[0] in ("time", "day", "week", "month"):
                return self.dims[0], True
            return "cost_api_equiv" if "cost_api_equiv" in self.metrics else self.metrics[0], False
        parts = self.order.split(":")
        if len(parts) != 3 or parts[0] not in ("metric", "dim") or parts[2] not in ("asc", "desc") or parts[1] not in (self.metrics if parts[0] == "metric" else self.dims):
            raise ValueError(f"not an order: {self.order!r}")
        return parts[1], parts[2] == "asc"


def parse(query: dict[str, str | list[str]]) -> Spec:
    """A spec from query-string values: lists by comma or by repetition, subagents=include or exclude."""
    def many(key: str) -> list[str]:
        given = query.get(key, [])
        return [x.strip() for part in (given if isinstance(given, list) else [given]) for x in part.split(",") if x.strip()]

    one = lambda key: (many(key) or [None])[0]
    chosen = {k: v for k in LISTS if (v := many(k))}
    chosen |= {k: v for k in ("since", "until") if (v := one(k)) is not None}
    if (sub := one("subagents")) is not None:
        if sub not in ("include", "exclude"):
            raise ValueError("subagents must be include or exclude")
        chosen["include_subagent_threads"] = sub == "include"
    limit = one("limit")
    if limit is not None and not limit.isdigit():
        raise ValueError("limit must be a number")
    return Spec(tuple(many("metrics")) or ("events",), tuple(many("dims")), chosen, one("order"), int(limit) if limit is not None else None)


def explain(spec: Spec) -> str:
    """What a query computes, in words."""
    lines = [f"Metrics: {', '.join(spec.metrics)}", f"By: {', '.join(spec.dims) or 'nothing (totals only)'}"]
    lines += [f"Where {k}: {v}" for k, v in spec.filter.items()]
    if FOLDED & set(spec.metrics):
        lines.append("Usage is folded per agent and request before it is summed; agents without a policy fold by request_max.")
    if PRICED & set(spec.metrics):
        lines.append("Costs are unknown wherever any spent bucket has no price in force at noon UTC of its day.")
    column, ascending = spec.ordering()
    lines.append(f"Order: {column} {'ascending' if ascending else 'descending'}" + (f", first {spec.limit}" if spec.limit is not None else ""))
    return "\n".join(lines)
