"""All registered queries."""

from clearwell.plans.registered import (
    cleaning,
    decisions,
    drifting,
    governing,
    graphs,
    nearness,
    profiling,
    repairing,
    requests,
    sourcing,
    stateful,
    streams,
    vectors,
)
from clearwell.plans.registered.base import Query

MODULES = (
    sourcing, profiling, cleaning, drifting, repairing, stateful, governing, graphs, vectors, decisions, requests,
    streams, nearness,
)


def all_queries() -> dict[str, Query]:
    return {name: query for m in MODULES for name, query in m.REGISTRY.queries.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.REGISTRY.oracle.items()}
