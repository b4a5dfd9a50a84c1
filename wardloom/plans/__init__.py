"""Named queries: importing a module here registers its own."""

from wardloom.plans import civic_queries, contained_queries, intel_queries, issue_queries, mesh_queries, more_queries, priority_queries, read_queries, record_queries, store_queries, term_queries  # noqa: F401
from wardloom.plans.registry import ORACLES, QUERIES


def all_queries() -> dict:
    return dict(QUERIES)


def all_oracles() -> dict:
    return dict(ORACLES)
