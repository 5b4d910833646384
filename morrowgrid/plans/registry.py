"""Named queries with their SQL."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register f(spark, sf_dir) under a name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def with_views(body: str, *views: tuple[str, str]) -> str:
    """body under WITH of (name, select) pairs; body may go on with further CTEs by starting with a comma."""
    head = "WITH " + ", ".join(f"{n} AS ({s})" for n, s in views)
    return f"{head} {body}"
