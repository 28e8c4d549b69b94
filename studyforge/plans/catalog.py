"""Registry of the core queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "stats_by_chapter"


def register(name: str, oracle: str | None = None):
    """Decorator: put a (spark, sf_dir) -> DataFrame function into the catalog."""

    def put(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return put


from . import bank, corpus, evidence, explanations, learning, papers, sessions, texts  # noqa: E402,F401  they register their queries
