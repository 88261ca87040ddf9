"""The registered queries over the archive and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from .fixtures import Archive, with_views

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of the derived archive as a query, with the DuckDB SQL of the same result."""

    def put(build: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: build(Archive(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = with_views(sql)
        return build

    return put


from . import changes, conversation, extras, feeds, integrity, relational, retrieval, storage, streams  # noqa: E402, F401  they register themselves
