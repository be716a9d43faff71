"""Named queries and the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectura.session import use_utc

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may use any name in ``CTES`` as a table."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(use_utc(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_ctes(sql)
        return fn

    return register


def with_ctes(sql: str) -> str:
    """Put the definitions of all names used, directly or not, in front of ``sql``."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(CTES[name])

    visit(sql)
    # A definition that names itself is recursive and cannot be materialized ahead.
    kind = lambda n: "" if re.search(rf"\b{n}\b", CTES[n]) else "MATERIALIZED "
    definitions = [f"{n} AS {kind(n)}({CTES[n].strip()})" for n in CTES if n in needed]
    body = sql.strip()
    if not definitions:
        return body
    recursive = re.match(r"WITH RECURSIVE\s", body)
    if recursive:
        return "WITH RECURSIVE " + ",\n".join(definitions) + ",\n" + body[recursive.end():]
    if re.match(r"WITH\s", body):
        return "WITH RECURSIVE " + ",\n".join(definitions) + ",\n" + body[5:]
    return "WITH RECURSIVE " + ",\n".join(definitions) + "\n" + body
