"""Registered queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from selenogrid.plans.workspace import Workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_CTES: dict[str, tuple[tuple[str, ...], str, str]] = {}


def cte(name: str, sql: str, needs: Iterable[str] = (), head: str = "") -> None:
    """Name a step of the checking SQL, with the steps it reads; ``head`` is the full head of a recursive step."""
    if name in _CTES:
        raise ValueError(f"step {name} is already defined")
    _CTES[name] = (tuple(needs), sql, head)


def sql(body: str, needs: Iterable[str]) -> str:
    """The body behind the WITH list of every step it needs, in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for dep in _CTES[name][0]:
                visit(dep)
            order.append(name)

    for name in needs:
        visit(name)
    steps = ",\n".join(f"{_CTES[n][2] or n} AS {'' if _CTES[n][2] else 'MATERIALIZED '}({_CTES[n][1]})" for n in order)
    body = body.strip()
    if not order:
        return body
    own = f",\n{body[5:]}" if body.startswith("WITH ") else f"\n{body}"
    return f"WITH RECURSIVE {steps}{own}"


def query(name: str, oracle: str | None = None, needs: Iterable[str] = ()) -> Callable:
    """Register ``fn(workspace) -> DataFrame`` and, where SQL can express it on whole tables, its check."""

    def keep(fn: Callable[[Workspace], DataFrame]) -> Callable[[Workspace], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is already registered")
        QUERIES[name] = lambda spark, sf_dir: fn(Workspace.of(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = sql(oracle, needs)
        return fn

    return keep
