"""The registered queries: a Spark job each, with the oracle text where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.fixtures import Tables, duckdb_cte
from tidemark.session import configure


@dataclass(frozen=True)
class Query:
    run: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.run(Tables(configure(spark), sf_dir))


REGISTRY: dict[str, Query] = {}


def query(name: str, uses: str = "", sql: str | None = None):
    """Register a job under `name`; `uses` lists the derived tables its oracle reads."""

    def register(run: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(run, _with_inputs(uses.split(), sql) if sql else None)
        return run

    return register


def _with_inputs(uses: list[str], sql: str) -> str:
    body = sql.strip()
    head = "WITH "
    if body.startswith("WITH RECURSIVE "):
        head, body = "WITH RECURSIVE ", body.removeprefix("WITH RECURSIVE ")
        ctes = [body]
    elif body.startswith("WITH "):
        ctes = [body.removeprefix("WITH ")]
    else:
        ctes = []
    inputs = [duckdb_cte(name) for name in uses]
    if ctes:
        return head + ",\n".join(inputs + ctes)
    return (head + ",\n".join(inputs) + "\n" if inputs else "") + body
