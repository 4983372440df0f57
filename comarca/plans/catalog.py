"""The query catalog: a Spark callable, its SQL twin and the digits results are published with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from comarca.session import configure


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    digits: dict[str, int] = field(default_factory=dict)

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(configure(spark), sf_dir)
        return df.withColumns({c: F.round(F.col(c), d) + F.lit(0.0) for c, d in self.digits.items()})

    def oracle(self) -> str | None:
        if self.sql is None or not self.digits:
            return self.sql
        swaps = ", ".join(f"round({c}, {d}) + 0.0 AS {c}" for c, d in self.digits.items())
        return f"SELECT * REPLACE ({swaps}) FROM ({self.sql})"


CATALOG: dict[str, Query] = {}


def query(name: str, sql: str | None = None, **digits: int):
    """Register a query. ``digits`` gives the decimals a floating column is published with."""

    def register(build):
        if name in CATALOG:
            raise ValueError(f"query {name!r} is registered twice")
        CATALOG[name] = Query(name, build, sql, digits)
        return build

    return register
