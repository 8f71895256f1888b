"""Name -> query and name -> oracle SQL, filled by the modules next to this one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from karvan.plans.sqlviews import with_views
from karvan.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, tuple[list[str], str]] = {}


def _wide_integers(df: DataFrame) -> DataFrame:
    """Report every count and rank as BIGINT, the integer type of the SQL side."""
    narrow = {f.name for f in df.schema if isinstance(f.dataType, IntegerType)}
    if not narrow:
        return df
    return df.select(*[F.col(c).cast("long").alias(c) if c in narrow else F.col(c) for c in df.columns])


def query(name: str, views: str = "", sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``views`` lists the shared SQL views its oracle reads."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _wide_integers(fn(configure(spark), sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            _ORACLES[name] = (views.split(), sql)
        return fn

    return register


def oracles() -> dict[str, str]:
    """Complete SQL per key; composed late because views may live in any module."""
    return {name: with_views(names, sql) for name, (names, sql) in _ORACLES.items()}
