"""All queries of the raster engine by name, with their DuckDB SQL where it can express them.

``query`` registers a function (spark, sf_dir) -> DataFrame with its columns' kinds (l: long, the default; d: double,
rounded to 4 places; b: boolean; s: string), which both sides are brought to.
"""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict[str, str] = {}

_SPARK = {"l": "bigint", "d": "double", "b": "boolean", "s": "string"}
_DUCK = {"l": "BIGINT", "d": "DOUBLE", "b": "BOOLEAN", "s": "VARCHAR"}


def _kinds(columns: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) if ":" in c else (c, "l") for c in columns.split()]


def query(name: str, columns: str, sql: str | None = None):
    def add(f):
        def run(spark, sf_dir: str) -> DataFrame:
            cast = lambda c, k: F.round(F.col(c).cast("double"), 4) + 0.0 if k == "d" else F.col(c).cast(_SPARK[k])
            return f(spark, sf_dir).select(*[cast(c, k).alias(c) for c, k in _kinds(columns)])

        QUERIES[name] = run
        if sql:
            cast = lambda c, k: f'round("{c}"::DOUBLE, 4) + 0.0' if k == "d" else f'"{c}"::{_DUCK[k]}'
            SQL[name] = f"SELECT {', '.join(f'{cast(c, k)} AS "{c}"' for c, k in _kinds(columns))} FROM ({sql}) AS q"
        return f

    return add


for module in ("pointwise", "aggregates", "windows", "connected", "trees", "distances", "shapes"):
    import_module(f"tessera.plans.{module}")
