"""A query is a Spark function, the shape of its result, and (where SQL can say it) its SQL twin.

The shape is written once and applied to both sides, so names, types and rounding agree:
``s`` text (also dates and times), ``i`` bigint, ``f`` double rounded to 6 digits,
``b`` boolean, ``a`` array as comma-separated text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sql import with_tables
from .views import Tables

_SCALE = 1e6


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[Tables], DataFrame]
    shape: tuple[tuple[str, str], ...]
    sql: str | None
    grain: str


REGISTRY: dict[str, Query] = {}


def query(shape: str, sql: str | None = None, grain: str = "coarse"):
    columns = tuple(tuple(item.split(":")) for item in shape.split())

    def register(run):
        REGISTRY[run.__name__] = Query(run.__name__, run, columns, sql, grain)
        return run
    return register


def _spark_column(name: str, kind: str):
    c = F.col(f"`{name}`")
    if kind == "s":
        out = c.cast("string")
    elif kind == "i":
        out = c.cast("bigint")
    elif kind == "b":
        out = c.cast("boolean")
    elif kind == "a":
        out = F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))
    else:
        d = c.cast("double")
        out = F.when(~F.isnan(d), F.rint(d * _SCALE) / _SCALE + F.lit(0.0))
    return out.alias(name)


def _sql_column(column: str, kind: str) -> str:
    name = f'"{column}"'
    if kind == "s":
        out = f"CAST({name} AS VARCHAR)"
    elif kind == "i":
        out = f"CAST({name} AS BIGINT)"
    elif kind == "b":
        out = f"CAST({name} AS BOOLEAN)"
    elif kind == "a":
        out = f"array_to_string({name}, ',')"
    else:
        d = f"CAST({name} AS DOUBLE)"
        out = f"CASE WHEN NOT isnan({d}) THEN round_even({d} * 1e6, 0) / 1e6 + CAST(0 AS DOUBLE) END"
    return f"{out} AS {name}"


def shaped(q: Query, tables: Tables) -> DataFrame:
    return q.run(tables).select(*[_spark_column(n, k) for n, k in q.shape])


def oracle(q: Query) -> str | None:
    if q.sql is None:
        return None
    columns = ", ".join(_sql_column(n, k) for n, k in q.shape)
    return with_tables(f"SELECT {columns} FROM ({q.sql}) AS answer", q.grain)
