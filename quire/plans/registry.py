"""Query registry and the table bindings shared by queries and reference SQL.

A binding is one SQL text over the given tables. ``{table}`` names a given table, ``[[name]]``
another binding; SHA256HEX(x) and JSON_K(x) stand for the one spelling that differs by engine.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.plans.bindings import BINDINGS
from quire.session import spread, stream_table, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_SPARK = ((r"SHA256HEX\((\w+)\)", r"sha2(\1, 256)"), (r"JSON_K\((\w+)\)", r"CAST(get_json_object(\1, '$.k') AS INT)"))
_DUCK = ((r"SHA256HEX\((\w+)\)", r"sha256(\1)"), (r"JSON_K\((\w+)\)", r"CAST(json_extract_string(\1, '$.k') AS INT)"))


def _expand(text: str) -> str:
    while "[[" in text:
        text = re.sub(r"\[\[(\w+)\]\]", lambda m: f"({BINDINGS[m.group(1)].strip()})", text)
    return text


def _spell(text: str, rules: tuple) -> str:
    for pattern, spelling in rules:
        text = re.sub(pattern, spelling, text)
    return text


def bind(spark: SparkSession, root: str, name: str, heavy: bool = False) -> DataFrame:
    """A binding as a DataFrame; ``heavy`` spreads few input splits over all cores."""
    text = _spell(_expand(BINDINGS[name]), _SPARK)
    tables = {t: table(spark, root, t) for t in set(re.findall(r"\{(\w+)\}", text))}
    if heavy:
        tables = {t: spread(df) for t, df in tables.items()}
    return spark.sql(text, **tables)


def bind_stream(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The binding over a file stream of its table, for bindings of a single table without joins."""
    text = _spell(_expand(BINDINGS[name]), _SPARK)
    tables = {t: stream_table(spark, root, t) for t in set(re.findall(r"\{(\w+)\}", text))}
    return spark.sql(text, **tables)


def reference_sql(text: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", _spell(_expand(text), _DUCK)).strip()


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query and, where it can be stated in SQL, its reference."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = reference_sql(sql)
        return fn

    return register
