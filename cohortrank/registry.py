"""Queries by name, each with the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def round_up(value: Column | str, digits: int) -> Column:
    """Rounded, ties upwards. Engines sum in different orders, so a value within a ten-thousandth of a unit below a
    tie counts as a tie; both sides of a comparison round this way."""
    scale = 10.0**digits
    return F.floor(F.col(value) * scale + 0.5001 if isinstance(value, str) else value * scale + 0.5001) / scale


def with_round_up(sql: str) -> str:
    """sql with each rup(x, n) written out as round_up() computes it."""
    while (at := sql.find("rup(")) >= 0:
        depth, comma, i = 0, 0, at + 4
        while depth or sql[i] != ")":
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            comma = i if sql[i] == "," and not depth else comma
            i += 1
        scale = 10 ** int(sql[comma + 1 : i])
        sql = f"{sql[:at]}(floor(({sql[at + 4 : comma]}) * {scale}.0 + 0.5001) / {scale}.0){sql[i + 1 :]}"
    return sql


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = with_round_up(sql)
        return function

    return add
