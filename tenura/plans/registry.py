"""Where queries and their SQL counterparts are collected."""

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(spark, folder) -> DataFrame`` under a name."""

    def register(f):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


# Ratios of money or counts often lie exactly between two rounded values, where
# the order of the arithmetic alone would decide. Both engines add this to such
# ratios before rounding.
NUDGE = 1e-7


def rounded(df: DataFrame, digits: int = 4, *, ratios: tuple[str, ...] = ()) -> DataFrame:
    """Round doubles so that summation order cannot show."""
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    exact = {c: F.round(F.col(f"`{c}`"), digits) for c in doubles if c not in ratios}
    return df.withColumns(exact | {c: F.round(F.col(c) + NUDGE, digits) for c in ratios})


def labelled(df: DataFrame, *columns: str) -> DataFrame:
    """Month dates as ``yyyy-MM``."""
    return df.withColumns({c: F.date_format(c, "yyyy-MM") for c in columns or ("month",)})


def sql_text(template: str, **parts: str) -> str:
    """A ``{name}`` template as a SQL concatenation of literals and expressions."""
    pieces = [
        parts[piece[1:-1]] if piece.startswith("{") else "'" + piece.replace("'", "''") + "'"
        for piece in re.split(r"(\{\w+\})", template)
        if piece
    ]
    return "(" + " || ".join(pieces) + ")"
