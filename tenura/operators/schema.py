"""Column names, types and the column-level checks of a transaction table.

Name checks look at ``df.columns`` only and cost no job.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.errors import LeakageError, SchemaError
from tenura.fixed_values import (
    COLUMN_ALIASES,
    FEATURES,
    FORMULA_PREFIXES,
    INJECTION_WARNING,
    LEAKAGE_COLUMNS,
    OPTIONAL_COLUMNS,
    REQUIRED_COLUMNS,
)
from tenura.functions.text import fill


def normalise_headers(df: DataFrame) -> DataFrame:
    """Strip, lower-case, and replace blanks in column names by underscores."""
    names = [c.strip().lower().replace(" ", "_") for c in df.columns]
    clashes = sorted({n for n in names if names.count(n) > 1})
    if clashes:
        raise SchemaError(f"columns differ only in case or blanks: {clashes}")
    return df.toDF(*names)


def alias_mapping(columns) -> dict[str, str]:
    """Alias -> canonical name for the columns that need renaming."""
    mapping = {
        c: COLUMN_ALIASES[c]
        for c in columns
        if c in COLUMN_ALIASES and COLUMN_ALIASES[c] not in columns
    }
    targets = list(mapping.values())
    doubled = sorted({t for t in targets if targets.count(t) > 1})
    if doubled:
        raise SchemaError(f"several columns could be {doubled}: {sorted(mapping)}")
    return mapping


def apply_aliases(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(alias_mapping(df.columns))


def require_columns(df: DataFrame) -> DataFrame:
    missing = sorted(set(REQUIRED_COLUMNS) - set(df.columns))
    if missing:
        raise SchemaError(f"Required column(s) missing: {missing}. Found: {sorted(df.columns)}.")
    return df


def schema_report(spark: SparkSession, columns) -> DataFrame:
    """``(column, status, source)`` with status required / optional / extra / missing.

    ``columns`` are the names before aliasing; ``source`` is the alias used.
    """
    renamed = {v: k for k, v in alias_mapping(columns).items()}
    present = set(columns) - set(renamed.values()) | set(renamed)

    def status(c):
        if c not in present:
            return "missing"
        if c in REQUIRED_COLUMNS:
            return "required"
        return "optional" if c in OPTIONAL_COLUMNS else "extra"

    known = (*REQUIRED_COLUMNS, *OPTIONAL_COLUMNS)
    rows = [(c, status(c), renamed.get(c)) for c in (*known, *sorted(present - set(known)))]
    return spark.createDataFrame(rows, "column string, status string, source string")


def to_amount(c):
    """Text to double; NULL unless it is a finite number.

    ``NaN`` and every spelling of infinity are missing values: sums skip them
    and the quality report counts them. Java's type suffixes (``12.5d``) do
    not make a number.
    """
    value = c.try_cast("double")
    finite = ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(~c.rlike(r"(?i)[df]\s*$") & finite, value)


def coerce_types(df: DataFrame) -> DataFrame:
    """Amount to double, ids and dimensions trimmed, status lower-cased.

    Values that do not fit become NULL and are counted by the quality report.
    """
    rules = {
        "transaction_amount": to_amount,
        "customer_id": lambda c: F.nullif(F.trim(c), F.lit("nan")),
        "subscription_id": lambda c: F.nullif(F.trim(c), F.lit("nan")),
        "subscription_status": lambda c: F.lower(F.trim(c)),
        "country": lambda c: F.trim(c),
        "product": lambda c: F.trim(c),
    }
    return df.withColumns({c: rule(F.col(c)) for c, rule in rules.items() if c in df.columns})


def canonical_schema(df: DataFrame) -> DataFrame:
    """Headers, aliases, required columns and types in one step; no job runs."""
    return df.transform(normalise_headers).transform(apply_aliases).transform(require_columns).transform(coerce_types)


def formula_cells(df: DataFrame) -> DataFrame:
    """Columns with cells a spreadsheet would run as formulas: ``(column, cells, warning)``.

    One pass over the data whatever the number of columns; the data is not changed.
    """
    strings = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    if not strings:
        raise SchemaError("there are no text columns to look at")
    counts = df.agg(
        *[
            F.count_if(F.substring(F.col(f"`{c}`"), 1, 1).isin(*FORMULA_PREFIXES)).alias(c)
            for c in strings
        ]
    )
    warning = fill(INJECTION_WARNING, column=F.col("column"), n=F.col("cells").cast("string"))
    return (
        counts.unpivot([], [F.col(f"`{c}`") for c in strings], "column", "cells")
        .where("cells > 0")
        .withColumn("warning", warning)
    )


def assert_no_leakage(df: DataFrame) -> DataFrame:
    """Raise if a column that encodes the label is among the features."""
    banned = sorted(set(LEAKAGE_COLUMNS) & set(df.columns))
    if banned:
        raise LeakageError(f"the columns {banned} say who churned; take them out of the features")
    return df


def feature_projection(df: DataFrame, features=FEATURES) -> DataFrame:
    """The features that exist, missing values as 0."""
    kept = [c for c in features if c in df.columns]
    return assert_no_leakage(df.select("customer_id", *kept).na.fill(0.0, kept).na.fill(0, kept))


def _comparable(column: Column, kind: str) -> Column:
    """A string that is equal for equal values only."""
    if kind in ("double", "float"):
        return (column + 0.0).cast("string")  # one zero
    return F.hex(column) if kind == "binary" else column.cast("string")


def column_profile(df: DataFrame, *, approximate: bool = False) -> DataFrame:
    """Per column: type, non-null, null and distinct counts, in one pass over the rows.

    Exact counts group (column, value) pairs, whose copies are combined before
    the shuffle; ``approximate=True`` keeps a sketch per column and task
    instead. Columns that are arrays, maps or structs are compared as JSON.
    """
    kinds = dict(df.dtypes)
    if approximate:
        aggregates = []
        for c in df.columns:
            column = F.col(f"`{c}`")
            aggregates += [
                F.count(column).alias(f"{c}|present"),
                F.approx_count_distinct(column).alias(f"{c}|distinct"),
            ]
        one = df.agg(F.count("*").alias("rows"), *aggregates)
        counts = [
            F.struct(
                F.lit(i).alias("i"),
                F.col("rows"),
                F.col(f"`{c}|present`").alias("present"),
                F.col(f"`{c}|distinct`").alias("distinct"),
            )
            for i, c in enumerate(df.columns)
        ]
        found = one.select(F.inline(F.array(*counts)))
    else:
        nested = lambda kind: kind.startswith(("array", "map", "struct"))
        value = lambda c: F.to_json(F.col(f"`{c}`")) if nested(kinds[c]) else _comparable(F.col(f"`{c}`"), kinds[c])
        pairs = df.select(
            F.inline(F.array(*[F.struct(F.lit(i).alias("i"), value(c).alias("v")) for i, c in enumerate(df.columns)]))
        )
        found = (
            pairs.groupBy("i", "v")
            .agg(F.count("*").alias("n"))
            .groupBy("i")
            .agg(
                F.sum("n").alias("rows"),
                F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("present"),
                F.count("v").alias("distinct"),
            )
        )
    named = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("type")) for c in df.columns])
    columns = df.sparkSession.range(1).select(F.posexplode(named).alias("i", "c"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return columns.join(found, "i", "left").select(
        "c.column",
        "c.type",
        zero(F.col("present")).alias("non_null"),
        zero(F.col("rows") - F.col("present")).alias("null_count"),
        zero(F.col("distinct")).alias("distinct_count"),
    )


def preview(df: DataFrame, order, n: int = 100) -> DataFrame:
    """The first rows in the given order."""
    return df.orderBy(*order).limit(n)
