"""Data-quality findings and the one automatic fix, removing duplicates."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura.errors import InsufficientDataError
from tenura.fixed_values import (
    MAX_DUPLICATE_PCT,
    MAX_FUTURE_DAYS,
    MIN_AMOUNT,
    QUALITY_FAILED,
    QUALITY_FINDINGS,
    QUALITY_PASSED,
    QUALITY_PASSED_WARNINGS,
)
from tenura.functions import text

KEYS = ("customer_id", "transaction_date", "transaction_amount")


def _rules(as_of) -> dict[str, Column]:
    day, ts, amount = F.col("customer_id"), F.col("transaction_date"), F.col("transaction_amount")
    latest = F.date_add(F.lit(as_of).cast("date") if as_of else F.current_date(), MAX_FUTURE_DAYS)
    return {
        "null_customer": day.isNull() | (day == ""),
        "null_date": ts.isNull(),
        "null_amount": amount.isNull(),
        "negative_amount": amount < MIN_AMOUNT,
        "future_date": ts > latest.cast("timestamp_ntz"),
        "zero_amount": amount == 0.0,
    }


def _grouped(df: DataFrame) -> DataFrame:
    """Rows by duplicate key, combined before the shuffle, however often one row repeats."""
    return df.groupBy(*KEYS).agg(F.count("*").alias("n"))


def quality_counts(df: DataFrame, as_of=None) -> DataFrame:
    """One row: total rows and the affected rows per finding.

    Every rule depends on the duplicate key only, so the rows are grouped by
    that key once and all findings come from the grouped rows.
    """
    grouped = _grouped(df)
    counts = [
        F.coalesce(F.sum(F.when(rule, F.col("n"))), F.lit(0)).alias(name)
        for name, rule in _rules(as_of).items()
    ]
    return grouped.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"),
        *counts,
    )


def finding_count(df: DataFrame, name: str, as_of=None) -> DataFrame:
    """Affected rows of one finding: ``(rows, affected_count)``.

    Without duplicates to look for this is a single aggregation over the scan.
    """
    if name == "duplicates":
        return quality_counts(df, as_of).select("rows", F.col("duplicates").alias("affected_count"))
    return df.agg(
        F.count("*").alias("rows"), F.count_if(_rules(as_of)[name]).alias("affected_count")
    )


def _examples(grouped: DataFrame, rule: Column, value: Column, shown: Column, n: int = 3) -> Column:
    """The ``n`` smallest offending values as a scalar array of strings, from the rows by duplicate key.

    Each task keeps ``n`` values; only those are collected into the array. The
    condition names the count, so that it stays behind the grouping, which
    this and the counts then share: the table is scanned once.
    """
    offending = F.when(rule & (F.col("n") > 0), F.struct(value.alias("v"), shown.alias("s")))
    copies = F.array_repeat(offending, F.least(F.col("n"), F.lit(n)).cast("int"))
    few = grouped.select(F.explode(copies).alias("x")).where("x IS NOT NULL").select("x.*").orderBy("v").limit(n)
    return few.agg(
        F.transform(F.array_sort(F.collect_list(F.struct("v", "s"))), lambda e: e["s"])
    ).scalar()


def quality_report(df: DataFrame, as_of=None) -> DataFrame:
    """One row per finding that affects rows, in check order."""
    rules = _rules(as_of)
    amount, ts = F.col("transaction_amount"), F.col("transaction_date")
    examples = {
        "negative_amount": _examples(_grouped(df), rules["negative_amount"], amount, amount.cast("string")),
        "future_date": _examples(_grouped(df), rules["future_date"], ts, F.date_format(ts, "yyyy-MM-dd")),
    }
    none = F.array().cast("array<string>")
    pct = F.try_divide(F.col("n") * 100.0, F.col("rows"))

    entries = []
    for i, (name, (severity, category, message)) in enumerate(QUALITY_FINDINGS.items()):
        entries.append(
            F.struct(
                F.lit(i).alias("ordinal"),
                F.lit(name).alias("check"),
                F.lit(severity).alias("severity"),
                F.lit(category).alias("category"),
                F.lit(message).alias("template"),
                F.col(name).alias("n"),
                examples.get(name, none).alias("example_values"),
            )
        )
    findings = (
        quality_counts(df, as_of)
        .select("rows", F.inline(F.array(*entries)))
        .where("n > 0")
        .withColumn("pct", pct)
    )
    severity = F.when(
        (F.col("check") == "duplicates") & (F.col("pct") > MAX_DUPLICATE_PCT), F.lit("error")
    ).otherwise(F.col("severity"))
    message = F.replace(F.col("template"), F.lit("{n}"), text.count(F.col("n")))
    message = F.replace(message, F.lit("{pct}"), text.plain_number(F.col("pct"), 1))
    return findings.select(
        "ordinal",
        severity.alias("severity"),
        "category",
        "check",
        message.alias("message"),
        F.col("n").alias("affected_count"),
        F.round("pct", 2).alias("affected_pct"),
        "example_values",
    )


def quality_summary(df: DataFrame, as_of=None) -> DataFrame:
    """One row: does the table pass (no errors), how many rows are affected, in words."""
    report = quality_report(df, as_of)
    error = F.col("severity") == "error"
    totals = report.agg(
        F.count_if(error).alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
        F.coalesce(F.sum(F.when(error, F.col("affected_count"))), F.lit(0)).alias("error_count"),
    )
    rows = df.agg(F.count("*").alias("rows"))
    parts = dict(
        rows=text.count(F.col("total_rows")),
        warnings=F.col("warnings").cast("string"),
        errors=F.col("errors").cast("string"),
    )
    return (
        totals.withColumn("total_rows", rows.scalar())
        .withColumn("passed", F.col("errors") == 0)
        .withColumn(
            "summary",
            F.when(F.col("errors") > 0, text.fill(QUALITY_FAILED, **parts))
            .when(F.col("warnings") > 0, text.fill(QUALITY_PASSED_WARNINGS, **parts))
            .otherwise(text.fill(QUALITY_PASSED, **parts)),
        )
    )


def check_quality(df: DataFrame, as_of=None, *, strict: bool = False) -> DataFrame:
    """The report; with ``strict`` a table with errors is refused."""
    if strict:
        found = quality_summary(df, as_of).first()
        if not found["passed"]:
            raise InsufficientDataError(f"{found['error_count']} rows have blocking quality findings")
    return quality_report(df, as_of)


def dedup_transactions(df: DataFrame, ordinal: str | None = None) -> DataFrame:
    """Keep one row per (customer, date, amount): the first in ``ordinal`` order.

    Without an ordinal the smallest of the remaining columns is kept, so the
    result does not depend on partitioning. This is an aggregation rather
    than a ranked window: copies are reduced before the shuffle, and a key
    repeated by a third of the table never meets in one task.
    """
    keys = [c for c in KEYS if c in df.columns]
    if len(keys) < 2:
        return df
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(keys)
    ranked = [ordinal, *[c for c in rest if c != ordinal]] if ordinal else rest
    kept = df.groupBy(*keys).agg(F.min(F.struct(*ranked)).alias("kept"))
    return kept.select(*[c if c in keys else F.col("kept")[c].alias(c) for c in df.columns])
