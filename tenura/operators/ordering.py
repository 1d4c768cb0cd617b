"""Exact order statistics and running totals over large columns.

Both need a total order, which a single task cannot provide at scale. Rows are
dealt to the shuffle partitions by range and stored with their partition's
number; partitions are then ordered in parallel and joined by the totals of
those before them. The ranges only balance the work: results are exact
whatever they are.

Spark's total order holds: NULL comes first in ascending and last in
descending order, NaN is larger than infinity, and each is one value like any
other.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenura.session import store


def _ranged(df: DataFrame, order: Column) -> DataFrame:
    """``df`` stored with ``_range``, which grows along the order."""
    return store(df.repartitionByRange(order).withColumn("_range", F.spark_partition_id()))


def _order(column: str, descending: bool) -> Column:
    return F.desc(column) if descending else F.asc(column)


def running_totals(
    df: DataFrame, column: str, totals: dict[str, str], *, descending: bool = False
) -> DataFrame:
    """Add cumulative sums ``{new: source}`` in the order of a numeric column.

    ``column`` must be distinct: group equal values first, so that a value
    shared by a third of the rows is one row here.
    """
    order = _order(column, descending)
    cut = _ranged(df, order)
    # at most one row per shuffle partition
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        cut.groupBy("_range")
        .agg(*[F.sum(source).alias(f"_before_{new}") for new, source in totals.items()])
        .withColumns(
            {
                f"_before_{new}": F.coalesce(F.sum(f"_before_{new}").over(earlier), F.lit(0))
                for new in totals
            }
        )
    )
    inside = Window.partitionBy("_range").orderBy(order)
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = cut.withColumns({new: F.sum(source).over(inside) for new, source in totals.items()})
    return (
        local.join(F.broadcast(before), "_range")
        .withColumns({new: F.col(new) + F.col(f"_before_{new}") for new in totals})
        .drop("_range", *[f"_before_{new}" for new in totals])
    )


def with_next(
    df: DataFrame, column: str, fields: list[str], *, descending: bool = False
) -> DataFrame:
    """Add ``next_<field>`` of the following row in the order of a distinct numeric column."""
    order = _order(column, descending)
    cut = _ranged(df, order)
    inside = Window.partitionBy("_range").orderBy(order)
    row = F.struct(*fields)
    # the row after a range's last one is the first of the next range
    opening = (
        cut.withColumn("_at", F.row_number().over(inside))
        .where("_at = 1")
        .select("_range", F.lead(row).over(Window.orderBy("_range")).alias("_opening"))
    )
    return (
        cut.join(F.broadcast(opening), "_range")
        .withColumn("_ahead", F.coalesce(F.lead(row).over(inside), F.col("_opening")))
        .withColumns({f"next_{f}": F.col("_ahead")[f] for f in fields})
        .drop("_range", "_opening", "_ahead")
    )


def exact_quantile(df: DataFrame, column: str, q: float) -> DataFrame:
    """The linearly interpolated quantile as one row ``(quantile)``.

    NULL and NaN are no values; infinities are. Without values the quantile is
    NULL. Equal values are combined first; only the sizes of the ranges reach
    the driver, and only the ranges of the two ranks in question are ordered.
    """
    value = F.col(column).cast("double")
    counted = df.select(value.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    cut = _ranged(counted.groupBy("v").agg(F.count("*").alias("n")), F.asc("v"))
    sizes = {r["_range"]: r["n"] for r in cut.groupBy("_range").agg(F.sum("n").alias("n")).collect()}
    position = q * max(sum(sizes.values()) - 1, 0)
    low = int(position)
    high = min(low + 1, max(sum(sizes.values()) - 1, 0))
    starts, start = {}, 0
    for part in sorted(sizes):
        if start <= high and start + sizes[part] > low:
            starts[part] = start
        start += sizes[part]
    inside = Window.partitionBy("_range").orderBy("v")
    first = F.lit(0)
    for part, before in starts.items():
        first = F.when(F.col("_range") == part, F.lit(before)).otherwise(first)
    ranked = cut.where(F.col("_range").isin(list(starts))).withColumn(
        "first", first + F.sum("n").over(inside) - F.col("n")
    )
    at = lambda rank: F.max(F.when((F.col("first") <= rank) & (F.col("first") + F.col("n") > rank), F.col("v")))
    found = ranked.agg(at(low).alias("low"), at(high).alias("high"))
    between = F.col("low") + (F.col("high") - F.col("low")) * (position - low)
    same = (F.col("low") == F.col("high")) | F.lit(position == low)
    return found.select(F.when(same, F.col("low")).otherwise(between).alias("quantile"))
