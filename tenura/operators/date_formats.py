"""Finding the date format of a string column and parsing with it."""

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura.errors import DateFormatError
from tenura.fixed_values import DATE_FORMATS, MIXED_FORMAT, MIXED_PATTERNS


@dataclass(frozen=True)
class DetectedFormat:
    format: str
    label: str
    is_ambiguous: bool
    first_component_le_12: bool


# Strptime directives and the Spark pattern letters they stand for.
DIRECTIVES = {
    "Y": "yyyy",
    "y": "yy",
    "m": "M",
    "d": "d",
    "H": "H",
    "I": "h",
    "M": "m",
    "S": "s",
    "f": "SSSSSS",
    "b": "MMM",
    "B": "MMMM",
    "p": "a",
    "j": "DDD",
}


def spark_pattern(fmt: str) -> str:
    """The Spark pattern of a strptime format; a directive without one is an error.

    One digit or two are read, as strptime does, except where numbers touch.
    """
    parts = re.findall(r"%.|[^%]+|%$", fmt)
    out = []
    for i, part in enumerate(parts):
        if part == "%%" or part[0] != "%":
            plain = part.replace("%%", "%").replace("'", "''")
            out.append(re.sub(r"[A-Za-z\[\]{}#]+", lambda m: f"'{m.group()}'", plain))
            continue
        letters = DIRECTIVES.get(part[1:])
        if letters is None:
            raise DateFormatError(f"Dates with {part} in their format cannot be read.")
        touching = [p for p in (*parts[i - 1 : i], *parts[i + 1 : i + 2]) if len(p) == 2 and p[0] == "%"]
        out.append(letters * 2 if len(letters) == 1 and letters != "a" and touching else letters)
    return "".join(out)


def _parse(x: Column, pattern: str, shape: str | None) -> Column:
    if pattern == MIXED_FORMAT:
        tried = [_parse(x, p, None) for p in MIXED_PATTERNS]
        return F.coalesce(F.when(x.rlike(r"^\s*\d{4}-"), x.try_cast("timestamp_ntz")), *tried)
    parsed = F.try_to_timestamp(x, F.lit(pattern)).cast("timestamp_ntz")
    if re.search(r"(?<!y)yy(?!y)", pattern):  # 69 to 99 are of the last century
        parsed = F.when(F.year(parsed) > 2068, parsed - F.expr("INTERVAL '100' YEAR")).otherwise(parsed)
    return F.when(x.rlike(shape), parsed) if shape else parsed


def _known(fmt: str):
    """Spark pattern and shape of a strptime format or of a Spark pattern."""
    for strptime, pattern, _, shape in DATE_FORMATS:
        if fmt in (strptime, pattern):
            return pattern, shape
    return (spark_pattern(fmt) if "%" in fmt else fmt), None


def _statistics(df: DataFrame, column: str) -> DataFrame:
    """One row from one pass: values parsed per candidate (named by position)
    and the largest first and second number."""
    values = df.where(F.col(column).isNotNull()).select(F.trim(F.col(column)).alias("x"))
    parts = F.split("x", r"[/\-.]")
    part = lambda i: F.max(F.try_element_at(parts, F.lit(i)).try_cast("int"))
    return values.agg(
        *[
            F.count(_parse(F.col("x"), pattern, shape)).alias(str(i))
            for i, (_, pattern, _, shape) in enumerate(DATE_FORMATS)
        ],
        part(1).alias("max_first"),
        part(2).alias("max_second"),
    )


def _candidates() -> Column:
    """Candidates as structs that sort by score, earlier ones first among equals."""
    return F.array(
        *[
            F.struct(
                F.col(str(i)).alias("score"),
                F.lit(-i).alias("priority"),
                F.lit(fmt).alias("format"),
                F.lit(label).alias("label"),
            )
            for i, (fmt, _, label, _) in enumerate(DATE_FORMATS)
        ]
    )


def format_scores(df: DataFrame, column: str = "transaction_date") -> DataFrame:
    """Values each candidate parses: ``(ordinal, format, label, score)``.

    All candidates are counted in one pass over the whole column.
    """
    scores = _statistics(df, column).select(F.inline(_candidates()))
    return scores.select((-F.col("priority")).alias("ordinal"), "format", "label", "score")


def pick_format(scores: DataFrame) -> DataFrame:
    """The best candidate; earlier candidates win ties; no row if none parsed."""
    best = F.max_by(
        F.struct("format", "label", "score"), F.struct(F.col("score"), -F.col("ordinal"))
    )
    return scores.where("score > 0").agg(best.alias("b")).where("b IS NOT NULL").select("b.*")


def ambiguity(df: DataFrame, column: str = "transaction_date") -> DataFrame:
    """One row: the picked format and whether day and month may be swapped.

    ``is_ambiguous`` needs both numbers of all values to be at most 12;
    ``first_component_le_12`` looks at the first number only. No row if no
    candidate parsed anything. One pass over the data.
    """
    day_month = F.col("best.label").isin("US", "EU")
    low = lambda c: F.coalesce(F.col(c) <= 12, F.lit(False))
    return (
        _statistics(df, column)
        .withColumn("best", F.array_max(_candidates()))
        .where("best.score > 0")
        .select(
            "best.format",
            "best.label",
            "best.score",
            "max_first",
            "max_second",
            (day_month & low("max_first")).alias("first_component_le_12"),
            (day_month & low("max_first") & low("max_second")).alias("is_ambiguous"),
        )
    )


def detect_format(df: DataFrame, column: str = "transaction_date") -> DetectedFormat:
    """Run the detection (one small result row reaches the driver).

    If no candidate parses anything, values may still be timestamps or dates in
    words: the format is then ``mixed`` and every value is parsed by itself.
    """
    found = ambiguity(df, column).first()
    if found is None:
        if not df.where(_parse(F.col(column), MIXED_FORMAT, None).isNotNull()).limit(1).isEmpty():
            return DetectedFormat(MIXED_FORMAT, "UNKNOWN", False, False)
        raise DateFormatError(f"Could not detect a date format in {column}.")
    return DetectedFormat(
        found["format"], found["label"], found["is_ambiguous"], found["first_component_le_12"]
    )


def parse_dates(
    df: DataFrame, fmt: str, column: str = "transaction_date", into: str | None = None
) -> DataFrame:
    """Parse with one format (strptime directives or a Spark pattern); misfits become NULL."""
    pattern, shape = _known(fmt)
    return df.withColumn(into or column, _parse(F.col(column), pattern, shape))


def parse_failures(df: DataFrame, fmt: str, column: str = "transaction_date") -> DataFrame:
    """``(rows, failures, failed)``: failed when over half of all rows do not parse."""
    pattern, shape = _known(fmt)
    parsed = _parse(F.col(column), pattern, shape)
    return df.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col(column).isNotNull() & parsed.isNull()).alias("failures"),
    ).withColumn("failed", F.col("failures") > F.col("rows") * 0.5)


def check_parse(df: DataFrame, fmt: str, column: str = "transaction_date") -> int:
    """Number of failures; raises when over half of the rows fail."""
    found = parse_failures(df, fmt, column).first()
    if found["failed"]:
        raise DateFormatError(f"More than 50% of {column} could not be parsed with '{fmt}'.")
    return found["failures"]


def sample_pairs(
    df: DataFrame, fmt: str, order, column: str = "transaction_date", n: int = 5
) -> DataFrame:
    """The first ``n`` parsed values next to their raw text, for confirmation."""
    pattern, shape = _known(fmt)
    return (
        df.withColumn("parsed", _parse(F.col(column), pattern, shape))
        .where("parsed IS NOT NULL")
        .orderBy(*order)
        .limit(n)
        .select(F.col(column).alias("raw"), F.date_format("parsed", "MMMM dd, yyyy").alias("parsed"))
    )


def apply_parsed_dates(df: DataFrame, column: str = "parsed_date") -> DataFrame:
    """Replace ``transaction_date`` by a parsed column."""
    return df.withColumn("transaction_date", F.col(column)).drop(column)
