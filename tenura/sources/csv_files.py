"""Reading uploaded CSV files: everything is a string until the schema step."""

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenura.errors import InsufficientDataError
from tenura.fixed_values import ALLOWED_EXTENSIONS, NULL_TOKENS

READABLE_EXTENSIONS = (".csv",)  # of the allowed ones; spreadsheets have to be exported first
LATIN1 = "ISO-8859-1"  # every byte is a character
SPLITTABLE = ("UTF-8", "US-ASCII", "ASCII", LATIN1, "LATIN1")  # a line end and a quote are one byte in these
FILE, PLACE = "_tenura_file", "_tenura_place"  # columns for what is known of a row's file, and for its place


def _read(spark, path, encoding, multi_line, columns=None) -> DataFrame:
    reader = spark.read
    if columns:
        reader = reader.schema(", ".join(f"`{c}` string" for c in columns))
    return reader.csv(
        path,
        header=True,
        inferSchema=False,
        multiLine=multi_line,
        encoding=encoding,
        quote='"',
        escape='"',
    )


def _lines(spark, path) -> DataFrame:
    """Every line with its file, the byte range it is read in, and a number that orders lines in a range."""
    value = F.col("value")
    quotes = F.octet_length(value) - F.octet_length(F.replace(value, F.lit('"'), F.lit("")))
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_name").alias("name"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        (quotes % 2 == 1).alias("odd"),
        "value",
    )


@dataclass(frozen=True)
class _Files:
    """Files that are read in the same way: by header, encoding and whether quoted cells hold line breaks."""

    line: str | None
    utf8: bool
    broken: bool
    paths: tuple[str, ...]


def _headers(spark, path) -> list[_Files]:
    """Files by their first line, by whether all their lines are valid UTF-8, and by lines with an odd number of quotes.

    One pass over the files; one row per file reaches the driver.
    """
    first = F.when(F.col("block") == 0, F.col("row"))
    files = _lines(spark, path).groupBy("file").agg(
        F.min_by(F.rtrim("value"), first).alias("line"),
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"),
        F.bool_or("odd").alias("broken"),
    )
    found: dict[tuple, list[str]] = {}
    for r in files.orderBy("file").collect():
        found.setdefault((r["line"], r["utf8"], r["broken"]), []).append(r["file"])
    return [_Files(*key, tuple(paths)) for key, paths in found.items()]


def _open_quotes(lines: DataFrame) -> DataFrame:
    """Per byte range: is a quoted cell open where it begins, and on which line (range, number) did its record begin?

    Each range counts its odd lines; sums over the ranges before, of which a
    file has one per read task, say whether a cell is open.
    """
    ranges = lines.groupBy("file", "block").agg(
        F.count_if("odd").alias("n"), F.max(F.when(F.col("odd"), F.col("row"))).alias("last")
    )
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.select(
        "file",
        "block",
        (F.coalesce(F.sum("n").over(before), F.lit(0)) % 2 == 1).alias("open"),
        F.last(F.when(F.col("n") > 0, F.col("block")), ignorenulls=True).over(before).alias("open_block"),
        F.last("last", ignorenulls=True).over(before).alias("open_row"),
    )


def _with_owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each line of a record that spans several the record's first line, and whether a line begins its file."""
    here, is_open, owner, first = None, False, (None, None), None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist()))
        rows, odd = batch.column("row").to_pylist(), batch.column("odd").to_pylist()
        starts = [i for i in range(len(keys)) if keys[i] != (keys[i - 1] if i else here)]
        blocks, owners, heads = [], [], []
        for i, key in enumerate(keys):
            if starts and i == starts[0]:  # another range: what is open is known from the ranges before
                starts.pop(0)
                here, first = key, rows[i]
                is_open = batch.column("open")[i].as_py()
                owner = (batch.column("open_block")[i].as_py(), batch.column("open_row")[i].as_py())
            inside = is_open
            if odd[i]:
                is_open = not is_open
                if is_open:
                    owner = (key[1], rows[i])
            several = inside or odd[i]
            blocks.append(owner[0] if several else None)
            owners.append(owner[1] if several else None)
            heads.append(key[1] == 0 and rows[i] == first)
        kept = batch.select(["file", "name", "size", "block", "row", "value"])
        for name, values, kind in (
            ("owner_block", blocks, pa.int64()),
            ("owner_row", owners, pa.int64()),
            ("head", heads, pa.bool_()),
        ):
            kept = kept.append_column(name, pa.array(values, kind))
        yield kept


def _records(spark, paths) -> DataFrame:
    """The files' records without their headers, as (file, name, size, block, row, value), by many tasks per file.

    A quote is open behind an odd number of quotes. Lines that are whole
    records stay where they are; only those of records with line breaks are
    brought together.
    """
    lines = _lines(spark, list(paths))
    # a row for each read task
    begun = lines.join(F.broadcast(_open_quotes(lines)), ["file", "block"])
    owned = begun.select(
        "file", "name", "size", "block", "row", "odd", "open", "open_block", "open_row", F.col("value").cast("binary").alias("value")
    ).mapInArrow(
        _with_owners,
        "file string, name string, size long, block long, row long, value binary, "
        "owner_block long, owner_row long, head boolean",
    )
    place = ["file", "name", "size", "block", "row"]
    single = owned.where("owner_row IS NULL AND NOT head").select(*place, "value")
    pieces = F.array_sort(F.collect_list(F.struct("block", "row", "value")))
    several = (
        owned.where("owner_row IS NOT NULL")
        .groupBy("file", "name", "size", "owner_block", "owner_row")
        .agg(pieces.alias("lines"), F.bool_or("head").alias("head"))
        .where("NOT head")
        .select(
            "file",
            "name",
            "size",
            F.col("owner_block").alias("block"),
            F.col("owner_row").alias("row"),
            F.expr(
                "aggregate(slice(lines, 2, size(lines)), lines[0].value, (a, x) -> concat(a, binary('\n'), x.value))"
            ).alias("value"),
        )
    )
    return single.unionByName(several)


def _rows(spark, files: _Files, encoding, multi_line, names=None) -> DataFrame:
    """The rows of files as strings, with ``FILE`` (path, name, size) and ``PLACE``, which orders rows as in the files."""
    paths = list(files.paths)
    several = multi_line and files.broken
    if several and encoding.upper() in SPLITTABLE:
        columns = names or _read(spark, paths, encoding, True).columns
        records = _records(spark, paths)
        text = F.col("value").cast("string") if encoding.upper() == "UTF-8" else F.decode("value", encoding)
        records = records.withColumn("value", text).where(F.trim("value") != "")
        parsed = F.from_csv("value", ", ".join(f"`{c}` string" for c in columns), {"quote": '"', "escape": '"'})
        return records.select(
            parsed.alias("cells"),
            F.struct(F.col("file").alias("path"), "name", "size").alias(FILE),
            F.struct("file", "block", "row").alias(PLACE),
        ).select("cells.*", FILE, PLACE)
    rows = _read(spark, paths, encoding, several, names)
    return rows.select(
        *[F.col(f"`{c}`") for c in rows.columns],
        F.struct(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_name").alias("name"),
            F.col("_metadata.file_size").alias("size"),
        ).alias(FILE),
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias(PLACE),
    )


def scan_csv(
    spark: SparkSession,
    path,
    *,
    encoding: str | None = None,
    multi_line: bool = True,
    null_tokens: bool = True,
    ordinal: str | None = None,
    file: str | None = None,
) -> DataFrame:
    """Read CSV files with a header row, every column as a string.

    Files may have their columns in different orders, or lack some; columns
    are those of all files. ``encoding=None`` reads each file as UTF-8, or as
    Latin-1 if any of its lines is not valid UTF-8. A first pass over the
    lines finds headers and encodings. Cells beyond the header's width
    are not read: see :func:`malformed_rows`. ``multi_line`` allows line
    breaks inside quoted cells. Files are split over tasks with or without
    such cells; only an encoding named other than UTF-8, ASCII or Latin-1
    makes a file that has them one task. ``ordinal`` names an added column
    that orders rows as they stand in the files, ``file`` one with path, name,
    size and number of columns of each row's file.
    """
    whole = None
    for files in _headers(spark, path):
        rows = _rows(spark, files, encoding or ("UTF-8" if files.utf8 else LATIN1), multi_line)
        columns = [F.col(f"`{c}`") for c in rows.columns if c not in (FILE, PLACE)]
        if file:
            facts = F.struct(f"{FILE}.*", F.lit(len(columns)).cast("long").alias("columns"))
            columns.append(facts.alias(file))
        if ordinal:
            columns.append(F.col(PLACE).alias(ordinal))
        rows = rows.select(*columns)
        whole = rows if whole is None else whole.unionByName(rows, allowMissingColumns=True)
    if whole is None:
        return _read(spark, path, encoding or "UTF-8", False)
    added = [c for c in (file, ordinal) if c]
    columns = [c for c in whole.columns if c not in added]
    whole = whole.select(*[F.col(f"`{c}`") for c in columns], *added)
    return nullify_tokens(whole, columns=columns) if null_tokens else whole


def malformed_rows(spark: SparkSession, path, *, multi_line: bool = True) -> DataFrame:
    """Rows with more cells than their header: ``(file, cells)``, up to the first cell too many.

    A pass over the files, as Latin-1.
    """
    whole = spark.createDataFrame([], "file string, cells array<string>")
    for files in _headers(spark, path):
        width = len(_read(spark, list(files.paths), LATIN1, multi_line and files.broken).columns)
        names = [f"c{i}" for i in range(width + 1)]
        rows = _rows(spark, files, LATIN1, multi_line, names).where(F.col(names[-1]).isNotNull())
        whole = whole.unionByName(rows.select(F.col(f"{FILE}.name").alias("file"), F.array(*names).alias("cells")))
    return whole


def nullify_tokens(df: DataFrame, columns=None) -> DataFrame:
    """Turn the null tokens into NULL in every string column."""
    strings = {f.name for f in df.schema.fields if f.dataType.typeName() == "string"}
    targets = strings & set(columns or df.columns)
    return df.select(
        *[
            F.when(~F.col(f"`{c}`").isin(*NULL_TOKENS), F.col(f"`{c}`")).alias(c)
            if c in targets
            else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def file_status(spark: SparkSession, path, *, max_bytes: int | None = None) -> DataFrame:
    """All files: ``(path, file, bytes, reason)``; the reason why one is not read is NULL for files that are.

    Lists the files without reading their contents.
    """
    files = (
        spark.read.format("binaryFile")
        .load(path)
        .select("path", F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"))
    )
    suffix = F.lower(F.regexp_extract("file", r"(\.[^.]*)$", 1))
    reason = F.when(~suffix.isin(*ALLOWED_EXTENSIONS), F.lit("unsupported extension")).when(
        ~suffix.isin(*READABLE_EXTENSIONS), F.lit("spreadsheet: export it as CSV")
    )
    if max_bytes is not None:
        reason = reason.when(F.col("bytes") > max_bytes, F.lit("too large"))
    return files.withColumn("reason", reason)


def file_guard(spark: SparkSession, path, *, max_bytes: int | None = None) -> DataFrame:
    """Files that are not read: ``(file, bytes, reason)``, empty when all is well."""
    return file_status(spark, path, max_bytes=max_bytes).where("reason IS NOT NULL").drop("path")


def ingest_summary(rows: DataFrame, file: str = "_file", malformed: DataFrame | None = None) -> DataFrame:
    """Per file: ``(file_path, file_name, row_count, column_count, file_size_bytes, malformed_count)``.

    ``rows`` come from :func:`scan_csv` with a ``file`` column, which may have
    passed through unions and filters since; a file without rows has no line.
    ``malformed`` is a result of :func:`malformed_rows` on the same files.
    """
    facts = F.col(file)
    summary = rows.groupBy(facts["path"].alias("file_path"), facts["name"].alias("file_name")).agg(
        F.count("*").alias("row_count"),
        F.max(facts["columns"]).alias("column_count"),
        F.max(facts["size"]).alias("file_size_bytes"),
    )
    if malformed is None:
        return summary.withColumn("malformed_count", F.lit(None).cast("long"))
    wide = malformed.groupBy(F.col("file").alias("file_name")).agg(F.count("*").alias("malformed_count"))
    return summary.join(wide, "file_name", "left").na.fill(0, ["malformed_count"])


def require_rows(df: DataFrame) -> DataFrame:
    """Raise unless there is at least one data row."""
    if df.isEmpty():
        raise InsufficientDataError("the upload has no data rows")
    return df
