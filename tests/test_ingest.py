import pytest

from tenura import workflows
from tenura.errors import DateFormatError, InsufficientDataError, LeakageError, SchemaError
from tenura.operators import date_formats as dates
from tenura.operators import schema
from tenura.sources import file_guard, file_status, ingest_summary, require_rows, scan_csv
from tenura.sources.csv_files import malformed_rows


def write(tmp_path, text, name="upload.csv", encoding="utf-8"):
    (tmp_path / name).write_bytes(text.encode(encoding))
    return str(tmp_path)


TWO_ROWS = "customer_id,transaction_date,transaction_amount\nCUST_001,2024-01-15,99.00\nCUST_002,2024-02-01,49.00\n"


def test_two_rows_all_strings(spark, tmp_path):
    df = scan_csv(spark, write(tmp_path, TWO_ROWS))
    assert df.dtypes == [(c, "string") for c in ("customer_id", "transaction_date", "transaction_amount")]
    assert df.count() == 2
    assert schema.formula_cells(df).count() == 0


def test_null_tokens_and_quoted_line_breaks(spark, tmp_path):
    path = write(tmp_path, 'customer_id,note\nNA,"two\nlines"\nn/a,"say ""hi"""\nnone,NULL\n')
    rows = scan_csv(spark, path, ordinal="o").orderBy("o").collect()
    assert [r["customer_id"] for r in rows] == [None, None, "none"]
    assert [r["note"] for r in rows] == ["two\nlines", 'say "hi"', None]


def test_byte_order_mark_and_latin1(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    bom = write(tmp_path / "a", "﻿customer_id,product\nc1,café\n")
    legacy = write(tmp_path / "b", "customer_id,product\nc1,café\n", encoding="latin-1")
    for path in (bom, legacy):
        df = scan_csv(spark, path)
        assert df.columns == ["customer_id", "product"]
        assert df.first()["product"] == "café"


def test_columns_are_matched_by_name(spark, tmp_path):
    write(tmp_path, "customer_id,date,amount\nc1,2024-01-01,1\n", "a.csv")
    write(tmp_path, "amount,customer_id,date,country\n2,c2,2024-01-02,NL\n", "b.csv")
    for encoding in (None, "UTF-8"):
        rows = {r["customer_id"]: r for r in scan_csv(spark, str(tmp_path), encoding=encoding, ordinal="o").collect()}
        assert (rows["c1"]["date"], rows["c1"]["amount"], rows["c1"]["country"]) == ("2024-01-01", "1", None)
        assert (rows["c2"]["date"], rows["c2"]["amount"], rows["c2"]["country"]) == ("2024-01-02", "2", "NL")


def test_encoding_is_decided_per_file(spark, tmp_path):
    write(tmp_path, "customer_id,größe\nc1,café\nc2,\ufffd\n", "a.csv")
    write(tmp_path, "customer_id,größe\nc3,café\n", "b.csv", encoding="latin-1")
    rows = scan_csv(spark, str(tmp_path)).collect()
    assert {r["customer_id"]: r["größe"] for r in rows} == {"c1": "café", "c2": "\ufffd", "c3": "café"}


def test_rows_wider_than_the_header_are_found(spark, tmp_path):
    text = 'customer_id,date,amount\nc1,2024-01-01,1\nc2,2024-01-02,2,EXTRA\nc3,2024-01-03\nc4,"a,b",,more\n'
    found = malformed_rows(spark, write(tmp_path, text)).collect()
    assert sorted(r["cells"][-1] for r in found) == ["EXTRA", "more"] and len(found[0]["cells"]) == 4
    assert {r["file"] for r in found} == {"upload.csv"}
    done = workflows.ingest(spark, str(tmp_path), date_format="%Y-%m-%d")
    assert done.malformed.count() == 2 and done.files.first()["row_count"] == 4 and done.refused.count() == 0
    assert done.date_samples.first()["parsed"] == "January 01, 2024"
    with pytest.raises(SchemaError):
        workflows.ingest(spark, str(tmp_path), date_format="%Y-%m-%d", strict=True)


def test_amounts_that_are_no_numbers_are_missing(spark):
    texts = ["5", "NaN", "nan", "inf", "-inf", "Infinity", "-Infinity", "1e999", "12.5d", "1e3", None]
    df = spark.createDataFrame([("c", "2024-01-01", x) for x in texts], "customer_id string, transaction_date string, transaction_amount string")
    rows = schema.coerce_types(df).collect()
    assert [r["transaction_amount"] for r in rows] == [5.0] + [None] * 8 + [1000.0, None]


@pytest.mark.parametrize(
    ("fmt", "raw", "expected"),
    [
        ("%d %b %Y", "3 Feb 2024", "2024-02-03 00:00:00"),
        ("%Y-%m-%d %H:%M:%S", "2024-02-03 04:05:06", "2024-02-03 04:05:06"),
        ("%m/%d/%y", "2/3/24", "2024-02-03 00:00:00"),
        ("%m/%d/%y", "2/3/99", "1999-02-03 00:00:00"),
        ("%Y%m%d", "20240203", "2024-02-03 00:00:00"),
        ("%d.%m.%Y at %I:%M %p", "03.02.2024 at 4:05 PM", "2024-02-03 16:05:00"),
    ],
)
def test_any_strptime_format(spark, fmt, raw, expected):
    df = spark.createDataFrame([(raw,), ("no date",)], "transaction_date string")
    rows = [r[0] for r in dates.parse_dates(df, fmt).collect()]
    assert [str(x) for x in rows] == [expected, "None"]


def test_unknown_directives_are_refused(spark):
    df = spark.createDataFrame([("x",)], "transaction_date string")
    for fmt in ("%Q", "%Y-%U", "%"):
        with pytest.raises(DateFormatError):
            dates.parse_dates(df, fmt)


def test_header_only_is_insufficient(spark, tmp_path):
    with pytest.raises(InsufficientDataError):
        require_rows(scan_csv(spark, write(tmp_path, "customer_id,transaction_date\n")))


def test_file_guard_and_summary(spark, tmp_path):
    write(tmp_path, TWO_ROWS)
    write(tmp_path, "x", "notes.txt")
    found = {r["file"]: r["reason"] for r in file_guard(spark, str(tmp_path), max_bytes=10).collect()}
    assert found == {"notes.txt": "unsupported extension", "upload.csv": "too large"}
    status = {r["file"]: r["reason"] for r in file_status(spark, str(tmp_path)).collect()}
    assert status == {"notes.txt": "unsupported extension", "upload.csv": None}
    rows = scan_csv(spark, str(tmp_path / "upload.csv"), null_tokens=False, file="f")
    summary = ingest_summary(rows, "f").first()
    assert (summary["file_name"], summary["row_count"], summary["column_count"]) == ("upload.csv", 2, 3)
    assert summary["file_size_bytes"] == len(TWO_ROWS) and summary["malformed_count"] is None


def test_ingest_of_files_with_different_headers(spark, tmp_path):
    write(tmp_path, "customer_id,date,amount\nc1,2024-01-25,10\nc1,2024-01-26,11,more\n", "a.csv")
    write(tmp_path, "date,amount,customer_id\n2024-01-27,12,c2\n", "b.csv")
    write(tmp_path, "date,product,amount,customer_id\n2024-01-28,café,13,c3\n", "c.csv", encoding="latin-1")
    write(tmp_path, 'customer_id,product,date,amount\nc4,"two\nlines, ""so""",2024-01-29,14\n', "d.csv")
    done = workflows.ingest(spark, str(tmp_path))
    rows = sorted((r["customer_id"], str(r["transaction_date"].date()), r["transaction_amount"], r["product"])
                  for r in done.transactions.collect())
    assert rows == [
        ("c1", "2024-01-25", 10.0, None),
        ("c1", "2024-01-26", 11.0, None),
        ("c2", "2024-01-27", 12.0, None),
        ("c3", "2024-01-28", 13.0, "café"),
        ("c4", "2024-01-29", 14.0, 'two\nlines, "so"'),
    ]
    files = {r["file_name"]: (r["row_count"], r["column_count"], r["malformed_count"]) for r in done.files.collect()}
    assert files == {"a.csv": (2, 3, 1), "b.csv": (1, 3, 0), "c.csv": (1, 4, 0), "d.csv": (1, 4, 0)}
    assert done.malformed.count() == 1 and done.refused.count() == 0


def quoted_file(n):
    """CSV text with line breaks, quotes, commas and blank lines inside quoted cells, and its rows."""
    cells = ['plain', 'two\nlines', 'say ""hi""', '""\n""', 'a,b', '\n\n', 'x\ny ""\nz""', '']
    rows, lines = [], ['id,"a ""wide""\nname",end']
    for i in range(n):
        cell = cells[i * 7 % len(cells)]
        rows.append((str(i), cell.replace('""', '"') or None, f"e{i}"))
        lines.append(f'{i},"{cell}",e{i}' if i % len(cells) or cell else f"{i},{cell},e{i}")
    return "\n".join(lines) + "\n", rows


@pytest.mark.parametrize("most", [64, 200, 1000, 10_000_000])
def test_quoted_line_breaks_across_byte_ranges(spark, tmp_path, most):
    """Ranges may begin inside a cell, between two quotes or on a blank line of a cell."""
    text, expected = quoted_file(300)
    for name in ("a.csv", "b.csv"):
        paths = write(tmp_path, text, name)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    whole = spark.read.csv(paths, header=True, multiLine=True, quote='"', escape='"')
    reference = sorted(map(tuple, whole.collect()), key=str)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(most))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        found = scan_csv(spark, str(tmp_path), null_tokens=False, ordinal="o")
        assert found.columns == ["id", 'a "wide"\nname', "end", "o"]
        rows = found.orderBy("o").drop("o").collect()
        ranges = spark.read.text(paths).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert sorted(map(tuple, rows), key=str) == reference
    assert [r["id"] for r in rows] == [r[0] for r in expected] * 2
    assert [r[1] for r in rows[:300]] == [r[1] for r in expected]
    assert ranges > 5 if most < 5000 else ranges >= 1


def test_quoted_line_breaks_in_latin1(spark, tmp_path):
    path = write(tmp_path, 'id,text\n1,"caf\xe9\nau lait"\n2,th\xe9\n', encoding="latin-1")
    assert sorted(map(tuple, scan_csv(spark, path).collect())) == [("1", "café\nau lait"), ("2", "thé")]


def test_an_open_quote_at_the_end(spark, tmp_path):
    path = write(tmp_path, 'id,text\n1,a\n2,"never closed\n3,b\n')
    assert [r["id"] for r in scan_csv(spark, path, ordinal="o").orderBy("o").collect()] == ["1", "2"]


def test_profile_of_all_types(spark):
    rows = [(1, 0.0, "a", b"x", [1, 2]), (1, -0.0, None, b"x", [1, 2]), (None, float("nan"), "a", None, [2]), (3, float("nan"), "", b"", None)]
    df = spark.createDataFrame(rows, "i int, d double, s string, b binary, l array<int>")
    found = {r["column"]: tuple(r)[1:] for r in schema.column_profile(df).collect()}
    assert found == {
        "i": ("int", 3, 1, 2),
        "d": ("double", 4, 0, 2),
        "s": ("string", 3, 1, 2),
        "b": ("binary", 3, 1, 2),
        "l": ("array<int>", 3, 1, 2),
    }
    plan = schema.column_profile(df)._jdf.queryExecution().toString()
    assert "Expand" not in plan
    none = {r["column"]: tuple(r)[2:] for r in schema.column_profile(df.where("false")).collect()}
    assert set(none.values()) == {(0, 0, 0)} and len(none) == 5
    near = {r["column"]: r["distinct_count"] for r in schema.column_profile(df.select("i", "s"), approximate=True).collect()}
    assert near == {"i": 2, "s": 2}


def test_headers_and_aliases(spark):
    df = spark.createDataFrame([("a", "2024-01-01", "1")], [" Cust_ID ", "Order Date", "REVENUE"])
    assert schema.canonical_schema(df).columns == ["customer_id", "transaction_date", "transaction_amount"]


def test_canonical_name_wins_over_alias(spark):
    columns = ["customer_id", "user_id", "date", "amount"]
    assert schema.alias_mapping(columns) == {"date": "transaction_date", "amount": "transaction_amount"}


def test_two_aliases_for_one_column(spark):
    with pytest.raises(SchemaError):
        schema.alias_mapping(["cust_id", "user_id"])


@pytest.mark.parametrize("missing", ["customer_id", "transaction_date", "transaction_amount"])
def test_missing_required_column(spark, missing):
    kept = [c for c in ("customer_id", "transaction_date", "transaction_amount") if c != missing]
    with pytest.raises(SchemaError, match=missing):
        schema.require_columns(spark.createDataFrame([("a", "b")], kept))


def test_schema_report(spark):
    report = schema.schema_report(spark, ["user_id", "date", "amount", "country", "coupon"])
    found = {r["column"]: (r["status"], r["source"]) for r in report.collect()}
    assert found["customer_id"] == ("required", "user_id")
    assert found["country"] == ("optional", None)
    assert found["coupon"] == ("extra", None)
    assert found["product"] == ("missing", None)


def test_coercion(spark):
    df = spark.createDataFrame(
        [(" c1 ", "12.5", " Active "), ("nan", "not_a_number", None), ("c3", "12.5d", "x")],
        "customer_id string, transaction_amount string, subscription_status string",
    )
    rows = schema.coerce_types(df).collect()
    assert [tuple(r) for r in rows] == [("c1", 12.5, "active"), (None, None, None), ("c3", None, "x")]


@pytest.mark.parametrize("column", ["subscription_status", "is_active", "status", "churned", "churn_flag", "active"])
def test_leakage_guard(spark, column):
    with pytest.raises(LeakageError):
        schema.assert_no_leakage(spark.createDataFrame([(1, 2)], ["aov", column]))


def column(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "transaction_date string")


@pytest.mark.parametrize(
    "values, label",
    [
        (["2024-01-15", "2024-1-5"], "ISO"),
        (["2024/01/15"], "YMD_SLASH"),
        (["01/15/2024"], "US"),
        (["15/01/2024"], "EU"),
        (["15.01.2024"], "EU"),
        (["01-15-2024"], "US"),
    ],
)
def test_format_labels(spark, values, label):
    found = dates.detect_format(column(spark, *values, None))
    assert (found.label, found.is_ambiguous) == (label, False)


def test_ambiguous_dates(spark):
    found = dates.detect_format(column(spark, "01/02/2024", "03/04/2024", "05/06/2024"))
    assert (found.label, found.is_ambiguous, found.first_component_le_12) == ("US", True, True)
    settled = dates.detect_format(column(spark, "01/02/2024", "03/25/2024"))
    assert (settled.is_ambiguous, settled.first_component_le_12) == (False, True)


@pytest.mark.parametrize("fmt, month", [("%d/%m/%Y", 2), ("%m/%d/%Y", 1)])
def test_forced_format(spark, fmt, month):
    assert dates.parse_dates(column(spark, "01/02/2024"), fmt).first()[0].month == month


def test_mixed_formats(spark):
    df = column(spark, "2024-01-15 10:30:00", "Jan 5, 2024", "25/12/2023 8:15", "12/10/2023 8:15", "nonsense")
    found = dates.detect_format(df)
    assert (found.format, found.label) == ("mixed", "UNKNOWN")
    parsed = [r[0] and r[0].isoformat() for r in dates.parse_dates(df, found.format).collect()]
    assert parsed == ["2024-01-15T10:30:00", "2024-01-05T00:00:00", "2023-12-25T08:15:00", "2023-12-10T08:15:00", None]


def test_unparseable_dates(spark):
    with pytest.raises(DateFormatError):
        dates.detect_format(column(spark, *["junk"] * 10))
    good = column(spark, *["2024-01-15"] * 9, "2024-02-30")
    assert dates.check_parse(good, "%Y-%m-%d") == 1
    with pytest.raises(DateFormatError):
        dates.check_parse(good, "%d.%m.%Y")


def test_calendar_and_shape_are_checked(spark):
    df = column(spark, "2024-02-30", "24-01-01", " 2024-01-01", "2024-01-01x", "002024-01-01")
    assert [r[0] for r in dates.parse_dates(df, "%Y-%m-%d").collect()] == [None] * 5


def test_sample_pairs_stay_paired(spark):
    df = spark.createDataFrame([(1, "bad"), (2, "2024-01-05"), (3, "2024-03-01")], "k int, transaction_date string")
    pairs = dates.sample_pairs(df, "%Y-%m-%d", ["k"]).collect()
    assert [tuple(p) for p in pairs] == [("2024-01-05", "January 05, 2024"), ("2024-03-01", "March 01, 2024")]


def test_ingest_workflow(spark, tmp_path):
    text = "User_ID,Date,Amount,coupon\nc1,25/01/2024,10\nc1,25/01/2024,10\nc2,26/01/2024,=1\nc3,02/02/2024,-5\n"
    done = workflows.ingest(spark, write(tmp_path, text), as_of="2024-06-01")
    assert (done.date_format, done.ambiguous, done.parse_failures) == ("%d/%m/%Y", False, 0)
    assert done.transactions.columns == ["customer_id", "transaction_date", "transaction_amount", "coupon"]
    assert done.transactions.count() == 3
    found = {r["check"]: r["affected_count"] for r in done.quality.collect()}
    assert found == {"null_amount": 1, "negative_amount": 1, "duplicates": 1}
    assert [(r["column"], r["cells"]) for r in done.formula_cells.collect()] == [("amount", 2)]
    sources = {r["column"]: r["source"] for r in done.columns.collect() if r["source"]}
    assert sources == {"customer_id": "user_id", "transaction_date": "date", "transaction_amount": "amount"}


def test_ingest_of_latin1(spark, tmp_path):
    path = write(tmp_path, "user_id,date,amount,product\nc1,2024-01-25,10,café\n", encoding="latin-1")
    assert workflows.ingest(spark, path).transactions.first()["product"] == "café"


def test_ingest_asks_about_ambiguous_dates(spark, tmp_path):
    path = write(tmp_path, "user_id,date,amount\nc1,01/02/2024,10\n")
    with pytest.raises(DateFormatError):
        workflows.ingest(spark, path, allow_ambiguous=False)
    done = workflows.ingest(spark, path, date_format="%d/%m/%Y")
    assert done.transactions.first()["transaction_date"].month == 2
