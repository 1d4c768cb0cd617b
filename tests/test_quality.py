import pytest
from pyspark.sql import functions as F

from tenura.errors import InsufficientDataError
from tenura.operators import quality

AS_OF = "2024-06-01"


def base(n=20):
    return [(f"C{i}", f"2024-01-{i + 1:02d}", 99.0) for i in range(n)]


def report(make_tx, rows):
    return {r["check"]: r for r in quality.quality_report(make_tx(rows), AS_OF).collect()}


def test_clean_table_passes(make_tx):
    df = make_tx(base())
    assert quality.quality_report(df, AS_OF).count() == 0
    summary = quality.quality_summary(df, AS_OF).first()
    assert summary["passed"] and summary["summary"] == "✅ 20 rows passed quality checks."


@pytest.mark.parametrize(
    "row, check, severity",
    [
        ((None, "2024-02-01", 1.0), "null_customer", "error"),
        (("", "2024-02-01", 1.0), "null_customer", "error"),
        (("X", None, 1.0), "null_date", "error"),
        (("X", "2024-02-01", None), "null_amount", "warning"),
        (("X", "2024-02-01", -50.0), "negative_amount", "warning"),
        (("X", "2024-07-01", 1.0), "future_date", "error"),
        (("X", "2024-02-01", 0.0), "zero_amount", "info"),
        (("C0", "2024-01-01", 99.0), "duplicates", "warning"),
    ],
)
def test_single_finding(make_tx, row, check, severity):
    found = report(make_tx, base() + [row])
    assert list(found) == [check]
    assert (found[check]["severity"], found[check]["affected_count"]) == (severity, 1)
    assert found[check]["affected_pct"] == 4.76


def test_many_duplicates_are_an_error(make_tx):
    found = report(make_tx, base() + base(2))
    assert found["duplicates"]["severity"] == "error"
    assert "(9.1% of total)" in found["duplicates"]["message"]


def test_examples_and_tomorrow(make_tx):
    rows = base() + [("X", "2024-02-01", float(-v)) for v in (5, 7, 9, 11)] + [("Y", "2024-06-02", 1.0)]
    found = report(make_tx, rows)
    assert found["negative_amount"]["example_values"] == ["-11.0", "-9.0", "-7.0"]
    assert "future_date" not in found


def test_summary_and_strict(make_tx):
    df = make_tx(base() + [(None, "2024-02-01", 1.0), ("X", "2024-02-01", -1.0)])
    summary = quality.quality_summary(df, AS_OF).first()
    assert (summary["passed"], summary["errors"], summary["warnings"], summary["error_count"]) == (False, 1, 1, 1)
    with pytest.raises(InsufficientDataError):
        quality.check_quality(df, AS_OF, strict=True)


def test_dedup_keeps_the_first_row(make_tx):
    rows = [("a", "2024-01-01", 1.0), ("a", "2024-01-01", 1.0), ("a", "2024-01-01", 2.0), (None, None, None), (None, None, None)]
    df = make_tx(rows).coalesce(1).withColumn("nr", F.monotonically_increasing_id()).withColumn("note", F.col("nr") * 10)
    kept = quality.dedup_transactions(df, "nr")
    assert sorted(r["nr"] for r in kept.collect()) == [0, 2, 3]
    assert all(r["note"] == r["nr"] * 10 for r in kept.collect())
    assert quality.dedup_transactions(make_tx(rows)).count() == 3
