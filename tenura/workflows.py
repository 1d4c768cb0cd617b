"""The two end-to-end jobs: cleaning an upload and studying its customers."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.errors import DateFormatError, SchemaError
from tenura.operators import briefing, date_formats, explain, kpis, quality, schema, scoring, segments, survival
from tenura.operators import customers as cust
from tenura.operators.forecast import as_series
from tenura.operators.model import ChurnModel, train_model
from tenura.session import ensure_utc, store
from tenura.sources import file_guard, ingest_summary, require_rows, scan_csv
from tenura.sources.csv_files import malformed_rows


@dataclass
class Ingested:
    """Clean transactions and what was found on the way."""

    transactions: DataFrame
    columns: DataFrame
    formula_cells: DataFrame
    date_format: str
    ambiguous: bool
    parse_failures: int
    quality: DataFrame
    malformed: DataFrame
    date_samples: DataFrame
    files: DataFrame
    refused: DataFrame


def ingest(
    spark: SparkSession,
    path,
    *,
    date_format: str | None = None,
    allow_ambiguous: bool = True,
    as_of=None,
    strict: bool = False,
    **scan,
) -> Ingested:
    """Read, normalise, parse, check and deduplicate CSV files.

    The text is read once and stored as it is, and once more with its types:
    what follows reads those columns only, with filters pushed down.
    With ``allow_ambiguous=False`` a file whose days and months cannot be told
    apart is refused until ``date_format`` is given; ``date_samples`` shows
    what the format makes of some dates. ``malformed`` has the rows with cells
    beyond the header, ``files`` the rows, columns, bytes and such rows per file and ``refused``
    the files that are no CSV. ``strict`` refuses files with such rows or with
    blocking quality findings.
    """
    ensure_utc(spark)
    malformed = malformed_rows(spark, path, multi_line=scan.get("multi_line", True))
    if strict and not malformed.isEmpty():
        raise SchemaError("some rows have more cells than the header")
    scanned = scan_csv(spark, path, ordinal="_ordinal", file="_file", **scan)
    raw = store(schema.normalise_headers(scanned))
    require_rows(raw)
    cells = raw.drop("_ordinal", "_file")
    text = schema.canonical_schema(raw.drop("_file"))
    ambiguous = False
    if date_format is None:
        found = date_formats.detect_format(text)
        date_format, ambiguous = found.format, found.is_ambiguous
        if ambiguous and not allow_ambiguous:
            raise DateFormatError("dates fit day-first and month-first; pass date_format to confirm")
    failures = date_formats.check_parse(text, date_format)
    parsed = store(date_formats.parse_dates(text, date_format))
    report = quality.check_quality(parsed, as_of, strict=strict)
    clean = store(quality.dedup_transactions(parsed, "_ordinal").drop("_ordinal"))
    return Ingested(
        transactions=clean,
        columns=schema.schema_report(spark, cells.columns),
        formula_cells=schema.formula_cells(cells),
        date_format=date_format,
        ambiguous=ambiguous,
        parse_failures=failures,
        quality=report,
        malformed=malformed,
        date_samples=date_formats.sample_pairs(text, date_format, ["_ordinal"]),
        files=ingest_summary(raw, "_file", malformed),
        refused=file_guard(spark, path),
    )


@dataclass
class Study:
    """Trained model and the tables that follow from it."""

    customers: DataFrame
    split: DataFrame
    model: ChurnModel
    metrics: DataFrame
    roc: DataFrame
    importance: DataFrame
    predictions: DataFrame
    clv: DataFrame
    segments: DataFrame


def study(
    tx: DataFrame,
    *,
    churn_window_days: int = 90,
    reference=None,
    max_explained: int | None = None,
    **training,
) -> Study:
    """Features, temporal split, training, evaluation, explanation, CLV, segments.

    Customers, the split and the predictions are stored, since several
    results read them; transactions are read once.
    """
    ensure_utc(tx.sparkSession)
    customers = store(
        cust.customer_table(tx, churn_window_days=churn_window_days, reference=reference)
    )
    split = store(cust.temporal_split(cust.feature_matrix(customers)))
    model = train_model(split.where("split = 'train'"), **training)
    scored = store(model.score(split))
    test = scored.where("split = 'test'")
    judged = test.select("customer_id", F.col("is_churned").alias("label"), "churn_probability")
    outcomes = scoring.stored_outcomes(judged)
    predictions = scored.select("customer_id", "churn_probability")
    shap = explain.shap_values(model, split.where("split = 'test'"), max_samples=max_explained)
    return Study(
        customers=customers,
        split=split,
        model=model,
        metrics=scoring.evaluate(judged, model.n_train, outcomes),
        roc=scoring.roc_points(judged, outcomes),
        importance=store(explain.shap_importance(shap, model.features)),
        predictions=predictions,
        clv=survival.clv_per_customer(customers),
        segments=segments.segment_customers(customers, predictions),
    )


def brief(tx: DataFrame, *, study: Study | None = None, forecast: DataFrame | None = None) -> DataFrame:
    """One row with the written briefing: six sections and how they were made.

    Without a study the sections on segments, lifetime value and the model use
    their wording without them; ``forecast`` is a result of
    :func:`tenura.operators.forecast.forecast` on the same transactions.
    """
    ensure_utc(tx.sparkSession)
    monthly = store(kpis.monthly_kpis(tx))
    customers = store(cust.customer_table(tx)) if study is None else study.customers
    given = {}
    if study is not None:
        given = {
            "segments": briefing.segment_counts(study.segments),
            "top_clv": survival.clv_quantile(study.clv),
            "importance": briefing.top_two_features(study.importance),
            "metrics": study.metrics,
        }
    if forecast is not None:
        given["forecast"] = briefing.forecast_facts(as_series(monthly), forecast)
    facts = briefing.briefing_facts(
        snapshot=kpis.kpi_snapshot(tx, monthly),
        trend=kpis.revenue_trend(monthly),
        churn=cust.churn_summary(customers),
        behaviour=cust.rfm_summary(customers),
        **given,
    )
    return briefing.briefing_report(facts)
