"""Reading, schema, date formats and data quality."""

from pyspark.sql import functions as F

from tenura import fixed_values as fixed
from tenura.operators import date_formats as dates
from tenura.operators import quality, schema
from tenura.plans import tables as t
from tenura.plans.registry import NUDGE, query, rounded, sql_text
from tenura.session import shared_dir, store
from tenura.sources import csv_files
from tenura.sources.tables import read_table

_RAW_NAMED = (
    'cust_id AS " Cust_ID ", order_date AS "Order Date", amount AS "Amount", '
    'subscription_id AS "Subscription_ID", subscription_status AS "Subscription_Status", '
    'country AS "Country", product AS "Product"'
)


@query("scan_csv_strings", f"WITH {t.RAW} SELECT {_RAW_NAMED} FROM raw")
def scan_csv_strings(spark, folder):
    return csv_files.scan_csv(spark, t.raw_csv(spark, folder), encoding="UTF-8", null_tokens=False)


@query("scan_null_tokens", f"WITH {t.NULLED} SELECT {_RAW_NAMED} FROM nulled")
def scan_null_tokens(spark, folder):
    return csv_files.scan_csv(spark, t.raw_csv(spark, folder))


@query(
    "scan_encoding_fallback",
    f"WITH {t.NULLED} SELECT cust_id, amount, product || ' café' AS product FROM nulled",
)
def scan_encoding_fallback(spark, folder):
    path = _latin1_csv(spark, folder)
    return csv_files.scan_csv(spark, path).select("cust_id", "amount", "product")


def _latin1_csv(spark, folder) -> str:
    path = shared_dir(spark)
    accented = schema.normalise_headers(t.raw(spark, folder)).withColumn(
        "product", F.concat("product", F.lit(" café"))
    )
    accented.write.options(
        header=True, encoding="ISO-8859-1", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)
    return path


@query("scan_parquet_adapter", f"WITH {t.TX} SELECT * FROM tx")
def scan_parquet_adapter(spark, folder):
    return t.tx(spark, folder)


@query("normalise_headers", f"WITH {t.RAW} SELECT * FROM raw")
def normalise_headers(spark, folder):
    return schema.normalise_headers(t.raw(spark, folder))


# Uploads of several files: orders by status and year, with their columns in three orders. The third
# kind has a column more, whose cells hold quotes and a line break; the last kind is no CSV.
_NOTE = 'on "hold"\nuntil called'
_KINDS = {
    "F": ("customer_id", "date", "amount"),
    "O": ("date", "amount", "customer_id"),
    "P": ("customer_id", "note", "date", "amount"),
}


def _uploads(spark, folder) -> str:
    """Writes the files, one for each kind and year; returns their folder."""
    path = shared_dir(spark)
    orders = read_table(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("amount"),
        F.lit(_NOTE).alias("note"),
        F.year("o_orderdate").alias("year"),
        "o_orderstatus",
    )
    orders = store(orders.repartition("year"))
    for kind, columns in _KINDS.items():
        own = orders.where(F.col("o_orderstatus") == kind).select(*columns, "year").repartition("year")
        own.write.partitionBy("year").options(header=True, escape='"').csv(f"{path}/{kind}")
    lines = orders.select(F.concat_ws(";", "customer_id", "date").alias("value"), "year").repartition("year")
    lines.write.partitionBy("year").text(f"{path}/T")
    return path


_ROW = f"len(customer_id) + len(amount) + 13 + CASE WHEN kind = 'P' THEN {len(_NOTE) + 5} ELSE 0 END"
_UPLOADS = f"""
uploads AS (
  SELECT o_orderstatus AS kind, CAST(year(o_orderdate) AS VARCHAR) AS year, CAST(o_custkey AS VARCHAR) AS customer_id,
         CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS amount FROM orders),
files AS (
  SELECT kind, year, count(*) AS row_count, CASE WHEN kind = 'P' THEN 4 ELSE 3 END AS column_count,
         CASE WHEN kind = 'P' THEN 29 ELSE 24 END + sum({_ROW}) AS bytes
  FROM uploads WHERE kind IN ('F', 'O', 'P') GROUP BY kind, year)"""


def _by_folder(df, path: str):
    """The kind and year of each file, from its folder."""
    part = lambda i: F.regexp_extract(path, "/([FOPT])/year=([0-9]+)/", i)
    return df.withColumns({"kind": part(1), "year": part(2)})


@query(
    "file_guard",
    f"""WITH {_UPLOADS} SELECT kind, year, CAST(bytes AS BIGINT) AS bytes, NULL AS reason FROM files
    UNION ALL SELECT 'T', year, CAST(sum(len(customer_id) + 12) AS BIGINT), 'unsupported extension' FROM uploads GROUP BY year""",
)
def file_guard(spark, folder):
    """A row per file: those of a table written as CSV are read, those written as plain text are refused."""
    status = csv_files.file_status(spark, f"{_uploads(spark, folder)}/*/year=*")
    return _by_folder(status, "path").select("kind", "year", "bytes", "reason")


@query(
    "ingest_summary",
    f"""WITH {_UPLOADS} SELECT kind, year, CAST(row_count AS BIGINT) AS row_count, CAST(column_count AS BIGINT) AS column_count,
    CAST(bytes AS BIGINT) AS file_size_bytes, CAST(0 AS BIGINT) AS malformed_count FROM files""",
)
def ingest_summary(spark, folder):
    """A row per file of one upload whose files have their columns in different orders."""
    root = _uploads(spark, folder)
    paths = [f"{root}/{kind}/year=*" for kind in _KINDS]
    rows = csv_files.scan_csv(spark, paths, file="_file")
    found = csv_files.ingest_summary(rows, "_file", csv_files.malformed_rows(spark, paths))
    return _by_folder(found, "file_path").drop("file_path", "file_name")


@query(
    "scan_csv_mixed_files",
    """SELECT CAST(o_custkey AS VARCHAR) AS customer_id, strftime(o_orderdate, '%Y-%m-%d') AS date,
    CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS amount,
    CASE WHEN o_orderstatus = 'P' THEN 'on "hold"' || chr(10) || 'until called' END AS note
    FROM orders WHERE o_orderstatus IN ('F', 'O', 'P')""",
)
def scan_csv_mixed_files(spark, folder):
    """Columns are matched by name; a column that some files lack is NULL there; cells keep their line breaks."""
    root = _uploads(spark, folder)
    return csv_files.scan_csv(spark, [f"{root}/{kind}/year=*" for kind in _KINDS])


@query("min_rows_guard", f"WITH {t.RAW} SELECT CAST(count(*) AS BIGINT) AS row_count FROM raw")
def min_rows_guard(spark, folder):
    return csv_files.require_rows(t.raw(spark, folder)).agg(F.count("*").alias("row_count"))


_WARNING = sql_text(fixed.INJECTION_WARNING, column='"column"', n="CAST(cells AS VARCHAR)")


@query(
    "formula_injection_scan",
    f"""WITH {t.NULLED},
    cells AS (SELECT unnest(['cust_id', 'order_date', 'amount', 'subscription_id',
                             'subscription_status', 'country', 'product']) AS "column",
                     unnest([cust_id, order_date, amount, subscription_id,
                             subscription_status, country, product]) AS cell FROM nulled),
    found AS (SELECT "column", count(*) AS cells FROM cells
              WHERE cell[1] IN ('=', '+', '-', '@', '|', chr(9), chr(13)) GROUP BY 1)
    SELECT "column", CAST(cells AS BIGINT) AS cells, {_WARNING} AS warning FROM found""",
)
def formula_injection_scan(spark, folder):
    cells = csv_files.nullify_tokens(schema.normalise_headers(t.raw(spark, folder)))
    return schema.formula_cells(cells)


@query(
    "schema_alias_map",
    f"""WITH {t.RAW} SELECT cust_id AS customer_id, order_date AS transaction_date,
    amount AS transaction_amount, subscription_id, subscription_status, country, product FROM raw""",
)
def schema_alias_map(spark, folder):
    named = schema.normalise_headers(t.raw(spark, folder))
    return schema.require_columns(schema.apply_aliases(named))


@query(
    "schema_required",
    f"""WITH {t.RAW} SELECT cust_id AS customer_id, order_date AS transaction_date,
    amount AS transaction_amount FROM raw""",
)
def schema_required(spark, folder):
    named = schema.apply_aliases(schema.normalise_headers(t.raw(spark, folder)))
    return schema.require_columns(named).select(*fixed.REQUIRED_COLUMNS)


@query("coerce_types", f"WITH {t.CANONICAL} SELECT * FROM canonical")
def coerce_types(spark, folder):
    return t.canonical(spark, folder)


@query(
    "feature_projection",
    f"""WITH {t.TX_CUSTOMERS} SELECT customer_id, recency_days, frequency,
    round(monetary_total, 2) AS monetary_total, round(aov + {NUDGE}, 4) AS aov, tenure_days,
    round(tx_per_month + {NUDGE}, 4) AS tx_per_month, round(gap_std_days, 4) AS gap_std_days FROM feats""",
)
def feature_projection(spark, folder):
    features = schema.feature_projection(t.customers(spark, folder))
    return rounded(features.withColumn("monetary_total", F.round("monetary_total", 2)), ratios=("aov", "tx_per_month"))


@query(
    "leakage_guard",
    f"WITH {t.TX_CUSTOMERS} SELECT CAST(count(*) AS BIGINT) AS customers, CAST(7 AS INTEGER) AS features FROM feats",
)
def leakage_guard(spark, folder):
    guarded = schema.assert_no_leakage(schema.feature_projection(t.customers(spark, folder)))
    return guarded.agg(F.count("*").alias("customers")).withColumn(
        "features", F.lit(len(guarded.columns) - 1)
    )


_PROFILED = {
    "customer_id": "string",
    "transaction_date": "timestamp_ntz",
    "transaction_amount": "double",
    "subscription_id": "string",
    "subscription_status": "string",
    "country": "string",
    "product": "string",
}


@query(
    "column_profile",
    f"WITH {t.PARSED} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{kind}' AS "type", CAST(count({c}) AS BIGINT) AS non_null,
        CAST(count(*) - count({c}) AS BIGINT) AS null_count,
        CAST(count(DISTINCT {c}) AS BIGINT) AS distinct_count FROM parsed"""
        for c, kind in _PROFILED.items()
    ),
)
def column_profile(spark, folder):
    return schema.column_profile(t.parsed(spark, folder))


@query(
    "preview",
    f"WITH {t.TX} SELECT * FROM tx ORDER BY transaction_date, CAST(subscription_id AS BIGINT) LIMIT 100",
)
def preview(spark, folder):
    order = ["transaction_date", F.col("subscription_id").cast("long")]
    return schema.preview(t.tx(spark, folder), order)


@query(
    "head_rows",
    f"""WITH {t.TX} SELECT subscription_id, transaction_date FROM tx
    ORDER BY transaction_date, CAST(subscription_id AS BIGINT) LIMIT 200""",
)
def head_rows(spark, folder):
    order = ["transaction_date", F.col("subscription_id").cast("long")]
    return schema.preview(t.tx(spark, folder), order, 200).select("subscription_id", "transaction_date")


# --- Date formats ----------------------------------------------------------------------


def _shape(regex: str) -> str:
    return regex.strip("^$")


def _scores_sql(source: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT {i} AS ordinal, '{fmt}' AS format, '{label}' AS label,
        CAST(count(CASE WHEN regexp_full_match(trim(transaction_date), '{_shape(shape)}')
                        THEN try_strptime(trim(transaction_date), '{fmt}') END) AS BIGINT) AS score
        FROM {source}"""
        for i, (fmt, _, label, shape) in enumerate(fixed.DATE_FORMATS)
    )


@query("date_format_scores", f"WITH {t.CANONICAL} {_scores_sql('canonical')}")
def date_format_scores(spark, folder):
    return dates.format_scores(t.canonical(spark, folder))


@query(
    "date_format_pick",
    f"""WITH {t.CANONICAL}, scores AS ({_scores_sql('canonical')})
    SELECT format, label, score FROM scores WHERE score > 0 ORDER BY score DESC, ordinal LIMIT 1""",
)
def date_format_pick(spark, folder):
    return dates.pick_format(dates.format_scores(t.canonical(spark, folder)))


def _as_text(spark, folder, pattern):
    tx = t.tx(spark, folder)
    return tx.withColumn("transaction_date", F.date_format("transaction_date", pattern))


def _ambiguity_sql(style: str, variant: str) -> str:
    return f"""
    {variant}_text AS (SELECT strftime(transaction_date, '{style}') AS transaction_date FROM tx),
    {variant}_scores AS ({_scores_sql(variant + '_text')}),
    {variant}_pick AS (SELECT * FROM {variant}_scores WHERE score > 0 ORDER BY score DESC, ordinal LIMIT 1),
    {variant}_range AS (
      SELECT max(try_cast(regexp_split_to_array(transaction_date, '[/\\-.]')[1] AS INTEGER)) AS max_first,
             max(try_cast(regexp_split_to_array(transaction_date, '[/\\-.]')[2] AS INTEGER)) AS max_second
      FROM {variant}_text),
    {variant} AS (
      SELECT '{variant}' AS variant, format, label, score, max_first, max_second,
             label IN ('US', 'EU') AND max_first <= 12 AS first_component_le_12,
             label IN ('US', 'EU') AND max_first <= 12 AND max_second <= 12 AS is_ambiguous
      FROM {variant}_pick, {variant}_range)"""


@query(
    "date_ambiguity",
    f"""WITH {t.TX}, {_ambiguity_sql('%m/%d/%Y', 'month_first')}, {_ambiguity_sql('%d.%m.%Y', 'day_first')},
    {_ambiguity_sql('%m-01-%Y', 'month_only')}
    SELECT * FROM month_first UNION ALL SELECT * FROM day_first UNION ALL SELECT * FROM month_only""",
)
def date_ambiguity(spark, folder):
    variants = {"month_first": "MM/dd/yyyy", "day_first": "dd.MM.yyyy", "month_only": "MM-'01'-yyyy"}
    found = [
        dates.ambiguity(_as_text(spark, folder, pattern)).select(F.lit(name).alias("variant"), "*")
        for name, pattern in variants.items()
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("date_parse", f"WITH {t.PARSED} SELECT subscription_id, transaction_date FROM parsed")
def date_parse(spark, folder):
    raw = t.canonical(spark, folder)
    detected = dates.detect_format(raw)
    return dates.parse_dates(raw, detected.format).select("subscription_id", "transaction_date")


@query(
    "date_parse_mixed",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN date_trunc('second', ts)
    WHEN 1 THEN date_trunc('minute', ts) ELSE date_trunc('day', ts) END AS transaction_date FROM events""",
)
def date_parse_mixed(spark, folder):
    """Event times written in three ways, none of them a plain date."""
    k = F.col("event_id") % 3
    written = (
        F.when(k == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(k == 1, F.date_format("ts", "MM/dd/yyyy HH:mm"))
        .otherwise(F.date_format("ts", "MMMM d, yyyy"))
    )
    events = read_table(spark, folder, "events")
    named = events.select("event_id", written.alias("transaction_date"))
    return dates.parse_dates(named, dates.detect_format(named).format)


@query(
    "date_parse_failures",
    f"""WITH {t.PARSED}, n AS (
      SELECT count(*) AS rows, (SELECT count(transaction_date) FROM canonical) - count(transaction_date) AS failures
      FROM parsed)
    SELECT CAST(rows AS BIGINT) AS rows, CAST(failures AS BIGINT) AS failures, failures > rows * 0.5 AS failed FROM n""",
)
def date_parse_failures(spark, folder):
    return dates.parse_failures(t.canonical(spark, folder), "%Y-%m-%d")



@query(
    "date_sample_pairs",
    f"""WITH {t.CANONICAL}, both_forms AS (
      SELECT transaction_date AS raw, CAST(subscription_id AS BIGINT) AS k,
             CASE WHEN regexp_full_match(transaction_date, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}')
                  THEN try_strptime(transaction_date, '%Y-%m-%d') END AS d FROM canonical)
    SELECT raw, strftime(d, '%B %d, %Y') AS parsed FROM both_forms WHERE d IS NOT NULL ORDER BY k LIMIT 5""",
)
def date_sample_pairs(spark, folder):
    order = [F.col("subscription_id").cast("long")]
    return dates.sample_pairs(t.canonical(spark, folder), "%Y-%m-%d", order)


@query("apply_parsed_dates", f"WITH {t.PARSED} SELECT * FROM parsed")
def apply_parsed_dates(spark, folder):
    both = dates.parse_dates(t.canonical(spark, folder), "%Y-%m-%d", into="parsed_date")
    return dates.apply_parsed_dates(both)


# --- Data quality ------------------------------------------------------------------------

AS_OF = "2001-08-02"

_RULES = {
    "null_customer": "customer_id IS NULL OR customer_id = ''",
    "null_date": "transaction_date IS NULL",
    "null_amount": "transaction_amount IS NULL",
    "negative_amount": "transaction_amount < 0",
    "future_date": f"transaction_date > DATE '{AS_OF}' + INTERVAL 1 DAY",
    "zero_amount": "transaction_amount = 0",
}

_DUPLICATES = """
copies AS (SELECT row_number() OVER (PARTITION BY customer_id, transaction_date, transaction_amount) AS nth FROM parsed)"""

for _name, _rule in _RULES.items():
    _key = {"null_customer": "dq_null_customer"}.get(_name, f"dq_{_name}")

    @query(
        _key,
        f"""WITH {t.PARSED} SELECT CAST(count(*) AS BIGINT) AS rows,
        CAST(count(CASE WHEN {_rule} THEN 1 END) AS BIGINT) AS affected_count FROM parsed""",
    )
    def _finding(spark, folder, name=_name):
        return quality.finding_count(t.parsed(spark, folder), name, AS_OF)


@query(
    "dq_duplicates",
    f"""WITH {t.PARSED}, {_DUPLICATES} SELECT CAST(count(*) AS BIGINT) AS rows,
    CAST(count(CASE WHEN nth > 1 THEN 1 END) AS BIGINT) AS affected_count FROM copies""",
)
def dq_duplicates(spark, folder):
    return quality.finding_count(t.parsed(spark, folder), "duplicates", AS_OF)


def _report_sql() -> str:
    counts = ", ".join(
        f"(SELECT count(*) FROM parsed WHERE {rule}) AS {name}" for name, rule in _RULES.items()
    )
    rows = []
    for i, (name, (severity, category, message)) in enumerate(fixed.QUALITY_FINDINGS.items()):
        pct = f"{name} * 100.0 / rows"
        shown = sql_text(message, n=f"format('{{:,}}', {name})", pct=f"format('{{:.1f}}', {pct})")
        level = f"CASE WHEN {pct} > 5.0 THEN 'error' ELSE 'warning' END" if name == "duplicates" else f"'{severity}'"
        examples = {
            "negative_amount": """(SELECT string_agg(v, '; ' ORDER BY a) FROM (
               SELECT transaction_amount AS a, CAST(transaction_amount AS VARCHAR) AS v FROM parsed
               WHERE transaction_amount < 0 ORDER BY a LIMIT 3))""",
            "future_date": f"""(SELECT string_agg(strftime(d, '%Y-%m-%d'), '; ' ORDER BY d) FROM (
               SELECT transaction_date AS d FROM parsed WHERE {_RULES['future_date']} ORDER BY d LIMIT 3))""",
        }.get(name, "''")
        rows.append(
            f"""SELECT {i} AS ordinal, {level} AS severity, '{category}' AS category, '{name}' AS "check",
            {shown} AS message, CAST({name} AS BIGINT) AS affected_count, round({pct}, 2) AS affected_pct,
            {examples} AS example_values FROM counts WHERE {name} > 0"""
        )
    return f"""{t.PARSED}, {_DUPLICATES},
    counts AS (SELECT (SELECT count(*) FROM parsed) AS rows,
                      (SELECT count(*) FROM copies WHERE nth > 1) AS duplicates, {counts}),
    report AS ({' UNION ALL '.join(rows)})"""


@query("dq_report", f"WITH {_report_sql()} SELECT * FROM report")
def dq_report(spark, folder):
    report = quality.quality_report(t.parsed(spark, folder), AS_OF)
    return report.withColumn("example_values", F.concat_ws("; ", "example_values"))


@query(
    "dq_summary",
    f"""WITH {_report_sql()}, totals AS (
      SELECT count(CASE WHEN severity = 'error' THEN 1 END) AS errors,
             count(CASE WHEN severity = 'warning' THEN 1 END) AS warnings,
             coalesce(sum(CASE WHEN severity = 'error' THEN affected_count END), 0) AS error_count,
             (SELECT count(*) FROM parsed) AS total_rows FROM report)
    SELECT CAST(errors AS BIGINT) AS errors, CAST(warnings AS BIGINT) AS warnings,
           CAST(error_count AS BIGINT) AS error_count, CAST(total_rows AS BIGINT) AS total_rows,
           errors = 0 AS passed,
           CASE WHEN errors > 0 THEN {sql_text(fixed.QUALITY_FAILED, errors="CAST(errors AS VARCHAR)")}
                WHEN warnings > 0 THEN {sql_text(fixed.QUALITY_PASSED_WARNINGS, rows="format('{:,}', total_rows)",
                                                 warnings="CAST(warnings AS VARCHAR)")}
                ELSE {sql_text(fixed.QUALITY_PASSED, rows="format('{:,}', total_rows)")} END AS summary
    FROM totals""",
)
def dq_summary(spark, folder):
    return quality.quality_summary(t.parsed(spark, folder), AS_OF)


@query(
    "dedup_transactions",
    f"""WITH {t.PARSED}, ranked AS (
      SELECT *, row_number() OVER (PARTITION BY customer_id, transaction_date, transaction_amount
                                   ORDER BY subscription_id) AS nth FROM parsed)
    SELECT * EXCLUDE (nth) FROM ranked WHERE nth = 1""",
)
def dedup_transactions(spark, folder):
    return quality.dedup_transactions(t.parsed(spark, folder), "subscription_id")
