"""Transaction tables the queries start from, in Spark and in SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.operators import customers as cust
from tenura.operators.schema import canonical_schema
from tenura.operators.date_formats import parse_dates
from tenura.session import shared_dir, store
from tenura.sources import events_as_transactions, nullify_tokens, orders_as_transactions
from tenura.sources.tables import read_table

# --- Clean transactions: one per order ------------------------------------------------


def tx(spark: SparkSession, folder: str) -> DataFrame:
    return orders_as_transactions(spark, folder)


def tx_dimensions(spark: SparkSession, folder: str) -> DataFrame:
    return orders_as_transactions(spark, folder, dimensions=True)


def events(spark: SparkSession, folder: str) -> DataFrame:
    return events_as_transactions(spark, folder)


def customers(spark: SparkSession, folder: str) -> DataFrame:
    """For results that read the customer table once."""
    return cust.customer_table(tx(spark, folder))


def stored_customers(spark: SparkSession, folder: str) -> DataFrame:
    """For results that read it several times."""
    return store(customers(spark, folder))


TX = """
tx AS (
  SELECT CAST(o_custkey AS VARCHAR) AS customer_id, o_orderdate AS transaction_date,
         o_totalprice AS transaction_amount, CAST(o_orderkey AS VARCHAR) AS subscription_id,
         o_orderstatus AS subscription_status
  FROM orders)"""

EVENTS = """
tx AS (
  SELECT CAST(user_id AS VARCHAR) AS customer_id, ts AS transaction_date,
         value AS transaction_amount
  FROM events)"""

TX_DIMENSIONS = """
tx AS (
  SELECT CAST(o_custkey AS VARCHAR) AS customer_id, o_orderdate AS transaction_date,
         o_totalprice AS transaction_amount, c_mktsegment AS product, n_name AS country
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
              LEFT JOIN nation ON c_nationkey = n_nationkey)"""

# Row by row: every gap is taken between two transactions.
CUSTOMERS = """
gaps AS (
  SELECT *, CAST(floor((epoch_us(transaction_date) - epoch_us(lag(transaction_date) OVER (
      PARTITION BY customer_id ORDER BY transaction_date))) / 86400000000.0) AS BIGINT) AS gap
  FROM tx),
cust AS (
  SELECT customer_id, max(transaction_date) AS last_tx_date, min(transaction_date) AS first_tx_date,
         count(transaction_date) AS frequency, coalesce(sum(transaction_amount), 0) AS monetary_total,
         coalesce(stddev_samp(gap), 0) AS gap_std_days
  FROM gaps WHERE customer_id IS NOT NULL GROUP BY customer_id),
days AS (
  SELECT *, CAST(floor((epoch_us((SELECT max(transaction_date) FROM tx)) - epoch_us(last_tx_date))
           / 86400000000.0) AS BIGINT) AS recency_days,
         greatest(CAST(floor((epoch_us(last_tx_date) - epoch_us(first_tx_date))
           / 86400000000.0) AS BIGINT), 1) AS tenure_days
  FROM cust),
feats AS (
  SELECT customer_id, recency_days, frequency, monetary_total,
         monetary_total / frequency AS aov, tenure_days,
         frequency / greatest(tenure_days / 30.44, 1) AS tx_per_month, gap_std_days,
         recency_days > 90 AS is_churned, first_tx_date, last_tx_date
  FROM days),
scored AS (
  SELECT *, least(greatest(recency_days / greatest((SELECT max(recency_days) FROM feats), 1), 0), 1)
         AS churn_probability
  FROM feats)"""

TX_CUSTOMERS = TX + "," + CUSTOMERS

# --- Raw uploads: every column text, with the usual defects ----------------------------------

RAW_COLUMNS = (
    " Cust_ID ",
    "Order Date",
    "Amount",
    "Subscription_ID",
    "Subscription_Status",
    "Country",
    "Product",
)


def raw(spark: SparkSession, folder: str) -> DataFrame:
    """All orders as an upload would bring them.

    By order number some cells are blank, padded, malformed, negative, in
    another date format or start like a formula, and one order in a hundred
    appears twice.
    """
    orders = read_table(spark, folder, "orders")
    owners = read_table(spark, folder, "customer").join(
        read_table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left"
    )
    k = F.col("o_orderkey") % 100
    key = F.col("o_custkey").cast("string")
    money = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    day = lambda pattern: F.date_format("o_orderdate", pattern)
    joined = orders.join(owners, F.col("o_custkey") == F.col("c_custkey"), "left")
    cells = [
        F.when(k == 3, None)
        .when(k == 4, "NULL")
        .when(k == 5, F.concat(F.lit(" "), key, F.lit(" ")))
        .when(k == 6, F.concat(F.lit("=SUM("), key, F.lit(")")))
        .when(k == 7, "N/A")
        .otherwise(key),
        F.when(k == 11, "not-a-date")
        .when(k == 12, None)
        .when(k == 13, day("MM/dd/yyyy"))
        .when(k == 14, "2999-12-31")
        .otherwise(day("yyyy-MM-dd")),
        F.when(k == 21, F.concat(F.lit("-"), money))
        .when(k == 22, "0")
        .when(k == 23, "abc")
        .when(k == 24, None)
        .otherwise(money),
        F.col("o_orderkey").cast("string"),
        F.when(k == 31, F.concat(F.lit(" "), "o_orderstatus")).otherwise(F.col("o_orderstatus")),
        F.when(k == 41, "n/a").otherwise(F.col("n_name")),
        F.when(k == 42, F.concat(F.lit("@"), "c_mktsegment")).otherwise(F.col("c_mktsegment")),
    ]
    copies = F.when(k == 50, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    named = [cell.alias(name) for cell, name in zip(cells, RAW_COLUMNS)]
    return joined.select(*named, F.explode(copies).alias("copy")).drop("copy")


def raw_csv(spark: SparkSession, folder: str, **options) -> str:
    """The raw upload written as CSV files; returns their folder."""
    path = shared_dir(spark)
    raw(spark, folder).write.options(
        header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, **options
    ).csv(path)
    return path


def canonical(spark: SparkSession, folder: str) -> DataFrame:
    """Raw upload with null tokens resolved, canonical names and types; dates still text."""
    return canonical_schema(nullify_tokens(raw(spark, folder)))


def parsed(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical upload with dates parsed as ISO."""
    return parse_dates(canonical(spark, folder), "%Y-%m-%d")


RAW = """
raw AS (
  SELECT CASE k WHEN 3 THEN NULL WHEN 4 THEN 'NULL' WHEN 5 THEN ' ' || ckey || ' '
              WHEN 6 THEN '=SUM(' || ckey || ')' WHEN 7 THEN 'N/A' ELSE ckey END AS cust_id,
         CASE k WHEN 11 THEN 'not-a-date' WHEN 12 THEN NULL
              WHEN 13 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 14 THEN '2999-12-31'
              ELSE strftime(o_orderdate, '%Y-%m-%d') END AS order_date,
         CASE k WHEN 21 THEN '-' || money WHEN 22 THEN '0' WHEN 23 THEN 'abc' WHEN 24 THEN NULL
              ELSE money END AS amount,
         CAST(o_orderkey AS VARCHAR) AS subscription_id,
         CASE k WHEN 31 THEN ' ' || o_orderstatus ELSE o_orderstatus END AS subscription_status,
         CASE k WHEN 41 THEN 'n/a' ELSE n_name END AS country,
         CASE k WHEN 42 THEN '@' || c_mktsegment ELSE c_mktsegment END AS product
  FROM (SELECT *, o_orderkey % 100 AS k, CAST(o_custkey AS VARCHAR) AS ckey,
               CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS money
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey
                    LEFT JOIN nation ON c_nationkey = n_nationkey)
  CROSS JOIN (SELECT 1 AS copy UNION ALL SELECT 2)
  WHERE copy = 1 OR k = 50)"""

_TOKENS = "('', 'NULL', 'null', 'None', 'NA', 'N/A', 'n/a')"

NULLED = RAW + ",\nnulled AS (SELECT " + ", ".join(
    f"CASE WHEN {c} NOT IN {_TOKENS} THEN {c} END AS {c}"
    for c in ("cust_id", "order_date", "amount", "subscription_id", "subscription_status", "country", "product")
) + " FROM raw)"

CANONICAL = NULLED + """,
canonical AS (
  SELECT nullif(trim(cust_id), 'nan') AS customer_id, order_date AS transaction_date,
         try_cast(amount AS DOUBLE) AS transaction_amount,
         nullif(trim(subscription_id), 'nan') AS subscription_id,
         lower(trim(subscription_status)) AS subscription_status,
         trim(country) AS country, trim(product) AS product
  FROM nulled)"""

PARSED = CANONICAL + """,
parsed AS (
  SELECT * REPLACE (CASE WHEN regexp_full_match(transaction_date, '\\d{4}-\\d{1,2}-\\d{1,2}')
                         THEN try_strptime(transaction_date, '%Y-%m-%d') END AS transaction_date)
  FROM canonical)"""
