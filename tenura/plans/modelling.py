"""Model, evaluation and explanation."""

from pyspark.sql import functions as F

from tenura.fixed_values import FEATURES
from tenura.operators import customers as cust
from tenura.operators import explain, model, scoring
from tenura.plans import tables as t
from tenura.plans.customers import SPLIT
from tenura.plans.registry import query, rounded
from tenura.session import store

# --- Evaluation of a score that SQL can compute too: short tenure as risk -----------------------

SCORED = """
judged AS (
  SELECT customer_id, CAST(is_churned AS INTEGER) AS label,
         1 - tenure_days / CAST((SELECT max(tenure_days) FROM feats) AS DOUBLE) AS p FROM feats)"""

TX_SCORED = t.TX_CUSTOMERS + "," + SCORED


def _scored(spark, folder):
    customers = t.stored_customers(spark, folder)
    longest = customers.agg(F.max("tenure_days")).scalar()
    return customers.select(
        "customer_id",
        F.col("is_churned").cast("int").alias("label"),
        (1 - F.col("tenure_days") / longest).alias("churn_probability"),
    )


_AUC = """
SELECT round(sum(CASE WHEN a.p > b.p THEN a.n * b.n WHEN a.p = b.p THEN a.n * b.n / 2.0 ELSE 0 END)
             / (SELECT sum(label) * sum(1 - label) FROM judged), 6) AS auc
FROM (SELECT p, count(*) AS n FROM judged WHERE label = 1 GROUP BY p) a,
     (SELECT p, count(*) AS n FROM judged WHERE label = 0 GROUP BY p) b"""


@query("auc_exact", f"WITH {TX_SCORED} {_AUC}")
def auc_exact(spark, folder):
    return rounded(scoring.auc_exact(_scored(spark, folder)), 6)


@query("auc_distributed", f"WITH {TX_SCORED} {_AUC}")
def auc_distributed(spark, folder):
    """As ``auc_exact``, from outcomes by score that several results share."""
    scored = _scored(spark, folder)
    return rounded(scoring.auc_exact(scored, scoring.stored_outcomes(scored)), 6)


_ROC = """
steps AS (SELECT p, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM judged GROUP BY p),
curve AS (
  SELECT p, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
         row_number() OVER w AS nr, lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg
  FROM steps WINDOW w AS (ORDER BY p DESC))"""

_ROC_POINTS = """
SELECT round(p, 6) AS threshold, round(fp * 1.0 / (SELECT sum(neg) FROM steps), 6) AS fpr,
       round(tp * 1.0 / (SELECT sum(pos) FROM steps), 6) AS tpr FROM curve"""


@query("roc_points", f"WITH {TX_SCORED}, {_ROC} {_ROC_POINTS} UNION ALL SELECT NULL, 0.0, 0.0")
def roc_points(spark, folder):
    return rounded(scoring.roc_points(_scored(spark, folder)), 6)


@query(
    "roc_turning_points",
    f"""WITH {TX_SCORED}, {_ROC} {_ROC_POINTS}
    WHERE nr = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg UNION ALL SELECT NULL, 0.0, 0.0""",
)
def roc_turning_points(spark, folder):
    return rounded(scoring.roc_points(_scored(spark, folder), drop_intermediate=True), 6)


@query(
    "confusion_matrix",
    f"""WITH {TX_SCORED} SELECT CAST(a AS INTEGER) AS actual, CAST(b AS INTEGER) AS predicted,
    CAST((SELECT count(*) FROM judged WHERE label = a AND CAST(p >= 0.5 AS INTEGER) = b) AS BIGINT) AS n
    FROM (SELECT unnest([0, 0, 1, 1]) AS a, unnest([0, 1, 0, 1]) AS b)""",
)
def confusion_matrix(spark, folder):
    return scoring.confusion_matrix(_scored(spark, folder))


METRICS = """
hits AS (
  SELECT count(*) FILTER (label = 1 AND p >= 0.5) AS tp, count(*) FILTER (p >= 0.5) AS flagged,
         count(*) FILTER (label = 1) AS actual, count(*) AS n_test FROM judged)"""


@query(
    "classification_metrics",
    f"""WITH {TX_SCORED}, {METRICS} SELECT round(coalesce(tp * 1.0 / nullif(flagged, 0), 0), 6) AS precision,
    round(coalesce(tp * 1.0 / nullif(actual, 0), 0), 6) AS recall,
    round(coalesce(2.0 * tp / nullif(flagged + actual, 0), 0), 6) AS f1, CAST(n_test AS BIGINT) AS n_test FROM hits""",
)
def classification_metrics(spark, folder):
    return rounded(scoring.classification_metrics(_scored(spark, folder)), 6)


# --- The model ----------------------------------------------------------------------------------


def _split(spark, folder):
    matrix = cust.feature_matrix(t.stored_customers(spark, folder))
    return cust.temporal_split(matrix)


@query(
    "class_weights",
    f"""WITH {t.TX_CUSTOMERS}, {SPLIT} SELECT CAST(is_churned AS INTEGER) AS label, CAST(count(*) AS BIGINT) AS n,
    round((SELECT count(*) FROM split WHERE split = 'train') / (2.0 * count(*)), 6) AS weight
    FROM split WHERE split = 'train' GROUP BY 1""",
)
def class_weights(spark, folder):
    return rounded(model.class_weights(_split(spark, folder).where("split = 'train'")), 6)


@query(
    "single_class_guard",
    f"""WITH {t.TX_CUSTOMERS}, {SPLIT} SELECT CAST(count(DISTINCT is_churned) AS BIGINT) AS classes
    FROM split WHERE split = 'train'""",
)
def single_class_guard(spark, folder):
    train = _split(spark, folder).where("split = 'train'")
    return model.class_weights(train).agg(F.count("*").alias("classes"))


@query(
    "standard_scale",
    f"WITH {t.TX_CUSTOMERS}, {SPLIT}, train AS (SELECT * FROM split WHERE split = 'train') "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg({c}), 3) AS mean, round(stddev_pop({c}), 3) AS scale FROM train"
        for c in FEATURES
    ),
)
def standard_scale(spark, folder):
    train = _split(spark, folder).where("split = 'train'")
    return rounded(model.scale_statistics(train), 3)


def trained(spark, folder):
    split = store(_split(spark, folder))
    return model.train_model(split.where("split = 'train'")), split


# Newton steps of the logistic regression: moments of all training rows, then an 8 x 8 system solved
# by elimination without pivoting (curvature plus penalty is positive definite).
_Z = ["1.0", *[f"z{i}" for i in range(1, len(FEATURES) + 1)]]
_MOMENTS = ", ".join(
    "[" + ", ".join([f"sum(h * {a} * {b}) + {float(a == b != '1.0')}" for b in _Z] + [f"sum(e * {a})" + (f" + b[{i}]" if i > 1 else "")]) + "]"
    for i, a in enumerate(_Z, 1)
)
_SYSTEM = f"""SELECT k, b, [{_MOMENTS}] AS m
         FROM (SELECT *, w * (p - y) AS e, w * p * (1 - p) AS h
               FROM (SELECT k, b, train.*, 1 / (1 + exp(-({" + ".join(f"b[{i}] * {z}" for i, z in enumerate(_Z, 1))}))) AS p
                     FROM newton, train WHERE k < 25))
         GROUP BY k, b"""
for _row in range(1, len(_Z) + 1):
    _SYSTEM = f"""SELECT k, b, list_transform(m, lambda r, i: CASE WHEN i = {_row}
                     THEN list_transform(r, lambda x: x / m[{_row}][{_row}])
                     ELSE list_transform(r, lambda x, j: x - r[{_row}] * m[{_row}][j] / m[{_row}][{_row}]) END) AS m
         FROM ({_SYSTEM})"""

LOGISTIC = f"""
stats AS (SELECT count(*) AS n, count(*) FILTER (is_churned) AS churned,
  {", ".join(f"avg({c}) AS m{i}, coalesce(nullif(stddev_pop({c}), 0), 1) AS s{i}" for i, c in enumerate(FEATURES, 1))}
  FROM split WHERE split = 'train'),
scaled AS (
  SELECT customer_id, split, CAST(is_churned AS DOUBLE) AS y,
         CASE WHEN is_churned THEN n / (2.0 * churned) ELSE n / (2.0 * (n - churned)) END AS w,
         {", ".join(f"({c} - m{i}) / s{i} AS z{i}" for i, c in enumerate(FEATURES, 1))}
  FROM split, stats),
train AS MATERIALIZED (SELECT * FROM scaled WHERE split = 'train'),
newton AS (
  SELECT 0 AS k, [{", ".join(["0.0::DOUBLE"] * len(_Z))}] AS b
  UNION ALL
  SELECT k + 1, list_transform(b, lambda x, i: x - m[i][{len(_Z) + 1}]) FROM ({_SYSTEM})),
coefficients AS (SELECT b FROM newton ORDER BY k DESC LIMIT 1),
logistic AS (
  SELECT customer_id, split, CAST(y AS INTEGER) AS is_churned,
         1 / (1 + exp(-({" + ".join(f"b[{i}] * {z}" for i, z in enumerate(_Z, 1))}))) AS lr_probability
  FROM scaled, coefficients)"""

_LOGISTIC = f"WITH RECURSIVE {t.TX_CUSTOMERS}, {SPLIT}, {LOGISTIC}"


def logistic(spark, folder):
    """The fitted regression alone, and the split that it was fitted on."""
    split = store(_split(spark, folder))
    train = split.where("split = 'train'")
    found = model.training_statistics(train).first()
    weights = {r["label"]: r["weight"] for r in model.class_weights(train).collect()}
    weight = F.when(F.col("is_churned") == 1, weights[1]).otherwise(weights[0])
    scaling = {c: (found[c]["mean"], found[c]["scale"]) for c in FEATURES}
    return model.train_lr(train.withColumn("weight", weight), scaling), scaling, split


@query(
    "train_lr",
    f"{_LOGISTIC} SELECT customer_id, split, is_churned, round(lr_probability, 4) AS lr_probability FROM logistic",
)
def train_lr(spark, folder):
    """The regression's probability for every customer."""
    fitted, scaling, split = logistic(spark, folder)
    scaled = {c: (F.col(c) - mean) / scale for c, (mean, scale) in scaling.items()}
    rows = split.select("customer_id", "split", "is_churned", fitted.probability(scaled).alias("lr_probability"))
    return rounded(rows, 4)


@query(
    "train_lr_coefficients",
    f"""{_LOGISTIC} SELECT unnest(['intercept', {", ".join(f"'{c}'" for c in FEATURES)}]) AS term,
    round(unnest(b), 4) AS coefficient FROM coefficients""",
)
def train_lr_coefficients(spark, folder):
    fitted, _, _ = logistic(spark, folder)
    terms = [("intercept", fitted.intercept), *zip(fitted.features, fitted.coefficients.tolist())]
    return rounded(spark.createDataFrame(terms, "term string, coefficient double"), 4)


# A forest drawn at random has no counterpart in SQL. The queries below return what the operators
# find; tests compare them with independent computations.


@query("train_rf")
def train_rf(spark, folder):
    """The forest's probability for every customer, by a walk of all rows through the stored trees."""
    fitted, split = trained(spark, folder)
    walked = explain.walk_forest(fitted, split)
    labels = split.select("customer_id", "split", "is_churned")
    return labels.join(rounded(walked, 6), "customer_id")


@query("forest_leaf_counts")
def forest_leaf_counts(spark, folder):
    """Per tree: leaves, the weight of the training rows in them, and the churned share of it."""
    fitted, _ = trained(spark, folder)
    leaves = explain.forest_nodes(fitted, spark).where("left < 0").groupBy("tree")
    found = leaves.agg(
        F.count("*").alias("leaves"),
        F.sum("cover").alias("weight"),
        (F.sum("churned") / F.sum("cover")).alias("churned_share"),
    )
    return rounded(found, 6)


@query("score_ensemble")
def score_ensemble(spark, folder):
    fitted, split = trained(spark, folder)
    columns = ["customer_id", "split", "is_churned", "lr_probability", "rf_probability", "churn_probability"]
    return rounded(fitted.score(split).select(*columns), 6)


def evaluation(fitted, split):
    """Metrics on the test customers."""
    scored = store(fitted.scored(split.where("split = 'test'")))
    return scoring.evaluate(scored, fitted.n_train)


@query("model_metrics")
def model_metrics(spark, folder):
    return rounded(evaluation(*trained(spark, folder)), 6)


@query(
    "sample_cap",
    f"WITH {t.TX_CUSTOMERS} SELECT CAST(least(count(*), 1000) AS BIGINT) AS sampled FROM feats",
)
def sample_cap(spark, folder):
    rows = explain.sample_rows(cust.feature_matrix(t.customers(spark, folder)))
    return rows.agg(F.count_distinct("customer_id").alias("sampled"))


def explained(spark, folder):
    """Shapley values of all test customers, and the names of the features."""
    fitted, split = trained(spark, folder)
    return store(explain.shap_values(fitted, split.where("split = 'test'"))), fitted.features


@query("shap_values")
def shap_values(spark, folder):
    """Each test customer's value per feature; with the base value they add up to the forest's probability."""
    shap, features = explained(spark, folder)
    rows = shap.select("customer_id", "base_value", "rf_probability")
    return rounded(explain.shap_long(shap, features).join(rows, "customer_id"), 6)


@query("shap_importance")
def shap_importance(spark, folder):
    return rounded(explain.shap_importance(*explained(spark, folder)).drop("rank"), 6)


@query("importance_rank")
def importance_rank(spark, folder):
    return explain.shap_importance(*explained(spark, folder)).select("rank", "feature_name")


@query("top_features")
def top_features(spark, folder):
    return rounded(explain.top_features(explain.shap_importance(*explained(spark, folder)), 3), 6)
