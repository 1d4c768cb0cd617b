"""Churn model: weighted logistic regression and random forest, averaged."""

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura.errors import ModelError
from tenura.fixed_values import FEATURES
from tenura.operators.schema import assert_no_leakage
from tenura.session import store


def training_statistics(matrix: DataFrame, features=FEATURES) -> DataFrame:
    """One row from one pass: rows, churned rows, mean and scale of every feature.

    Scale is the population standard deviation, 1 for a constant feature.
    """
    scale = lambda c: F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0))
    return matrix.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("is_churned") == 1).alias("churned"),
        *[F.struct(F.avg(c).alias("mean"), scale(c).alias("scale")).alias(c) for c in features],
    )


def scale_statistics(matrix: DataFrame, features=FEATURES) -> DataFrame:
    """``(feature, mean, scale)`` of the training rows."""
    entry = lambda c: F.struct(
        F.lit(c).alias("feature"), F.col(f"{c}.mean").alias("mean"), F.col(f"{c}.scale").alias("scale")
    )
    return training_statistics(matrix, features).select(
        F.inline(F.array(*[entry(c) for c in features]))
    )


def class_weights(matrix: DataFrame) -> DataFrame:
    """Balanced weights ``(label, n, weight)``: rows / (2 x rows of the class)."""
    n, churned = F.col("n"), F.col("churned")
    entry = lambda label, size: F.struct(
        F.lit(label).alias("label"), size.alias("n"), F.try_divide(n, size * 2).alias("weight")
    )
    return (
        training_statistics(matrix, ())
        .select(F.inline(F.array(entry(0, n - churned), entry(1, churned))))
        .where("n > 0")
    )


def standard_scale(matrix: DataFrame, statistics: dict[str, tuple[float, float]]) -> DataFrame:
    """Replace each feature by its z-score."""
    return matrix.withColumns(
        {c: (F.col(c) - mean) / scale for c, (mean, scale) in statistics.items()}
    )


def _assemble(df: DataFrame, columns, output: str) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=output).transform(df)


def _churn_share(column: str) -> Column:
    return vector_to_array(column)[1]


@dataclass
class LogisticFit:
    """Intercept and coefficients of scaled features, and the Newton steps that it took to find them."""

    features: tuple[str, ...]
    intercept: float
    coefficients: np.ndarray
    steps: int

    def margin(self, scaled: dict[str, Column]) -> Column:
        """The log odds as a sum of plain columns."""
        total = F.lit(float(self.intercept))
        for c, b in zip(self.features, self.coefficients.tolist()):
            total = total + F.lit(b) * scaled[c]
        return total

    def probability(self, scaled: dict[str, Column]) -> Column:
        return 1 / (1 + F.exp(-self.margin(scaled)))


@dataclass
class ChurnModel:
    """The two fitted models and what is needed to prepare their input."""

    features: tuple[str, ...]
    scaling: dict[str, tuple[float, float]]
    logistic: LogisticFit
    forest: RandomForestClassificationModel
    n_train: int

    def score(self, matrix: DataFrame) -> DataFrame:
        """Add ``lr_probability``, ``rf_probability`` and their mean ``churn_probability``."""
        scaled = {c: (F.col(c) - mean) / scale for c, (mean, scale) in self.scaling.items()}
        forest = self.forest.transform(_assemble(matrix, self.features, "_raw"))
        both = forest.select(
            *matrix.columns,
            self.logistic.probability(scaled).alias("lr_probability"),
            _churn_share("probability").alias("rf_probability"),
        )
        return both.withColumn("churn_probability", (F.col("lr_probability") + F.col("rf_probability")) / 2)

    def scored(self, matrix: DataFrame, label: str = "is_churned") -> DataFrame:
        """``(customer_id, label, churn_probability)`` for evaluation."""
        return self.score(matrix).select(
            "customer_id", F.col(label).alias("label"), "churn_probability"
        )


def _newton_moments(rows: DataFrame, beta: np.ndarray):
    """Loss, gradient and curvature of the weighted log loss over all rows, in one aggregation.

    ``rows`` has the label y, the weight w and the scaled features z1, z2 ...
    With 1 in front of the features z: the sums of w (p - y) z and of
    w p (1 - p) z z'.
    """
    k = len(beta)
    one = ["1D", *[f"z{i}" for i in range(1, k)]]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    margin = " + ".join(f"{b!r}D * {z}" for b, z in zip(beta.tolist(), one))
    found = (
        rows.selectExpr("*", f"{margin} AS s")
        .selectExpr("*", "1 / (1 + exp(-s)) AS p")
        .selectExpr("*", "w * (p - y) AS e", "w * p * (1 - p) AS h")
        .selectExpr(
            "sum(w * (log1p(exp(-abs(s))) + greatest(s, 0D) - y * s))",
            *[f"sum(e * {x})" for x in one],
            *[f"sum(h * {one[i]} * {one[j]})" for i, j in pairs],
        )
        .first()
    )
    curvature = np.zeros((k, k))
    for (i, j), value in zip(pairs, found[1 + k :]):
        curvature[i, j] = curvature[j, i] = value
    return found[0], np.array(found[1 : 1 + k], dtype=float), curvature


def train_lr(
    train: DataFrame, scaling: dict[str, tuple[float, float]], *, max_iter: int = 1000, tolerance: float = 1e-6
) -> LogisticFit:
    """L2-regularised logistic regression with unit inverse strength, by Newton steps.

    Minimises the weighted log loss plus half the squared coefficients; the
    intercept is free. Every step is one aggregation of moments over the rows
    (``is_churned``, ``weight`` and the features) and a small linear system on
    the driver; a step that does not lower the loss is halved. Errors shrink with
    the square of a step, so a last one below ``tolerance`` leaves next to none.
    """
    features = tuple(scaling)
    scaled = [((F.col(c) - mean) / scale).alias(f"z{i}") for i, (c, (mean, scale)) in enumerate(scaling.items(), 1)]
    rows = train.select(F.col("is_churned").cast("double").alias("y"), F.col("weight").alias("w"), *scaled)
    penalty = np.array([0.0] + [1.0] * len(features))
    beta, step, before = np.zeros(1 + len(features)), None, np.inf
    for steps in range(1, max_iter + 1):
        loss, gradient, curvature = _newton_moments(rows, beta)
        loss += 0.5 * float(beta[1:] @ beta[1:])
        if step is not None and loss > before + 1e-9 * abs(before) and np.abs(step).max() > tolerance:
            step = step / 2
            beta = beta - step
            continue
        before = loss
        step = -np.linalg.solve(curvature + np.diag(penalty), gradient + penalty * beta)
        beta = beta + step
        if np.abs(step).max() <= tolerance * max(1.0, np.abs(beta).max()):
            break
    return LogisticFit(features, float(beta[0]), beta[1:], steps)


def train_rf(
    train: DataFrame, *, trees: int = 200, depth: int = 10, seed: int = 42
) -> RandomForestClassificationModel:
    """Random forest on unscaled features, two of seven tried per split."""
    return RandomForestClassifier(
        featuresCol="_raw",
        labelCol="is_churned",
        weightCol="weight",
        numTrees=trees,
        maxDepth=depth,
        featureSubsetStrategy="2",
        maxBins=128,
        maxMemoryInMB=1024,
        seed=seed,
    ).fit(train)


def train_model(
    train: DataFrame,
    *,
    features=FEATURES,
    trees: int = 200,
    depth: int = 10,
    max_iter: int = 1000,
    seed: int = 42,
) -> ChurnModel:
    """Fit both models on a feature matrix with a 0/1 ``is_churned``.

    The training rows are stored first: the passes that follow read a table
    with a short lineage. The driver sees two counts, two numbers per feature,
    and a sum for each pair of features in every step.
    """
    assert_no_leakage(train.select("customer_id", *features))
    train = store(train.select("is_churned", *features))
    found = training_statistics(train, features).first()
    n_train, churned = found["n"], found["churned"]
    if churned in (0, n_train):
        raise ModelError("training data has only one class; churned and active customers are needed")
    scaling = {c: (found[c]["mean"], found[c]["scale"]) for c in features}
    weight = F.when(F.col("is_churned") == 1, n_train / (2 * churned)).otherwise(
        n_train / (2 * (n_train - churned))
    )
    weighted = train.withColumn("weight", weight)
    logistic = train_lr(weighted, scaling, max_iter=max_iter)
    forest = train_rf(
        _assemble(weighted, features, "_raw").select("is_churned", "weight", "_raw"), trees=trees, depth=depth, seed=seed
    )
    return ChurnModel(tuple(features), scaling, logistic, forest, n_train)
