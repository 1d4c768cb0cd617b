"""Evaluation of scores: ``(customer_id, label, churn_probability)`` tables.

Curves need the distinct scores several times; they are stored once, so that
a model is not applied again for each pass.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.operators.ordering import running_totals, with_next
from tenura.session import store


def outcomes_by_score(scored: DataFrame) -> DataFrame:
    """``(score, positives, negatives)`` per distinct score, combined before the shuffle."""
    return scored.groupBy(F.col("churn_probability").alias("score")).agg(
        F.count_if(F.col("label") == 1).alias("positives"),
        F.count_if(F.col("label") == 0).alias("negatives"),
    )


def stored_outcomes(scored: DataFrame) -> DataFrame:
    """Outcomes by score, stored for the passes that AUC and ROC make over them."""
    return store(outcomes_by_score(scored))


def auc_exact(scored: DataFrame, outcomes: DataFrame | None = None) -> DataFrame:
    """One row ``(auc)``: chance that a positive outscores a negative, ties count half.

    A missing score ranks below all others.

    ``outcomes`` passes a result of :func:`stored_outcomes`.
    """
    by_score = stored_outcomes(scored) if outcomes is None else outcomes
    ranked = running_totals(by_score, "score", {"below": "negatives"})
    wins = F.sum(
        F.col("positives") * (F.col("below") - F.col("negatives") + F.col("negatives") / 2.0)
    )
    pairs = F.sum("positives").cast("double") * F.sum("negatives")
    return ranked.agg(F.try_divide(wins, pairs).alias("auc"))


def roc_points(
    scored: DataFrame,
    outcomes: DataFrame | None = None,
    *,
    drop_intermediate: bool = False,
) -> DataFrame:
    """``(threshold, fpr, tpr)`` from the origin (threshold NULL) down the distinct scores.

    ``drop_intermediate`` drops points between two equal steps.
    """
    by_score = stored_outcomes(scored) if outcomes is None else outcomes
    totals = by_score.agg(
        F.struct(F.sum("positives").alias("p"), F.sum("negatives").alias("n"))
    )
    cumulative = running_totals(
        by_score, "score", {"tp": "positives", "fp": "negatives"}, descending=True
    )
    if drop_intermediate:
        cumulative = _turns(cumulative)
    points = cumulative.withColumn("t", totals.scalar()).select(
        F.col("score").alias("threshold"),
        F.try_divide("fp", "t.n").alias("fpr"),
        F.try_divide("tp", "t.p").alias("tpr"),
    )
    origin = totals.select(
        F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return origin.unionByName(points)


def _turns(cumulative: DataFrame) -> DataFrame:
    """Drop points whose step equals the next one's; the first and last stay."""
    ahead = with_next(
        cumulative, "score", ["positives", "negatives"], descending=True
    )
    first = F.col("tp") + F.col("fp") == F.col("positives") + F.col("negatives")
    same = (F.col("next_positives") == F.col("positives")) & (
        F.col("next_negatives") == F.col("negatives")
    )
    return ahead.where(first | F.col("next_positives").isNull() | ~same)


def confusion_matrix(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``(actual, predicted, n)`` with all four cells."""
    predicted = (F.col("churn_probability") >= threshold).cast("int")
    cell = lambda a, p: F.count_if((F.col("label") == a) & (predicted == p)).alias(f"{a}{p}")
    cells = [(a, p) for a in (0, 1) for p in (0, 1)]
    counts = scored.agg(*[cell(a, p) for a, p in cells])
    return counts.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(a).alias("actual"),
                        F.lit(p).alias("predicted"),
                        F.col(f"{a}{p}").alias("n"),
                    )
                    for a, p in cells
                ]
            )
        )
    )


def classification_metrics(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row ``(precision, recall, f1, n_test)``; an undefined ratio is 0."""
    flagged = F.col("churn_probability") >= threshold
    hits = F.count_if(flagged & (F.col("label") == 1))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    counts = scored.agg(
        hits.alias("tp"),
        F.count_if(flagged).alias("flagged"),
        F.count_if(F.col("label") == 1).alias("actual"),
        F.count("*").alias("n_test"),
    )
    return counts.select(
        ratio(F.col("tp"), F.col("flagged")).alias("precision"),
        ratio(F.col("tp"), F.col("actual")).alias("recall"),
        ratio(F.col("tp") * 2, F.col("flagged") + F.col("actual")).alias("f1"),
        "n_test",
    )


def evaluate(scored: DataFrame, n_train: int, outcomes: DataFrame | None = None) -> DataFrame:
    """One row ``(precision, recall, f1, n_test, auc, n_train)``."""
    return (
        classification_metrics(scored)
        .withColumn("auc", auc_exact(scored, outcomes).scalar())
        .withColumn("n_train", F.lit(n_train).cast("long"))
    )
