import itertools
import math
import os

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from tenura import sinks, workflows
from tenura.errors import LeakageError, ModelError
from tenura.operators import explain, model, scoring
from tenura.plans import QUERIES
from tenura.sources import orders_as_transactions


@pytest.fixture(scope="module")
def matrix(spark):
    """60 active and 60 churned customers that recency and frequency separate, with noise."""
    rng = np.random.default_rng(7)
    rows = []
    for i in range(120):
        churned = i % 2
        rows.append(
            (
                f"c{i}",
                float(rng.normal(150 if churned else 40, 30)),
                float(rng.normal(3 if churned else 9, 2)),
                *[float(v) for v in rng.normal(100, 20, 4)],
                1.0,
                churned,
            )
        )
    features = ", ".join(f"{c} double" for c in model.FEATURES)
    return spark.createDataFrame(rows, f"customer_id string, {features}, is_churned int")


@pytest.fixture(scope="module")
def fitted(matrix):
    return model.train_model(matrix, trees=20, depth=5)


def test_probabilities(fitted, matrix):
    rows = fitted.score(matrix).collect()
    for r in rows:
        assert 0 <= r["churn_probability"] <= 1
        assert r["churn_probability"] == pytest.approx((r["lr_probability"] + r["rf_probability"]) / 2)
    mean = lambda y: np.mean([r["churn_probability"] for r in rows if r["is_churned"] == y])
    assert mean(1) > mean(0) + 0.5
    assert scoring.auc_exact(fitted.scored(matrix)).first()["auc"] > 0.9


def test_logistic_optimum(fitted, matrix):
    """The gradient of half the squared weights plus the weighted loss vanishes."""
    data = matrix.toPandas()
    mean, scale = np.array([fitted.scaling[c] for c in model.FEATURES]).T
    x = (data[list(model.FEATURES)].to_numpy() - mean) / scale
    y = data["is_churned"].to_numpy()
    w, b = fitted.logistic.coefficients, fitted.logistic.intercept
    miss = 1 / (1 + np.exp(-(x @ w + b))) - y
    assert np.abs(w + x.T @ miss).max() < 1e-8
    assert abs(miss.sum()) < 1e-8
    assert fitted.logistic.steps < 15


def test_newton_on_separable_and_constant_features(spark):
    """Far apart classes, a constant feature and very unequal classes still give the optimum."""
    rows = [(float(i), 5.0, int(i >= 290), 300 / 580 if i < 290 else 15.0) for i in range(300)]
    train = spark.createDataFrame(rows, "a double, b double, is_churned int, weight double")
    fit = model.train_lr(train, {"a": (149.5, 86.6), "b": (5.0, 1.0)})
    z = (np.arange(300) - 149.5) / 86.6
    miss = np.where(z > (289.5 - 149.5) / 86.6, 15.0, 300 / 580)
    y = (np.arange(300) >= 290).astype(float)
    error = miss * (1 / (1 + np.exp(-(fit.intercept + fit.coefficients[0] * z))) - y)
    assert abs(error.sum()) < 1e-7 and abs(error @ z + fit.coefficients[0]) < 1e-7
    assert fit.coefficients[1] == 0.0


def test_walk_through_the_stored_trees(fitted, matrix):
    """Level by level through the table of nodes, every row gets the forest's own probability."""
    walked = {r["customer_id"]: r["rf_probability"] for r in explain.walk_forest(fitted, matrix).collect()}
    own = {r["customer_id"]: r["rf_probability"] for r in fitted.score(matrix).collect()}
    assert walked == pytest.approx(own, abs=1e-12)


def test_leaves_count_the_training_rows(fitted, matrix):
    """Each tree's leaves share out the weight of a sample as large as the training rows."""
    nodes = explain.forest_nodes(fitted, matrix.sparkSession).toPandas()
    at = nodes.set_index(["tree", "id"])
    inner = nodes[nodes["left"] >= 0]
    for column in ("cover", "churned"):
        children = sum(at.loc[list(zip(inner["tree"], inner[side])), column].to_numpy() for side in ("left", "right"))
        assert children == pytest.approx(inner[column].to_numpy())
    roots = nodes[nodes["id"] == 0]
    assert roots["cover"].to_numpy() == pytest.approx(120, rel=0.35)  # drawn with replacement
    share = (roots["churned"] / roots["cover"]).to_numpy()
    assert np.abs(share - 0.5).max() < 0.25 and abs(share.mean() - 0.5) < 0.05


def test_constant_feature_scales_to_one(fitted):
    assert fitted.scaling["gap_std_days"] == (1.0, 1.0)


def test_one_class_is_refused(matrix):
    with pytest.raises(ModelError):
        model.train_model(matrix.where("is_churned = 1"))


def test_leaky_feature_is_refused(matrix):
    with pytest.raises(LeakageError):
        model.train_model(matrix.withColumn("status", F.col("aov")), features=("aov", "status"))


def test_class_weights(matrix):
    skewed = matrix.where("is_churned = 1 OR customer_id < 'c4'")
    rows = model.class_weights(skewed).collect()
    n = sum(r["n"] for r in rows)
    assert all(r["weight"] == pytest.approx(n / (2 * r["n"])) for r in rows)


def test_shapley_values(fitted, matrix):
    features = model.FEATURES
    shap = explain.shap_values(fitted, matrix, max_samples=None)
    rows = shap.collect()
    assert len(rows) == 120
    for r in rows:
        assert r["base_value"] + sum(r["phi"]) == pytest.approx(r["rf_probability"], abs=1e-9)
    # against the definition: all orders in which features can become known
    leaves = explain.forest_leaves(explain.forest_nodes(fitted, shap.sparkSession), 7).toPandas()
    x = matrix.where("customer_id = 'c3'").toPandas()[list(features)].to_numpy(dtype=float)[0]
    met = np.array([(x > lo) & (x <= up) for lo, up in zip(leaves["lower"], leaves["upper"])])
    ratio = np.array(leaves["ratio"].tolist())
    trees = leaves["tree"].nunique()

    def known(subset):
        mask = np.isin(np.arange(7), subset)
        return (leaves["value"].to_numpy() * np.where(mask, met, ratio).prod(axis=1)).sum() / trees

    phi = next(r["phi"] for r in rows if r["customer_id"] == "c3")
    for i in range(7):
        others = [j for j in range(7) if j != i]
        expected = 0.0
        for size in range(7):
            weight = math.factorial(size) * math.factorial(6 - size) / math.factorial(7)
            for subset in itertools.combinations(others, size):
                expected += weight * (known([*subset, i]) - known(list(subset)))
        assert phi[i] == pytest.approx(expected, abs=1e-9)


def test_importance_and_sampling(fitted, matrix):
    shap = explain.shap_values(fitted, matrix, max_samples=30)
    ranked = explain.shap_importance(shap, fitted.features).orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == list(range(1, 8))
    assert {ranked[0]["feature_name"], ranked[1]["feature_name"]} == {"recency_days", "frequency"}
    sampled = lambda df: {r["customer_id"] for r in explain.sample_rows(df, 30).collect()}
    assert sampled(matrix.repartition(7)) == sampled(matrix.coalesce(1)) and len(sampled(matrix)) == 30
    assert explain.top_features(explain.shap_importance(shap, fitted.features), 2).count() == 2


def scores(spark, rows):
    return spark.createDataFrame(rows, "customer_id string, label int, churn_probability double")


def test_auc_with_ties(spark):
    rng = np.random.default_rng(3)
    rows = [(str(i), int(rng.random() < 0.4), float(rng.integers(0, 40) / 40)) for i in range(600)]
    rows += [(f"t{i}", i % 2, 0.5) for i in range(300)]
    pos = np.array([r[2] for r in rows if r[1]])
    neg = np.array([r[2] for r in rows if not r[1]])
    brute = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    df = scores(spark, rows)
    assert scoring.auc_exact(df).first()["auc"] == pytest.approx(brute, abs=1e-12)
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="churn_probability", numBins=0)
    assert evaluator.evaluate(df) == pytest.approx(brute, abs=1e-9)


def test_roc_against_counting(spark):
    rng = np.random.default_rng(4)
    df = scores(spark, [(str(i), int(rng.random() < 0.5), float(rng.integers(0, 90) / 90)) for i in range(500)])
    all_rows = df.collect()
    positives = sum(r["label"] for r in all_rows)
    for drop in (False, True):
        curve = [tuple(r) for r in scoring.roc_points(df, drop_intermediate=drop).na.fill(2.0).collect()]
        assert (2.0, 0.0, 0.0) in curve and any(p[1:] == (1.0, 1.0) for p in curve)
        for threshold, fpr, tpr in curve:
            kept = [r for r in all_rows if r["churn_probability"] >= threshold]
            assert tpr == pytest.approx(sum(r["label"] for r in kept) / positives)
            assert fpr == pytest.approx(sum(1 - r["label"] for r in kept) / (500 - positives))


def test_scores_that_are_missing_or_infinite(spark):
    rows = [("a", 1, float("inf")), ("b", 0, None), ("c", 1, float("nan")), ("d", 0, 0.5), ("e", 1, 0.5), ("f", 0, float("-inf"))]
    df = scores(spark, rows)
    # NaN > inf > 0.5 > -inf > NULL: e ties with d and beats b and f
    assert scoring.auc_exact(df).first()["auc"] == pytest.approx((3 + 3 + 2.5) / 9)
    assert scoring.roc_points(df).count() == 6


def test_metrics_and_confusion(spark):
    df = scores(spark, [("a", 1, 0.9), ("b", 0, 0.7), ("c", 1, 0.5), ("d", 0, 0.2)])
    cells = {(r["actual"], r["predicted"]): r["n"] for r in scoring.confusion_matrix(df).collect()}
    assert cells == {(0, 0): 1, (0, 1): 1, (1, 0): 0, (1, 1): 2}
    m = scoring.classification_metrics(df).first()
    assert (m["precision"], m["recall"], m["f1"], m["n_test"]) == (pytest.approx(2 / 3), 1.0, pytest.approx(0.8), 4)
    none = scoring.classification_metrics(scores(spark, [("a", 1, 0.1)])).first()
    assert (none["precision"], none["recall"], none["f1"]) == (0.0, 0.0, 0.0)


def exports(spark):
    scored = spark.createDataFrame(
        [("a", 0.5), ("b", 0.9), ("c", 0.123456789), ("d", 0.7), ("gone", 0.1)],
        "customer_id string, churn_probability double",
    )
    customers = spark.createDataFrame(
        [(c, 10, 1234.56, 3, 100) for c in "abcd"],
        "customer_id string, recency_days long, monetary_total double, frequency long, tenure_days long",
    )
    return scored, customers


def test_exports(spark, tmp_path):
    scored, customers = exports(spark)
    out = sinks.at_risk_export(scored, customers)
    rows = out.collect()
    assert out.columns == ["Customer ID", "Churn Probability", "Days Since Last Purchase", "Total Spend", "Total Purchases"]
    assert [r[0] for r in rows] == ["b", "d", "a", "c", "gone"]
    assert rows[3][1] == 0.1235 and rows[4][3] is None
    assert sinks.full_predictions_export(scored, customers).columns[-1] == "Tenure Days"
    sinks.write_csv(out, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 5


def test_top_at_risk(spark):
    scored, customers = exports(spark)
    rows = sinks.top_at_risk(scored, customers, n=2).collect()
    assert [tuple(r) for r in rows] == [("b", "90.0%", "$1,235", 10, 3), ("d", "70.0%", "$1,235", 10, 3)]


DATA = os.environ.get("TENURA_TEST_DATA", "/root/testdata/sf0.001")


def test_model_queries(spark):
    """The registered results agree with each other and with numpy."""
    rows = {name: modelling_query(spark, name) for name in ("score_ensemble", "train_rf", "train_lr", "model_metrics")}
    scored = rows["score_ensemble"].set_index("customer_id").sort_index()
    mean = (scored["lr_probability"] + scored["rf_probability"]) / 2
    assert np.abs(mean - scored["churn_probability"]).max() < 2e-6
    walked = rows["train_rf"].set_index("customer_id").sort_index()["rf_probability"]
    assert np.abs(walked - scored["rf_probability"]).max() < 2e-6
    regression = rows["train_lr"].set_index("customer_id").sort_index()["lr_probability"]
    assert np.abs(regression - scored["lr_probability"]).max() < 1e-4
    test = scored[scored["split"] == "test"]
    hit = (test["churn_probability"] >= 0.5).to_numpy()
    y = test["is_churned"].to_numpy().astype(bool)
    metrics = rows["model_metrics"].iloc[0]
    assert metrics["n_test"] == len(test) and metrics["n_train"] == len(scored) - len(test)
    assert metrics["precision"] == pytest.approx((hit & y).sum() / hit.sum(), abs=1e-6)
    assert metrics["recall"] == pytest.approx((hit & y).sum() / y.sum(), abs=1e-6)
    pos, neg = test["churn_probability"][y].to_numpy(), test["churn_probability"][~y].to_numpy()
    wins = (pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()
    assert metrics["auc"] == pytest.approx(wins, abs=1e-3)


def modelling_query(spark, name):
    return QUERIES[name](spark, DATA).toPandas()


def test_explanation_queries(spark):
    shap = modelling_query(spark, "shap_values")
    per_row = shap.groupby("customer_id").agg({"phi": "sum", "base_value": "first", "rf_probability": "first"})
    assert np.abs(per_row["phi"] + per_row["base_value"] - per_row["rf_probability"]).max() < 1e-5
    importance = modelling_query(spark, "shap_importance").set_index("feature_name")["mean_abs_shap"]
    means = shap["phi"].abs().groupby(shap["feature_name"]).mean()
    assert importance.to_dict() == pytest.approx(means.to_dict(), abs=1e-5)
    ranks = modelling_query(spark, "importance_rank").sort_values("rank")
    assert list(ranks["feature_name"]) == list(importance.sort_values(ascending=False).index)
    assert set(modelling_query(spark, "top_features")["feature_name"]) == set(ranks["feature_name"][:3])


def test_study(spark):
    done = workflows.study(orders_as_transactions(spark, "/root/testdata/sf0.001"), trees=10, depth=4)
    n = done.customers.count()
    assert done.predictions.count() == done.clv.count() == done.segments.count() == n
    metrics = done.metrics.first()
    assert metrics["n_train"] + metrics["n_test"] == n and 0.5 < metrics["auc"] <= 1.0
    assert done.importance.count() == 7
