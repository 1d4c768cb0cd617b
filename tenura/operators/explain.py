"""Shapley values of the random forest's churn probability.

For one leaf with value v, let z be the product of cover ratios of a
feature's splits on the path and o be 1 if the row meets all of them. The
leaf's Shapley value for feature i is

    v (o_i - z_i) * integral over t in (0, 1) of prod_{j != i} (z_j + t (o_j - z_j))

The integrand is a polynomial of degree (features - 1), for which
Gauss-Legendre quadrature with half as many nodes is exact. Features off the
path have z = o = 1 and drop out. A leaf's values depend on a row only through
the pattern of features whose splits the row meets, so they are worked out once
per pattern and looked up by row. Values of all leaves add up, averaged over
the trees.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenura.errors import ModelError
from tenura.operators.model import ChurnModel
from tenura.session import shared_dir, store

MAX_LEAVES = 1_000_000
MAX_FEATURES = 12  # a leaf has a value for each pattern of features
LEAF_SCHEMA = "tree int, value double, lower array<double>, upper array<double>, ratio array<double>"


def sample_rows(matrix: DataFrame, n: int = 1000, seed: int = 42) -> DataFrame:
    """At most ``n`` rows, the same ones on every run and for every partitioning."""
    return matrix.orderBy(F.xxhash64("customer_id", F.lit(seed)), "customer_id").limit(n)


def forest_nodes(model: ChurnModel, spark) -> DataFrame:
    """The forest as a table, one row per node, written by Spark's own model writer."""
    if model is None or model.forest is None:
        raise ModelError("train the model before explaining it")
    path = shared_dir(spark)
    model.forest.write().save(path)
    data = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    impurity = F.col("impurityStats")
    return data.select(
        F.col("treeID").alias("tree"),
        "id",
        F.col("leftChild").alias("left"),
        F.col("rightChild").alias("right"),
        F.col("split.featureIndex").alias("feature"),
        F.try_element_at("split.leftCategoriesOrThreshold", F.lit(1)).alias("threshold"),
        F.aggregate(impurity, F.lit(0.0), lambda a, x: a + x).alias("cover"),
        F.element_at(impurity, 2).alias("churned"),
    )


def walk_forest(model: ChurnModel, rows: DataFrame, nodes: DataFrame | None = None, key: str = "customer_id") -> DataFrame:
    """``(key, rf_probability)``: every row's mean leaf share over the trees, from the forest as a table.

    All rows go through all trees together, level by level: a join with the
    nodes brings each row's split, the comparison the next node; a row that has
    reached its leaf stays there. ``nodes`` is a result of :func:`forest_nodes`.
    """
    nodes = store(forest_nodes(model, rows.sparkSession)) if nodes is None else nodes
    table = nodes.select(
        "tree", F.col("id").alias("node"), "left", "right", "feature", "threshold", (F.col("churned") / F.col("cover")).alias("share")
    )
    trees = F.sequence(F.lit(0), F.lit(model.forest.getNumTrees - 1))
    values = F.array(*[F.col(c).cast("double") for c in model.features])
    at = rows.select(key, values.alias("x"), F.explode(trees).alias("tree"), F.lit(0).alias("node"))
    value = F.get("x", F.col("feature"))
    child = F.when(value <= F.col("threshold"), F.col("left")).otherwise(F.col("right"))
    for _ in range(max(tree.depth for tree in model.forest.trees)):
        at = at.join(table, ["tree", "node"]).select(
            key, "x", "tree", F.when(F.col("left") < 0, F.col("node")).otherwise(child).alias("node")
        )
    return at.join(table, ["tree", "node"]).groupBy(key).agg(F.avg("share").alias("rf_probability"))


def forest_leaves(nodes: DataFrame, n_features: int) -> DataFrame:
    """One row per leaf: its churn share and, per feature, the interval
    (lower, upper] that reaches it and the product of cover ratios."""

    def walk(tree: pd.DataFrame) -> pd.DataFrame:
        tree = tree.sort_values("id")
        left, right, feature, threshold, cover, churned = (
            tree[c].to_numpy() for c in ("left", "right", "feature", "threshold", "cover", "churned")
        )
        at = {node: i for i, node in enumerate(tree["id"])}
        root = (np.full(n_features, -np.inf), np.full(n_features, np.inf), np.ones(n_features))
        stack, leaves = [(0, *root)], []
        while stack:
            i, lower, upper, ratio = stack.pop()
            if left[i] < 0:
                leaves.append((churned[i] / cover[i], lower, upper, ratio))
                continue
            f, cut = feature[i], threshold[i]
            for child, below in ((at[left[i]], True), (at[right[i]], False)):
                lo, up, z = lower.copy(), upper.copy(), ratio.copy()
                z[f] *= cover[child] / cover[i]
                if below:
                    up[f] = min(up[f], cut)
                else:
                    lo[f] = max(lo[f], cut)
                stack.append((child, lo, up, z))
        found = pd.DataFrame(leaves, columns=["value", "lower", "upper", "ratio"])
        found.insert(0, "tree", tree["tree"].iloc[0])
        return found

    # small data that would otherwise land in one task, tree after tree
    spread = nodes.repartition(nodes.sparkSession.sparkContext.defaultParallelism, "tree")
    return spread.groupBy("tree").applyInPandas(walk, LEAF_SCHEMA)


def _contributions(value, ratio, points, weights) -> np.ndarray:
    """Shapley values (patterns x leaves x features) of each leaf for each pattern of features whose
    splits a row meets; bit f of a pattern's number stands for feature f."""
    n = ratio.shape[1]
    met = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
    gain = met[:, None, :] - ratio
    phi = np.zeros(gain.shape)
    for t, w in zip(points, weights):
        factor = ratio + t * gain
        phi += gain / factor * (factor.prod(axis=2) * (w * value))[:, :, None]
    return phi


def _met_patterns(x, lower, upper) -> np.ndarray:
    """Per row and leaf the number of the pattern of met features."""
    code = np.zeros((len(x), len(lower)), np.int32)
    for f in range(x.shape[1]):
        column = x[:, f : f + 1]
        code |= ((column > lower[:, f]) & (column <= upper[:, f])).astype(np.int32) << f
    return code


def shap_values(model: ChurnModel, matrix: DataFrame, *, max_samples: int | None = None) -> DataFrame:
    """``(customer_id, base_value, rf_probability, phi)`` with one value per feature.

    ``base_value`` plus the values equals the forest's probability.
    Every row is explained unless ``max_samples`` asks for some. Rows are
    spread over tasks; each holds the leaves, at most ``MAX_LEAVES``.
    """
    spark = matrix.sparkSession
    features = list(model.features)
    if len(features) > MAX_FEATURES:
        raise ModelError(f"at most {MAX_FEATURES} features can be explained")
    nodes = store(forest_nodes(model, spark))
    if nodes.where("left < 0").count() > MAX_LEAVES:
        raise ModelError(f"the forest has more than {MAX_LEAVES:,} leaves; train fewer or shallower trees")
    leaves = forest_leaves(nodes, len(features)).toPandas().sort_values("tree", kind="stable")
    trees = leaves["tree"].nunique()
    stack = lambda c: np.array(leaves[c].tolist(), dtype=float)
    ratio = stack("ratio")
    value = leaves["value"].to_numpy() / trees
    base = float((value * ratio.prod(axis=1)).sum())
    points, weights = np.polynomial.legendre.leggauss((len(features) + 1) // 2)
    shared = spark.sparkContext.broadcast(
        (
            np.flatnonzero(np.diff(leaves["tree"], append=-1)) + 1,
            (value, stack("lower"), stack("upper"), ratio),
            ((points + 1) / 2, weights / 2),
        )
    )

    def explain(batches):
        ends, forest, quadrature = shared.value
        for batch in batches:
            x = batch[features].to_numpy(dtype=float)
            phi = np.zeros(x.shape)
            for start, end in zip([0, *ends[:-1]], ends):
                value, lower, upper, ratio = (a[start:end] for a in forest)
                table = _contributions(value, ratio, *quadrature)
                at = np.arange(len(value))
                for r in range(0, len(x), 256):
                    phi[r : r + 256] += table[_met_patterns(x[r : r + 256], lower, upper), at].sum(axis=1)
            yield pd.DataFrame(
                {
                    "customer_id": batch["customer_id"],
                    "base_value": base,
                    "rf_probability": batch["rf_probability"],
                    "phi": list(phi),
                }
            )

    rows = sample_rows(matrix, max_samples) if max_samples is not None else matrix
    scored = model.score(rows).select("customer_id", *features, "rf_probability")
    if max_samples is not None:
        # a limited result sits in one partition; spread its rows over the cores
        scored = scored.repartition(spark.sparkContext.defaultParallelism, "customer_id")
    return scored.mapInPandas(
        explain, "customer_id string, base_value double, rf_probability double, phi array<double>"
    )


def shap_long(shap: DataFrame, features) -> DataFrame:
    """``(customer_id, feature_name, phi)``."""
    entries = F.arrays_zip(
        F.array(*[F.lit(f) for f in features]).alias("feature_name"), F.col("phi")
    )
    return shap.select("customer_id", F.inline(entries).alias("feature_name", "phi"))


def shap_importance(shap: DataFrame, features) -> DataFrame:
    """``(feature_name, mean_abs_shap, rank)``, most influential first."""
    means = shap.agg(
        *[F.avg(F.abs(F.col("phi")[i])).alias(f) for i, f in enumerate(features)]
    ).unpivot([], list(features), "feature_name", "mean_abs_shap")
    order = Window.orderBy(F.desc("mean_abs_shap"), "feature_name")
    return means.withColumn("rank", F.row_number().over(order).cast("long"))


def top_features(importance: DataFrame, n: int = 7) -> DataFrame:
    return importance.orderBy("rank").limit(n)
