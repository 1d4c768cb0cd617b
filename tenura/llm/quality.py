"""Text quality by support vectors over n-gram indicators scaled with class log-count ratios."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenura.llm.common import by_batch, held_out, unit_hash
from tenura.llm.ngrams import distinct

ORDERS = range(1, 5)
BITS = 18
SOFT = 10.0  # added to squared row lengths, so that a short text's few n-grams weigh little


def indicators(text: str | None) -> np.ndarray:
    """Buckets of the byte n-grams that occur; a word equal to the one before it is written as one sign."""
    words = (text or "").encode().split(b" ")
    if len(words) > 1:
        words = words[:1] + [b"\x01" if w == v and w else w for v, w in zip(words, words[1:], strict=False)]
    return distinct(b" ".join(words), ORDERS, BITS)


@dataclass
class QualityModel:
    """Hinge-loss weights times log-count ratios (``weights``), squared ratios, bias, and a sigmoid of the margin."""

    weights: np.ndarray
    ratio_squares: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, at: np.ndarray) -> float:
        size = np.sqrt(SOFT + float(self.ratio_squares[at].sum(dtype=np.float64)))
        return float(self.weights[at].sum(dtype=np.float64) / size) + self.bias

    def score(self, text: str | None) -> float:
        margin = self.margin(indicators(text))
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500))))


def log_count_ratios(rows: list[np.ndarray], positive: np.ndarray, buckets: int, alpha: float = 1.0) -> np.ndarray:
    """Per bucket, the log ratio of its smoothed share among the two classes' indicators."""
    counts = np.full((2, buckets), alpha)
    for at, label in zip(rows, positive.astype(int), strict=True):
        counts[label][at] += 1
    counts /= counts.sum(axis=1, keepdims=True)
    return np.log(counts[1] / counts[0])


def dual_coordinate_descent(
    rows: list[np.ndarray], values: np.ndarray, signs: np.ndarray, costs: np.ndarray, epochs: int, seed: int = 5
) -> tuple[np.ndarray, float]:
    """Weights and bias of least hinge loss plus half their squared norm, for scaled rows and a constant one.

    Each step solves one row's dual variable exactly within [0, cost] and moves
    the weights by the difference. An epoch without progress ends the descent.
    """
    weights = np.zeros(len(values))
    alphas = np.zeros(len(rows))
    bias = 0.0
    squares = [float((values[at] ** 2).sum()) for at in rows]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            at = rows[i]
            x = values[at] / np.sqrt(SOFT + squares[i])
            length = 1 + squares[i] / (SOFT + squares[i])
            slack = 1 - signs[i] * (float(weights[at] @ x) + bias)
            best = min(max(alphas[i] + slack / length, 0.0), costs[i])
            step = best - alphas[i]
            if step:
                weights[at] += step * signs[i] * x
                bias += step * signs[i]
                alphas[i] = best
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return weights, bias


def _sigmoid_fit(margins: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the sigmoid with the least log loss, by Newton steps; targets are kept off 0 and 1."""
    n1, n0 = positive.sum(), (~positive).sum()
    target = np.where(positive, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.column_stack([margins, np.ones(len(margins))])
    w = np.array([1.0, np.log((n1 + 1) / (n0 + 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - target) + 1e-3 * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w -= step / max(1.0, float(np.abs(step).max()) / 5)
    return float(w[0]), float(w[1])


def train(rows: list[np.ndarray], positive: np.ndarray, cost: float = 1.0, epochs: int = 15) -> QualityModel:
    """Fit on bucket lists and labels; every fifth row sets the sigmoid instead of the weights.

    With one class only, or none, every text gets the smoothed share of label 1.
    """
    buckets = 1 << BITS
    share = (positive.sum() + 1) / (len(positive) + 2)
    if len(set(positive.tolist())) < 2:
        none = np.zeros(buckets, np.float32)
        return QualityModel(none, none, 0.0, 0.0, float(np.log(share / (1 - share))))
    checks = np.arange(len(rows)) % 5 == 0
    if len(set(positive[checks].tolist())) < 2 or len(set(positive[~checks].tolist())) < 2:
        checks, learns = np.ones(len(rows), bool), np.ones(len(rows), bool)
    else:
        learns = ~checks
    chosen = [rows[i] for i in np.flatnonzero(learns)]
    labels = positive[learns]
    ratios = log_count_ratios(chosen, labels, buckets)
    each = len(labels) / 2 / np.array([max((~labels).sum(), 1), max(labels.sum(), 1)])
    weights, bias = dual_coordinate_descent(
        chosen, ratios, np.where(labels, 1.0, -1.0), cost * each[labels.astype(int)], epochs
    )
    model = QualityModel((weights * ratios).astype(np.float32), (ratios**2).astype(np.float32), bias, 1.0, 0.0)
    margins = np.array([model.margin(rows[i]) for i in np.flatnonzero(checks)])
    model.slope, model.shift = _sigmoid_fit(margins, positive[checks])
    return model


def fit(
    docs: DataFrame,
    labels: DataFrame,
    rows_per_class: int = 2500,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    folds: int = 4,
) -> QualityModel:
    """Train on at most ``rows_per_class`` labelled whole texts of each class that are not held out.

    Ids are drawn by a hash, and of rows with the same id one. Labels that are
    null, or not 0 or 1, are no labels; a document with both is drawn with
    both. A null text counts as empty.
    """
    known = (
        labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds))
        .distinct()
    )
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return train([], np.zeros(0, bool))
    draw = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, 2 * rows_per_class / n)])
    by_hash = Window.partitionBy("label").orderBy(unit_hash(F.col("doc_id")), "doc_id")
    drawn = known.where(unit_hash(F.col("doc_id")) < draw[F.col("label")])
    drawn = drawn.withColumn("nth", F.row_number().over(by_hash)).where(F.col("nth") <= rows_per_class).drop("nth")

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [indicators(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(rows, pa.list_(pa.int32())), batch.column(2)], ["doc_id", "at", "label"]
        )

    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    # at most 2 * rows_per_class ids are broadcast; each task passes on one row of an id
    of_id = Window.partitionBy("doc_id", "label").orderBy("hash")
    got = (
        texts.join(F.broadcast(drawn), "doc_id")
        .withColumn("hash", F.xxhash64("text"))
        .withColumn("nth", F.row_number().over(of_id))
        .where("nth = 1")
        .select("doc_id", "text", "label")
        .mapInArrow(by_batch(make), f"doc_id {kind}, at array<int>, label int")
        .toArrow()
    )
    at = got["at"].combine_chunks()
    cuts, values = at.offsets.to_numpy(), at.values.to_numpy()
    labels_got = np.array(got["label"].to_pylist(), int)
    order = np.lexsort([np.diff(cuts), labels_got, np.array([str(x) for x in got["doc_id"].to_pylist()])])
    return train([values[cuts[i] : cuts[i + 1]] for i in order], labels_got[order] == 1)


def score(
    docs: DataFrame,
    model: QualityModel,
    threshold: float = 0.7,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 is likelier) and predicted (score >= threshold) of every row.

    A null text counts as empty; an empty one has the score of the bias alone.
    Equal texts have equal scores, whatever their ids; whole texts are read,
    block by block where they are very long.
    The model (two arrays of 2**18 numbers) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = np.array([shared.value.score(t) for t in batch.column(1).to_pylist()])
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
            ["doc_id", "score", "predicted"],
        )

    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(by_batch(make), f"doc_id {kind}, score double, predicted int")
