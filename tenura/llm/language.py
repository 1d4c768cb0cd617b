"""Language identification: averaged hashed subword embeddings under a linear softmax."""

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenura.llm.common import by_batch, held_out, unit_hash
from tenura.llm.ngrams import counted, hashed_blocks

UNKNOWN = "und"
ORDERS = range(2, 5)
BITS = 16
_LETTER = regex.compile(r"\p{L}")
_NO_LETTERS = regex.compile(r"\P{L}+")


def letters(text: str | None) -> bytes:
    """The words of a text, small, between single blanks; empty if it has no letter."""
    if not text or not _LETTER.search(text):
        return b""
    return b" " + _NO_LETTERS.sub(" ", text.lower()).strip().encode() + b" "


@dataclass
class LanguageModel:
    """``table`` holds, per bucket, the product of its embedding and the softmax weights."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0
    _columns: np.ndarray | None = None  # the table by language

    def logits(self, data: bytes) -> np.ndarray:
        columns = np.ascontiguousarray(self.table.T) if self._columns is None else self._columns
        self._columns = columns
        total, n = np.zeros(len(self.languages)), 0
        for block in hashed_blocks(data, ORDERS, BITS):
            total += [column.take(block).sum(dtype=np.float64) for column in columns]
            n += len(block)
        return total / max(n, 1) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated confidence, and whether that is too low to be believed."""
        data = letters(text)
        if not data or not self.languages:
            return UNKNOWN, 0.0, True
        p = softmax(self.logits(data) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] < self.reject_below)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _sgd(bags, classes, n_classes, dim, epochs, rate, seed):
    """Embeddings and softmax weights by stochastic gradient descent, a document a step."""
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 1 / dim, (1 << BITS, dim)).astype(np.float32)
    weights = rng.normal(0, 1 / dim, (dim, n_classes)).astype(np.float32)
    bias = np.zeros(n_classes, np.float32)
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            at, share = bags[i]
            step = rate * (1 - done / steps)
            mean = share @ embed[at]
            error = softmax(mean @ weights + bias)
            error[classes[i]] -= 1
            back = weights @ error
            weights -= step * np.outer(mean, error)
            bias -= 0.1 * step * error
            # each bucket moves in proportion to its share; the sum of squares
            # keeps the step's size the same for short and long texts
            embed[at] -= (step / float(share @ share)) * share[:, None] * back * 0.05
            done += 1
    return embed @ weights, bias


def _calibrate(
    model: LanguageModel, logits: np.ndarray, classes: np.ndarray, reject_rate: float, most: float = 0.4
) -> None:
    """Temperature of least log loss, and the confidence that at most ``reject_rate`` of the rows miss.

    The threshold is never above ``most``: a text of two languages is kept.
    """
    if not len(classes):
        return
    rows = np.arange(len(classes))
    temperatures = np.geomspace(0.05, 20, 121)
    loss = [-np.log(softmax(logits / t)[rows, classes] + 1e-12).mean() for t in temperatures]
    model.temperature = float(temperatures[int(np.argmin(loss))])
    confidence = softmax(logits / model.temperature).max(axis=1)
    model.reject_below = min(float(np.quantile(confidence, reject_rate, method="lower")), most)


def fit(
    docs: DataFrame,
    rows_per_language: int = 700,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    dim: int = 16,
    epochs: int = 8,
    rate: float = 0.5,
    reject_rate: float = 0.001,
    folds: int = 4,
) -> LanguageModel:
    """Train on at most ``rows_per_language`` whole texts of each language that are not held out.

    Rows are drawn by a hash of doc_id, text and place, so one id or one text
    on most rows does not bring them all. A fifth of them calibrates the
    confidence instead of training the weights. Rows with a null text or
    language are not learned from; without any other the model knows no
    language and answers ``und``.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), folds)
    )
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return LanguageModel([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0))
    languages = sorted(counts)
    # a first draw leaves about twice as many, so that few rows of a language meet
    draw = F.create_map(*[F.lit(x) for k in languages for x in (k, 2 * rows_per_language / counts[k])])
    drawn = rows.withColumn(
        "draw", unit_hash(F.col("doc_id"), F.crc32(F.col("text").cast("binary")), F.monotonically_increasing_id())
    ).where(F.col("draw") < draw[F.col("lang")])
    order = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    drawn = drawn.withColumn("nth", order).where(F.col("nth") <= rows_per_language)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        bags = [counted(letters(t), ORDERS, BITS) for t in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([at for at, _ in bags], pa.list_(pa.int32())),
                pa.array([(n / max(n.sum(), 1)).astype(np.float32) for _, n in bags], pa.list_(pa.float32())),
                batch.column(1),
                batch.column(2),
            ],
            ["at", "share", "lang", "calibrates"],
        )

    bags = drawn.select(
        "text", "lang", (F.col("nth") % 5 == 0).alias("calibrates")
    ).mapInArrow(by_batch(make), "at array<int>, share array<float>, lang string, calibrates boolean")
    got = bags.toArrow()
    number = {k: i for i, k in enumerate(languages)}
    classes = np.array([number[x] for x in got["lang"].to_pylist()], np.int64)
    calibrates = np.array(got["calibrates"].to_pylist(), bool)
    at, share = got["at"].combine_chunks(), got["share"].combine_chunks()
    cuts, ats, shares = at.offsets.to_numpy(), at.values.to_numpy(), share.values.to_numpy()
    pairs = [(ats[a:b], shares[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    full = np.array([len(p[0]) > 0 for p in pairs], bool)
    order = np.lexsort([[float(p[1].max()) if len(p[1]) else 0.0 for p in pairs], [len(p[0]) for p in pairs], classes])
    learn = [i for i in order if full[i] and not calibrates[i]]
    if not learn:
        learn = [i for i in order if full[i]]
    table, bias = _sgd(
        [pairs[i] for i in learn], classes[learn], len(languages), dim, epochs, rate, seed=7
    )
    model = LanguageModel(languages, table.astype(np.float32), bias.astype(np.float64))
    test = [i for i in order if full[i] and calibrates[i]]
    logits = np.array([pairs[i][1] @ table[pairs[i][0]] + bias for i in test]).reshape(len(test), len(languages))
    _calibrate(model, logits.astype(np.float64), classes[test], reject_rate)
    return model


def predict(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row.

    A null text, or one without a letter, is ``und`` with score 0 and
    rejected. The model (its table has 2**16 rows) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shared.value.predict(t) for t in batch.column(1).to_pylist()]
        columns = [list(c) for c in zip(*found, strict=True)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c) for c in columns)], ["doc_id", "lang_pred", "score", "rejected"]
        )

    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(by_batch(make), f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def rejected(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.predict(t)[2] for t in texts], dtype=bool)

    return docs.where(~rejected(F.col(text)))
