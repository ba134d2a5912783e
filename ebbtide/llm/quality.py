"""Text quality by compression: which labelled text helps to compress a document more?

Two zstandard dictionaries are built from pieces of good and of bad labelled
documents. A document is compressed with each; the size difference over the sum
of the sizes, with the plain ratio and the length, is calibrated to a
probability on labelled documents that the dictionaries have not seen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import lean

#: Labelled documents per class that training reads at most, those with the lowest hash.
SAMPLE_DOCS = 6000
#: Pieces per class that a dictionary is built from at most, and their bytes.
PIECES, PIECE_BYTES = 20_000, 512
DICTIONARY_BYTES = 512 << 10
#: Bytes of the stretches that a dictionary is put together from.
SEGMENT = 1024
LEVEL = 3


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold whose labels are never learned; a null id is not in it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]


class Sizer:
    """Compressed sizes with either dictionary and with none."""

    def __init__(self, good: bytes, bad: bytes):
        def of(raw: bytes | None):
            if not raw:
                return zstandard.ZstdCompressor(level=LEVEL)
            data = zstandard.ZstdCompressionDict(raw)
            data.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=data)

        self.ways = [of(good), of(bad), of(None)]

    def features(self, text: str | None) -> list[float]:
        data = (text or "").encode()
        good, bad, plain = (len(w.compress(data)) if data else 0 for w in self.ways)
        gain = (bad - good) / (bad + good + 1)
        length = float(np.log(len(data) + 1))
        return [gain, plain / (len(data) + 1), length, gain * length, gain * gain]


def dictionary(pieces: list[bytes]) -> bytes:
    """A trained dictionary, or the pieces themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, k=SEGMENT, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICTIONARY_BYTES:]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, steps: int = 100, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression by Newton steps that are
    halved until the loss falls; x has a column of ones."""
    weight = np.ones(len(y)) if weight is None else weight
    sign = 2 * y - 1

    def loss(w: np.ndarray) -> float:
        return float((weight * np.logaddexp(0, -sign * (x @ w))).sum() + ridge / 2 * (w @ w))

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - ridge * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > now:
            size /= 2
        if size <= 1e-6 or now - loss(w + size * step) < 1e-9 * (1 + now):
            break
        w = w + size * step
        now = loss(w)
    return w


def train(docs: DataFrame, labels: DataFrame, text: str = "text") -> Model:
    """Model from a bounded sample of the labelled rows outside the held-out fold.

    Rows of one id with contradicting or null labels are left out. One half of
    the sample builds the dictionaries, the other calibrates.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out()).groupBy("doc_id")
    known = known.agg(F.min("quality").alias("quality"), F.max("quality").alias("top")).where("quality = top")
    lot = F.xxhash64(F.lit("sample"), "doc_id")
    totals = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    picked = [known.where(F.col("quality") == q).orderBy(lot, "doc_id").limit(SAMPLE_DOCS) for q in (0, 1)]
    sample = picked[0].union(picked[1]).select(F.col("doc_id").alias("id"), "quality")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col(text).alias("body")).join(F.broadcast(sample), "id")
    calibrates = F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(2)) == 0

    def cut(batches):
        for batch in batches:
            for body, quality in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                data = (body.as_py() or "").encode()
                pieces = [data[i : i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]
                yield pa.RecordBatch.from_arrays([pa.array([quality] * len(pieces), pa.int32()), pa.array(pieces, pa.binary())], ["quality", "piece"])

    pieces = texts.where(~calibrates).select("body", F.col("quality").cast("int")).mapInArrow(lean(cut), "quality int, piece binary")
    raw = []
    for q in (1, 0):
        rows = pieces.where(F.col("quality") == q).select("piece").orderBy(F.xxhash64("piece"), "piece").limit(PIECES).collect()
        raw.append(dictionary([bytes(r["piece"]) for r in rows]))
    good, bad = raw

    def measure(batches):
        sizer = Sizer(good, bad)
        for batch in batches:
            rows = [sizer.features(b.as_py()) for b in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, pa.list_(pa.float64()))], ["quality", "x"])

    fit = texts.where(calibrates).select("body", F.col("quality").cast("int")).mapInArrow(lean(measure), "quality int, x array<double>").collect()
    fit.sort(key=lambda r: (r["quality"], r["x"]))
    if not fit:
        return Model(good, bad, (0.0,) * 5, (1.0,) * 5, (0.0,) * 6)
    x, y = np.array([r["x"] for r in fit]), np.array([r["quality"] for r in fit], float)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    # the sample holds the classes more evenly than the labels do
    share = np.array([totals[int(q)] / (y == q).sum() for q in y])
    weights = logistic(np.c_[np.ones(len(x)), (x - mean) / scale], y, share * len(y) / share.sum())
    return Model(good, bad, tuple(mean), tuple(scale), tuple(weights))


def _probabilities(texts: pa.Array, model: Model, sizer: Sizer) -> np.ndarray:
    x = np.array([sizer.features(b.as_py()) for b in texts]).reshape(-1, 5)
    z = np.c_[np.ones(len(x)), (x - np.array(model.mean)) / np.array(model.scale)] @ np.array(model.weights)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(docs: DataFrame, model: Model, name: str, text: str = "text") -> DataFrame:
    """`docs` without the text and with a new column, 0 to 1, for every whole text; null counts as empty."""
    others = [c for c in docs.columns if c != text]
    kinds = docs.select(*others).withColumn(name, F.lit(0.0)).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        m = shared.value
        sizer = Sizer(m.good, m.bad)
        for batch in batches:
            p = pa.array(_probabilities(batch[text], m, sizer), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in others), p], [*others, name])

    return docs.mapInArrow(lean(rows), kinds)


ACCEPT = 0.7


def quality_scores(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`, repeats included.

    Without labels of both classes the score is the share of good ones, or 0.5
    without any. Empty texts get the score that the calibration gives them.
    """
    scored = score(docs.select("doc_id", "text"), train(docs, labels), "_score")
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= accept).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT, text: str = "text") -> DataFrame:
    """The rows of `docs`, with their columns, that score at least `accept`;
    others do not leave the batch they were scored in."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, text))

    def rows(batches):
        m = shared.value
        sizer = Sizer(m.good, m.bad)
        for batch in batches:
            yield batch.filter(pa.array(_probabilities(batch[text], m, sizer) >= accept))

    return docs.mapInArrow(lean(rows), docs.schema)
