"""Quality classifier: random Fourier features, ridge regression from partition sums, isotonic calibration.

Statistics of whole documents are computed once and stored. Labelled rows give the normal equations of a
ridge regression on random Fourier features of the standardised statistics (an approximate Gaussian
kernel), summed by partition and then by cell, so the driver gets one small matrix whatever the
input. A part of the labelled rows is kept out of that fit and gives, as counts by score bin, the
isotonic curve that turns raw scores into probabilities.

Defined results: a null text counts as empty and is scored; a null doc_id is never a labelled row and is not
held out; a document with several labels counts with the greatest; labels that are null are no labels; without
labels of both kinds every score is their mean (0.5 without any); an empty table gives an empty
table; repeated rows are scored each, and teach each where their id is labelled; very long texts are read whole; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

FEATURES = 192
RIDGE = 1e-3
SEED = 7
BINS = 1000
THRESHOLD = 0.7
_SYMBOLS = list(b"#*$%&|<>")
N_STATISTICS = 18


def statistics(text: str | None) -> list[float]:
    """Fixed number of figures of one text."""
    raw = (text or "").encode("utf-8", "replace")
    n = max(len(raw), 1)
    words = raw.split()
    m = max(len(words), 1)
    of = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    upper, lower = int(of[65:91].sum()), int(of[97:123].sum())
    grams = len(set(zip(words, words[1:], words[2:], strict=False)))
    return [
        np.log1p(len(raw)), np.log1p(len(words)), float(sizes.mean()), float(np.log1p(sizes.max())), upper / (upper + lower + 1),
        float(of[_SYMBOLS].sum()) / n, float(of[33]) / m, float(of[124]) / m, float(of[48:58].sum()) / n, float(of[[44, 46, 58, 59]].sum()) / m,
        float(of[128:].sum()) / n, len(set(words)) / m, max(Counter(words).values(), default=0) / m, 1 - len(set(lines)) / max(len(lines), 1),
        1 - grams / max(len(words) - 2, 1) if len(words) > 2 else 0.0, np.log1p(m / max(len(lines), 1)), np.log1p(m / (1 + int(of[46]))), float((sizes <= 3).mean()),
    ]


def with_statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    names = [f"x{k}" for k in range(N_STATISTICS)]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column(1)], np.float64).reshape(-1, N_STATISTICS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in x.T)], names=["doc_id", *names])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(of, "doc_id long, " + ", ".join(f"{n} double" for n in names))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phases: np.ndarray
    beta: np.ndarray
    at: np.ndarray
    value: np.ndarray

    def design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.ones((len(z), 1)), z, np.sqrt(2 / len(self.phases)) * np.cos(z @ self.weights + self.phases)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.design(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.at, self.value)


def isotonic(at: np.ndarray, n: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools neighbours until the rates rise; centre and rate of each pool."""
    pools: list[list[float]] = []
    for x, k, p in zip(at.tolist(), n.tolist(), positive.tolist(), strict=True):
        pools.append([x * k, k, p])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[1] for p in pools]), np.array([p[2] / p[1] for p in pools])


def _matrix(rows: Iterator[pa.RecordBatch]) -> np.ndarray:
    return np.vstack([np.column_stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(b.num_columns)]) for b in rows])


def fit(labelled: DataFrame, calibration: DataFrame, moments: tuple[np.ndarray, np.ndarray], features: int = FEATURES, ridge: float = RIDGE, seed: int = SEED) -> Model:
    """labelled, calibration: columns x0.. and y. moments: mean and scale of each statistic."""
    rng = np.random.default_rng(seed)
    weights = rng.normal(size=(N_STATISTICS, features)) / np.sqrt(N_STATISTICS)
    model = Model(*moments, weights, rng.uniform(0, 2 * np.pi, features), np.zeros(1 + N_STATISTICS + features), np.array([0.0]), np.array([0.5]))
    size = len(model.beta)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            if batch.num_rows:
                m = _matrix([batch])
                z = model.design(m[:, :-1])
                total += z.T @ np.column_stack([z, m[:, -1]])
        if total[0, 0]:
            cells = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(cells[0].ravel()), pa.array(cells[1].ravel()), pa.array(total.ravel())], names=["r", "c", "v"])

    cells = labelled.mapInArrow(sums, "r long, c long, v double").groupBy("r", "c").agg(F.sum("v")).collect()  # size * (size + 1) cells
    total = np.zeros((size, size + 1))
    for r, c, v in cells:
        total[r, c] = v
    count, positive = total[0, 0], total[0, -1]
    if not count or positive in (0, count):
        model.value = np.array([positive / count if count else 0.5])
        return model
    model.beta = np.linalg.solve(total[:, :-1] + ridge * count * np.eye(size), total[:, -1])

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = _matrix([batch])
                bins = np.clip(np.round(model.raw(m[:, :-1]) * BINS), -BINS, 2 * BINS).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(m[:, -1])], names=["bin", "y"])

    curve = calibration.mapInArrow(raw, "bin long, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("p")).orderBy("bin").collect()  # 3 * BINS + 1 at most
    if curve:
        bins, n, p = (np.array(x, float) for x in zip(*curve, strict=True))
        model.at, model.value = isotonic(bins / BINS, n, p)
    else:
        model.at, model.value = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text", label_id_column: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs. Rows whose crc32 of the id mod 4 is 2 never teach; 3 calibrates."""
    remainder = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4, F.lit(0))
    x = stored(with_statistics(docs, id_column, text_column), "statistics")
    names = [f"x{k}" for k in range(N_STATISTICS)]
    moments = x.agg(*(F.avg(n) for n in names), *(F.stddev_pop(n) for n in names)).first()
    mean, scale = (np.array([v or 0.0 for v in part]) for part in (moments[:N_STATISTICS], moments[N_STATISTICS:]))
    scale[scale < 1e-9] = 1.0
    y = labels.filter(F.col(label).isNotNull()).groupBy(F.col(label_id_column).alias("__id")).agg(F.max(label).cast("double").alias("y"))
    known = stored(x.join(y, F.col("doc_id") == F.col("__id")).filter(remainder != 2).select(*names, "y", (remainder == 3).alias("calibrates")), "labelled")
    model = fit(known.filter(~F.col("calibrates")).select(*names, "y"), known.filter("calibrates").select(*names, "y"), (mean, scale))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = model.score(_matrix([pa.RecordBatch.from_arrays(batch.columns[1:], names=names)]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = x.mapInArrow(score, "doc_id long, score double, predicted int")
    return scored.select("doc_id", (remainder == 2).alias("held_out"), "score", "predicted")
