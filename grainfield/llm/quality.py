"""Quality classifier: random Fourier features of document statistics, ridge by summed normal equations, isotonic calibration.

Statistics of each whole text (shares of kinds of characters, word and line shape, repetition) are standardised and mapped
to random Fourier features, which approximate a Gaussian kernel. Each task adds up its normal equations, one set for each
fold; the sums solve the ridge regression of all folds but one, whose scores of the left-out fold are calibrated by pooling
adjacent violators over a fixed grid of scores. The model scored with is that of all folds.

The fit reads a bounded sample of the labelled rows (`most`, chosen by hash of the id); scoring covers every row.

Defined results: null and empty texts have the statistics of an empty text and get a score; labels that are null are not
learned from, of repeated labels the mean counts; without any label every score is 0.5; repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import aside, back, crc_mod, cut, slices, texts_of

FEATURES = 256
MOST_FITTED = 200_000
FIT_TASKS = 8
FOLDS = 4
PIECE = 4096
RIDGE = 1e-3
GRID = 2000
THRESHOLD = 0.3
_LOW, _HIGH = -0.5, 1.5

#: Kinds of bytes: 0 other ASCII, 1 a-z, 2 A-Z, 3 0-9, 4 space and tab, 5 line ends, 6 sentence marks, 7 quotes and brackets, 8 not ASCII, 9 control
_KIND = np.array([4 if c in b" \t" else 5 if c in b"\n\r" else 9 if c < 32 else 3 if 48 <= c <= 57 else 2 if 65 <= c <= 90 else 1 if 97 <= c <= 122 else 8 if c > 127 else 6 if c in b".,;:?" else 7 if c in b"\"'()-" else 0 for c in range(256)])
_KINDS = np.zeros((256, 10))
_KINDS[np.arange(256), _KIND] = 1


def statistics(text: bytes) -> list[float]:
    """Statistics of one whole text; all are finite for any text."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n = max(1, len(text))
    share = counts / n
    kinds = share @ _KINDS
    used = share[share > 0]
    words = text.split()
    w = max(1, len(words))
    distinct = len(set(words))
    lines = text.count(b"\n") + 1
    letters = max(1e-9, kinds[1] + kinds[2])
    return [
        *kinds.tolist(),
        np.log1p(len(text)),
        np.log1p(len(words)),
        np.log1p(sum(map(len, words)) / w),
        distinct / w,
        np.log1p(len(words) / lines),
        kinds[2] / letters,
        share[124] * 10,  # |
        share[33] * 10,  # !
        float(share[[35, 36, 37, 38, 42, 60, 61, 62, 64, 94, 95, 123, 125, 126]].sum()) * 10,
        float(-(used * np.log2(used)).sum()),
        float(share[1:32].max(initial=0)),
    ]


N_STATS = len(statistics(b""))


def with_statistics(docs: DataFrame, text: str = "text", keep: list[Column | str] = ("doc_id",)) -> DataFrame:
    """The kept columns and stats array<double>: one pass, no shuffle."""
    kept = docs.select(*keep, F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            stats = pa.array([statistics(t) for t in texts_of(batch.column("__text"))], pa.list_(pa.float64()))
            yield pa.record_batch([*batch.columns[:-1], stats], names=[*batch.schema.names[:-1], "stats"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields[:-1], T.StructField("stats", T.ArrayType(T.DoubleType()))]))


@dataclass
class Quality:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None  # None: no labels, every score is `base`
    knots: np.ndarray  # scores before calibration, rising
    values: np.ndarray  # and after
    base: float = 0.5

    def features(self, stats: np.ndarray) -> np.ndarray:
        return fourier((stats - self.mean) / self.scale)

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), self.base)
        raw = self.features(stats) @ self.weights
        # a thousandth of the score keeps the order within levels
        return 0.999 * np.interp(raw, self.knots, self.values) + 0.001 / (1 + np.exp(-4 * (np.clip(raw, -20, 20) - 0.5)))


def fourier(z: np.ndarray, n: int = FEATURES, seed: int = 20240501) -> np.ndarray:
    """cos(wz + b) with w of a Gaussian kernel whose width is the dimension, and a constant."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], n - 1)), rng.uniform(0, 2 * np.pi, n - 1)
    return np.hstack([np.sqrt(2 / n) * np.cos(np.clip(z, -8, 8) @ w + b), np.ones((len(z), 1))])


def _stack(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), N_STATS)


def _summed(rows: DataFrame, of) -> np.ndarray | None:
    """Element-wise sums over all rows of of(stats, y, fold). Each task sends one array in pieces, pieces are added up
    piece by piece, and one array reaches the driver, however many tasks there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(_stack(batch.column("stats")), np.asarray(batch.column("y"), np.float64), np.asarray(batch.column("fold"), np.int64))
                total = part if total is None else total + part
        if total is not None:
            pieces = np.array_split(total, -(-len(total) // PIECE))
            yield pa.record_batch({"piece": pa.array(range(len(pieces)), pa.int32()), "total": pa.array([x.tobytes() for x in pieces], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.float64) for x in table.column("total").to_pylist()]
        return pa.table({"piece": table.column("piece")[:1], "total": pa.array([np.sum(parts, axis=0).tobytes()], pa.binary())})

    schema = "piece int, total binary"
    found = rows.mapInArrow(run, schema).groupBy("piece").applyInArrow(add, schema).collect()
    return np.concatenate([np.frombuffer(r.total, np.float64) for r in sorted(found, key=lambda r: r.piece)]) if found else None


def pooled(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Isotonic regression: adjacent violators pooled."""
    blocks: list[list[float]] = []
    for v, w in zip(values.tolist(), weights.tolist(), strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks[-1]
            blocks[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.repeat([b[0] for b in blocks], [b[2] for b in blocks])


def fit(stats: DataFrame, labels: DataFrame, id: str = "doc_id", label: str = "quality", most: int = MOST_FITTED) -> Quality:
    """Learn from rows of stats (id, stats) that have a label. Callers leave out what is held out."""
    known = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull()).groupBy(F.col(id).alias(id)).agg(F.avg(F.col(label).cast("double")).alias("y"))
    rows = stats.join(known, id).select("stats", "y", F.pmod(F.xxhash64(F.col(id), F.lit(1)), F.lit(FOLDS)).alias("fold"), F.pmod(F.xxhash64(F.col(id), F.lit(2)), F.lit(1_000_000)).alias("draw"))
    rows = cut(rows, "labelled")
    share = min(1.0, most / max(1, rows.count()))
    rows = rows.where(F.col("draw") < share * 1_000_000).repartition(FIT_TASKS)
    moments = _summed(rows, lambda x, y, fold: np.concatenate([[len(x), y.sum()], x.sum(0), (x * x).sum(0)]))
    if moments is None:
        return Quality(np.zeros(N_STATS), np.ones(N_STATS), None, np.zeros(1), np.zeros(1))
    n, positive = moments[:2]
    mean = moments[2 : 2 + N_STATS] / n
    scale = np.sqrt(np.maximum(moments[2 + N_STATS :] / n - mean**2, 0))
    scale[scale < 1e-9] = 1.0

    def equations(x, y, fold):
        z = fourier((x - mean) / scale)
        both = np.hstack([z, y[:, None]])
        return np.concatenate([(z[fold == f].T @ both[fold == f]).ravel() for f in range(FOLDS)])

    sums = _summed(rows, equations).reshape(FOLDS, FEATURES, FEATURES + 1)

    def solve(total):
        a = total[:, :-1] + RIDGE * max(1.0, n / 1000) * np.eye(FEATURES)
        return np.linalg.solve(a, total[:, -1])

    left_out = np.array([solve(sums.sum(0) - sums[f]) for f in range(FOLDS)])

    def histogram(x, y, fold):
        raw = (fourier((x - mean) / scale) * left_out[fold]).sum(1)
        bins = np.clip(((raw - _LOW) / (_HIGH - _LOW) * GRID).astype(np.int64), 0, GRID - 1)
        return np.concatenate([np.bincount(bins, minlength=GRID), np.bincount(bins, weights=y, minlength=GRID), np.bincount(bins, weights=raw, minlength=GRID)])

    count, good, raw = _summed(rows, histogram).reshape(3, GRID)
    there = np.flatnonzero(count)
    level = pooled(good[there] / count[there], count[there])
    return Quality(mean, scale, solve(sums.sum(0)), raw[there] / count[there], level, positive / n)


def score(stats: DataFrame, model: Quality, threshold: float = THRESHOLD) -> DataFrame:
    """The columns beside stats, with score and predicted."""
    shared = stats.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in stats.schema.fields if f.name not in ("stats", "score", "predicted")]
    rows = stats.select(*[f.name for f in kept], "stats")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.score(_stack(batch.column("stats")))
            yield pa.record_batch([*batch.columns[:-1], pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], names=[*batch.schema.names[:-1], "score", "predicted"])

    return rows.mapInArrow(run, T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", held_out: int | None = 5) -> tuple[Quality, DataFrame]:
    """A model of the labelled documents (without those whose crc32(id) mod held_out is 0), and the written statistics of all."""
    stats = cut(with_statistics(docs, text, [id]), "statistics")
    seen = stats.where(crc_mod(id, held_out) != 0) if held_out else stats
    return fit(seen, labels, id), stats


def reject(docs: DataFrame, model: Quality, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with a score of at least threshold, columns (whatever their names) and whole texts as they were."""
    own, names = aside(docs)
    stats = with_statistics(own, names[text], [*names.values()])
    return back(score(stats, model, threshold).where(F.col("predicted") == 1), names)
