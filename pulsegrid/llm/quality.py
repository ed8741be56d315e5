"""Quality classifier: random Fourier features, ridge by partition-summed normal equations, isotonic calibration.

Statistics of the whole text (lengths, character classes, repetition, line shape) are standardised and
lifted by random Fourier features of a Gaussian kernel. Each partition of the labelled sample sums its
normal equations per fold; their totals (a fixed size, whatever the rows) give one ridge model per
left-out fold and one over all. Out-of-fold scores, counted in fixed bins, are calibrated by
pool-adjacent-violators. The sample is bounded by ``max_train`` labelled rows, taken by a hash of the
id; every document is scored. Ids, language, source and labels are never features.

Null and empty texts have all-zero statistics and get a score like any other. Rows without a label are
not learned from; without any usable label every score is 0.5. Repeated rows are scored one by one.
Other columns are ignored by ``score_quality`` and kept by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, table

THRESHOLD = 0.3
FEATURES, FOLDS, GRID = 192, 4, 2000
_B = np.arange(256)
_LETTER = ((_B | 32) >= 97) & ((_B | 32) <= 122)
_CLASSES = np.stack(
    [
        (_B >= 65) & (_B <= 90), (_B >= 97) & (_B <= 122), (_B >= 48) & (_B <= 57), _B >= 128, np.isin(_B, list(b" \t")), np.isin(_B, list(b"\r\n")),
        np.isin(_B, list(b".,;:")), np.isin(_B, list(b"!?")), np.isin(_B, list(b"#$%&*")), np.isin(_B, list(b"|<>{}[]\\/=_")), np.isin(_B, list(b"()\"'-@+")),
    ]
)
N_STATS = len(_CLASSES) + 11


def statistics(text: str | None) -> np.ndarray:
    raw = (text or "").encode()
    words = raw.lower().split()
    out = np.zeros(N_STATS, np.float64)
    if not words:
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = counts / len(raw)
    out[: len(_CLASSES)] = np.sqrt(_CLASSES @ share)
    p = share[share > 0]
    n, lines = len(words), raw.split(b"\n")
    lengths = np.fromiter(map(len, words), np.int64, n)
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    distinct = len(set(words))
    out[len(_CLASSES) :] = (
        np.log1p(n), lengths.mean() / 10, lengths.std() / 10, distinct / n, np.log(distinct) / np.log(n + 1),
        sum(map(eq, words, words[1:])) / n, -(p * np.log(p)).sum(), np.log1p(len(lines)), np.log1p(sizes.mean()), len(set(lines)) / len(lines), lengths.max() ** 0.5 / 10,
    )
    return out


def crc_mod(id_col: str, by: int) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % by


class Model:
    def __init__(self, mean: np.ndarray, std: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.std = mean, std
        self.w = rng.normal(size=(len(mean), FEATURES)) / np.sqrt(len(mean)) * 1.2
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)
        self.coef, self.x, self.y = np.zeros(FEATURES + 1), np.array([0.0, 1.0]), np.array([0.5, 0.5])

    def lift(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.std, -5, 5)
        return np.hstack([np.cos(z @ self.w + self.b) * np.sqrt(2 / FEATURES), np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.lift(stats) @ self.coef

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = self.raw(stats)
        smooth = 1 / (1 + np.exp(-6 * (raw - 0.5)))  # keeps the order within a calibrated step
        return np.clip(0.99 * np.interp(raw, self.x, self.y) + 0.01 * smooth, 0, 1)


def ridge(gram: np.ndarray, right: np.ndarray, n: float, strength: float) -> np.ndarray:
    penalty = np.eye(len(gram)) * strength * max(n, 1) ** 0.5
    penalty[-1, -1] = 1e-9
    return np.linalg.solve(gram + penalty, right)


def isotonic(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: means y with weights n to the nearest non-decreasing sequence."""
    blocks: list[list[float]] = []
    for v, w in zip(y, n, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, k2 = blocks.pop()
            v1, w1, k1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, k1 + k2])
    return np.concatenate([[v] * k for v, _, k in blocks]) if blocks else np.array([])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATS) if len(column) else np.zeros((0, N_STATS))


def document_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: _id, _stats."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            stats = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(stats, pa.list_(pa.float64()))], names=["_id", "_stats"])

    return docs.select(id_col, text_col).mapInArrow(run, f"_id {kind}, _stats array<double>")


def fit(
    stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", hold_out: int = 5, max_train: int = 40_000, parts: int = 8, strength: float = 0.02
) -> Model:
    """Learn from at most about max_train labelled rows of stats whose crc32(id) mod hold_out is not 0."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y")).dropna().filter(crc_mod("_id", hold_out) != 0)
    n = known.count()
    keep = F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, max_train / max(n, 1)))
    sample = materialize(stats.join(known.filter(keep).groupBy("_id").agg(F.avg("_y").alias("_y")), "_id").withColumn("_fold", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(FOLDS)).cast("int")))
    sample = sample.select("_stats", "_y", "_fold").repartition(parts)
    moments = [f(F.col("_stats")[k]).alias(f"{f.__name__}{k}") for k in range(N_STATS) for f in (F.avg, F.stddev_pop)]
    row = sample.agg(*moments).first()
    mean, std = (np.array([row[f"{f}{k}"] if row[f"{f}{k}"] is not None else 0.0 for k in range(N_STATS)]) for f in ("avg", "stddev_pop"))
    model = Model(mean, np.where(std > 1e-9, std, 1.0))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = FEATURES + 1
        gram, right, rows = np.zeros((FOLDS, d, d)), np.zeros((FOLDS, d)), np.zeros(FOLDS)
        for batch in batches:
            x, y, fold = model.lift(_matrix(batch.column(0))), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for k in range(FOLDS):
                xs, ys = x[fold == k], y[fold == k]
                gram[k] += xs.T @ xs
                right[k] += xs.T @ ys
                rows[k] += len(ys)
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()]), pa.array([right.tobytes()]), pa.array([rows.tobytes()])], names=["g", "r", "n"])

    gram, right, rows = 0.0, 0.0, 0.0
    for g, r, n in sample.mapInArrow(sums, "g binary, r binary, n binary").toLocalIterator():  # `parts` rows of a fixed size
        gram = gram + np.frombuffer(g).reshape(FOLDS, FEATURES + 1, FEATURES + 1)
        right, rows = right + np.frombuffer(r).reshape(FOLDS, -1), rows + np.frombuffer(n)
    if not np.sum(rows):
        return model
    total = gram.sum(0), right.sum(0), rows.sum()
    folds = [ridge(total[0] - gram[k], total[1] - right[k], total[2] - rows[k], strength) for k in range(FOLDS)]
    model.coef = ridge(*total, strength)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, fold = model.lift(_matrix(batch.column(0))), batch.column(2).to_numpy()
            raw = np.zeros(len(x))
            for k in range(FOLDS):
                raw[fold == k] = x[fold == k] @ folds[k]
            at = np.clip(np.round((raw + 0.5) / 2 * GRID), 0, GRID).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1)], names=["at", "y"])

    bins = sample.mapInArrow(binned, "at long, y double").groupBy("at").agg(F.avg("y"), F.count(F.lit(1))).orderBy("at").collect()  # at most GRID + 1
    at, y, n = (np.array(c, float) for c in zip(*bins, strict=True))
    model.x, model.y = at / GRID * 2 - 0.5, isotonic(y, n)
    return model


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", hold_out: int = 5, **how) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted."""
    stats = materialize(document_statistics(docs, id_col, text_col))
    model = docs.sparkSession.sparkContext.broadcast(fit(stats, labels, id_col, label_col, hold_out, **how))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.score(_matrix(batch.column(1))))], names=["doc_id", "score"])

    scored = stats.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", (crc_mod("doc_id", hold_out) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", hold_out: int = 5, **how) -> DataFrame:
    """The rows of docs scored THRESHOLD or more; texts are read twice but never shuffled."""
    stats = materialize(document_statistics(docs, id_col, text_col))
    model = docs.sparkSession.sparkContext.broadcast(fit(stats, labels, id_col, label_col, hold_out, **how))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            if texts:
                score = model.value.score(np.stack([statistics(t) for t in texts]))
                yield batch.filter(pa.array(score >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
