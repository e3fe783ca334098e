"""Toxicity: linear classifier of character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from encore.sources.workspace import cut

SIZES = (3, 4, 5)
BITS = 20
FEATURES = 4096
TRAIN_ROWS = 6000
THRESHOLD = 0.3
BLOCK_CHARS = 1 << 20


@dataclass
class Model:
    """Feature number of each bucket (-1: none), weight of each feature, and bias."""

    table: np.ndarray
    weights: np.ndarray
    bias: float


def _blocks(column: pa.Array):
    """Runs of texts as code points with a space around each: (first row, code points, bounds)."""
    texts = [f" {(x or '').lower()} " for x in column.to_pylist()]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    lo = 0
    while lo < len(texts):
        at = ends[lo] - lengths[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, at + BLOCK_CHARS, "right")))
        hi = min(hi, lo + 60_000)
        raw = "".join(texts[lo:hi]).encode("utf-32-le", "surrogatepass")
        yield lo, np.frombuffer(raw, np.uint32), np.concatenate(([0], ends[lo:hi] - at))
        lo = hi


def _buckets(points: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each place; white space counts as a space."""
    points = np.where((points >= 9) & (points <= 13), np.uint32(32), points)
    h = np.full(max(0, len(points) - n + 1), n, np.uint32)
    with np.errstate(over="ignore"):
        for k in range(n):
            h *= np.uint32(0x01000193)
            h += points[k : k + len(h)]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(12)
        h *= np.uint32(0x297A2D39)
    return h >> np.uint32(32 - BITS)


def _present(points: np.ndarray, bounds: np.ndarray, table: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket), or (row, feature) of a table, sorted."""
    keys = []
    for n in SIZES:
        found = _buckets(points, n)
        if table is None:
            at = np.arange(len(found))
        else:
            found = table[found]
            at = np.flatnonzero(found >= 0)
            found = found[at]
        rows = np.searchsorted(bounds, at, "right") - 1
        whole = at + n <= bounds[rows + 1]
        keys.append((rows[whole] << 32) | found[whole].astype(np.int64))
    keys = np.unique(np.concatenate(keys))
    return keys >> 32, keys & 0xFFFFFFFF


def training_rows(labels: DataFrame, key: str = "doc_id", label: str = "toxic", rows: int = TRAIN_ROWS) -> DataFrame:
    """(key, label) of at most ``rows`` labelled documents, the first in the order of a hash.

    Null labels are left out; of repeated keys the highest label counts.
    """
    one = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("_label"))
    return one.orderBy(F.xxhash64(F.lit(5), F.col(key)), key).limit(rows)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS, features: int = FEATURES) -> Model:
    """Fit on at most ``rows`` labelled documents, a bound that is a parameter.

    Tasks count in how many documents of each label a bucket occurs; the ratios of
    these counts, in logarithms, scale the features, and the ``features`` buckets whose
    ratio differs most from zero for its counts are kept. The weights are a logistic
    regression on presence times ratio. Counts of at most 2**BITS buckets and the kept
    features of at most ``rows`` documents come to the driver. Without documents of
    both labels every score is one half.
    """
    picked = F.broadcast(training_rows(labels, key, label, rows).withColumnRenamed(key, "_picked"))
    train = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(
        picked, F.col("_key") == F.col("_picked")
    ).select("_key", "_label", "_text")

    def count(batches):
        seen = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            labels_ = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, points, bounds in _blocks(batch.column(2)):
                row, bucket = _present(points, bounds, None)
                for k in (0, 1):
                    seen[k] += np.bincount(bucket[labels_[lo + row] == k], minlength=1 << BITS).astype(np.int32)
        at = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(at.astype(np.int32)), pa.array(seen[0, at].astype(np.int64)), pa.array(seen[1, at].astype(np.int64))],
            names=["bucket", "n0", "n1"],
        )

    spread = cut(train.repartition(8, "_key"))
    sums = spread.mapInArrow(count, "bucket int, n0 bigint, n1 bigint").groupBy("bucket").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1")
    ).where("n0 + n1 >= 3").toArrow()
    bucket, n0, n1 = (sums.column(k).to_numpy().astype(np.int64) for k in range(3))
    table = np.full(1 << BITS, -1, np.int16)
    if not len(bucket):
        return Model(table, np.zeros(0), 0.0)
    order = np.argsort(bucket)
    bucket, n0, n1 = bucket[order], n0[order], n1[order]
    ratio = np.log((n1 + 1) / (n1.sum() + 1)) - np.log((n0 + 1) / (n0.sum() + 1))
    ratio -= np.median(ratio)
    sure = np.abs(ratio) / np.sqrt(1 / (n1 + 1) + 1 / (n0 + 1))
    kept = np.sort(np.argsort(-sure, kind="stable")[:features])
    table[bucket[kept]] = np.arange(len(kept))
    ratio = ratio[kept]

    def extract(batches):
        for batch in batches:
            for lo, points, bounds in _blocks(batch.column(2)):
                row, feature = _present(points, bounds, table)
                ends = np.searchsorted(row, np.arange(len(bounds)))
                part = batch.slice(lo, len(bounds) - 1)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(feature.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], names=["_key", "_label", "at"])

    kind = train.schema["_key"].dataType.simpleString()
    found = spread.mapInArrow(extract, f"_key {kind}, _label int, at array<int>").toArrow()
    found = found.sort_by([("_key", "ascending")]).combine_chunks()
    y = found.column("_label").to_numpy().astype(np.float64)
    if not 0 < y.sum() < len(y):
        return Model(np.full(1 << BITS, -1, np.int16), np.zeros(0), 0.0)
    lists = found.column("at").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    weights, bias = _regress(np.repeat(np.arange(len(y)), lengths), lists.flatten().to_numpy().astype(np.int64), ratio, y)
    return Model(table, weights * ratio, bias)


def _regress(row: np.ndarray, col: np.ndarray, scale: np.ndarray, y: np.ndarray, penalty: float = 3e-4, steps: int = 200) -> tuple[np.ndarray, float]:
    """Logistic regression by full-batch steps with moving averages of gradient and square."""
    w, b = np.zeros(len(scale)), float(np.log(y.mean() / (1 - y.mean())))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    value = scale[col]
    for t in range(1, steps + 1):
        z = np.bincount(row, value * w[col], minlength=len(y)) + b
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g, gb = np.bincount(col, value * d[row], minlength=len(w)) + penalty * w, d.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        step = 0.03 * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        w -= step * m / (np.sqrt(v) + 1e-8)
        b -= step * mb / (np.sqrt(vb) + 1e-8)
    return w, float(b)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """All rows with the probability of label 1; a column of that name is replaced.

    Every whole text is read; null and empty texts get the score of no features.
    """
    kept = docs.select(*[c for c in docs.columns if c != name])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = kept.columns.index(text)
    names = [*kept.columns, name]

    def run(batches):
        model = sent.value
        for batch in batches:
            out = np.full(batch.num_rows, model.bias)
            if len(model.weights):
                for lo, points, bounds in _blocks(batch.column(at)):
                    row, feature = _present(points, bounds, model.table)
                    out[lo : lo + len(bounds) - 1] += np.bincount(row, model.weights[feature], minlength=len(bounds) - 1)
            prob = 1 / (1 + np.exp(-np.clip(out, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prob)], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{schema}, `{name}` double")
