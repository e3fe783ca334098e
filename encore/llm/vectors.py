"""Embedding near-dedup: randomised-rotation binary codes with stored correction factors."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from encore.llm.blocks import groups
from encore.llm.components import components
from encore.sources.workspace import cut

LIMIT = 0.93
CELL = 2048
UNIT = 4096
MISS = 1e-6


def rotation(size: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng((seed, size)).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def plan(rows: int, limit: float) -> tuple[int, int]:
    """Bits of a cell's number and number of tables for a label with that many vectors.

    A cell holds some ``CELL`` vectors. Two vectors at the limit differ in the sign of one
    random projection with probability angle / pi; there are so many tables that they
    share no cell with probability ``MISS`` at most. One cell needs only one table.
    """
    bits = max(0, math.ceil(math.log2(max(1, rows) / CELL)))
    same = (1 - math.acos(limit) / math.pi) ** bits
    return bits, 1 if not bits else math.ceil(math.log(MISS) / math.log(1 - same))


def codes(vectors: np.ndarray, seed: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated unit vectors, their sign codes (as +-1/sqrt(d)), and each code's correction factor."""
    turned = vectors @ rotation(vectors.shape[1], seed)
    sign = np.where(turned >= 0, 1.0, -1.0) / math.sqrt(vectors.shape[1])
    return turned, sign, np.einsum("ij,ij->i", turned, sign)


def candidate_pairs(a: np.ndarray, b: np.ndarray, limit: float, same: bool):
    """Index pairs whose cosine may reach the limit, by their codes.

    The inner product of one vector's code with the other vector, divided by the code's
    stored factor f, is an unbiased estimate of the cosine c. It is off by at most
    sqrt(1 - c*c) * sqrt(1 - f*f) / f: that bound has confidence one, so no pair at or above
    the limit has an estimate below limit - bound, and only the others are computed exactly.
    """
    turned, _, _ = codes(b)
    _, sign, factor = codes(a)
    reach = limit - math.sqrt(1 - limit * limit) * np.sqrt(np.maximum(0, 1 - factor**2)) / factor - 1e-9
    least = (reach * factor).astype(np.float32)
    sign, turned = sign.astype(np.float32), turned.astype(np.float32)
    for lo in range(0, len(a), 512):
        estimate = sign[lo : lo + 512] @ turned.T
        i, j = np.nonzero(estimate >= least[lo : lo + 512, None] - 1e-5)
        i = i + lo
        if same:
            i, j = i[i < j], j[i < j]
        yield i, j


def _valid(embedding: str):
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(embedding).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(embedding, lambda x: x != 0)


def near_duplicates(rows: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", limit: float = LIMIT) -> DataFrame:
    """(key, n_links, component_id, kept) of every row.

    Rows with equal labels link at a cosine of ``limit`` or more, in double precision.
    Vectors that are null, empty or zero or hold null or non-finite numbers, and rows with a
    null label, link with nothing; vectors of different lengths never link. ``n_links`` counts
    the other rows linked directly, ``component_id`` is the smallest key reachable, itself
    included, ``kept`` says that it is the row's own. Keys should be unique: rows with
    equal keys get a row each and count as links like any other.

    Equal vectors are one point with a count. Points of a label share cells of the signs of
    random projections, in so many tables that a link at the limit itself is missed with
    probability one in a million; a label that fits one cell is compared completely. In a
    cell, codes decide which pairs are computed exactly. A pair counts in the first table
    that it shares. Cells with many points are cut into units, and pairs of units are tasks.
    Tasks return sums and spanning links, never all pairs.
    """
    spark = rows.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = rows.select(F.col(key).alias("_key"), F.col(embedding).alias("_vec"), F.col(label).alias("_label"))
    fine = plain.where(_valid("_vec") & F.col("_label").isNotNull())
    points = cut(fine.groupBy("_label", "_vec").agg(F.min("_key").alias("rep"), F.count(F.lit(1)).alias("n")).withColumn("point", F.xxhash64("_label", "_vec")))
    sized = points.groupBy("_label").agg(F.count(F.lit(1)).alias("rows"))
    kinds = {f.name: f.dataType.simpleString() for f in StructType(points.schema.fields).fields}

    def number(batches):
        for batch in batches:
            for size in set(batch.column(3).to_pylist()):
                at = np.flatnonzero(batch.column(3).to_numpy() == size)
                part = batch.take(pa.array(at))
                bits, tables = plan(size, limit)
                lists = part.column(1).to_pylist()
                for width in sorted(set(map(len, lists))):
                    own = [i for i, v in enumerate(lists) if len(v) == width]
                    x = np.array([lists[i] for i in own], np.float64)
                    cells = np.zeros((len(own), tables), np.int64)
                    seeds = range(-(-bits * tables // width)) if bits else []
                    sign = np.concatenate([x @ rotation(width, 100 + s) >= 0 for s in seeds], axis=1) if bits else None
                    for t in range(tables if bits else 0):
                        # Bits of one table come from one rotation as far as it lasts.
                        cells[:, t] = sign[:, t * bits : (t + 1) * bits] @ (1 << np.arange(bits))
                    rows_ = np.repeat(np.arange(len(own)), tables)
                    take = pa.array(np.array(own)[rows_])
                    raw = [v.tobytes() for v in x]
                    seen = [c.astype(np.int32).tobytes() for c in cells]
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0).take(take), pa.array(np.full(len(rows_), width, np.int32)),
                            pa.array(np.tile(np.arange(tables), len(own)).astype(np.int32)), pa.array(cells.ravel()),
                            part.column(2).take(take), part.column(4).take(take),
                            pa.array([raw[i] for i in rows_], pa.binary()), pa.array([seen[i] for i in rows_], pa.binary()),
                        ],
                        names=["_label", "width", "tab", "cell", "point", "n", "x", "cells"],
                    )

    placed = points.join(sized, "_label").select("_label", "_vec", "point", "rows", "n")
    schema = f"_label {kinds['_label']}, width int, tab int, cell bigint, point bigint, n bigint, x binary, cells binary"
    placed = placed.mapInArrow(number, schema)
    cell = ["_label", "width", "tab", "cell"]
    crowd = placed.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / UNIT).cast("int").alias("units"))
    spread = placed.join(crowd, cell).withColumn("unit", F.pmod("point", F.col("units")).cast("int"))
    spread = spread.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("units") - 1)))
    spread = spread.withColumns({"u": F.least("unit", "_other"), "v": F.greatest("unit", "_other")}).drop("_other", "units")
    task = [*cell, "u", "v"]

    def compare(batches):
        for table in groups(batches, task):
            unit = table.column("unit").to_numpy()
            u, v, tab = (table.column(k)[0].as_py() for k in ("u", "v", "tab"))
            x = np.frombuffer(b"".join(table.column("x").to_pylist()), np.float64).reshape(table.num_rows, -1)
            seen = np.frombuffer(b"".join(table.column("cells").to_pylist()), np.int32).reshape(table.num_rows, -1)[:, :tab]
            norm = np.sqrt(np.einsum("ij,ij->i", x, x))
            point, n = table.column("point").to_numpy(), table.column("n").to_numpy()
            a, b = np.flatnonzero(unit == u), np.flatnonzero(unit == v)
            links, root = np.zeros(len(x), np.int64), np.arange(len(x))
            unitary = x / norm[:, None]
            for i, j in candidate_pairs(unitary[a], unitary[b], limit, u == v):
                i, j = a[i], b[j]
                exact = np.einsum("ij,ij->i", x[i], x[j]) / (norm[i] * norm[j]) >= limit
                i, j = i[exact], j[exact]
                if tab and len(i):
                    new = ~(seen[i] == seen[j]).any(axis=1)
                    i, j = i[new], j[new]
                if len(i):
                    np.add.at(links, i, n[j])
                    np.add.at(links, j, n[i])
                    root = _joined(root, i, j)
            some = np.flatnonzero((links > 0) | (root != np.arange(len(x))))
            if len(some):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(point[some]), pa.array(point[root[some]]), pa.array(links[some])], names=["a", "b", "links"]
                )

    found = cut(spread.repartition(4 * shards, *task).sortWithinPartitions(*task).mapInArrow(compare, "a bigint, b bigint, links bigint"))
    linked = found.groupBy("a").agg(F.sum("links").alias("links"))
    group = components(found)
    per_point = cut(
        points.select("point", "_label", "_vec", "rep", "n").join(linked, F.col("point") == F.col("a"), "left")
        .join(group, F.col("point") == F.col("node"), "left")
        .select("_label", "_vec", "point", "rep", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "point").alias("root"))
    )
    least = per_point.groupBy("root").agg(F.min("rep").alias("component"))
    answer = per_point.join(least, "root").select(
        F.col("point").alias("p"), F.col("_label").alias("l"), F.col("_vec").alias("w"), "n_links", "component"
    )
    marked = plain.withColumn("p", F.when(_valid("_vec") & F.col("_label").isNotNull(), F.xxhash64("_label", "_vec")))
    joined = marked.alias("m").join(
        answer.alias("a"), (F.col("m.p") == F.col("a.p")) & (F.col("_label") == F.col("l")) & (F.col("_vec") == F.col("w")), "left"
    )
    component = F.coalesce("component", "_key")
    return joined.select(
        F.col("_key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("_key") == component, F.lit(True)).alias("kept"),
    )


def _joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots after linking i with j; the smallest index of a component is its root."""
    while True:
        a, b = root[i], root[j]
        open_ = a != b
        if not open_.any():
            return root
        low, high = np.minimum(a, b)[open_], np.maximum(a, b)[open_]
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
