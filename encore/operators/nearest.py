"""Exact nearest texts by edit distance of many queries in a large table.

Every task compares its rows with the queries in blocks and passes on only the
best ``k`` per query, so pairs are never written out. Few queries are broadcast
after their number was checked; more are spread over a grid of groups of
bounded size. Both ways give the same rows.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

from encore.operators.ranking import top_k_per
from encore.sources.workspace import cut

# Queries that may be broadcast, rows of one grid group, and result rows per step.
MAX_BROADCAST = 4096
GRID_ROWS = 16384
STEP_ROWS = 1_000_000


def _distances(codes, lengths, query):
    """Unit-cost edit distances of one query to texts given as columns of codes."""
    import numpy as np

    widest = int(lengths.max()) if len(lengths) else 0
    codes = codes[:widest]
    table = np.repeat(np.arange(widest + 1, dtype=np.int32)[:, None], len(lengths), axis=1)
    for i, c in enumerate(query, 1):
        swap = table[:-1] + (codes != c)
        best = np.minimum(swap, table[1:] + 1)
        table[0] = i
        for w in range(widest):
            np.minimum(best[w], table[w] + 1, out=table[w + 1])
    return table[lengths, np.arange(len(lengths))]


def _edit_costs(texts, k):
    """Function from a query to its edit distances; texts that cannot be among
    the k nearest get no distance.

    Two texts are at least as far apart as the longer one has letters that the
    other lacks. The most promising texts are compared first, then all those
    that this bound does not rule out.
    """
    import numpy as np

    lengths = np.array([len(t) for t in texts])
    codes = np.zeros((max(lengths.max(), 1), len(texts)), dtype=np.int32)
    letters = np.zeros((len(texts), 64), dtype=np.int16)
    for i, t in enumerate(texts):
        marks = [ord(c) for c in t]
        codes[: len(t), i] = marks
        for m in marks:
            letters[i, m % 64] += 1
    first_look = max(4 * k, 512)

    def costs(query):
        marks = [ord(c) for c in query]
        if len(texts) <= first_look:
            return _distances(codes, lengths, marks).astype(float)
        own = np.bincount([m % 64 for m in marks], minlength=64)
        bound = np.maximum(lengths, len(marks)) - np.minimum(letters, own).sum(axis=1)
        cost = np.full(len(texts), np.inf)
        near = np.argpartition(bound, first_look)[:first_look]
        cost[near] = _distances(codes[:, near], lengths[near], marks)
        limit = np.partition(cost[near], k - 1)[k - 1]
        rest = np.flatnonzero((bound <= limit) & np.isinf(cost))
        cost[rest] = _distances(codes[:, rest], lengths[rest], marks)
        return cost

    return costs


def _finder(k: int):
    """Function (pandas rows, query names, query payloads) -> frames of best pairs."""
    kernel, step_rows = _edit_costs, STEP_ROWS

    def find(rows, asked, payloads):
        import numpy as np
        import pandas as pd

        costs = kernel(list(rows["item"]), k)
        names, ties = rows["name"].to_numpy(), rows["tie"].to_numpy()
        place = np.empty(len(names), dtype=np.int64)
        place[np.argsort(ties, kind="stable")] = np.arange(len(names))
        step = max(1, step_rows // min(k, len(names)))
        for lo in range(0, len(asked), step):
            kept, prices, who = [], [], []
            for j in range(lo, min(lo + step, len(asked))):
                cost = costs(payloads[j])
                keep = np.arange(len(names))
                if len(names) > k:
                    keep = np.flatnonzero(cost <= np.partition(cost, k - 1)[k - 1])
                    keep = keep[np.lexsort((place[keep], cost[keep]))[:k]]
                kept.append(keep)
                prices.append(cost[keep])
                who.append(np.full(len(keep), j))
            at, by = np.concatenate(kept), np.concatenate(who)
            yield pd.DataFrame(
                {
                    "query": np.array(asked, dtype=object)[by],
                    "name": names[at],
                    "tie": ties[at],
                    "cost": np.concatenate(prices),
                }
            )

    return find


def nearest(
    base: DataFrame, queries: DataFrame, k: int, max_broadcast: int = MAX_BROADCAST
) -> DataFrame:
    """(query, name, tie, cost, rank): the ``k`` rows of least edit distance to each query.

    ``base`` has (name, tie, item), ``queries`` (query, item), items are texts; ``tie`` orders
    equal costs.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    find = _finder(k)
    fields = {f.name: f.dataType for f in base.schema.fields}
    schema = T.StructType(
        [
            T.StructField("query", queries.schema["query"].dataType),
            T.StructField("name", fields["name"]),
            T.StructField("tie", fields["tie"]),
            T.StructField("cost", T.DoubleType()),
        ]
    )
    base = cut(base.select("name", "tie", "item"))
    rows = base.count()
    parallel = base.sparkSession.sparkContext.defaultParallelism
    head = queries.select("query", "item").limit(max_broadcast + 1).collect()
    if len(head) <= max_broadcast:
        names = [r["query"] for r in head]
        payloads = [r["item"] for r in head]
        sent = base.sparkSession.sparkContext.broadcast((names, payloads))

        def scan(batches):
            for rows in batches:
                if len(rows) and sent.value[0]:
                    yield from find(rows, *sent.value)

        parts = max(parallel, rows // GRID_ROWS + 1)
        found = base.repartition(parts, "name").mapInPandas(scan, schema)
    else:
        queries = cut(queries.select("query", "item"))
        # A group returns at most k rows per query, so large k means fewer queries.
        per_block = max(1, min(GRID_ROWS, 4 * STEP_ROWS // k))
        cells, blocks = rows // GRID_ROWS + 1, queries.count() // per_block + 1
        left = base.withColumn("cell", F.pmod(F.xxhash64("name"), F.lit(cells))).withColumn(
            "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        )
        right = queries.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")).withColumn(
            "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long")))
        )

        def meet(rows, asked):
            import pandas as pd

            if not len(rows) or not len(asked):
                return pd.DataFrame({f.name: [] for f in schema.fields})
            return pd.concat(find(rows, list(asked["query"]), list(asked["item"])))

        found = left.groupBy("cell", "block").cogroup(right.groupBy("cell", "block")).applyInPandas(
            meet, schema
        )
    return top_k_per(found, ["query"], ["cost", "tie", "name"], k)
