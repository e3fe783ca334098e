"""Exact top k by inner product, comparing only with clusters that can hold a better row.

Rows are put into clusters around a bounded sample of them. A query's inner product with any
row of a cluster is at most that with the centre plus its own length times the radius, and at
most the product of its own and the cluster's largest length. Queries with the same nearest cluster
form blocks of bounded size. A task holds one block with the best ``k`` rows found so far of each
query, and the rows stream by; a query skips clusters whose bound does not reach its k-th score.
The rows are packed and written once, and every task reads them there: nothing is dealt out to the
blocks, so no disk is used for that. The stream holds the rows twice, and a block meets those of its
near clusters in the first round and the others in the second. A block passes on ``k`` rows per query
whatever the number of clusters; only with few blocks the rows are cut into slices, whose lists are merged.
"""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

from encore.operators.ranking import top_k_per
from encore.operators.skew import salted_join
from encore.sources.workspace import cut, workspace

# Most centres (their vectors go to every task), rows compared at once, queries of one block, scores held at once.
CENTRES = 256
ROWS_PER_CENTRE = 1024
CELL_ROWS = 4096
CELL_QUERIES = 8192
SCORES = 1 << 20
# Bytes after which a packed piece of the rows ends, at the next name; share of the clusters that a block meets first.
PACK_BYTES = 1 << 21
NEAR = 8
# Listed pairs that a task holds (twice as many between two cuts), groups with a limit of their own, bytes of a listed pair.
PAIRS = 1 << 22
GROUPS = 1024
PAIR_BYTES = 32
# Share of a score that the order of addition may change, far above what doubles need.
SLACK = 1e-9
# Least room for new pairs between two cuts; largest number that single precision compares.
ROOM = 1 << 16
NARROW = 1e15


def _matrix(column):
    """Vectors of an Arrow list column, all of one size, as rows."""
    import numpy as np

    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat, float).reshape(len(column), -1)


def _assigned(base: DataFrame, centres):
    """``base`` with the nearest centre and the distance to it."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("item"))
            squares = (x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)
            nearest = squares.argmin(1)
            away, length = np.sqrt(((x - centres[nearest]) ** 2).sum(1)), np.sqrt((x**2).sum(1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(nearest.astype(np.int32)), pa.array(away), pa.array(length)],
                names=[*batch.schema.names, "cluster", "away", "length"],
            )

    fields = [*base.schema.fields, T.StructField("cluster", T.IntegerType()), T.StructField("away", T.DoubleType()), T.StructField("length", T.DoubleType())]
    return base.mapInArrow(run, T.StructType(fields))


def _bounds(q, centres, radii, longest):
    """Largest inner product that a row of each cluster can have with each query."""
    import numpy as np

    lengths = np.sqrt((q**2).sum(1))[:, None]
    bound = np.minimum(q @ centres.T + lengths * radii, lengths * longest)
    return bound + SLACK * (1 + np.abs(bound))


def _homed(queries: DataFrame, centres, radii, longest):
    """``queries`` with the cluster of the largest bound."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                bound = _bounds(_matrix(batch.column("item")), centres, radii, longest)
                home = np.nan_to_num(bound, nan=-np.inf).argmax(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home)], names=[*batch.schema.names, "home"])

    return queries.mapInArrow(run, T.StructType([*queries.schema.fields, T.StructField("home", T.IntegerType())]))


def _grid(n_rows: int, width: int, n_queries: int, k: int, tasks: int) -> tuple[int, int]:
    """Queries of a block and slices of the rows: enough cells for the tasks, with the least work besides.

    A further block reads the rows once more, a further slice shuffles and sorts lists, at four times the cost a byte.
    """
    limit, slices = max(1, min(CELL_QUERIES, PAIRS // k, n_queries)), 1
    while -(-n_queries // limit) * slices < tasks:
        more_rows = -(-n_queries // limit) * n_rows * 8 * (width + 8)
        if limit > 1 and more_rows <= 4 * slices * n_queries * min(k, n_rows) * PAIR_BYTES:
            limit = -(-limit // 2)
        else:
            slices *= 2
    return limit, slices


def _blocks(homes: list[tuple[int, int]], limit: int) -> list[tuple[int, int, int]]:
    """(home, first block, blocks): small homes share a block, large ones are several."""
    out, block, filled = [], 0, 0
    for home, n in homes:
        parts = -(-n // limit)
        if filled and filled + n > limit:
            block, filled = block + 1, 0
        out.append((home, block, parts))
        block, filled = (block + parts, 0) if parts > 1 else (block, filled + n)
    return out


def _near(homes, centres):
    """Clusters of ``homes`` and those near them, at least one in ``NEAR`` of all."""
    import numpy as np

    some = np.unique(homes)
    away = ((centres[:, None, :] - centres[some][None, :, :]) ** 2).sum(2).min(1)
    return set(np.argsort(away, kind="stable")[: max(len(some), -(-len(centres) // NEAR))].tolist()) | set(some.tolist())


def _used(at, size: int):
    """Positions that occur in ``at``, and ``at`` as places among them."""
    import numpy as np

    flag = np.zeros(size, bool)
    flag[at] = True
    return np.flatnonzero(flag), (np.cumsum(flag) - 1)[at]


def _places(*keys):
    """Place of each row among those with the same keys; rows are in order of them."""
    import numpy as np

    first = np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0))
    starts = np.flatnonzero(first)
    return np.arange(len(first)) - np.repeat(starts, np.diff(np.append(starts, len(first))))


class _Cell:
    """Queries of a block with their best rows so far."""

    def __init__(self, asked, k, cap, centres, radii, longest):
        import numpy as np
        import pyarrow as pa

        self.k, self.cap, self.names = k, cap, asked.column("query")
        self.q = _matrix(asked.column("item"))
        n, width = self.q.shape
        self.bound = _bounds(self.q, centres, radii, longest)
        lengths, far = np.sqrt((self.q**2).sum(1)), np.nan_to_num(longest).max()
        self.slack = SLACK * (1 + lengths * far)
        # Scores are compared in single precision first, with the error that this can have.
        self.narrow = bool(np.abs(self.q).max(initial=0) < NARROW and far < NARROW)
        self.q32 = self.q.astype(np.float32) if self.narrow else None
        self.slack32 = self.slack + (width + 8) * 2.0**-23 * lengths * far + 1e-30
        self.least = np.full(n, -np.inf)
        # Null is a group of its own, but a null ``own`` excludes no group.
        self.codes: dict = {}
        self.own = np.array([-1 if g is None else self._code(g) for g in asked.column("own").to_pylist()], np.int64)
        self.columns = max(1, min(GROUPS, PAIRS // n))
        # The last column stands for all further groups and never gets a limit.
        self.group_least = None if cap is None else np.full((n, self.columns + 1), -np.inf)
        self.who, self.at, self.score = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0)
        self.new, self.held, self.pool, self.kinds, self.pooled, self.slot = [], 0, [], [], 0, None
        self.visits = []
        self.space = np.zeros(0, np.float32), np.zeros(0, bool)
        self.pa = pa

    def _code(self, group) -> int:
        return self.codes.setdefault(group, len(self.codes))

    def _coded(self, column):
        import numpy as np
        import pyarrow.compute as pc

        some = pc.unique(column)
        codes = np.array([self._code(g) for g in some.to_pylist()], np.int64)
        return codes[pc.index_in(column, some).to_numpy()]

    def _lowest(self, kinds):
        """Score below which no row of these groups is listed, per query."""
        import numpy as np

        if self.cap is None:
            return self.least
        some = np.unique(kinds)
        limits = self.group_least[:, np.minimum(some, self.columns)]
        limits[some[None, :] == self.own[:, None]] = np.inf
        return np.maximum(self.least, limits.min(1))

    def meet(self, rows, known, cluster):
        """Rows of one cluster and the pairs of them that must not be listed."""
        import numpy as np
        import pyarrow.compute as pc

        x, kinds = _matrix(rows.column("item")), self._coded(rows.column("group"))
        skip_query = skip_row = np.zeros(0, np.int64)
        if known is not None:
            skip_query, skip_row = (
                pc.fill_null(pc.index_in(known.column(a).combine_chunks(), side.combine_chunks()), -1).to_numpy()
                for a, side in (("known_to", self.names), ("name", rows.column("name")))
            )
            met = (skip_query >= 0) & (skip_row >= 0)
            skip_query, skip_row = skip_query[met], skip_row[met]
        active = np.flatnonzero(~(self.bound[:, cluster] < self._lowest(kinds)))
        self.visits.append((active, cluster, rows.num_rows))
        if not len(active):
            return
        if self.cap is not None:
            # Rows of one group side by side have one limit per query.
            order = np.argsort(kinds, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            rows, x, kinds, skip_row = rows.take(self.pa.array(order)), x[order], kinds[order], place[skip_row]
        narrow = self.narrow and bool(np.abs(x).max(initial=0) < NARROW)
        q, slack, y = (self.q32, self.slack32, x.astype(np.float32)) if narrow else (self.q, self.slack, x)
        spot = np.full(len(self.q), -1)
        self.slot = np.full(len(x), -1)
        for a in range(0, len(x), CELL_ROWS):
            b = min(len(x), a + CELL_ROWS)
            mine = (skip_row >= a) & (skip_row < b)
            step = max(1, SCORES // (b - a))
            if self.cap is None:
                runs = [(0, b - a, -1)]
            else:
                ends = [*(np.flatnonzero(np.diff(kinds[a:b])) + 1).tolist(), b - a]
                runs = list(zip([0, *ends[:-1]], ends, np.minimum(kinds[a:b][[e - 1 for e in ends]], self.columns).tolist()))
            for lo in range(0, len(active), step):
                who = active[lo : lo + step]
                score, hit = self._tile(len(who), b - a, y.dtype)
                np.matmul(q[who], y[a:b].T, out=score)
                self._compare(score, hit, who, runs, kinds[a:b], slack[who])
                if mine.any():
                    spot[who] = np.arange(len(who))
                    at = spot[skip_query[mine]]
                    here, there = at[at >= 0], skip_row[mine][at >= 0] - a
                    hit[here, there], score[here, there] = False, -np.inf
                    spot[who] = -1
                flat = np.flatnonzero(hit)
                if len(flat) > len(who) and self._tighten(score, hit, who, flat, runs, slack[who]):
                    flat = np.flatnonzero(hit)
                if len(flat):
                    at, row = np.divmod(flat, b - a)
                    self._keep(rows, kinds, who[at], row + a, x)

    def _tile(self, n, width, kind):
        """Room for the scores and hits of ``n`` queries, used again."""
        import numpy as np

        if len(self.space[0]) < n * width or self.space[0].dtype != kind:
            self.space = np.empty(n * width, kind), np.empty(n * width, bool)
        return tuple(part[: n * width].reshape(n, width) for part in self.space)

    def _compare(self, score, hit, who, runs, kinds, slack):
        """``hit``: whether a row can be among the best of a query."""
        import numpy as np

        if self.cap is None:
            np.greater_equal(score, (self.least[who] - slack).astype(score.dtype)[:, None], out=hit)
            return
        own = self.own[who]
        if len(runs) * 32 <= score.shape[1]:
            for start, end, column in runs:
                limit = np.maximum(self.least[who], self.group_least[who, column]) - slack
                np.greater_equal(score[:, start:end], limit.astype(score.dtype)[:, None], out=hit[:, start:end])
        else:
            limit = np.maximum(self.least[who][:, None], self.group_least[who][:, np.minimum(kinds, self.columns)])
            np.greater_equal(score, (limit - slack[:, None]).astype(score.dtype), out=hit)
        if (own >= 0).any():
            for start, end, _ in runs:
                same = own == kinds[start]
                if same.any():
                    hit[same, start:end], score[same, start:end] = False, -np.inf

    def _tighten(self, score, hit, who, flat, runs, slack):
        """Raise limits that a part of the rows passes by itself, and drop what does not reach them."""
        import numpy as np

        width, most = score.shape[1], self.k if self.cap is None else self.cap
        changed = False
        run_of = np.repeat(np.arange(len(runs)), [end - start for start, end, _ in runs])
        at, row = np.divmod(flat, width)
        counts = np.bincount(at * len(runs) + run_of[row], minlength=len(who) * len(runs)).reshape(len(who), -1)
        for i in np.flatnonzero((counts > 2 * most).any(0)).tolist():
            start, end, column = runs[i]
            if column == self.columns:
                continue
            many = np.flatnonzero(counts[:, i] > 2 * most)
            part = score[many, start:end]
            part[np.isnan(part)] = -np.inf
            nth = np.partition(part, part.shape[1] - most, axis=1)[:, part.shape[1] - most].astype(float)
            hit[many, start:end] &= part >= (nth - 3 * slack[many]).astype(part.dtype)[:, None]
            # So many rows reach this whatever the error.
            if self.cap is None:
                self.least[who[many]] = np.maximum(self.least[who[many]], nth - 2 * slack[many])
            else:
                self.group_least[who[many], column] = np.maximum(self.group_least[who[many], column], nth - 2 * slack[many])
            changed = True
        return changed

    def _keep(self, rows, kinds, who, row, x):
        """Add pairs; row by row sums do not depend on where a row stands, so equal rows tie."""
        import numpy as np

        for lo in range(0, len(who), SCORES // 16 + 1):
            w, r = who[lo : lo + SCORES // 16 + 1], row[lo : lo + SCORES // 16 + 1]
            score = (x[r] * self.q[w]).sum(1)
            w, r, score = w[score > -np.inf], r[score > -np.inf], score[score > -np.inf]
            fresh = _used(r, len(x))[0]
            fresh = fresh[self.slot[fresh] < 0]
            if len(fresh):
                self.slot[fresh] = self.pooled + np.arange(len(fresh))
                self.pool.append(rows.select(["name", "tie", "group"]).take(self.pa.array(fresh)))
                self.kinds.append(kinds[fresh])
                self.pooled += len(fresh)
            self.new.append((w.astype(np.int32), self.slot[r], score))
            self.held += len(w)
            if self.held > min(PAIRS, max(len(self.who), ROOM)):
                self._cut()

    def _cut(self):
        """Keep the best ``k`` rows of each query, at most ``cap`` per group, equal ones by tie and name."""
        import numpy as np

        who, at, score = (np.concatenate(c) for c in zip((self.who, self.at, self.score), *self.new, strict=True))
        self.new, self.held = [], 0
        if not len(who):
            return

        self.table, kinds = self.pa.concat_tables(self.pool).combine_chunks(), np.concatenate(self.kinds)
        if self.cap is not None:
            kind = kinds[at]
            order = self._ordered(who, at, score, kind)
            who, at, score, kind = who[order], at[order], score[order], kind[order]
            nth = _places(who, kind)
            full = (nth == self.cap - 1) & (kind < self.columns)
            self.group_least[who[full], kind[full]] = score[full]
            kept = nth < self.cap
            who, at, score = who[kept], at[kept], score[kept]
        order = self._ordered(who, at, score)
        who, at, score = who[order], at[order], score[order]
        nth = _places(who)
        full = nth == self.k - 1
        self.least[who[full]] = score[full]
        kept = nth < self.k
        used, at = _used(at[kept], len(kinds))
        self.who, self.at, self.score, self.nth = who[kept], at, score[kept], nth[kept]
        self.table = self.table.take(self.pa.array(used)).combine_chunks()
        self.pool, self.kinds, self.pooled = [self.table], [kinds[used]], len(used)
        if self.slot is not None:
            self.slot[:] = -1

    def _ordered(self, who, at, score, *kind):
        """Order of pairs by query, group if given, falling score, tie and name."""
        import numpy as np
        import pyarrow.compute as pc

        order = np.argsort(-score)
        for key in (*kind, who):  # small integers sort in linear time
            key = key.astype(np.int16) if key.max() < 1 << 15 else key
            order = order[np.argsort(key[order], kind="stable")]
        keys = [c[order] for c in (who, *kind, score)]
        same = np.all([c[1:] == c[:-1] for c in keys], axis=0)
        tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
        if len(tied):
            by_tie = pc.sort_indices(self.table, sort_keys=[("tie", "ascending"), ("name", "ascending")], null_placement="at_start").to_numpy()
            place = np.empty(len(by_tie), np.int64)
            place[by_tie] = np.arange(len(by_tie))
            some = order[tied]
            run = np.cumsum(np.append(True, ~same))[tied]
            order[tied] = some[np.lexsort((place[at[some]], run))]
        return order

    def best(self):
        """Batches of (query, name, tie, group, cost, rank)."""
        import numpy as np

        self._cut()
        for lo in range(0, len(self.who), SCORES // 16 + 1):
            part = slice(lo, lo + SCORES // 16 + 1)
            rows = self.table.take(self.pa.array(self.at[part]))
            yield from self.pa.table(
                {
                    "query": self.names.take(self.pa.array(self.who[part])),
                    **{c: rows.column(c) for c in ("name", "tie", "group")},
                    "cost": self.pa.array(-self.score[part]),
                    "rank": self.pa.array((self.nth[part] + 1).astype(np.int32)),
                }
            ).combine_chunks().to_batches()

    def visited(self):
        """Batches of (query, cluster, rows)."""
        import numpy as np

        for active, cluster, n in self.visits:
            yield from self.pa.table(
                {
                    "query": self.names.take(self.pa.array(active)),
                    "cluster": self.pa.array(np.full(len(active), cluster, np.int32)),
                    "rows": self.pa.array(np.full(len(active), n, np.int64)),
                }
            ).combine_chunks().to_batches()


class _Whole:
    """Queries of a block whose lists hold all rows: nothing is compared, every list is sorted once."""

    def __init__(self, asked):
        import pyarrow as pa

        self.names, self.q = asked.column("query"), _matrix(asked.column("item"))
        self.rows, self.skip, self.held, self.pa = [], [], 0, pa

    def meet(self, rows, known, cluster):
        import numpy as np
        import pyarrow.compute as pc

        if known is not None:
            query, row = (
                pc.fill_null(pc.index_in(known.column(a).combine_chunks(), side.combine_chunks()), -1).to_numpy()
                for a, side in (("known_to", self.names), ("name", rows.column("name")))
            )
            met = (query >= 0) & (row >= 0)
            self.skip.append(np.stack([query[met], row[met] + self.held]))
        self.rows.append(rows)
        self.held += rows.num_rows

    def best(self):
        """Batches of (query, name, tie, group, cost, rank)."""
        import numpy as np
        import pyarrow.compute as pc

        if not self.rows:
            return
        rows = self.pa.concat_tables(self.rows)
        self.rows = []
        order = pc.sort_indices(rows, sort_keys=[("tie", "ascending"), ("name", "ascending")], null_placement="at_start").to_numpy()
        x = _matrix(rows.column("item"))[order]
        rows = rows.select(["name", "tie", "group"]).take(self.pa.array(order)).combine_chunks()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        query, row = np.concatenate(self.skip, axis=1) if self.skip else np.zeros((2, 0), np.int64)
        cost = np.empty(len(x))
        for j in range(len(self.q)):
            for lo in range(0, len(x), CELL_ROWS):
                cost[lo : lo + CELL_ROWS] = -(x[lo : lo + CELL_ROWS] * self.q[j]).sum(1)
            listed = cost < np.inf
            listed[place[row[query == j]]] = False
            at = np.flatnonzero(listed)
            at = at[np.argsort(cost[at], kind="stable")]
            for lo in range(0, len(at), SCORES // 16 + 1):
                part = at[lo : lo + SCORES // 16 + 1]
                some = rows.take(self.pa.array(part))
                yield from self.pa.table(
                    {
                        "query": self.names.take(self.pa.array(np.full(len(part), j))),
                        **{c: some.column(c) for c in ("name", "tie", "group")},
                        "cost": self.pa.array(cost[part]),
                        "rank": self.pa.array(np.arange(lo + 1, lo + len(part) + 1, dtype=np.int32)),
                    }
                ).combine_chunks().to_batches()


def _bytes(table) -> bytes:
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _table(data):
    import pyarrow as pa

    return pa.ipc.open_stream(data).read_all().combine_chunks()


def _packed(batches):
    """(cluster, rows, known) of runs of rows; a name and its pairs that must not be listed are never parted."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def pack(tables):
        table = pa.concat_tables(tables).combine_chunks()
        pair = pc.is_valid(table.column("known_to"))
        known, rows = table.filter(pair), table.filter(pc.invert(pair))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([table.column("cluster")[0].as_py()], pa.int32()),
                pa.array([_bytes(rows.select(["name", "tie", "group", "item"]))], pa.binary()),
                pa.array([_bytes(known.select(["name", "known_to"])) if known.num_rows else None], pa.binary()),
            ],
            names=["cluster", "rows", "known"],
        )

    run, held, last = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        cell = np.stack([table.column(c).to_numpy() for c in ("cluster", "part")])
        codes = pc.dictionary_encode(table.column("name")).combine_chunks()
        name = pc.fill_null(codes.indices, -1).to_numpy()
        if last is not None:
            news = (cell[:, 0] != last[0]).any(), table.column("name")[0] != last[1]
        else:
            news = True, True
        turns = np.append(news[0], (np.diff(cell) != 0).any(0))
        starts = np.append(news[1], np.diff(name) != 0) | turns
        size = max(1, batch.nbytes // batch.num_rows)
        begin = 0
        for at in np.flatnonzero(starts).tolist():
            held_here = held + (at - begin) * size
            if turns[at] or held_here >= PACK_BYTES:
                if at > begin:
                    run.append(table.slice(begin, at - begin))
                if run:
                    yield pack(run)
                run, held, begin = [], 0, at
        run.append(table.slice(begin))
        held += (table.num_rows - begin) * size
        last = cell[:, -1], table.column("name")[-1]
    if run:
        yield pack(run)


def _scan(k, cap, centres, radii, longest, result, rounds, whole):
    """Function of pairs of a block and packed rows: lists of the block, as bytes."""

    def run(pairs):
        import pyarrow as pa

        cell, seen = None, set()
        for (asked,), (number, cluster, rows, known) in pairs:
            if cell is None:
                asked = _table(asked)
                near = _near(asked.column("home").to_numpy(), centres)
                cell = _Whole(asked) if whole else _Cell(asked, k, cap, centres, radii, longest)
            first = number not in seen
            seen.add(number)
            if rounds == 1 or first == (cluster in near):
                cell.meet(_table(rows), None if known is None else _table(known), cluster)
        if cell is not None:
            for batch in getattr(cell, result)():
                yield (_bytes(pa.Table.from_batches([batch])),)

    return run


def _unpacked(batches):
    for batch in batches:
        for data in batch.column(0):
            yield from _table(data.as_buffer()).to_batches()


def _asked(batches):
    """The queries of a partition, which are one block, as bytes."""
    import pyarrow as pa

    batches = [b for b in batches if b.num_rows]
    if batches:
        yield pa.RecordBatch.from_arrays([pa.array([_bytes(pa.Table.from_batches(batches))], pa.binary())], names=["asked"])


def search(
    base: DataFrame, queries: DataFrame, k: int, cap: int | None = None, known: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Best rows of each query, and the clusters that each query visited.

    ``base`` has distinct (name, tie, item[, group]), ``queries`` distinct (query, item[, own]); items
    are double vectors of one size. Result: (query, name, tie, group, cost, rank) with the
    ``k`` largest inner products (``cost`` is their negative), equal ones by ``tie``. With ``cap`` at most
    so many rows of a group are listed, and none of the query's ``own`` group; a null
    ``own`` excludes nothing. ``known`` (query, name) are pairs that must not be listed. All
    of this holds before anything is cut to ``k``. Visits: (query, cluster, rows), found by a
    scan of its own if they are read. Rows and queries with a null item are left out. Empty
    tables give no rows.
    """
    import numpy as np

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    group = F.col("group") if "group" in base.columns else F.lit(None).cast("string").alias("group")
    own = F.col("own") if "own" in queries.columns else F.lit(None).cast(base.schema["group"].dataType if "group" in base.columns else "string").alias("own")
    rows = cut(base.where("item is not null").select("name", "tie", "item", group))
    asked = cut(queries.where("item is not null and query is not null").select("query", "item", own))
    spark = rows.sparkSession
    n_rows = rows.count()
    n_queries, n_names = asked.agg(F.count("query"), F.count_distinct("query")).first()
    if n_queries > n_names:  # each copy of a query counts as often as there are copies
        asked = cut(asked.join(asked.select("query"), "query"))
        n_names, n_queries = 0, asked.count()
    kind = asked.schema["query"].dataType
    schema = T.StructType(
        [T.StructField("query", kind), *(rows.schema[c] for c in ("name", "tie", "group")), T.StructField("cost", T.DoubleType()), T.StructField("rank", T.IntegerType())]
    )
    seen = T.StructType([T.StructField("query", kind), T.StructField("cluster", T.IntegerType()), T.StructField("rows", T.LongType())])
    if not n_rows or not n_queries or k < 1:
        return spark.createDataFrame([], schema), spark.createDataFrame([], seen)
    n_centres = max(1, min(CENTRES, n_rows // ROWS_PER_CENTRE))
    sample = rows.select("name", "item").orderBy(F.xxhash64("name"), "name").limit(n_centres).collect()
    centres = np.array([r["item"] for r in sample], float)
    placed = cut(_assigned(rows, centres))
    radii, longest = np.zeros(len(centres)), np.zeros(len(centres))
    spans = placed.groupBy("cluster").agg(F.max("away").alias("radius"), F.max("length").alias("longest"), F.count(F.lit(1)).alias("n"))
    parts = []
    for r in spans.collect():  # one row per centre
        radii[r["cluster"]], longest[r["cluster"]] = r["radius"], r["longest"]
        parts.append((r["cluster"], max(1, r["n"] // (4 * CELL_ROWS))))
    homed = cut(_homed(asked, centres, radii, longest))
    homes = sorted(tuple(r) for r in homed.groupBy("home").count().collect())  # one row per centre
    tasks = 2 * spark.sparkContext.defaultParallelism
    limit, slices = _grid(n_rows, centres.shape[1], n_queries, k, tasks)
    blocks = _blocks(homes, limit)
    firsts = F.broadcast(spark.createDataFrame(blocks, "home int, first int, parts int"))  # at most CENTRES rows
    sizes = F.broadcast(spark.createDataFrame(parts, "cluster int, parts int"))
    block = (F.col("first") + F.pmod(F.xxhash64("query"), F.col("parts"))).cast("int").alias("block")
    dealt = homed.join(firsts, "home").select("query", "item", "own", "home", block)
    placed = placed.join(sizes, "cluster").withColumn("part", F.pmod(F.xxhash64("name"), "parts").cast("int"))
    right = placed.select("cluster", "part", "name", "tie", "group", "item", F.lit(None).cast(kind).alias("known_to"))
    if known is not None:
        pairs = known.join(asked.select("query").distinct(), "query").select("query", "name").distinct()
        met = salted_join(pairs, placed.select("name", "cluster", "part"), "name")
        right = right.unionByName(met.select("cluster", "part", "name", F.col("query").alias("known_to")), allowMissingColumns=True)
    stream = right.repartition("cluster", "part").sortWithinPartitions("cluster", "part", "name", F.col("known_to").isNull())
    path = f"{workspace(spark)}/cuts/{uuid.uuid4().hex}"
    packed = stream.mapInArrow(_packed, "cluster int, rows binary, known binary").rdd
    packed.zipWithUniqueId().map(lambda r: (r[1], *r[0])).saveAsPickleFile(path, 1)
    whole = k >= n_rows and cap is None and slices == 1
    rounds = 1 if whole or k >= n_rows or slices > 1 or len(centres) == 1 else 2
    pieces = spark.sparkContext.pickleFile(path, slices)
    pieces = (spark.sparkContext.union([pieces] * rounds) if rounds > 1 else pieces).coalesce(slices)
    slices = pieces.getNumPartitions()
    n_blocks = 1 + max(first + parts - 1 for _, first, parts in blocks)
    left = dealt.repartitionById(n_blocks, F.col("block")).drop("block").mapInArrow(_asked, "asked binary").rdd
    cells = left.cartesian(pieces)

    def rows_of(result, fields):
        # Visits are those of a search; a whole list has none to save.
        scan = _scan(k, cap, centres, radii, longest, result, rounds, whole and result == "best")
        return spark.createDataFrame(cells.mapPartitions(scan), "data binary", verifySchema=False).mapInArrow(_unpacked, fields)

    found, visits = rows_of("best", schema), rows_of("visited", seen)
    if slices == 1 and n_names:
        return found, visits
    found = found.drop("rank")
    if cap is not None:
        found = top_k_per(found, ["query", "group"], ["cost", "tie", "name"], cap, "_nth").drop("_nth")
    return top_k_per(found, ["query"], ["cost", "tie", "name"], k), visits


def visited_share(visits: DataFrame, base_rows: int, queries: int) -> float:
    """Compared pairs as a share of all pairs."""
    seen = visits.agg(F.sum("rows")).first()[0] or 0
    return seen / max(1, base_rows * queries)
