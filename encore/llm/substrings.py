"""Suffix-array dedup: byte strings of a minimum length that occur twice, by interval expansion on a BWT."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from encore.llm.blocks import groups, prefix_hashes, ragged, span_hashes, text_blocks
from encore.sources.workspace import cut

LENGTH = 400
GRAM = 128
SEED_DEPTH = 32
SHARD_BYTES = 1 << 20
GROUP_BYTES = 1 << 22


def _runs(data: np.ndarray, offsets: np.ndarray, prefix: np.ndarray, length: int, gram: int):
    """Runs of windows with the same smallest hash of their grams.

    Returns (row, first window, last window, hash, times the hash occurs in the run).
    Equal windows have equal grams, so they lie in runs of the same hash.
    """
    empty = np.empty(0, np.int64)
    n, width = len(data) - gram + 1, length - gram + 1
    windows = len(data) - length + 1
    if windows <= 0:
        return empty, empty, empty, np.empty(0, np.uint64), empty
    at = np.arange(n)
    hashes = span_hashes(prefix, at, at + gram)
    low, step = hashes, 1
    while step * 2 <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    low = np.minimum(low[:windows], low[width - step : width - step + windows])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:windows]
    whole = np.arange(windows) + length <= offsets[row + 1]
    new = np.concatenate(([True], (low[1:] != low[:-1]) | (row[1:] != row[:-1])))
    first = np.flatnonzero(new & whole)
    stop = np.concatenate((np.flatnonzero(new), [windows]))
    last = stop[np.searchsorted(stop, first, "right")]
    ends = offsets[row[first] + 1] - length + 1
    last = np.minimum(last, ends) - 1
    lowest = low[first]
    # How often the smallest hash occurs in the run's windows.
    spot = np.flatnonzero(hashes == _widest(low, hashes, windows, width))
    lo, hi = np.searchsorted(spot, first), np.searchsorted(spot, last + width)
    owner = np.repeat(np.arange(len(first)), hi - lo)
    equal = hashes[spot[ragged(lo, hi - lo)]] == lowest[owner]
    return row[first], first, last, lowest, np.bincount(owner[equal], minlength=len(first))


def _widest(low, hashes, windows, width):
    """For each gram, its own hash if some window has it as its smallest, else another value."""
    # A gram is the smallest of some window around it exactly if the largest of these minima equals it.
    pad = np.concatenate((np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)))
    high, step = pad, 1
    while step * 2 <= width:
        high = np.maximum(high[:-step], high[step:])
        step *= 2
    n = len(hashes)
    return np.maximum(high[:n], high[width - step : width - step + n])


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes sorted by ``depth`` symbols or more, and for each the group of equal SEED_DEPTH prefixes.

    Prefix doubling from four symbols on; only suffixes that are still equal to a
    neighbour are sorted again. ``text`` has symbols below 65,536.
    """
    n = len(text)
    pad = np.concatenate((text.astype(np.uint64), np.zeros(4, np.uint64)))
    key = pad[:n] << np.uint64(48) | pad[1 : n + 1] << np.uint64(32) | pad[2 : n + 2] << np.uint64(16) | pad[3 : n + 3]
    order = np.argsort(key)
    new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    place = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n + depth * 2, np.int64)
    rank[n:] = -1
    rank[order] = place
    seeds, h = None, 4
    while h < depth:
        open_ = ~(new & np.concatenate((new[1:], [True])))
        if open_.any():
            spots = np.flatnonzero(open_)
            suffix = order[spots]
            second = rank[suffix + h]
            inner = np.lexsort((second, rank[suffix]))
            suffix, second = suffix[inner], second[inner]
            order[spots] = suffix
            group = rank[suffix]
            change = np.concatenate(([True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])))
            new[spots] = change
            start = np.maximum.accumulate(np.where(change, spots, 0))
            rank[suffix] = start
        h *= 2
        if h == SEED_DEPTH:
            seeds = new.copy()
    return order, new if seeds is None else seeds, rank[:n]


def common_prefixes(text: np.ndarray, order: np.ndarray, seeds: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix shares ``length`` symbols or more with the one before it in ``order``.

    Works on the Burrows-Wheeler transform alone. The intervals of all strings of
    SEED_DEPTH symbols (``seeds`` marks their first suffixes) are expanded backwards by
    every symbol before them, breadth first. An interval of a string of d symbols that
    ends where no common prefix is known yet shows that it is d, and only such intervals
    go on; so values come in increasing order, each once, and what is unknown at the
    minimum length is at least that long.
    """
    n = len(text)
    before = text[order - 1]
    back = np.empty(n, np.int64)
    back[np.argsort(before, kind="stable")] = np.arange(n)
    first = text[order]
    unknown = np.ones(n + 1, bool)
    unknown[np.flatnonzero(seeds)] = False
    unknown[n] = False
    lo = np.flatnonzero(seeds)
    hi = np.append(lo[1:], n)
    for _ in range(SEED_DEPTH, length):
        if not len(lo):
            break
        sizes = hi - lo
        owner = np.repeat(np.arange(len(lo)), sizes)
        there = back[ragged(lo, sizes)]
        order_ = np.argsort(there)
        there, owner = there[order_], owner[order_]
        symbol = first[there]
        new = np.concatenate(([True], (there[1:] != there[:-1] + 1) | (owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1])))
        start = np.flatnonzero(new)
        a, b = there[start], there[np.append(start[1:], len(there)) - 1] + 1
        fresh = unknown[b]
        lo, hi = a[fresh], b[fresh]
        unknown[hi] = False
    return unknown[:n]


def repeated_windows(segments: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Starts, in each segment, of the strings of ``length`` bytes that start anywhere else too."""
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    if len(segments) > 60_000:
        raise ValueError("too many segments for one transform")
    # Each segment ends with a symbol of its own, so nothing runs across.
    text = np.empty(int(sizes.sum()) + len(sizes), np.uint16)
    starts = np.cumsum(sizes + 1) - sizes - 1
    text[ragged(starts, sizes)] = np.frombuffer(b"".join(segments), np.uint8).astype(np.uint16) + 1
    text[starts + sizes] = 300 + np.arange(len(sizes))
    order, seeds, _ = suffix_order(text, length)
    shared = common_prefixes(text, order, seeds, length)
    shared |= np.append(shared[1:], False)
    found = np.sort(order[shared])
    cuts = np.searchsorted(found, starts)
    return [part - start for part, start in zip(np.split(found, cuts[1:]), starts)]


def cover(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal spans (start, length) that windows at sorted starts cover."""
    if not len(starts):
        return []
    new = np.concatenate(([True], starts[1:] > starts[:-1] + length))
    a = starts[new]
    b = starts[np.append(np.flatnonzero(new)[1:], len(starts)) - 1] + length
    return list(zip(a.tolist(), (b - a).tolist()))


SPANS = "array<struct<start:bigint,length:bigint>>"


def _span_lists(found: list[list[tuple[int, int]]]) -> pa.Array:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    return pa.array([[{"start": a, "length": b} for a, b in x] for x in found], kind)


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(_key, _tie, _spans): byte spans of each text covered by strings that occur twice.

    Every window of ``length`` bytes belongs to the run of windows around it with the
    same smallest hash of a ``gram``-byte string. Equal windows belong to runs of equal
    hash, so a run whose hash occurs once in the corpus is done. Of the other runs only
    distinct texts go on (told apart by hashes), to shards by hash. In a shard, a transform over the texts of
    whole hash groups tells the windows that occur twice. Runs with equal text repeat
    each other completely. Groups too large for a transform count each window's
    128-bit hash over the cluster instead, so no group meets in one task.
    """
    if not SEED_DEPTH <= gram <= length:
        raise ValueError(f"the hashed strings take between {SEED_DEPTH} bytes and the minimum length")
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.withColumn("_tie", F.xxhash64("_text"))
    kind = rows.schema["_key"].dataType.simpleString()

    def count(batches):
        for _, data, offsets in text_blocks(batches, "_text"):
            _, _, _, low, times = _runs(data, offsets, prefix_hashes(data), length, gram)
            yield pa.RecordBatch.from_arrays([pa.array(low.view(np.int64)), pa.array(times)], names=["low", "times"])

    def find(batches):
        for part, data, offsets in text_blocks(batches, "_text"):
            prefix = prefix_hashes(data)
            row, first, last, low, times = _runs(data, offsets, prefix, length, gram)
            stop = last + length
            columns = [
                part.column(0).take(pa.array(row)), part.column(2).take(pa.array(row)), pa.array(first - offsets[row]),
                pa.array(stop - first), pa.array(low.view(np.int64)), pa.array(times),
                pa.array(span_hashes(prefix, first, stop).view(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["_key", "_tie", "start", "length", "low", "times", "b1"])

    counts = rows.select("_text").mapInArrow(count, "low bigint, times bigint")
    twice = counts.groupBy("low").agg(F.sum("times").alias("_n")).where("_n > 1").select("low")
    schema = f"_key {kind}, _tie bigint, start bigint, length bigint, low bigint, times bigint, b1 bigint"
    runs = cut(rows.mapInArrow(find, schema).join(twice, "low", "left_semi"))
    body = ["low", "b1", "length"]
    distinct = runs.groupBy(*body).agg(
        F.count(F.lit(1)).alias("n"), F.max("times").alias("times"), F.min(F.struct("_key", "_tie", "start")).alias("rep")
    )
    sums = distinct.groupBy("low").agg(
        F.count(F.lit(1)).alias("kinds"), F.sum(F.col("length") + 1).alias("bytes"), F.max("times").alias("within")
    )
    known = cut(distinct.join(sums, "low"))
    # One text alone repeats itself as a whole, unless it holds its own hash twice.
    alone = (F.col("kinds") == 1) & ((F.col("n") > 1) | (F.col("within") == 1))
    asked = known.where(~alone).select(F.col("rep._key").alias("_key"), F.col("rep._tie").alias("_tie"), F.col("rep.start").alias("start"), *body, "n", "bytes")
    lists = asked.groupBy("_key", "_tie").agg(F.collect_list(F.struct("start", *body, "n", "bytes")).alias("_runs"))
    both = rows.alias("d").join(
        lists.alias("l"), F.col("d._key").eqNullSafe(F.col("l._key")) & (F.col("d._tie") == F.col("l._tie"))
    ).select("d._text", "l._runs")

    def bodies(batches):
        for batch in batches:
            for part, data, offsets in text_blocks([batch], "_text"):
                lists = part.column(1)
                inner, sizes = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(part.num_rows), sizes)
                field = {inner.type.field(k).name: inner.field(k) for k in range(inner.type.num_fields)}
                lo = offsets[row] + field["start"].to_numpy(zero_copy_only=False)
                hi = lo + field["length"].to_numpy(zero_copy_only=False)
                view = memoryview(np.ascontiguousarray(data))
                texts = [view[a:b].tobytes() for a, b in zip(lo.tolist(), hi.tolist())]
                names = [*body, "n", "bytes"]
                yield pa.RecordBatch.from_arrays([*(field[k] for k in names), pa.array(texts, pa.binary())], names=[*names, "body"])

    schema = "low bigint, b1 bigint, length bigint, n bigint, bytes bigint, body binary"
    texts = both.mapInArrow(bodies, schema)
    small = texts.where(F.col("bytes") <= GROUP_BYTES)
    large = texts.where(F.col("bytes") > GROUP_BYTES)
    out = f"low bigint, b1 bigint, length bigint, _inner {SPANS}"

    def transform(batches):
        held, size = [], 0
        for table in groups(batches, ["low"]):
            part = table.to_pydict()
            seen = {}
            for r in zip(*(part[k] for k in (*body, "n", "body"))):
                seen.setdefault(r[:3], r)
            held += seen.values()
            size += sum(r[2] for r in seen.values())
            if size >= SHARD_BYTES or len(held) > 50_000:
                yield solve(held)
                held, size = [], 0
        if held:
            yield solve(held)

    def solve(held):
        found = [cover(np.sort(w), length) for w in repeated_windows([r[4] for r in held], length)]
        found = [[(0, r[2])] if r[3] > 1 else spans for r, spans in zip(held, found)]
        columns = [pa.array([r[k] for r in held], pa.int64()) for k in range(3)]
        return pa.RecordBatch.from_arrays([*columns, _span_lists(found)], names=[*body, "_inner"])

    by_hash = small.repartition(4 * shards, "low").sortWithinPartitions("low")
    solved = by_hash.mapInArrow(transform, out)

    def windows(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("body")).to_pylist()
            for i, raw in enumerate(texts):
                prefix = prefix_hashes(np.frombuffer(raw, np.uint8))
                at = np.arange(len(raw) - length + 1)
                h1, h2 = span_hashes(prefix, at, at + length), span_hashes(prefix, at, at + length // 2)
                columns = [batch.column(k).take(pa.array(np.full(len(at), i))) for k in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(at), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))],
                    names=[*body, "n", "at", "h1", "h2"],
                )

    each = large.dropDuplicates(body).mapInArrow(windows, "low bigint, b1 bigint, length bigint, n bigint, at bigint, h1 bigint, h2 bigint")
    twice = each.groupBy("low", "h1", "h2").agg(F.sum("n").alias("_n")).where("_n > 1").select("low", "h1", "h2")
    spread = each.join(twice, ["low", "h1", "h2"]).groupBy(*body).agg(F.sort_array(F.collect_list("at")).alias("at"))

    def covered(batches):
        for batch in batches:
            found = [cover(np.array(x, np.int64), length) for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _span_lists(found)], names=[*body, "_inner"])

    solved = solved.unionByName(spread.mapInArrow(covered, out))
    whole = known.where(alone & (F.col("n") > 1)).select(
        *body, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("length").alias("length"))).alias("_inner")
    )
    answers = cut(solved.where(F.size("_inner") > 0).unionByName(whole))
    shift = lambda s: F.struct((F.col("start") + s["start"]).alias("start"), s["length"].alias("length"))
    return runs.join(answers, body).groupBy("_key", "_tie").agg(
        F.flatten(F.collect_set(F.transform("_inner", shift))).alias("_spans")
    )


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(key, n_bytes, spans, kept): byte spans that repeat, and the bytes that are left.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else in
    the corpus, in the same text too; strings are judged on the input. Null and
    empty texts and those shorter than ``length`` stay whole. Repeated rows are documents
    of their own, so they repeat each other. Columns other than key and text are not read.
    """
    spans = repeated_spans(docs, key, text, length, gram)
    rows = docs.select(F.col(key).alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("_t", F.xxhash64("_text"))
    joined = rows.join(spans, F.col("_k").eqNullSafe(F.col("_key")) & (F.col("_t") == F.col("_tie")), "left").select("_k", "_text", "_spans")
    kind = rows.schema["_k"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part, data, offsets in text_blocks([batch], "_text"):
                view = memoryview(np.ascontiguousarray(data))
                spans, kept = [], []
                for i, found in enumerate(part.column(2).to_pylist()):
                    raw = view[offsets[i] : offsets[i + 1]]
                    merged = merge([(s["start"], s["length"]) for s in found or []])
                    spans.append(merged)
                    kept.append(without(raw, merged))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(offsets)), _span_lists(spans), pa.array(kept, pa.binary())],
                    names=["_key", "n_bytes", "spans", "kept"],
                )

    return joined.mapInArrow(run, f"_key {kind}, n_bytes bigint, spans {SPANS}, kept binary").withColumnRenamed("_key", key)


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of spans that overlap or touch."""
    out: list[list[int]] = []
    for start, size in sorted(spans):
        if out and start <= out[-1][0] + out[-1][1]:
            out[-1][1] = max(out[-1][1], start + size - out[-1][0])
        else:
            out.append([start, size])
    return [(a, b) for a, b in out]


def without(raw, spans: list[tuple[int, int]]) -> bytes:
    """Bytes outside the spans."""
    parts, at = [], 0
    for start, size in spans:
        parts.append(bytes(raw[at:start]))
        at = start + size
    return b"".join([*parts, bytes(raw[at:])])
