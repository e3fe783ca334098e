"""Arrow text columns as byte arrays, and hashes of their words, for use inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Odd multipliers; any odd value has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BLOCK_BYTES = 1 << 21

_bytes = np.random.default_rng(20240613).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, kept for the next call."""
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
                steps = np.full(max(n, BLOCK_BYTES + 1), b, np.uint64)
                steps[0] = 1
                _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; a bijection."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the ends of its rows (n + 1 offsets); null is empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_blocks(batches, column: str, limit: int = BLOCK_BYTES):
    """Runs of whole rows of about ``limit`` bytes: (rows, bytes, offsets)."""
    for batch in batches:
        data, offsets = byte_view(batch.column(batch.schema.get_field_index(column)))
        lo, n = 0, batch.num_rows
        while lo < n:
            hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
            hi = min(n, max(lo + 1, hi), lo + 60_000)
            yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            lo = hi


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over the bytes, modulo 2**64."""
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_bytes[data] * powers(len(data))[0], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte span; equal bytes have equal hashes wherever they stand."""
    with np.errstate(over="ignore"):
        return mix((prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts])


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of bytes other than ASCII white space."""
    if not len(data):
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    solid = ~_space[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1] | first[1:-1]
    end[:-1] &= ~solid[1:] | first[1:-1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(offsets, starts, "right") - 1


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z; every other byte stays."""
    return _lower[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, lower-cased in A-Z, and its row."""
    starts, ends, rows = word_spans(data, offsets)
    return span_hashes(prefix_hashes(lower_ascii(data)), starts, ends), rows


def distinct_in_rows(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, sorted by row and value; rows are below 65,536."""
    order = np.argsort(values)
    order = order[np.argsort(rows[order].astype(np.uint16), kind="stable")]
    values, rows = values[order], rows[order]
    if len(values):
        keep = np.concatenate(([True], (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])))
        values, rows = values[keep], rows[keep]
    return values, rows


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each span, one span after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Spans between consecutive bounds of an array as binary values."""
    raw = np.ascontiguousarray(values)
    ends = pa.py_buffer((np.asarray(bounds, np.int64) * raw.itemsize).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, ends, pa.py_buffer(raw.tobytes())])


def groups(batches, key: list[str]):
    """Tables of rows with equal key out of batches sorted by that key."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)) for k in key]
        change = np.zeros(batch.num_rows, bool)
        for column in columns:
            a, b = column.slice(1), column.slice(0, len(column) - 1)
            change[1:] |= pc.not_equal(a, b).fill_null(True).to_numpy(zero_copy_only=False)
        head = tuple(c[0].as_py() for c in columns)
        change[0] = head != last
        cuts = np.flatnonzero(change)
        if len(cuts) and cuts[0] == 0 and held:
            yield pa.Table.from_batches(held)
            held = []
        edges = [*([] if len(cuts) and cuts[0] == 0 else [0]), *cuts.tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            if held and lo in cuts:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
        last = tuple(c[len(c) - 1].as_py() for c in columns)
    if held:
        yield pa.Table.from_batches(held)
