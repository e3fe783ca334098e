"""Line dedup: content-defined chunks of lines, removed where they repeat."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from encore.llm.blocks import _space, binaries, mix, prefix_hashes, ragged, span_hashes, text_blocks
from encore.operators.skew import salted_join
from encore.sources.workspace import cut

# A single line is a chunk from so many words or bytes on.
LONG_WORDS = 50
LONG_BYTES = 300
NEWLINE = 10


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (without the newline) and row of every line; an empty row has one empty line."""
    breaks = np.flatnonzero(data == NEWLINE)
    starts = np.sort(np.concatenate((offsets[:-1], breaks + 1)), kind="stable")
    ends = np.sort(np.concatenate((breaks, offsets[1:])), kind="stable")
    per_row = np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + 1
    return starts, ends, np.repeat(np.arange(len(offsets) - 1), per_row)


def rolled(hashes: np.ndarray) -> np.ndarray:
    """Hash of each line and the one behind it, rolled over the hashes of the lines."""
    with np.errstate(over="ignore"):
        return mix(hashes[:-1] * np.uint64(0x9DDFEA08EB382D69) + hashes[1:])


def windows(docs: DataFrame, key: str, tie: str, text: str) -> DataFrame:
    """(_key, _tie, start, length, digest): every two neighbouring lines, and every long line.

    Lines of white space only are no lines of their own; those between two neighbours
    belong to the window. ``digest`` is the rolling hash over the line hashes and, as
    white space counts too, the hash of the window's bytes.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for part, data, offsets in text_blocks(batches, "_text"):
            starts, ends, rows = line_spans(data, offsets)
            filled = ~_space[data]
            begins = filled.copy()
            begins[1:] &= ~filled[:-1]
            solid, word = (np.concatenate(([0], np.cumsum(x))) for x in (filled, begins))
            full = np.flatnonzero(solid[ends] > solid[starts])
            if not len(full):
                continue
            lo, hi, row = starts[full], ends[full], rows[full]
            # A row may begin within a run of filled bytes: its first word counts too.
            count = word[hi] - word[lo] + (filled[lo] & ~begins[lo])
            long = (count >= LONG_WORDS) | (hi - lo >= LONG_BYTES)
            pair = row[1:] == row[:-1]
            prefix = prefix_hashes(data)
            own = span_hashes(prefix, lo, hi)
            first, last = np.concatenate((lo[:-1][pair], lo[long])), np.concatenate((hi[1:][pair], hi[long]))
            row = np.concatenate((row[:-1][pair], row[long]))
            both = np.stack((np.concatenate((rolled(own)[pair], own[long])), span_hashes(prefix, first, last)), axis=1)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(take), part.column(1).take(take), pa.array(first - offsets[row]),
                    pa.array(last - first), binaries(both.ravel(), np.arange(0, 2 * len(row) + 1, 2)),
                ],
                names=["_key", "_tie", "start", "length", "digest"],
            )

    plain = docs.select(F.col(key).alias("_key"), F.col(tie).alias("_tie"), F.col(text).alias("_text"))
    return plain.mapInArrow(run, f"_key {kind}, _tie bigint, start bigint, length bigint, digest binary")


def window_bytes(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """(_key, _tie, start, length, digest, own, body): the bytes of the listed windows of each text."""
    both = rows.alias("d").join(
        listed.alias("l"), F.col("d._key").eqNullSafe(F.col("l._key")) & (F.col("d._tie") == F.col("l._tie"))
    ).select("d._key", "d._tie", "d._text", "l._spans")
    names = ["start", "length", "digest", "own"]

    def run(batches):
        for batch in batches:
            for part, data, offsets in text_blocks([batch], "_text"):
                spans = part.column(3)
                inner, sizes = spans.flatten(), spans.value_lengths().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(part.num_rows), sizes)
                start, length = (inner.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                bounds = np.concatenate(([0], np.cumsum(length)))
                body = binaries(data[ragged(offsets[row] + start, length)], bounds)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), *(inner.field(k) for k in range(4)), body],
                    names=["_key", "_tie", *names, "body"],
                )

    kind = rows.schema["_key"].dataType.simpleString()
    return both.mapInArrow(run, f"_key {kind}, _tie bigint, start bigint, length bigint, digest binary, own boolean, body binary")


def repeated_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_key, _tie, spans): byte spans of what another place holds first, as windows that make up chunks.

    The boundaries of chunks follow from the content: lines i and i + 1 are in one chunk
    if the rolling hash over the two occurs in another place too, and there is a boundary
    between them if it does not. So a repeated passage of two lines or more is a chunk
    wherever it stands, whatever stands around it, and inserted or removed lines shift nothing; a long
    line is a chunk of its own. Hashes only say what may be equal: every window is
    removed only if its bytes are those of the window's first place by key, text hash and
    position. ``_tie`` is a hash of the text, so that rows are told apart by key and text.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).withColumn("_tie", F.xxhash64("_text"))
    found = cut(windows(rows, "_key", "_tie", "_text"))
    place = F.struct("_key", "_tie", "start")
    twice = found.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("_first")).where("n > 1")
    some = salted_join(found, twice, "digest", "n").withColumn("own", place.eqNullSafe(F.col("_first")))
    listed = some.groupBy("_key", "_tie").agg(F.collect_set(F.struct("start", "length", "digest", "own")).alias("_spans"))
    compared = cut(window_bytes(rows, listed))
    first = compared.where("own").groupBy("digest").agg(F.first("body").alias("_body"))
    # Adaptive execution splits a digest with many rows; the other side has one row of it.
    again = compared.where("NOT own").join(first, "digest").where(F.col("body") == F.col("_body"))
    return again.groupBy("_key", "_tie").agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias("_spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans (start, length) with overlapping ones made one."""
    out: list[tuple[int, int]] = []
    for start, length in spans:
        if out and start < sum(out[-1]):
            out[-1] = (out[-1][0], max(sum(out[-1]), start + length) - out[-1][0])
        else:
            out.append((start, length))
    return out


def dedup_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", removed: str = "removed_lines") -> DataFrame:
    """All rows with repeated chunks taken out of the text, and how many lines went.

    A chunk is two lines or more, or one line of 50 words or 300 bytes. Its first place
    by key, text hash and position stays, so the first place of any line stays too. What
    is left keeps its line breaks; a text of which all lines go is empty, null stays null.
    Rows with equal key and text are one document, so they keep the same lines. An empty
    table gives no row. A column named like ``removed`` is replaced; all other columns stay as they are.
    """
    return _rebuilt(docs, repeated_chunks(docs, key, text), key, text, removed)


def _rebuilt(docs: DataFrame, spans: DataFrame, key: str, text: str, removed: str) -> DataFrame:
    kept = [c for c in docs.columns if c != removed]
    rows = docs.select(F.struct(*kept).alias("_row"), F.col(key).alias("_k"), F.xxhash64(text).alias("_t"))
    joined = rows.join(spans, F.col("_k").eqNullSafe(F.col("_key")) & (F.col("_t") == F.col("_tie")), "left").select("_row.*", "_spans")
    at = kept.index(text)

    def rebuild(batches):
        for batch in batches:
            old, spans = batch.column(at), batch.column(len(kept))
            counts = np.zeros(batch.num_rows, np.int64)
            changed = np.flatnonzero(~spans.is_null().to_numpy(zero_copy_only=False))
            if len(changed):
                values = old.to_pylist()
                for i in changed.tolist():
                    values[i], counts[i] = without(values[i], merged([(s["start"], s["length"]) for s in spans[i].as_py()]))
                old = pa.array(values, old.type)
            columns = [*batch.columns[:at], old, *batch.columns[at + 1 : len(kept)], pa.array(counts)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, removed])

    fields = joined.schema.fields[:-1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return joined.mapInArrow(rebuild, f"{schema}, `{removed}` bigint")


def without(text: str, spans: list[tuple[int, int]]) -> tuple[str, int]:
    """Text without the lines of the byte spans, and the number of these lines."""
    raw, parts, at, gone = text.encode(), [], 0, 0
    for start, length in spans:
        if start > at:
            parts.append(raw[at : start - 1])
        gone += raw.count(b"\n", start, start + length) + 1
        at = start + length + 1
    if at <= len(raw):
        parts.append(raw[at:])
    return b"\n".join(parts).decode(), gone
