"""Best-fit packing: token pieces into sequences of bounded length with minimum bin slack."""

from __future__ import annotations

import zlib
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from encore.llm.blocks import binaries, ragged
from encore.sources.workspace import cut

CAPACITY = 2048
END = 0
CACHED_PIECES = 300_000
# In front of a remembered piece: it goes through the whole tokenizer.
WHOLE = "\0"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
BLOCK_ROWS = 50_000

_encoders: dict = {}


# Bytes as the printable characters that stand for them in byte-level vocabularies.
_shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
_letters = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _shown)}


class WordEncoder:
    """Ids of words, each distinct one encoded once as long as it is remembered.

    The vocabulary drops white space and splits letters from other characters, so a text's
    ids are those of its words one after the other, and a word's are those of its letters
    and of the punctuation behind them. Small letters go to the tokenizer's model at once;
    all else goes through the whole tokenizer. The pieces remembered by a
    worker process are bounded; when full they are dropped.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.model = self.tokenizer.model
        self.clear()

    def clear(self) -> None:
        self.slots: dict[str, int] = {"": 0}
        self.starts, self.lengths, self.ids = np.zeros(1, np.int64), np.zeros(1, np.int64), np.empty(0, np.int32)

    def piece(self, piece: str) -> list[int]:
        if piece[0] == WHOLE:
            return self.tokenizer.encode(piece[1:], add_special_tokens=False).ids
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(_letters)
        return [t.id for t in self.model.tokenize(piece)]

    def remember(self, pieces: list[str]) -> np.ndarray:
        """Slots of distinct pieces."""
        missing = [p for p in pieces if p not in self.slots]
        if missing:
            new = list(map(self.piece, missing))
            n = len(self.slots)
            self.slots.update(zip(missing, range(n, n + len(missing))))
            lengths = np.fromiter(map(len, new), np.int64, len(new))
            flat = np.fromiter(chain.from_iterable(new), np.int32, int(lengths.sum()))
            self.starts = np.append(self.starts, len(self.ids) + np.cumsum(lengths) - lengths)
            self.lengths = np.append(self.lengths, lengths)
            self.ids = np.append(self.ids, flat)
        return np.fromiter(map(self.slots.__getitem__, pieces), np.int64, len(pieces))

    def split(self, found: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Letters and punctuation behind them of each word; a word of another form is a whole."""
        low = pc.utf8_lower(found)
        head = pc.utf8_rtrim(low, characters=PUNCTUATION)
        plain = pc.utf8_is_alpha(head).to_numpy(zero_copy_only=False).copy()
        other = np.flatnonzero(plain & ~pc.string_is_ascii(found).to_numpy(zero_copy_only=False))
        if len(other):
            # Marks may have to be composed first; sigma and some others have no single small form.
            at = pa.array(other)
            plain[other] = [
                is_normalized("NFC", w) and w.lower() == l and "\u03a3" not in w
                for w, l in zip(found.take(at).to_pylist(), low.take(at).to_pylist())
            ]
        marks = np.zeros(len(found), object)
        marks[:] = ""
        ended = np.flatnonzero(plain & (pc.binary_length(low).to_numpy() > pc.binary_length(head).to_numpy()))
        if len(ended):
            at = pa.array(ended)
            marks[ended] = [WHOLE + w[len(h) :] for w, h in zip(low.take(at).to_pylist(), head.take(at).to_pylist())]
        whole = pc.binary_join_element_wise(WHOLE, found, "")
        return pc.if_else(pa.array(plain), head, whole), pa.array(marks, pa.string())

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts, and how many each text has."""
        lists = pc.ascii_split_whitespace(texts)
        spread = lists.flatten().dictionary_encode()
        if len(self.slots) > CACHED_PIECES:
            self.clear()
        both = np.empty((len(spread.dictionary), 2), np.int64)
        for k, part in enumerate(self.split(spread.dictionary)):
            part = part.dictionary_encode()
            slots = self.remember(part.dictionary.to_pylist())
            both[:, k] = slots[part.indices.to_numpy(zero_copy_only=False)] if len(part) else 0
        lengths = self.lengths[both]
        flat = self.ids[ragged(self.starts[both].ravel(), lengths.ravel())]
        lengths = lengths.sum(axis=1)
        starts = np.cumsum(lengths) - lengths
        word = spread.indices.to_numpy(zero_copy_only=False)
        sizes = lengths[word]
        ids = flat[ragged(starts[word], sizes)]
        sums = np.concatenate(([0], np.cumsum(sizes)))
        bounds = lists.offsets.to_numpy(zero_copy_only=False)
        return ids, np.diff(sums[bounds - bounds[0]])


def token_pieces(
    docs: DataFrame,
    vocabulary: str,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end: int = END,
    keep_ids: bool = False,
) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]) of every document.

    A document's ids are those of the tokenizer file ``vocabulary``, without
    special tokens, and then ``end``; a null or empty text has only that one. Only
    documents with more than ``capacity`` ids are cut. ``ids`` are little-endian
    unsigned 32-bit numbers. The vocabulary must split at white space, as word
    vocabularies do.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"_key {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * keep_ids

    def cut_up(batches):
        encoder = _encoders.get(vocabulary) or _encoders.setdefault(vocabulary, WordEncoder(vocabulary))
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            lo = 0
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            while lo < batch.num_rows:
                at = ends[lo] - sizes[lo]
                hi = max(lo + 1, int(np.searchsorted(ends, at + (1 << 23), "right")))
                ids, counts = encoder.encode(texts.slice(lo, hi - lo))
                yield from rows(batch.column(0).slice(lo, hi - lo), ids, counts)
                lo = hi

    def rows(keys, ids, counts):
        total = counts + 1
        at = np.concatenate(([0], np.cumsum(total)))
        full = np.full(int(at[-1]), end, "<u4")
        full[ragged(at[:-1], counts)] = ids
        pieces = -(-total // capacity)
        doc = np.repeat(np.arange(len(total)), pieces)
        number = ragged(np.zeros(len(total), np.int64), pieces)
        start = number * capacity
        length = np.minimum(capacity, total[doc] - start)
        begin = at[doc] + start
        view = memoryview(full.tobytes())
        crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist())]
        columns = [
            keys.take(pa.array(doc)), pa.array(number, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()),
        ]
        names = ["_key", "piece", "start", "length", "ids_crc32"]
        if keep_ids:
            columns.append(binaries(full, np.append(begin, at[-1])))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(columns, names=names)

    plain = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return plain.mapInArrow(cut_up, schema).withColumnRenamed("_key", key)


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The fullest combination that holds the longest available length.

    Subset sums are bits of one integer; an available length joins with as many
    copies as there are, in powers of two. The steps are then walked back.
    """
    order = sorted((n for n, c in counts.items() if c), reverse=True)
    room = capacity - order[0]
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for n in order:
        left = min(counts[n] - (n == order[0]), room // n)
        copies = 1
        while left > 0 and not reach >> room & 1:
            k = min(copies, left)
            more = (reach | reach << (n * k)) & mask
            if more != reach:
                steps.append((n, k, reach))
                reach = more
            left -= k
            copies *= 2
        if reach >> room & 1:
            break
    use, best = {order[0]: 1}, reach.bit_length() - 1
    for n, k, before in reversed(steps):
        if not before >> best & 1:
            use[n] = use.get(n, 0) + k
            best -= n * k
    return use


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Combinations and how often each is repeated until all lengths are used up.

    As long as a combination's lengths are available, the next bin would get the
    same one, so it is repeated at once. One length at least runs short each time:
    the list grows with the number of distinct lengths, not with the rows.
    """
    counts = {n: c for n, c in counts.items() if c}
    out = []
    while counts:
        use = fullest(counts, capacity)
        times = min(counts[n] // k for n, k in use.items())
        out.append((use, times))
        for n, k in use.items():
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
    return out


def pack(pieces: DataFrame, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece"), capacity: int = CAPACITY) -> DataFrame:
    """Add (sequence_id, offset): bins of ``capacity`` filled by minimum bin slack.

    ``pieces`` should be a stored table, as it is read three times. Only the
    counts of the at most ``capacity`` distinct lengths reach the driver; the
    combinations found there are sent to the tasks, where a piece's rank among
    the pieces of its length says its sequence and place. Ranks are block totals
    plus ranks inside blocks of some ten thousand rows, so a length that holds
    most rows is spread. Columns with the names of the new ones are replaced.
    Lengths must lie between 1 and ``capacity``; an empty table gives none.
    """
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    rows = pieces.select(*kept)
    counts = {int(n): int(c) for n, c in rows.groupBy(length).count().collect()}
    if any(n < 1 or n > capacity for n in counts):
        raise ValueError(f"lengths must be between 1 and {capacity}")
    places, first = [], 0
    taken: dict[int, int] = {}
    for use, times in patterns(counts, capacity):
        at = 0
        for n, k in sorted(use.items(), reverse=True):
            places.append((n, taken.get(n, 0), k, at, first))
            taken[n] = taken.get(n, 0) + k * times
            at += n * k
        first += times
    table = np.array(sorted(places), np.int64).reshape(-1, 5)
    sent = rows.sparkSession.sparkContext.broadcast(table)
    blocks = max(16, -(-sum(counts.values()) // BLOCK_ROWS))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)))
    before = Window.partitionBy(length).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        rows.groupBy(length, "_block").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    )
    inside = Window.partitionBy(length, "_block").orderBy(*order)
    ranked = rows.join(sums, [length, "_block"]).withColumn(
        "_rank", F.col("_before") + F.row_number().over(inside) - 1
    ).select(*kept, "_rank")

    def place(batches):
        table = sent.value
        keys = (table[:, 0] << 48) + table[:, 1]
        for batch in batches:
            n = batch.column(kept.index(length)).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(len(kept)).to_numpy(zero_copy_only=False)
            row = table[np.searchsorted(keys, (n << 48) + rank, "right") - 1] if len(n) else table[:0]
            since = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(row[:, 4] + since // row[:, 2]), pa.array(row[:, 3] + since % row[:, 2] * n)],
                names=[*kept, "sequence_id", "offset"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields[:-1])
    return ranked.mapInArrow(place, f"{schema}, sequence_id bigint, offset bigint")


def packed(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Token pieces of all documents with their sequence and place in it.

    Repeated rows are packed as often as they stand in ``docs``. The pieces are
    stored once in the shared folder, so texts are encoded once.
    """
    pieces = cut(token_pieces(docs, vocabulary, key, text, capacity, keep_ids=keep_ids))
    return pack(pieces, "length", (key, "piece"), capacity)
