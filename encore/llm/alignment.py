"""Alignment of two tokenizers' tokens by lockstep merging of their byte ranges."""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from encore.llm.blocks import binaries, byte_view, ragged, text_blocks
from encore.sources.workspace import cut

# A-tokens of one lane; a long document is cut into lanes, so that all lanes end at about the same step.
LANE = 256
# Bytes of text of one block, a run of documents of one task whose linked pairs are counted together.
COUNTED_BYTES = 1 << 26
CACHED_UNITS = 300_000
HELD_PAIRS = 1 << 22

# The published pattern of byte-level vocabularies, and their printable characters for bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
_byte_of = {chr(b): b for b in _shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in _shown)}

_loaded: dict = {}


class BytePieces:
    """Ids and bytes of a byte-level BPE vocabulary; special tokens in a text are plain text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        known = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max(known.values()) + 1
        self.bytes = [b""] * self.size
        for piece, k in known.items():
            self.bytes[k] = bytes(map(_byte_of.__getitem__, piece)) if set(piece) <= _byte_of.keys() else piece.encode()
        ranks = {self.bytes[k]: k for k in spec["model"]["vocab"].values()}
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        made = [spec["model"]["vocab"][m] for m in merged]
        # Merges by rank are merges by id if ids were given in the order of the merges.
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        shaped = spec["pre_tokenizer"].items() >= plain.items() and spec.get("normalizer") is None
        if not shaped or made != sorted(made) or not all(bytes([b]) in ranks for b in range(256)):
            raise ValueError(f"{path} is no byte-level vocabulary with ids in the order of its merges")
        import tiktoken

        self.encoding = tiktoken.Encoding("units", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, units: list[str]) -> list[list[int]]:
        return list(map(self.encoding.encode_ordinary, units))


class WordPieces:
    """Ids and bytes of a sentence-piece vocabulary that puts a space in front of what it encodes."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        pieces = list(map(self.model.id_to_piece, range(self.size)))
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError(f"{path} has pieces that reach over a space")
        self.bytes = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)
        ]

    def encode(self, units: list[str]) -> list[list[int]]:
        # The model gives nothing for an empty text, but a unit is what stands behind a space.
        space = [self.model.piece_to_id("▁")]
        return [ids if u else space for u, ids in zip(units, self.model.encode(units, num_threads=1))]


class Units(dict):
    """Slots of remembered units: texts with the one space in front of them left out.

    A text is cut at each space behind a character that is no white space. No piece of
    either vocabulary reaches over such a place, so the ids of a text are those of its
    units, and each distinct unit is encoded once as long as it is remembered. What a worker
    process remembers is bounded; when full it is dropped.
    """

    def __init__(self, a_path: str, b_path: str):
        super().__init__()
        self.a, self.b = BytePieces(a_path), WordPieces(b_path)
        self.lengths = [np.fromiter(map(len, x.bytes), np.int64, x.size) for x in (self.a, self.b)]
        self.names = self.group_names()
        self.forget()

    def group_names(self) -> list[bytes]:
        """Written forms of A ids inside and at the end of a group, then of B ids."""
        return [b"%d%s" % (k, mark) for size, end in ((self.a.size, b"|"), (self.b.size, b";")) for mark in (b",", end) for k in range(size)]

    def forget(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.flat = [np.empty(0, np.int32) for _ in range(2)]
        self.counts = [np.empty(0, np.int64) for _ in range(2)]
        self.right = np.empty(0, bool)

    def __missing__(self, unit: str) -> int:
        self[unit] = slot = len(self)
        self.new.append(unit)
        return slot

    def learn(self) -> None:
        """Encode the units met since the last time."""
        if not self.new:
            return
        spaced = [" " + u for u in self.new]
        right = np.ones(len(self.new), bool)
        for k, (vocabulary, units) in enumerate(((self.a, spaced), (self.b, self.new))):
            lists = vocabulary.encode(units)
            right &= [b"".join(map(vocabulary.bytes.__getitem__, x)) == s.encode() for x, s in zip(lists, spaced)]
            counts = np.fromiter(map(len, lists), np.int64, len(lists))
            self.flat[k] = np.append(self.flat[k], np.fromiter(chain.from_iterable(lists), np.int32, int(counts.sum())))
            self.counts[k] = np.append(self.counts[k], counts)
        self.right = np.append(self.right, right)
        self.new = []

    def tokens(self, texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """For A and B all ids and how many each text has; and which texts have their bytes rendered.

        Empty texts and texts with other bytes have no tokens.
        """
        if len(self) > CACHED_UNITS:
            self.forget()
        split = [odd_units(t) if _odd.search(t) else t.split(" ") for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        slots = np.fromiter(map(self.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        self.learn()
        wrong = np.concatenate(([0], np.cumsum(~self.right[slots])))
        ends = np.cumsum(sizes)
        valid = (wrong[ends] == wrong[ends - sizes]) & np.fromiter(map(bool, texts), bool, len(texts))
        slots, sizes = slots[np.repeat(valid, sizes)], np.where(valid, sizes, 0)
        ends = np.cumsum(sizes)
        out = []
        for flat, counts in zip(self.flat, self.counts):
            starts = np.cumsum(counts) - counts
            per_unit = counts[slots]
            sums = np.concatenate(([0], np.cumsum(per_unit)))
            out.append((flat[ragged(starts[slots], per_unit)], sums[ends] - sums[ends - sizes]))
        return out, valid


# The space in front of a text counts as well.
_odd = re.compile(r"\A |\s ")
_bounds = re.compile(r"(?<=\S)(?= )")


def odd_units(text: str) -> list[str]:
    """Units of a text that has spaces behind white space."""
    return [u[1:] for u in _bounds.split(" " + text)]


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, a_counts: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, ...]:
    """Overlapping pairs of tokens (i, j), and the last tokens (i, j) of each group.

    ``a_ends`` and ``b_ends`` are the byte offsets at which tokens end, documents one
    behind the other, so that both have an end where a document ends. One state vector
    holds a pointer into A and one into B for every lane; in each step all lanes emit their pair
    and, where both tokens end, a cut, and move the pointer of the token that ends first.
    Lanes that are through are taken out. Lanes begin at every ``lane``-th A-token of a
    document, at the B-token that covers its first byte.
    """
    lanes = -(-a_counts // lane)
    first = np.repeat(np.cumsum(a_counts) - a_counts, lanes) + lane * ragged(np.zeros(len(lanes), np.int64), lanes)
    stop = np.minimum(first + lane, np.repeat(np.cumsum(a_counts), lanes))
    begin = np.concatenate(([0], a_ends))[first]
    i, j = first, np.searchsorted(b_ends, begin, "right")
    links, cuts = [], []
    while len(i):
        links.append((i, j))
        a, b = a_ends[i], b_ends[j]
        both = a == b
        cuts.append((i[both], j[both]))
        i, j = i + (a <= b), j + (b <= a)
        going = i < stop
        if not going.all():
            i, j, stop = i[going], j[going], stop[going]
    empty = np.empty(0, np.int64)
    parts = [[np.concatenate([empty, *(x[k] for x in found)]) for k in (0, 1)] for found in (links, cuts)]
    return (*parts[0], *parts[1])


class Aligned:
    """Tokens, links and groups of a run of texts."""

    def __init__(self, units: Units, texts: list[str]):
        self.units = units
        (self.a, self.n_a), (self.b, self.n_b) = units.tokens(texts)[0]
        a_ends, b_ends = (np.cumsum(length[x]) for length, x in zip(units.lengths, (self.a, self.b)))
        self.i, self.j, self.cut_a, self.cut_b = lockstep(a_ends, b_ends, self.n_a)
        row = np.repeat(np.arange(len(texts)), self.n_a)
        self.link_row = row[self.i]
        self.n_links = np.bincount(self.link_row, minlength=len(texts))
        self.n_groups = np.bincount(row[self.cut_a], minlength=len(texts))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct linked pairs of ids of each text: row, pair, and how many links have it."""
        pair = self.a[self.i].astype(np.int64) * self.units.b.size + self.b[self.j]
        code = self.link_row * (self.units.a.size * self.units.b.size) + pair
        code.sort()
        head = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.empty(0, np.int64)
        row, pair = np.divmod(code[head], self.units.a.size * self.units.b.size)
        return row, pair, np.diff(np.append(head, len(code)))

    def written_groups(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each text."""
        last_a, last_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        last_a[self.cut_a], last_b[self.cut_b] = True, True
        per_a, per_b = (np.diff(np.flatnonzero(x), prepend=-1) for x in (last_a, last_b))
        group_a, group_b = (np.cumsum(x) - x for x in (last_a, last_b))
        before_a, before_b = np.cumsum(per_a), np.cumsum(per_b) - per_b
        order = np.empty(len(self.a) + len(self.b), np.int64)
        size_a, size_b = self.units.a.size, self.units.b.size
        order[np.arange(len(self.a)) + before_b[group_a]] = self.a + size_a * last_a
        order[np.arange(len(self.b)) + before_a[group_b]] = self.b + 2 * size_a + size_b * last_b
        names = list(map(self.units.names.__getitem__, order.tolist()))
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        return [b"".join(names[lo:hi])[:-1] for lo, hi in zip([0, *ends], ends)]


def units_of(a_path: str, b_path: str) -> Units:
    """The vocabularies of this worker process, loaded once."""
    if (a_path, b_path) not in _loaded:
        _loaded[a_path, b_path] = Units(a_path, b_path)
    return _loaded[a_path, b_path]


def totals(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The counts of pairs, each pair once and sorted."""
    none = np.empty(0, np.int64)
    pair, count = (np.concatenate(x) for x in zip((none, none), *parts))
    order = np.argsort(pair, kind="stable")
    pair, count = pair[order], count[order]
    head = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))) if len(pair) else np.empty(0, np.int64)
    return pair[head], np.add.reduceat(count, head) if len(head) else count


def pair_type(a_size: int, b_size: int) -> type:
    """Unsigned type that holds every pair of ids."""
    return np.uint32 if a_size * b_size <= 1 << 32 else np.uint64


def aligned_blocks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Documents with their figures and linked pairs, and the pairs of each block with their numbers of documents.

    ``docs`` has (_key, _text). A row is a document with its block, or a ``pair`` of its
    block (``docs`` is not null). ``pairs`` and ``times`` hold a document's distinct pairs,
    as unsigned 64-bit values where 32 bits are too few, and how many links have each, in 32 bits. A block is a run of
    documents of one task with ``COUNTED_BYTES`` of text. The rows have to be written before they are
    used, so that documents and pairs belong together for good.
    """
    kind = docs.schema["_key"].dataType.simpleString()
    numbers = ["n_a", "n_b", "n_groups", "n_links"]
    fields = f"_key {kind}, {', '.join(f'{n} bigint' for n in numbers)}, groups_sha256 string, pairs binary, times binary"

    def run(batches):
        units = units_of(a_path, b_path)
        word = pair_type(units.a.size, units.b.size)
        block, size, held, schema = TaskContext.get().partitionId() << 24, 0, [], None

        def close():
            pair, count = totals(held)
            for lo in range(0, len(pair), 100_000):
                part = pair[lo : lo + 100_000]
                absent = [pa.nulls(len(part), f.type) for f in schema][:8]
                yield pa.RecordBatch.from_arrays(
                    [*absent, pa.array(np.full(len(part), block)), pa.array(part), pa.array(count[lo : lo + 100_000])], schema=schema
                )

        for part, data, _ in text_blocks(batches, "_text"):
            schema = schema or pa.schema(
                [("_key", part.schema.field(0).type), *((n, pa.int64()) for n in numbers), ("groups_sha256", pa.string()),
                 ("pairs", pa.binary()), ("times", pa.binary()), ("block", pa.int64()), ("pair", pa.int64()), ("docs", pa.int64())]
            )
            found = Aligned(units, [t or "" for t in part.column(1).to_pylist()])
            groups = [hashlib.sha256(g).hexdigest() if n else "" for g, n in zip(found.written_groups(), found.n_a)]
            row, pair, times = found.pairs()
            bounds = np.searchsorted(row, np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(x) for x in (found.n_a, found.n_b, found.n_groups, found.n_links)), pa.array(groups, pa.string()),
                 binaries(pair.astype(word), bounds), binaries(times.astype(np.uint32), bounds),
                 pa.array(np.full(part.num_rows, block)), *[pa.nulls(part.num_rows, pa.int64())] * 2], schema=schema,
            )
            held.append((pair, np.ones(len(pair), np.int64)))
            size += len(data)
            if len(held) > 1 and sum(len(p) for p, _ in held) > HELD_PAIRS:
                held = [totals(held)]
            if size >= COUNTED_BYTES:
                yield from close()
                block, size, held = block + 1, 0, []
        if schema is not None:
            yield from close()

    return docs.mapInArrow(run, f"{fields}, block bigint, pair bigint, docs bigint")


def counted_pairs(pairs: DataFrame, b_size: int) -> DataFrame:
    """(pair, n, best): in how many documents each pair of ids is linked, and whether no other
    pair of its A id is in more. ``pairs`` has (pair, docs)."""
    counts = cut(pairs.groupBy("pair").agg(F.sum("docs").alias("n")).withColumn("a", F.expr(f"pair div {b_size}")))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    A encodes a space and the text, B the text, to which it adds the space itself. A null or
    empty text, and one of which either side's joined bytes differ from space and text, has no
    tokens: zeros and an empty digest. Counts are over all rows, repeated ones included.
    An empty table gives no row. Other columns are not read.

    Counts go back to the documents by block: a block has each of its pairs once, so
    what is shuffled for them is far less than all links, and no pair gathers its documents.
    """
    plain = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    stored = cut(aligned_blocks(plain, a_path, b_path))
    own = stored.where("docs is null").drop("pair", "docs")
    blocks = stored.where("docs is not null").select("block", "pair", "docs")
    a_size, b_size = BytePieces(a_path).size, WordPieces(b_path).size
    counted = counted_pairs(blocks.select("pair", "docs"), b_size)
    sent = blocks.select("block", "pair").join(counted, "pair").select("block", "pair", "n", "best")
    both = own.unionByName(sent, allowMissingColumns=True)
    dealt = both.repartition("block").sortWithinPartitions("block", F.col("pair").asc_nulls_last())
    kind = plain.schema["_key"].dataType.simpleString()
    figures = ["n_a", "n_b", "n_groups", "n_links"]

    def run(batches):
        block, known, table = None, [], None
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            edges = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges, edges[1:]):
                if hi == lo:
                    continue
                some = batch.slice(lo, hi - lo)
                if blocks[lo] != block:
                    block, known, table = blocks[lo], [], None
                n_pairs = some.num_rows - some.column("pair").null_count
                if n_pairs:
                    head = some.slice(0, n_pairs)
                    known.append([head.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "n", "best")])
                rows = some.slice(n_pairs)
                if not rows.num_rows:
                    continue
                if table is None:
                    table = [np.concatenate(x) for x in zip(*known)] if known else [np.empty(0, np.int64)] * 3
                sums = np.zeros((2, rows.num_rows), np.int64)
                data, bounds = byte_view(rows.column("pairs"))
                pair = np.frombuffer(data.tobytes(), word).astype(np.int64)
                times = np.frombuffer(byte_view(rows.column("times"))[0].tobytes(), np.uint32).astype(np.int64)
                at = np.searchsorted(table[0], pair)
                row = np.repeat(np.arange(rows.num_rows), np.diff(bounds) // np.dtype(word).itemsize)
                np.add.at(sums, (slice(None), row), np.stack((times * table[2][at], times * table[1][at])))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("_key"), *(rows.column(c) for c in figures), pa.array(sums[0]), pa.array(sums[1]), rows.column("groups_sha256")],
                    names=["_key", *figures, "n_best", "count_sum", "groups_sha256"],
                )

    word = pair_type(a_size, b_size)
    schema = f"_key {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    return dealt.mapInArrow(run, schema).withColumnRenamed("_key", key)
