"""Document fingerprints: I-Match over several randomised lexicon subsets."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from encore.llm.blocks import BLOCK_BYTES, byte_view, distinct_in_rows, mix, text_blocks, words
from encore.sources.workspace import cut

SUBSETS = 64
# A subset takes a term with probability 2**-rate; the rates are dealt out in turn.
RATES = (2, 4, 6, 6, 8, 8, 8, 10)
MAX_TERMS = 1 << 17
COMMON = 0.1
SLOTS = 1 << 24


def document_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, n): hash of each lower-cased word and the number of documents that hold it."""
    return _summed(_counted(docs.select(F.col(text).alias("_text"))))


def _summed(parts: DataFrame) -> DataFrame:
    return parts.groupBy("term").agg(F.sum("n").alias("n"))


def _counted(rows: DataFrame) -> DataFrame:
    def count(batches):
        held, size = [], 0

        def flush():
            term, n = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(term)
            term, n = term[order], n[order]
            at = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
            return pa.RecordBatch.from_arrays(
                [pa.array(term[at].view(np.int64)), pa.array(np.add.reduceat(n, at))], names=["term", "n"]
            )

        for _, data, offsets in text_blocks(batches, "_text"):
            terms, _ = distinct_in_rows(*words(data, offsets))
            if len(terms):
                held.append(np.unique(terms, return_counts=True))
                size += len(held[-1][0])
            if size > 1_000_000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return rows.mapInArrow(count, "term bigint, n bigint")


def distinct_frequencies(docs: DataFrame, text: str = "text") -> tuple[DataFrame, int]:
    """(term, n) over distinct texts, told apart by a 64-bit hash, and their number.

    Texts that no other row holds are counted where they are. Only rows whose hash falls
    into a slot of a text that occurs twice are sent, once per task, and counted once.
    """
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    sizes = cut(rows.groupBy("_hash").agg(F.count(F.lit(1)).alias("n")))
    slots = sizes.where("n > 1").select(F.pmod("_hash", F.lit(SLOTS)).cast("int").alias("slot")).distinct().toArrow()
    taken = np.zeros(SLOTS, np.uint8)
    taken[slots.column(0).to_numpy()] = 1
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(taken))

    def split(twice):
        def run(batches):
            slot, seen = np.unpackbits(sent.value).astype(bool), set()
            for batch in batches:
                value = batch.column(1).to_numpy()
                hit = slot[value % SLOTS]
                if twice:
                    again = np.flatnonzero(hit)
                    fresh = []
                    for i, h in zip(again.tolist(), value[again].tolist()):
                        if h not in seen:
                            seen.add(h)
                            fresh.append(i)
                    yield batch.take(pa.array(fresh, pa.int64()))
                else:
                    yield batch.filter(pa.array(~hit))

        return rows.mapInArrow(run, "_text string, _hash bigint")

    copies = split(True).dropDuplicates(["_hash"])
    parts = _counted(split(False).select("_text")).unionByName(_counted(copies.select("_text")))
    return _summed(parts), sizes.count()


class Lexicon:
    """Terms of the chosen band with the subsets each belongs to."""

    def __init__(self, terms: np.ndarray, seed: int = 7):
        self.terms = np.sort(terms.astype(np.int64).view(np.uint64))
        self.values = mix(self.terms ^ np.uint64(seed))
        self.subsets = np.zeros(len(self.terms), np.uint64)
        for j in range(SUBSETS):
            draw = mix(self.values ^ mix(np.array([j + 1], np.uint64))[0])
            inside = draw < np.uint64(1 << (64 - RATES[j % len(RATES)]))
            self.subsets |= inside.astype(np.uint64) << np.uint64(j)

    def fingerprints(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One row of 64 hashes and a fallback per document, as 65 unsigned numbers of 32 bits.

        A subset's hash stands for the document's sorted distinct terms in it; 0: none.
        The fallback, used only if the document has no term of the lexicon, stands for
        all its distinct words.
        """
        n = len(offsets) - 1
        out = np.zeros((n, SUBSETS + 1), np.uint32)
        terms, rows = distinct_in_rows(*words(data, offsets))
        ends = np.searchsorted(rows, np.arange(n + 1))
        with np.errstate(over="ignore"):
            total = np.concatenate(([np.uint64(0)], np.cumsum(mix(terms))))
            every = (mix(total[ends[1:]] - total[ends[:-1]] + np.uint64(1)) >> np.uint64(32)) | np.uint64(1)
            at = np.searchsorted(self.terms, terms)
            at[at == len(self.terms)] = 0
            known = self.terms[at] == terms if len(self.terms) else np.zeros(len(terms), bool)
            at, rows = at[known], rows[known]
            ends = np.searchsorted(rows, np.arange(n + 1))
            value, member = self.values[at], self.subsets[at]
            sums = np.zeros(len(at) + 1, np.uint64)
            for j in range(SUBSETS):
                np.cumsum(value * (member >> np.uint64(j) & np.uint64(1)), out=sums[1:])
                s = sums[ends[1:]] - sums[ends[:-1]]
                out[:, j] = np.where(s == 0, 0, (mix(s + np.uint64(j)) >> np.uint64(32)) | np.uint64(1))
        out[:, SUBSETS] = np.where(ends[1:] == ends[:-1], every, 0)
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal hashes among the subsets that either document has terms in.

    Documents without terms of the lexicon are alike only if their words are equal.
    """
    used = (a[:, :SUBSETS] != 0) | (b[:, :SUBSETS] != 0)
    same = used & (a[:, :SUBSETS] == b[:, :SUBSETS])
    total = used.sum(axis=1)
    equal = (a == b).all(axis=1)
    return np.where(total > 0, np.where(equal, 1.0, same.sum(axis=1) / np.maximum(total, 1)), equal.astype(float))


def fit_lexicon(docs: DataFrame, text: str = "text", max_terms: int = MAX_TERMS, common: float = COMMON) -> Lexicon:
    """The band of inverse document frequency, counted over all distinct texts.

    A term is too common above the share ``common`` of texts. It is too rare below
    one ``max_terms``-th of all (text, term) pairs, so the lexicon has at most
    ``max_terms`` terms however large the corpus is, and may be sent to all tasks.
    """
    counts, rows = distinct_frequencies(docs, text)
    counts = cut(counts)
    pairs = counts.agg(F.sum("n")).first()[0] or 0
    low, high = max(2, -(-pairs // max_terms)), max(2, int(common * rows))
    terms = counts.where((F.col("n") >= low) & (F.col("n") <= high)).select("term").toArrow()
    return Lexicon(terms.column(0).to_numpy())


def _column(hashes: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in hashes], pa.binary())


def fingerprint(docs: DataFrame, lexicon: Lexicon, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """All rows with their fingerprint as hexadecimal text; a column of that name is replaced.

    Equal texts have equal fingerprints. Null is an empty text.
    """
    kept = docs.select(*[c for c in docs.columns if c != name])
    sent, names = docs.sparkSession.sparkContext.broadcast(lexicon), [*kept.columns, name]

    def run(batches):
        for part, data, offsets in text_blocks(batches, text):
            hashes = sent.value.fingerprints(data, offsets)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([r.tobytes().hex() for r in hashes])], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{schema}, `{name}` string")


def compare_with_next(docs: DataFrame, lexicon: Lexicon, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each document and of its text edited with that of the next one.

    The next document is the one with the next larger integer key, then text hash;
    after the last comes the first; a null key comes first of all. Texts move once:
    they go to ranges of keys, whose bounds are keys of documents, and the first
    document of a range also goes to the range before it.
    """
    spark = docs.sparkSession
    least = -(1 << 63)
    rows = docs.select(
        F.coalesce(F.col(key).cast("long"), F.lit(least)).alias("_at"),
        F.col(key).alias("_key"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
    )
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [k / ranges for k in range(ranges)]
    found = rows.agg(F.percentile_approx("_at", shares, 10 * ranges).alias("b"), F.min("_at").alias("m")).first()
    bounds = np.unique(np.array([*(found["b"] or []), found["m"] if found["m"] is not None else 0], np.int64))
    sent = spark.sparkContext.broadcast((lexicon, bounds))
    kind = docs.schema[key].dataType.simpleString()

    def spread(batches):
        for part, data, offsets in text_blocks(batches, "_text"):
            lexicon, bounds = sent.value
            at = part.column(0).to_numpy(zero_copy_only=False)
            hashes = _column(lexicon.fingerprints(data, offsets))
            room = np.searchsorted(bounds, at, "right") - 1
            first = np.flatnonzero(bounds[room] == at)
            take = np.concatenate((np.arange(len(at)), first))
            own = np.arange(len(take)) < len(at)
            place = np.concatenate((room, np.where(room[first] == 0, len(bounds) - 1, room[first] - 1)))
            wrap = np.concatenate((np.zeros(len(at), bool), room[first] == 0))
            columns = [c.take(pa.array(take)) for c in (*part.columns, hashes)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(place.astype(np.int32)), pa.array(wrap), pa.array(own)],
                names=["_at", "_key", "_text", "_print", "_room", "_wrap", "_own"],
            )

    def pair(batches):
        lexicon = sent.value[0]
        last, got, size = None, [], 0
        for batch in batches:
            for part, _, _ in text_blocks([batch], "_text"):
                for row in zip(*(part.column(k).to_pylist() for k in (1, 2, 3, 4, 6))):
                    if last is not None and last[4] and last[3] == row[3]:
                        got.append((last, row))
                        size += len(last[1])
                        if size > BLOCK_BYTES:
                            yield compare(lexicon, got)
                            got, size = [], 0
                    last = row
        if got:
            yield compare(lexicon, got)

    def compare(lexicon, got):
        edited, chars = [], []
        for (_, a, *_), (_, b, *_) in got:
            half = len(a) // 2
            edited.append(a[: len(a) - half] + b[:half])
            chars.append(len(a))
        own, following = (
            np.frombuffer(b"".join(pair_[k][2] for pair_ in got), np.uint32).reshape(-1, SUBSETS + 1) for k in (0, 1)
        )
        other = lexicon.fingerprints(*byte_view(pa.array(edited, pa.large_string())))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([a[0] for a, _ in got]),
                pa.array(chars, pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]),
                pa.array([r.tobytes().hex() for r in own]),
                pa.array([r.tobytes().hex() for r in other]),
                pa.array(likeness(own, other)),
                pa.array(likeness(own, following)),
            ],
            names=["_key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    held = "_at bigint, _key " + kind + ", _text string, _print binary, _room int, _wrap boolean, _own boolean"
    placed = rows.mapInArrow(spread, held).repartition(ranges // 4, "_room")
    out = (
        f"_key {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    order = ["_room", "_wrap", "_at", F.col("_own").desc(), F.xxhash64("_text")]
    return placed.sortWithinPartitions(*order).mapInArrow(pair, out).withColumnRenamed("_key", key)
