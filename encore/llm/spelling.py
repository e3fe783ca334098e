"""Spelling variants: words one edit apart, found by dense prefix and suffix lengths of block pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from encore.llm.blocks import ragged
from encore.sources.workspace import cut

SHORTEST = 7
RUN = r"[A-Za-zÀ-ÿ]"
# A place of an edit is known up to a zone: so many code points, or an eighth of a long word.
ZONE = 3
MOST_ZONES = 8
# Rows of a block; a key with more rows is compared as pairs of blocks in several tasks.
BLOCK = 2048
# Cells of one dense comparison (pairs times code points).
CELLS = 1 << 22

_upper, _lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def thinned_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST, every: int = 31) -> DataFrame:
    """(word): the letter runs of all texts, lower-cased in A-Z, every 31st with a code point left out.

    The CRC-32 of ``<key>:<run>`` decides which run loses a code point and which one. Only
    results of at least ``shortest`` code points are returned; a shorter run cannot give
    one. A null text has no runs, a null key counts as an empty one.
    """
    runs = F.regexp_extract_all(F.col(text), F.lit(f"({RUN}{{{shortest},}})"), 1)
    owner = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"))
    found = docs.select(owner.alias("_owner"), F.explode(runs).alias("_run"))
    # lower() is fast and right for ASCII; elsewhere only A-Z may change.
    ascii_only = F.octet_length("_run") == F.char_length("_run")
    found = found.withColumn("_run", F.when(ascii_only, F.lower("_run")).otherwise(F.translate("_run", _upper, _lower)))
    found = found.withColumn("_h", F.crc32(F.concat("_owner", "_run").cast("binary")))
    at = (F.col("_h") % F.char_length("_run")).cast("int")
    short = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.char_length("_run")))
    word = F.when(F.col("_h") % every == 0, short).otherwise(F.col("_run"))
    return found.select(word.alias("word")).where(F.char_length("word") >= shortest)


def lexicon(words: DataFrame, least: int = 2) -> DataFrame:
    """(word, n): distinct words with at least ``least`` occurrences; null is no word."""
    return words.where("word is not null").groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def zone_keys(words: DataFrame) -> DataFrame:
    """(key, base, width, zone, longer, word, n): the blocks that a word is compared in.

    Words one edit apart have lengths (m, m) or (m, m + 1). Cut the places of a word of
    length m into zones. An edit in a zone leaves everything before it and behind it
    equal, so both words have the same key for that zone: a hash of m, the zone, and what
    stands before and behind. A word of length L takes part with m = L and, as the
    longer one, with m = L - 1. Hashes that meet by chance cost a comparison and change nothing.
    """
    size = F.char_length("word")
    both = words.withColumn("longer", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("base", size - F.col("longer")).where("base >= 1")
    width = F.greatest(F.lit(ZONE), F.ceil(F.col("base") / MOST_ZONES)).cast("int")
    zoned = both.withColumn("width", width).withColumn(
        "zone", F.explode(F.sequence(F.lit(0), F.floor((F.col("base") - 1) / F.col("width")).cast("int")))
    )
    head = F.col("zone") * F.col("width")
    tail = F.col("base") - F.least("base", head + F.col("width"))
    key = F.xxhash64(
        "base", "zone", F.substring("word", F.lit(1), head), F.substring("word", size - tail + 1, tail)
    )
    return zoned.select(key.alias("key"), "base", "width", "zone", "longer", "word", "n")


def tiles(keyed: DataFrame) -> DataFrame:
    """The rows of every key, cut into pairs of blocks (a, b) where a key has many rows.

    ``own`` is the row's block. The keys that are cut are few: each has over ``BLOCK`` rows.
    """
    large = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > BLOCK)
    parts = F.coalesce(F.ceil(F.col("_rows") / BLOCK), F.lit(1)).cast("int")
    placed = keyed.join(cut(large), "key", "left").withColumn("_parts", parts)
    placed = placed.withColumn("own", F.pmod(F.xxhash64("word", "longer"), F.col("_parts")).cast("int"))
    other = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return other.select(
        *keyed.columns, "own", F.least("own", "_other").alias("a"), F.greatest("own", "_other").alias("b")
    )


def matrices(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of words, padded with 0 at the end and at the front, and their lengths.

    Both matrices have one more column of padding than the longest word has code points.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    points = points.astype(np.uint8) if not len(points) or points.max() < 256 else points
    wide = int(lengths.max(initial=0)) + 1
    left, right = np.zeros((2, len(words), wide), points.dtype)
    row = np.repeat(np.arange(len(words)), lengths)
    column = ragged(np.zeros(len(words), np.int64), lengths)
    left[row, column] = points
    right[row, column + np.repeat(wide - lengths, lengths)] = points
    return left, right[:, ::-1], lengths


def first_difference(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the common start of padded rows along the last axis, padding included."""
    differ = x != y
    at = differ.argmax(axis=-1)
    return np.where(np.take_along_axis(differ, at[..., None], -1)[..., 0], at, differ.shape[-1])


def single_edits(left, right, lengths, i, j):
    """Which pairs of rows (arrays that broadcast) differ by one inserted, deleted or replaced code point.

    That is so when common prefix plus common suffix reach the longer length less one.
    """
    longer = np.maximum(lengths[i], lengths[j])
    shorter = np.minimum(lengths[i], lengths[j])
    prefix = np.minimum(first_difference(left[i], left[j]), shorter)
    suffix = np.minimum(first_difference(right[i], right[j]), shorter)
    return (prefix + suffix >= longer - 1) & (longer - shorter <= 1) & (prefix < longer), prefix, suffix


def zone_windows(left: np.ndarray, lengths: np.ndarray, head: np.ndarray, tail: np.ndarray):
    """Code points between ``head`` and ``tail`` of each row, as ``matrices`` pads them."""
    inner = lengths - head - tail
    columns = np.arange(int(inner.max(initial=0)) + 1)
    inside = columns < inner[:, None]
    last = left.shape[1] - 1
    front = np.where(inside, np.take_along_axis(left, np.minimum(head[:, None] + columns, last), 1), 0)
    back = np.where(inside, np.take_along_axis(left, np.clip((lengths - tail)[:, None] - 1 - columns, 0, last), 1), 0)
    return front, back, inner


def near_pairs(left, right, lengths, starts, sizes, base, width, zone, longer, own, across):
    """Pairs of rows (i, j) one edit apart within each group of consecutive rows, each pair in one group only.

    Groups of about equal size and width are stacked and compared as dense blocks of what
    stands in their zone, as all else is equal. What is found is compared whole. Of the
    zones where both words have the same key, the first one reports the pair; this follows from
    their common prefix and suffix. Two longer words are left to the next length.
    """
    found = []
    head = zone * width
    front, back, inner = zone_windows(left, lengths, head, base - np.minimum(base, head + width))
    sides = 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)
    wide = width[starts] + 2
    for side, columns in sorted(set(zip(sides.tolist(), wide.tolist()))):
        members = np.flatnonzero((sides == side) & (wide == columns))
        if side == 1:
            continue
        columns = min(columns, front.shape[1])
        step = max(1, CELLS // (side * side * columns))
        rows_at_once = max(1, min(side, CELLS // (side * columns)))
        for lo in range(0, len(members), step):
            some = members[lo : lo + step]
            place = np.arange(side)
            at = np.minimum(starts[some, None] + place, (starts[some] + sizes[some] - 1)[:, None])
            real = place < sizes[some, None]
            for top in range(0, side, rows_at_once):
                part = slice(top, top + rows_at_once)
                i, j = at[:, part, None], at[:, None, :]
                open_pairs = real[:, part, None] & real[:, None, :] & (longer[i] == 0)
                open_pairs &= np.where(longer[j] == 1, True, place[part, None] < place[None, :])
                open_pairs &= ~across[some, None, None] | (own[i] != own[j])
                if not open_pairs.any():
                    continue
                near = single_edits(front[:, :columns], back[:, :columns], inner, i, j)[0] & open_pairs
                g, x, y = np.nonzero(near)
                found.append((at[g, top + x], at[g, y]))
    none = np.empty(0, np.int64)
    i, j = (np.concatenate([none, *x]) for x in (zip(*found) if found else ((), ())))
    kept = [np.empty(0, bool)]
    for lo in range(0, len(i), step := max(1, CELLS // left.shape[1])):
        x, y = i[lo : lo + step], j[lo : lo + step]
        near, p, s = single_edits(left, right, lengths, x, y)
        m, v = base[x], width[x]
        # The first zone that ends at or behind the place where the common suffix begins.
        first = np.clip(-(-(m - s) // v) - 1, 0, (m - 1) // v)
        kept.append(near & (first == zone[x]) & (p >= head[x]))
    kept = np.concatenate(kept)
    return i[kept], j[kept]


def near_counts(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best): how many words are one edit away, and the most frequent of them.

    ``words`` has distinct (word, n). Words without a near one do not appear. Ties of
    frequency go to the word that is smaller in code-point order. Every task returns one row
    for each of its words at most, not the pairs.
    """
    names = ["key", "a", "b"]
    placed = tiles(zone_keys(words))

    def compare(batches):
        for table in bundles(batches, names):
            word = table.column("word").to_pylist()
            n, base, width, zone, longer, own, key, a, b = (
                table.column(c).to_numpy() for c in ("n", "base", "width", "zone", "longer", "own", "key", "a", "b")
            )
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(key)))
            left, right, lengths = matrices(word)
            i, j = near_pairs(
                left, right, lengths, starts, sizes, base.astype(np.int64), width.astype(np.int64), zone.astype(np.int64),
                longer, own, (a != b)[starts],
            )
            if not len(i):
                continue
            # Words of the bundle by code point, and of each word its most frequent partner.
            codes = pc.rank(table.column("word").combine_chunks().cast(pa.binary()), tiebreaker="dense").to_numpy().astype(np.int64)
            who, other = np.concatenate((i, j)), np.concatenate((j, i))
            order = np.lexsort((codes[other], -n[other], codes[who]))
            who, other = who[order], other[order]
            head = np.flatnonzero(np.concatenate(([True], codes[who][1:] != codes[who][:-1])))
            count = np.diff(np.append(head, len(who)))
            strings = table.column("word").combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [
                    strings.take(pa.array(who[head])), pa.array(count.astype(np.int64)),
                    pa.array(n[other[head]].astype(np.int64)), strings.take(pa.array(other[head])),
                ],
                names=["word", "n_near", "best_n", "best"],
            )

    spread = placed.repartition(*names).sortWithinPartitions(*names)
    partial = spread.mapInArrow(compare, "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))).alias("_best")
    return partial.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("_best.m")).alias("best_n"), F.col("_best.w").alias("best")
    )


def bundles(batches, key: list[str], rows: int = 1 << 15):
    """Tables of whole groups of equal key out of sorted batches, of about ``rows`` rows or one group."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        change = np.zeros(size, bool)
        for name in key:
            values = table.column(name).to_numpy()
            change[1:] |= values[1:] != values[:-1]
        last = np.flatnonzero(change)
        if len(last):
            yield table.slice(0, last[-1])
            table = table.slice(last[-1])
        held, size = table.to_batches(), table.num_rows
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def follow(forms: DataFrame) -> DataFrame:
    """(word, root): where the chain word, form, form of the form, ... ends.

    ``forms`` has (word, form), one row per word with a form. A form is at least ``factor``
    times as frequent as its word, so chains have no loops and are as short as a
    logarithm; each round doubles the steps taken.
    """
    state = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = cut(state.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        state = moved.select("word", "root")
        if moved.where("_moved").isEmpty():
            return state


def variants(words: DataFrame, factor: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every distinct (word, n).

    A word's form is its near word of largest n if that is at least ``factor`` (over 1)
    times its own n, else null. A word without a form is its own root. An empty table gives no row.
    """
    if factor <= 1:
        raise ValueError("a form has to be more frequent than its word")
    words = cut(words.select("word", "n"))
    near = near_counts(words)
    joined = words.join(near, "word", "left")
    has = F.col("best_n") >= F.col("n") * factor
    judged = cut(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n"),
        )
    )
    roots = follow(judged.where("form is not null"))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Variants of the words of all texts; see ``thinned_runs`` and ``variants``.

    Other columns of ``docs`` are not read, so their names do not matter.
    """
    plain = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return variants(lexicon(thinned_runs(plain, "_key", "_text")))
