"""N-gram Jaccard join: sets of word shingles joined with signature trees."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from encore.llm.blocks import distinct_in_rows, groups, mix, powers, text_blocks, words
from encore.llm.components import components
from encore.operators.skew import salted_join
from encore.sources.workspace import cut

WORDS = 5
LINK = (3, 4)
FANOUT = 8
SIGNATURE = 32
UNIT = 500
ALONE = 1000
# Pairs of lowest nodes whose leaves are expanded at a time.
SLICE = 256

_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the n-word shingles of each row, with their row.

    A row with fewer words has one shingle of all its words; without words it has none.
    """
    word, row = words(data, offsets)
    counts = np.bincount(row, minlength=len(offsets) - 1)
    with np.errstate(over="ignore"):
        long = np.zeros(max(0, len(word) - n + 1), np.uint64)
        for k in range(n):
            long = long * _STEP + word[k : k + len(long)]
        inside = row[: len(long)] == row[n - 1 :] if len(long) else np.zeros(0, bool)
        values, rows = [mix(long[inside])], [row[: len(long)][inside]]
        first = np.cumsum(counts) - counts
        for size in range(1, n):
            some = np.flatnonzero(counts == size)
            short = np.full(len(some), size, np.uint64)
            for k in range(size):
                short = short * _STEP + word[first[some] + k]
            values.append(mix(short ^ np.uint64(size)))
            rows.append(some)
    return distinct_in_rows(np.concatenate(values), np.concatenate(rows))


def _bucket(values: np.ndarray, buckets: int) -> np.ndarray:
    return ((values >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


FIELDS = ("bucket", "_key", "n", "entity", "ids", "sizes", "counts", "values", "classes")


def _batch(kind: pa.DataType, rows: int, **columns) -> pa.RecordBatch:
    kinds = {"bucket": pa.int32(), "_key": kind, "n": pa.int64(), "entity": pa.int64()}
    arrays = [pa.array(columns[f], kinds.get(f, pa.binary())) if f in columns else pa.nulls(rows, kinds.get(f, pa.binary())) for f in FIELDS]
    return pa.RecordBatch.from_arrays(arrays, names=list(FIELDS))


def _packed(kind, bucket, entity, size, value, rank=None):
    """Rows that hold the tokens of one bucket each, grouped by set; input sorted by bucket and set."""
    if not len(bucket):
        return
    edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    out = {f: [] for f in ("bucket", "ids", "sizes", "counts", "values", *(("classes",) if rank is not None else ()))}
    for lo, hi in zip(edges, np.append(edges[1:], len(bucket))):
        part = entity[lo:hi]
        at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        out["bucket"].append(int(bucket[lo]))
        out["ids"].append(part[at].tobytes())
        out["sizes"].append(size[lo:hi][at].astype(np.uint32).tobytes())
        out["counts"].append(np.diff(np.append(at, hi - lo)).astype(np.uint32).tobytes())
        out["values"].append(value[lo:hi].tobytes())
        if rank is not None:
            out["classes"].append(rank[lo:hi].tobytes())
    yield _batch(kind, len(edges), **out)


def _unpacked(table: pa.Table, ranked: bool):
    """Set, size, value (and class) of every token in packed rows."""
    def joined(name, kind):
        return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)

    counts = joined("counts", np.uint32)
    out = [np.repeat(joined("ids", np.int64), counts), np.repeat(joined("sizes", np.uint32), counts), joined("values", np.uint64)]
    return [*out, joined("classes", np.uint8)] if ranked else out


def _sets(kind: pa.DataType, buckets: int):
    def run(batches):
        for part, data, offsets in text_blocks(batches, "_text"):
            value, row = shingles(data, offsets)
            ends = np.searchsorted(row, np.arange(len(offsets)))
            n = np.diff(ends)
            with np.errstate(over="ignore"):
                total = np.concatenate(([np.uint64(0)], np.cumsum(mix(value))))
                digest = mix(total[ends[1:]] - total[ends[:-1]] + n.astype(np.uint64)).view(np.int64)
            yield _batch(
                kind, len(n), bucket=np.arange(len(n), dtype=np.int32) % buckets, _key=part.column(0), n=n,
                entity=pa.array(digest, mask=n == 0),
            )
            once = np.zeros(len(n), bool)
            once[np.unique(digest, return_index=True)[1]] = True
            keep = once[row]
            value, row = value[keep], row[keep]
            bucket = _bucket(value, buckets)
            order = np.argsort(bucket.astype(np.uint16) if buckets < 65536 else bucket, kind="stable")
            value, row, bucket = value[order], row[order], bucket[order]
            yield from _packed(kind, bucket, digest[row], n[row], value)

    return run


def _shared(kind: pa.DataType, buckets: int):
    """Of the tokens in a bucket, those that two sets hold, with a class of their frequency."""
    def run(batches):
        for table in groups(batches, ["bucket"]):
            yield from _rows_only(kind, table)
            table = table.filter(table.column("values").is_valid())
            if not table.num_rows:
                continue
            entity, size, value = _unpacked(table, False)
            order = np.argsort(value)
            value = value[order]
            same = value[1:] == value[:-1]
            twice = np.concatenate((same, [False])) | np.concatenate(([False], same))
            value, order = value[twice], order[twice]
            entity, size = entity[order], size[order]
            order = np.lexsort((entity, value))
            value, entity, size = value[order], entity[order], size[order]
            if not len(value):
                continue
            first = np.concatenate(([True], (value[1:] != value[:-1]) | (entity[1:] != entity[:-1])))
            value, entity, size = value[first], entity[first], size[first]
            at = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
            often = np.diff(np.append(at, len(value)))
            rank = np.repeat(np.minimum(255, np.floor(4 * np.log2(often))).astype(np.uint8), often)
            keep = np.repeat(often > 1, often)
            value, entity, size, rank = value[keep], entity[keep], size[keep], rank[keep]
            bucket = _bucket(mix(entity.view(np.uint64)), buckets)
            order = np.lexsort((entity, bucket))
            yield from _packed(kind, bucket[order], entity[order], size[order], value[order], rank[order])

    return run


def _rows_only(kind, table):
    rows = table.filter(table.column("n").is_valid())
    for batch in rows.to_batches():
        yield batch


def _alive(kind: pa.DataType):
    """Sets that share so many tokens that they can link, their shared tokens rarest first."""
    def run(batches):
        for table in groups(batches, ["bucket"]):
            yield from _rows_only(kind, table)
            table = table.filter(table.column("values").is_valid())
            if not table.num_rows:
                continue
            entity, size, value, rank = _unpacked(table, True)
            order = np.lexsort((value, rank, entity))
            entity, size, value = entity[order], size[order], value[order]
            at = np.flatnonzero(np.concatenate(([True], entity[1:] != entity[:-1])))
            ends = np.append(at[1:], len(entity))
            n = size[at].astype(np.int64)
            keep = LINK[1] * (ends - at) >= LINK[0] * n
            at, ends, n = at[keep], ends[keep], n[keep]
            values = [value[a:b].tobytes() for a, b in zip(at, ends)]
            # Of each set the rarest tokens that must include one it shares with a partner.
            first = n // 4 + 1 - (n - (ends - at))
            sizes = [int(f).to_bytes(4, "little") for f in first]
            yield _batch(kind, len(n), entity=entity[at], ids=[int(x).to_bytes(8, "little") for x in n], sizes=sizes, values=values)

    return run


def _signatures(tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Token bitmap of each set, and how many of its tokens fall on a bit already set."""
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    flat = mix(np.concatenate(tokens))
    bit = (flat % np.uint64(SIGNATURE * 64)).astype(np.int64)
    bits = np.zeros((len(tokens), SIGNATURE * 64), np.uint8)
    bits[np.repeat(np.arange(len(tokens)), lengths), bit] = 1
    packed = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    return packed, lengths - bits.sum(axis=1, dtype=np.int64)


def _tree(bitmap, lost, least, most):
    """Levels of a signature tree, leaves first: OR of the bitmaps, most lost tokens, size range."""
    levels = [(bitmap, lost, least, most)]
    while len(levels[-1][0]) > 1:
        b, c, lo, hi = levels[-1]
        at = np.arange(0, len(b), FANOUT)
        levels.append((np.bitwise_or.reduceat(b, at), np.maximum.reduceat(c, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)))
    return levels


def tree_links(tokens: list[np.ndarray], sizes: np.ndarray, counter: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect the sets: a spanning forest of all pairs with J >= 3/4.

    ``tokens`` are the sorted tokens that a set shares with any other, ``sizes`` the full
    set sizes. Both sides of the traversal are the same tree. A pair of nodes goes
    on only if the largest overlap that its bitmaps allow could reach the least overlap
    that its size ranges ask for; the leaves left are counted token by token, unless
    they are connected already. ``counter`` takes the number of pairs counted.
    """
    if len(tokens) < 2:
        return []
    least_token = np.array([t.min() for t in tokens], np.uint64)
    order = np.lexsort((least_token, sizes // 8))
    order = order[np.argsort(least_token[order], kind="stable")]
    tokens = [np.sort(tokens[i]) for i in order]
    sizes = np.asarray(sizes, np.int64)[order]
    bitmap, lost = _signatures(tokens)
    levels = _tree(bitmap, lost, sizes, sizes)
    parent = list(range(len(tokens)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def reach(depth: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the bitmaps of each pair of nodes allow a link."""
        bits, over, lo, hi = levels[depth]
        keep = np.zeros(len(a), bool)
        for s in range(0, len(a), 1 << 16):
            x, y = a[s : s + (1 << 16)], b[s : s + (1 << 16)]
            overlap = np.bitwise_count(bits[x] & bits[y]).sum(axis=1, dtype=np.int64) + np.minimum(over[x], over[y])
            overlap = np.minimum(overlap, np.minimum(hi[x], hi[y]))
            keep[s : s + (1 << 16)] = (7 * overlap >= 3 * (lo[x] + lo[y])) & (4 * overlap >= 3 * np.maximum(lo[x], lo[y]))
        return keep

    def below(depth: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of nodes of a level under pairs of the level above."""
        step, n = np.arange(FANOUT), len(levels[depth][0])
        a = np.repeat((a[:, None] * FANOUT + step), FANOUT, axis=1).ravel()
        b = np.tile((b[:, None] * FANOUT + step), (1, FANOUT)).ravel()
        some = (a < n) & (b < n) & (a <= b)
        return a[some], b[some]

    a = b = np.zeros(1, np.int64)
    for depth in range(len(levels) - 1, 0, -1):
        if depth < len(levels) - 1:
            a, b = below(depth, a, b)
        keep = reach(depth, a, b)
        a, b = a[keep], b[keep]
    # Leaves are expanded in slices, near ones first; those connected by then fall out.
    near = np.argsort(b - a, kind="stable")
    a, b = a[near], b[near]
    found = []
    label = np.arange(len(tokens))
    for s in range(0, len(a), SLICE):
        left, right = below(0, a[s : s + SLICE], b[s : s + SLICE])
        apart = label[left] != label[right]
        left, right = left[apart], right[apart]
        keep = reach(0, left, right)
        left, right = left[keep], right[keep]
        near, known = np.argsort(right - left, kind="stable"), len(found)
        for i, j in zip(left[near].tolist(), right[near].tolist()):
            ri, rj = find(i), find(j)
            if ri == rj:
                continue
            if counter is not None:
                counter[0] += 1
            x, y = (tokens[i], tokens[j]) if len(tokens[i]) <= len(tokens[j]) else (tokens[j], tokens[i])
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            if 7 * int((y[at] == x).sum()) >= 3 * int(sizes[i] + sizes[j]):
                parent[max(ri, rj)] = min(ri, rj)
                found.append((int(order[i]), int(order[j])))
        if len(found) > known:
            label = np.array([find(i) for i in range(len(tokens))])
    return found


def units(members: DataFrame) -> DataFrame:
    """Members with their unit (``part`` of their root and band) and the numbers of units.

    ``parts`` counts the units of the band, ``above`` and ``below`` those of its neighbours.
    A cluster that is not ``large`` is one unit. In a large one a smallest token of more than
    ``UNIT`` sets has units of its own, among which a hash of the set deals; the other
    tokens share units by hash. So units have about ``UNIT`` sets, however alike these are.
    """
    tokens = cut(members.groupBy("root", "band", "low").agg(F.count(F.lit(1)).alias("c")))
    large = tokens.groupBy("root").agg((F.sum("c") > ALONE).alias("large"))
    hot, copies = F.col("c") > UNIT, F.ceil(F.col("c") / UNIT)
    parts = (
        tokens.groupBy("root", "band")
        .agg(F.ceil(F.sum(F.when(hot, 0).otherwise(F.col("c"))) / UNIT).alias("mixed"), F.sum(F.when(hot, copies).otherwise(0)).alias("own"))
        .join(large, "root")
        .select("root", "band", "large", "mixed", F.when(F.col("large"), F.col("mixed") + F.col("own")).otherwise(1).cast("int").alias("parts"))
    )
    up = parts.select(F.col("root"), (F.col("band") - 1).alias("band"), F.col("parts").alias("above"))
    down = parts.select(F.col("root"), (F.col("band") + 1).alias("band"), F.col("parts").alias("below"))
    parts = parts.join(up, ["root", "band"], "left").join(down, ["root", "band"], "left").na.fill(0, ["above", "below"])
    # At most one row for every UNIT members.
    before = Window.partitionBy("root", "band").orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    spot = F.struct("root", "band", "low").alias("_spot")
    salts = tokens.where(hot).withColumn("copies", copies).select(
        spot, "copies", "c", F.coalesce(F.sum("copies").over(before), F.lit(0)).alias("offset")
    )
    known = salted_join(members.select("*", spot), salts, "_spot", "c", "left").drop("_spot", "c").join(parts, ["root", "band"])
    part = F.when(~F.col("large"), 0).when(
        F.col("copies").isNotNull(), F.col("mixed") + F.col("offset") + F.pmod(F.xxhash64("entity"), F.coalesce("copies", F.lit(1)))
    ).otherwise(F.pmod(F.xxhash64("low"), F.greatest("mixed", F.lit(1))))
    return known.withColumn("part", part.cast("int")).drop("copies", "offset", "mixed")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of every row.

    Words are runs of anything but ASCII white space, lower-cased in A-Z. Two documents
    link at a Jaccard similarity of 0.75 or more of their sets of five-word shingles; a
    document with fewer words has its whole sequence as its only shingle, and one without
    words (or a null text) links with nothing. ``component_id`` is the smallest key that
    links reach. Rows with equal sets are one class and are compared once; null keys take
    part but are no one's smallest key, unless a component has no other.

    Tokens go to hash buckets, where those of one set only fall out: a set links only if
    others hold three quarters of it. Of the rest, each set's rarest tokens must include
    one that it shares with any partner, so sets that are connected by such tokens form
    clusters, and no link leaves a cluster. Each cluster is joined with itself by a
    signature tree. A large one is cut into units of bounded size by size band and smallest
    token (``units``), and pairs of units whose sizes can link are tasks of their own. Tasks return no pairs
    but a spanning forest. Sets are told apart by a 64-bit hash.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(rows.schema["_key"].dataType)
    name = rows.schema["_key"].dataType.simpleString()
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(60_000, shards)
    schema = f"bucket int, _key {name}, n bigint, entity bigint, ids binary, sizes binary, counts binary, values binary, classes binary"

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(shards, "bucket").sortWithinPartitions("bucket")

    tokens = rows.mapInArrow(_sets(kind, buckets), schema)
    shared = dealt(tokens).mapInArrow(_shared(kind, buckets), schema)
    stored = cut(dealt(shared).mapInArrow(_alive(kind), schema))
    plain = stored.where("n IS NOT NULL").select("_key", "n", "entity")
    sets = stored.where("n IS NULL").select("entity", "ids", "sizes", "values")

    def first_tokens(batches):
        for batch in batches:
            many = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32)
            values = [np.frombuffer(v, np.int64, int(k)) for v, k in zip(batch.column(2).to_pylist(), many)]
            if values:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(values)), pa.array(np.repeat(batch.column(0).to_numpy(), many))], names=["token", "entity"]
                )

    pairs = cut(sets.select("entity", "sizes", "values").mapInArrow(first_tokens, "token bigint, entity bigint"))
    least = pairs.groupBy("token").agg(F.min("entity").alias("m"), F.count(F.lit(1)).alias("c")).where("c > 1")
    hung = pairs.join(least, "token").select(F.col("entity").alias("a"), F.col("m").alias("b"))
    cluster = components(hung)

    def sized(batches):
        for batch in batches:
            n = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            low = [int(np.frombuffer(v, np.uint64).min() >> np.uint64(1)) for v in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(3), pa.array(n), pa.array(low, pa.int64()), batch.column(2)],
                names=["entity", "root", "n", "low", "values"],
            )

    members = cut(
        sets.join(cluster, F.col("entity") == F.col("node")).select("entity", "ids", "values", "root")
        .mapInArrow(sized, "entity bigint, root bigint, n bigint, low bigint, values binary")
    )
    members = members.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.4))).cast("int"))
    spread = units(members)
    own = F.struct(F.col("band").alias("band"), F.col("part").alias("part"))

    def others(count: str, shift: int):
        numbers = F.when(F.col(count) > 0, F.sequence(F.lit(0), F.col(count) - 1)).otherwise(F.array().cast("array<int>"))
        unit = lambda j: F.struct((F.col("band") + shift).alias("band"), j.alias("part"))
        return F.transform(numbers, lambda j: F.struct(F.least(own, unit(j)).alias("x"), F.greatest(own, unit(j)).alias("y")))

    zero = F.struct(F.lit(0).alias("band"), F.lit(0).alias("part"))
    tasks = F.when(F.col("large"), F.concat(others("parts", 0), others("above", 1), others("below", -1))).otherwise(
        F.array(F.struct(zero.alias("x"), zero.alias("y")))
    )
    jobs = spread.select("root", F.explode(tasks).alias("t"), "entity", "n", "values").select(
        "root", F.concat_ws(":", "t.x.band", "t.x.part", "t.y.band", "t.y.part").alias("task"), "entity", "n", "values"
    )

    def join(batches):
        for table in groups(batches, ["root", "task"]):
            ids = table.column("entity").to_numpy()
            found = tree_links([np.frombuffer(v, np.uint64) for v in table.column("values").to_pylist()], table.column("n").to_numpy())
            if found:
                at = np.array(found)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at[:, 0]]), pa.array(ids[at[:, 1]])], names=["a", "b"])

    dealt_jobs = jobs.repartition(shards, "root", "task").sortWithinPartitions("root", "task")
    group = components(dealt_jobs.mapInArrow(join, "a bigint, b bigint"))
    named = plain.join(group, F.col("entity") == F.col("node"), "left").select(
        "_key", "n", F.coalesce("root", "entity").alias("_group")
    )
    named = cut(named)
    smallest = named.where("_group IS NOT NULL").groupBy("_group").agg(F.min("_key").alias("_least"))
    return named.join(smallest, "_group", "left").select(
        F.col("_key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("_least", "_key").alias("component_id")
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose key is the smallest of their component.

    Rows without words all stay. Rows with a null key stay. Of rows with the same key
    all stay or none.
    """
    found = jaccard_components(docs, key, text)
    kept = found.where(F.col(key).isNull() | (F.col(key) == F.col("component_id"))).select(F.col(key).alias("_kept")).distinct()
    return docs.alias("d").join(kept.alias("k"), F.col(f"d.{key}").eqNullSafe(F.col("k._kept")), "left_semi")
