"""Brute-force comparisons, exact round trips and odd inputs of the llm operators."""

import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from encore.llm import chat, components, fingerprints, jaccard, lines, mixing, packing, queries, secrets, substrings, toxicity, vectors

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SMALL = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def texts_of(n, seed=1, size=60, words=40):
    rng = random.Random(seed)
    lexicon = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7))) for _ in range(words)]
    return [" ".join(rng.choice(lexicon) for _ in range(rng.randint(0, size))) for _ in range(n)]


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def odd_rows():
    """Nulls, empty texts, ties, repeated rows and a long text."""
    base = texts_of(12, 3)
    long = " ".join(texts_of(150, 4, 200, 400))
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(20, None), (21, ""), (22, "  \n "), (23, long), (24, long), (None, base[1]), (3, base[3]), (3, base[3]), (25, "ä " * 300)]
    return rows


def odd(spark, empty=False):
    """The odd rows with columns whose names clash with those that operators use."""
    rows = [] if empty else odd_rows()
    df = frame(spark, rows)
    return df.withColumns({"size": F.lit("x"), "score": F.lit(1), "copies": F.lit(2), "_key": F.lit(3), "_tie": F.lit(5), "_kept": F.lit(6), "n": F.lit(4), "source": F.lit(None).cast("string")})


def shingle_set(text):
    table = bytes(b + 32 if 65 <= b < 91 else b for b in range(256))
    found = [w.translate(table) for w in WORD.findall((text or "").encode())]
    if len(found) < 5:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + 5]) for i in range(len(found) - 4)}


def roots(keys, links):
    parent = {k: k for k in keys}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def near_texts(groups, copies, seed):
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([8, 40, 90]))]
        for _ in range(copies):
            changed = list(words)
            for _ in range(rng.randrange(4)):
                changed[rng.randrange(len(changed))] = f"x{rng.randrange(50)}"
            out.append(" ".join(changed))
    return out


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def jaccard_brute(rows):
    sets = {k: shingle_set(t) for k, t in rows}
    keys = sorted(sets)
    links = []
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                links.append((a, b))
    component = roots(keys, links)
    return {k: (len(sets[k]), component[k]) for k in keys}


@pytest.mark.parametrize("unit", [500, 3])
def test_jaccard_matches_brute_force(spark, unit, monkeypatch):
    """With small units every cluster is joined as pairs of units."""
    if unit < 500:
        monkeypatch.setattr(jaccard, "UNIT", unit)
        monkeypatch.setattr(jaccard, "ALONE", unit)
    rows = list(enumerate(near_texts(25, 6, 5) + ["one two", "One  two", "", None, "a b c d e"]))
    got = {r[0]: (r[1], r[2]) for r in jaccard.jaccard_components(frame(spark, rows)).collect()}
    assert got == jaccard_brute(rows)
    assert len({c for _, c in got.values()}) < len(rows)


def test_signature_tree_prunes_and_loses_nothing():
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 2**63, 80, dtype=np.uint64)
        for _ in range(5):
            own = base.copy()
            own[: rng.integers(0, 12)] = rng.integers(0, 2**63)
            sets.append(np.unique(own))
    sizes = np.array([len(s) for s in sets])
    counted = [0]
    found = jaccard.tree_links(sets, sizes, counted)
    links = [
        (i, j) for i in range(len(sets)) for j in range(i)
        if 4 * len(np.intersect1d(sets[i], sets[j])) >= 3 * len(np.union1d(sets[i], sets[j]))
    ]
    assert roots(range(len(sets)), found) == roots(range(len(sets)), links)
    assert counted[0] < len(sets) * (len(sets) - 1) / 2 / 10


def test_edited_copies_are_cut_into_bounded_units(spark, monkeypatch):
    for name in ("UNIT", "ALONE"):
        monkeypatch.setattr(jaccard, name, 20)
    rows = [(0, 3, e, 7) for e in range(600)] + [(0, 3, 1000 + e, 100 + e) for e in range(90)]
    rows += [(0, 4, 2000 + e, 7 + e % 2) for e in range(100)] + [(1, 3, 3000 + e, 7) for e in range(9)]
    got = jaccard.units(frame(spark, rows, "root long, band int, entity long, low long")).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in got:
        sizes.setdefault((r["root"], r["band"], r["part"]), []).append(r["entity"])
        assert 0 <= r["part"] < r["parts"]
    assert max(map(len, sizes.values())) <= 45
    numbers = {(r["root"], r["band"]): (r["parts"], r["above"], r["below"], r["large"]) for r in got}
    assert numbers == {(0, 3): (35, 6, 0, True), (0, 4): (6, 0, 35, True), (1, 3): (1, 0, 0, False)}
    assert not {k for k, v in sizes.items() if min(v) < 1000 <= max(v)}
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words[:59] + [f"x{k}"]) for k in range(130)] + [" ".join(words[:50] + [f"y{k}"] * 2) for k in range(70)]
    texts = list(enumerate(texts))
    found = {r[0]: (r[1], r[2]) for r in jaccard.jaccard_components(frame(spark, texts)).collect()}
    assert found == jaccard_brute(texts)


def test_tree_of_edited_copies_takes_little_memory():
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 2**63, 60, dtype=np.uint64))
    sets = [np.unique(np.append(base, np.uint64(2**63 + k))) for k in range(3000)]
    counted = [0]
    tracemalloc.start()
    found = jaccard.tree_links(sets, np.full(len(sets), 61), counted)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == len(sets) - 1 and counted[0] < 2 * len(sets)
    assert peak < 100 << 20


def test_jaccard_odd_rows(spark):
    got = jaccard.jaccard_components(odd(spark)).collect()
    assert len(got) == len(odd_rows())
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[24]["component_id"] == 23 and by[20]["n_shingles"] == 0 and by[22]["component_id"] == 22
    assert next(r for r in got if r["doc_id"] is None)["component_id"] == 1
    assert jaccard.jaccard_components(odd(spark, True)).count() == 0
    kept = {r["doc_id"] for r in jaccard.keep_one(odd(spark)).collect()}
    assert 23 in kept and 24 not in kept and 20 in kept


def windows_brute(rows, length):
    seen = {}
    for _, t in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - length + 1):
            seen[raw[i : i + length]] = seen.get(raw[i : i + length], 0) + 1
    out = []
    for k, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((k, len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(b for b, g in zip(raw, gone) if not g)))
    return sorted(out, key=repr)


def planted(seed=7):
    rng = random.Random(seed)
    passages = [" ".join(texts_of(3, s, 30)) for s in range(6)]
    rows = []
    for k in range(40):
        parts = texts_of(2, 100 + k, 40, 300)
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 3)
            parts.insert(rng.randrange(len(parts) + 1), p[a : len(p) - rng.randrange(40)])
        rows.append((k, " ".join(parts)))
    return rows + [(50, "ab" * 400), (51, "xyz" * 90 + "ü" * 120), (52, None), (53, ""), (54, rows[3][1])]


@pytest.mark.parametrize("limit", [1 << 22, 0])
def test_substrings_match_brute_force(spark, limit, monkeypatch):
    """With limit 0 every group is too large for a transform and counts windows instead."""
    monkeypatch.setattr(substrings, "GROUP_BYTES", limit)
    rows = planted()
    done = substrings.dedup_substrings(frame(spark, rows), length=120, gram=40).collect()
    got = sorted(((r[0], r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["spans"]), bytes(r["kept"])) for r in done), key=repr)
    assert got == windows_brute(rows, 120)
    assert sum(g[2] for g in got) > 1000


def test_transform_on_one_shard():
    rng = random.Random(1)
    segments = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(40, 300))) for _ in range(12)]
    segments += [segments[0][10:120], b"a" * 100]
    got = substrings.repeated_windows(segments, 36)
    seen = {}
    for s in segments:
        for i in range(len(s) - 35):
            seen[s[i : i + 36]] = seen.get(s[i : i + 36], 0) + 1
    for s, starts in zip(segments, got):
        assert starts.tolist() == [i for i in range(len(s) - 35) if seen[s[i : i + 36]] > 1]


def test_substrings_odd_rows(spark):
    rows = odd_rows()
    done = substrings.dedup_substrings(odd(spark)).collect()
    got = sorted(((r[0], r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["spans"]), bytes(r["kept"])) for r in done), key=repr)
    assert got == windows_brute(rows, 400)
    assert substrings.dedup_substrings(odd(spark, True)).count() == 0


def check_packing(rows, got, capacity):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    want = []
    for k, t in rows:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for p, a in enumerate(range(0, len(ids), capacity)):
            part = ids[a : a + capacity]
            want.append((k, p, a, len(part), zlib.crc32(part.tobytes())))
    assert sorted(((r[0], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=repr) == sorted(want, key=repr)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(w[3] for w in want) // capacity)


def test_packing_round_trip(spark):
    rows = odd_rows() + [(40, "Don't STOP, It's 12ab <|endoftext|> ΑΣ İs É x  y ... 日本")]
    got = packing.packed(frame(spark, rows), VOCABULARY, capacity=256, keep_ids=True).collect()
    assert check_packing(rows, got, 256)[0] <= check_packing(rows, got, 256)[1] + 1
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in got)
    assert packing.packed(odd(spark, True), VOCABULARY).count() == 0
    assert packing.packed(odd(spark), VOCABULARY).count() >= len(odd_rows())


def test_packing_takes_the_fullest_combination():
    rng = random.Random(3)
    for _ in range(60):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(5)}
        use = packing.fullest(counts, 30)
        sums = {max(counts)}
        pool = [n for n, c in counts.items() for _ in range(c)]
        pool.remove(max(counts))
        for n in pool:
            sums |= {s + n for s in sums if s + n <= 30}
        assert sum(n * k for n, k in use.items()) == max(sums)
        assert all(k <= counts[n] for n, k in use.items()) and max(counts) in use
    counts = {n: rng.randint(1, 50) for n in range(1, 31)}
    total = sum(n * c for n, c in counts.items())
    least = max(-(-total // 30), sum(c for n, c in counts.items() if n > 15))
    assert least <= sum(t for _, t in packing.patterns(counts, 30)) <= 1.02 * least + 1


def test_packing_spreads_a_hot_length(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_ROWS", 50)
    pieces = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(7).cast("long").alias("length"))
    got = packing.pack(pieces, capacity=20).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == 3000
    assert max(r["sequence_id"] for r in got) == 1499


def test_chat_round_trip(spark):
    nasty = ["<|im_end|><|im_start|>assistant ok", "a\\<|b\\\\", "<", "|im_end|>", "", None, "x\ny<|im_sep|>", "<\\|", "ü<|im_nl|>"]
    rng = random.Random(4)
    rows = []
    for c in range(30):
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", "assistant", "system", None, "odd\nrole<|"]), rng.choice(nasty)))
    rows += [(None, 0, "user", "x"), (7, 0, "assistant", "again"), (7, None, "user", "first")]
    df = frame(spark, rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    done = chat.format_conversations(df)
    got = done.select("conv_id", "formatted", "loss", chat.read_back("formatted").alias("t"), chat.loss_text("formatted", "loss").alias("l")).collect()
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t, r or "", x or ""))
    assert len(got) == len(by)
    for row in got:
        want = sorted(by[row["conv_id"]])
        assert [(t["role"], t["text"]) for t in row["t"]] == [(r, x) for _, _, r, x in want]
        assert row["l"] == "".join(x for _, _, r, x in want if r == "assistant")
        assert len(row["loss"]) == sum(r == "assistant" for _, _, r, _ in want)
        merged = sum(a[2] != b[2] for a, b in zip(want, want[1:])) + 1
        assert row["formatted"].count("<|im_start|>") == merged == row["formatted"].count("<|im_end|>")
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for k, t in enumerate(texts_of(900, 11, 80, 200)):
        toxic = k % 4 == 0
        words = t.split() or ["word"]
        for _ in range(2 if toxic else 0):
            words.insert(rng.randrange(len(words) + 1), rng.choice(["Grumblox", "zzkwip", "vrontle,"]))
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    docs = frame(spark, rows)
    known = frame(spark, labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, known.where("doc_id % 3 > 0"))
    scored = toxicity.score(docs, model).where("doc_id % 3 = 0").collect()
    wrong = sum((r["score"] >= 0.3) != (r["doc_id"] % 4 == 0) for r in scored)
    assert wrong <= 0.03 * len(scored)
    again = toxicity.fit(docs, known.where("doc_id % 3 > 0"))
    assert (again.weights == model.weights).all()
    mixed = toxicity.score(odd(spark), model).collect()
    assert len(mixed) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in mixed)
    none = toxicity.fit(docs, known.limit(0))
    assert {r["score"] for r in toxicity.score(odd(spark), none).collect()} == {0.5}
    assert toxicity.score(odd(spark, True), model).count() == 0


def test_mixing_targets_and_copies(spark):
    rng = random.Random(6)
    rows = [(k, " ".join(["w"] * rng.randint(0, 50)), rng.choice(["a", "b", "c", "d", None])) for k in range(2000)]
    rows += [(k, "w " * 30, "hot") for k in range(2000, 3000)] + [(4000, None, "a"), (4001, "", "empty"), (7, rows[7][1], rows[7][2])]
    docs = frame(spark, rows, "doc_id long, text string, source string").withColumn("copies", F.lit("old"))
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    total = sum(r["size"] for r in got)
    for s in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == s]
        taken, size = sum(r["size"] * r["copies"] for r in own), sum(r["size"] for r in own)
        assert all(r["source_size"] == size and 0 <= r["copies"] <= 3 for r in own)
        assert abs(taken - own[0]["target"]) <= 50
    assert abs(sum({r["source"]: r["target"] for r in got}.values()) - total) < 1
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(odd(spark)).count() == len(odd_rows())


def fill(sizes, weights, most=3):
    """Targets round by round: who is above the limit is closed, the rest is shared anew."""
    target = [0.0] * len(sizes)
    open_, rest = [i for i, s in enumerate(sizes) if s > 0], float(sum(sizes))
    while open_:
        unit = rest / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        for i in over or open_:
            target[i] = float(most * sizes[i]) if over else unit * weights[i]
            rest -= target[i]
        open_ = [i for i in open_ if i not in over] if over else []
    return target


def test_mixing_targets_match_rounds_of_sharing(spark):
    rng = random.Random(12)
    many = [(f"s{k:05}", rng.choice([0, 1, 2, 5, 50, 4000])) for k in range(3000)] + [("hot", 900_000), (None, 70), ("", 3), ("\U0001f600", 9), ("\uffee", 9)]
    for rows in ([("a", 10), ("b", 100), (None, 100)], [("a", 0), ("b", 5)], [("a", 7)], many):
        mixed = rows[:]
        rng.shuffle(mixed)
        got = mixing.targets(frame(spark, mixed, "source string, words long"), "source", "words").collect()
        ordered = sorted(rows, key=lambda r: (r[0] is None, (r[0] or "").encode()))
        wanted = fill([w for _, w in ordered], [1 + i % 3 for i in range(len(ordered))])
        found = {r["source"]: r["_target"] for r in got}
        assert len(found) == len(rows)
        assert [found[s] for s, _ in ordered] == pytest.approx(wanted)
        assert sum(wanted) == pytest.approx(sum(w for _, w in rows))
    assert mixing.targets(frame(spark, [], "source string, words long"), "source", "words").count() == 0


def test_mixing_matches_brute_force_draw(spark):
    """A second draw: running sums in plain Python over documents in the operator's order of sizes."""
    rng = random.Random(8)
    rows = [(k, " ".join(["w"] * rng.choice([0, 1, 4, 9, 200])), rng.choice(["a", "b", None, "hot", "hot"])) for k in range(1500)]
    got = mixing.mix(frame(spark, rows, "doc_id long, text string, source string")).collect()
    offset = spark.range(1).select(F.pmod(F.xxhash64(F.lit(11), F.lit("offset")), F.lit(1_000_003)) / 1_000_003.0).first()[0]
    for source in {r[2] for r in rows}:
        own = [r for r in got if r["source"] == source]
        wanted, left, at = own[0]["target"], own[0]["source_size"], 0.0
        for size in sorted({r["size"] for r in own} - {0}, reverse=True):
            taken, n = [r["copies"] for r in own if r["size"] == size], sum(r["size"] == size for r in own)
            rate = min(3, max(0.0, wanted / left))
            expected = [int(np.floor(at + (i + 1) * rate + offset) - np.floor(at + i * rate + offset)) for i in range(n)]
            assert sorted(taken) == sorted(expected)
            wanted, left, at = wanted - sum(taken) * size, left - n * size, (at + n * rate) % 1.0
        assert all(r["copies"] == 0 for r in own if r["size"] == 0)


def vectors_brute(rows, limit=0.93):
    fine = {}
    for k, v, l in rows:
        if v and l is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            fine[k] = (np.array(v, np.float32).astype(float), l)
    links = [
        (a, b) for a in fine for b in fine
        if a < b and fine[a][1] == fine[b][1] and len(fine[a][0]) == len(fine[b][0])
        and fine[a][0] @ fine[b][0] / np.sqrt((fine[a][0] @ fine[a][0]) * (fine[b][0] @ fine[b][0])) >= limit
    ]
    root = roots([k for k, _, _ in rows], links)
    count = {k: 0 for k, _, _ in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return {k: (count[k], root[k], root[k] == k) for k, _, _ in rows}


@pytest.mark.parametrize("cell,unit", [(2048, 4096), (16, 10)])
def test_vectors_match_brute_force(spark, cell, unit, monkeypatch):
    """Small cells need many tables, small units make pairs of units."""
    monkeypatch.setattr(vectors, "CELL", cell)
    monkeypatch.setattr(vectors, "UNIT", unit)
    rng = np.random.default_rng(8)
    rows, k = [], 0
    for g in range(40):
        base = rng.standard_normal(16)
        for _ in range(4):
            rows.append((k, (base + rng.standard_normal(16) * 0.25).tolist(), g % 3))
            k += 1
    rows += [(k + i, rows[0][1], 0) for i in range(3)] + [(k + 3, None, 0), (k + 4, [0.0] * 16, 0), (k + 5, rows[0][1], None)]
    rows += [(k + 6, [1.0, None], 0), (k + 7, [float("nan")] * 16, 1), (k + 8, [], 1), (k + 9, [float("inf"), 1.0], 0), (k + 10, [1.0, 2.0], 0)]
    df = frame(spark, rows, "vec_id long, embedding array<float>, label int").withColumn("n", F.lit(1))
    got = {r[0]: (r[1], r[2], r[3]) for r in vectors.near_duplicates(df).collect()}
    assert got == vectors_brute(rows)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_code_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 32))
    x[200:] = x[:200] + 0.3 * x[200:]
    x /= np.linalg.norm(x, axis=1)[:, None]
    errors = []
    for seed in range(20):
        turned, sign, factor = vectors.codes(x, seed)
        estimate, cosine = (sign[:200] @ turned[200:].T) / factor[:200, None], x[:200] @ x[200:].T
        bound = np.sqrt(1 - np.minimum(1, cosine**2)) * (np.sqrt(1 - factor[:200] ** 2) / factor[:200])[:, None]
        assert (np.abs(estimate - cosine) <= bound + 1e-9).all()
        errors.append((estimate - cosine).mean())
    assert abs(np.mean(errors)) < 0.005


def passages_brute(rows):
    """Pairs of neighbouring lines with words and long lines, compared as bytes; the first by key, text hash and place stays."""
    found = []
    for i, (k, text, tie) in enumerate(rows):
        split, at, full = text.encode().split(b"\n"), 0, []
        for j, line in enumerate(split):
            if WORD.search(line):
                full.append((j, at, line))
                if len(WORD.findall(line)) >= 50 or len(line) >= 300:
                    found.append((k, tie, at, line, i, j, j))
            at += len(line) + 1
        for (a, start, _), (b, _, _) in zip(full, full[1:]):
            found.append((k, tie, start, b"\n".join(split[a : b + 1]), i, a, b))
    seen, gone = set(), set()
    for _, _, _, body, i, a, b in sorted(found):
        if body in seen:
            gone.update((i, j) for j in range(a, b + 1))
        seen.add(body)
    out = {}
    for i, (k, text, _) in enumerate(rows):
        left = [t for j, t in enumerate(text.split("\n")) if (i, j) not in gone]
        out[k] = ("\n".join(left), sum((i, j) in gone for j in range(text.count("\n") + 1)))
    return out


def test_embedded_passages_go_whole(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(8))
    line = lambda n: " ".join(word() for _ in range(n))
    passages = [[line(60)], [line(12) + "ü" * 150], *([line(9) for _ in range(n)] for n in (2, 2, 3, 4, 5, 6, 7, 40))]
    passages += [[line(9), "", " ", line(9)], [line(9), line(9), "", line(9)]]
    rows, kept = [], {}
    for k in range(96):
        own = [line(rng.randrange(1, 9)) if rng.random() < 0.9 else "" for _ in range(rng.randrange(2, 9))]
        own[0] = line(3)
        at = rng.randrange(1, len(own) + 1)
        passage = passages[k % len(passages)]
        rows.append((k, "\n".join(own[:at] + passage + own[at:])))
        if k >= len(passages):
            kept[k] = ("\n".join(own), len(passage))
    rows += [(200, ""), (201, "\n\n\n"), (202, "ü\n" * 90), (203, passages[0][0]), (204, rows[3][1])]
    df = frame(spark, rows)
    hashes = {r[0]: r[1] for r in df.select("doc_id", F.xxhash64("text")).collect()}
    got = {r["doc_id"]: (r["text"], r["removed_lines"]) for r in lines.dedup_passages(df).collect()}
    assert got == passages_brute([(k, t, hashes[k]) for k, t in rows])
    assert {k: got[k] for k in kept} == kept
    assert got[203] == ("", 1) and got[202] == ("ü\n", 89)
    done = lines.dedup_passages(odd(spark))
    assert done.count() == len(odd_rows()) and set(odd(spark).columns) < set(done.columns)
    assert done.where("text IS NULL").count() == 1 and lines.dedup_passages(odd(spark, True)).count() == 0


def test_fingerprints_of_edited_texts(spark):
    rows = [(3 * k, t) for k, t in enumerate(texts_of(120, 21, 80, 300))] + [(1000, ""), (1001, None), (1002, "só " * 200)]
    rows.append((1003, rows[5][1]))
    docs = frame(spark, rows).withColumn("n_chars", F.lit("x"))
    lexicon = fingerprints.fit_lexicon(docs)
    got = {r["doc_id"]: r for r in fingerprints.compare_with_next(docs, lexicon).collect()}
    assert len(got) == len(rows)
    plain = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint(docs, lexicon).collect()}
    rows = sorted(rows)
    for (k, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        t, after = t or "", after or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[k]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == plain[k] and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert got[1003]["fingerprint"] == got[15]["fingerprint"] and got[1000]["fingerprint"] == got[1001]["fingerprint"]
    some = list(got.values())
    assert sum(r["near_edited"] for r in some) > 2 * sum(r["near_next"] for r in some)
    assert fingerprints.compare_with_next(docs.limit(0), lexicon).count() == 0
    assert fingerprints.compare_with_next(odd(spark), lexicon).count() == len(odd_rows())
    assert fingerprints.fingerprint(odd(spark), lexicon).count() == len(odd_rows())


def test_lexicon_is_bounded(spark):
    docs = frame(spark, [(k, " ".join(f"t{k % 50 + j}" for j in range(30))) for k in range(300)])
    assert 0 < len(fingerprints.fit_lexicon(docs, max_terms=100, common=1.0).terms) <= 100


def test_a_hot_group_counts_once_in_the_lexicon(spark):
    texts = texts_of(200, 41, 60, 4000)
    hot = " ".join(f"hot{j}" for j in range(60))
    rows = [(k, t) for k, t in enumerate(texts)] + [(1000 + k, hot) for k in range(100)] + [(2000, hot.replace("hot7 ", "cold ")), (2001, None), (2002, "")]
    docs = frame(spark, rows).repartition(7)
    lexicon = fingerprints.fit_lexicon(docs)
    alone = fingerprints.fit_lexicon(docs.where("doc_id < 1000 OR doc_id IN (1000, 2000, 2001)"))
    assert len(lexicon.terms) > 40 and (lexicon.terms == alone.terms).all()
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint(docs, lexicon).collect()}
    a, b = (np.frombuffer(bytes.fromhex(got[k]), np.uint32).reshape(1, -1) for k in (1000, 2000))
    assert fingerprints.likeness(a, b)[0] > 0.3


def test_secret_scan_learns_from_findings(spark):
    rng = random.Random(12)
    rows = []
    for k, t in enumerate(texts_of(300, 31, 60, 200)):
        words = t.split()
        extra = rng.choice([
            "password=" + "".join(rng.choice("0123456789abcdef") for _ in range(18)), "AKIA" + "".join(rng.choice("ABCDEFGH234567") for _ in range(16)),
            "".join(rng.choice("abcdefg") for _ in range(24)), "555-01" + str(rng.randrange(10, 99)), "",
        ])
        words.insert(rng.randrange(len(words) + 1), extra)
        rows.append((k, " ".join(words), rng.choice(["src/app", "tests/x", None])))
    docs = frame(spark, rows, "doc_id long, text string, source string")
    language = secrets.Language(secrets.word_counts(docs))
    found = secrets.features(secrets.candidates(docs), language).withColumn("label", secrets.known_format())
    model = secrets.fit(found.where("doc_id % 3 > 0"))
    judged = secrets.judge(found, model).where("doc_id % 3 = 0 AND label IS NOT NULL").collect()
    assert len(judged) > 30 and sum((r["score"] >= 0.5) != (r["label"] == 1) for r in judged) <= 1
    plan = secrets.judge(found, model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert secrets.fit(found.limit(0)) is None
    assert secrets.candidates(docs.limit(0)).count() == 0
    assert secrets.features(secrets.candidates(odd(spark)), language).count() >= 0


def test_copies_do_not_fill_the_training_rows(spark):
    values = frame(spark, [(k, f"value{k}") for k in range(40)]).select("doc_id", F.col("text").alias("value"), F.lit("").alias("before"), F.lit("").alias("after"))
    order = [r[0] for r in values.orderBy(F.xxhash64("value", "before", "after")).collect()]
    late = F.col("doc_id").isin(order[20:])
    found = values.withColumns({f: F.when(late, 1.0).otherwise(0.0) for f in secrets.FEATURES}).withColumn("label", late.cast("int"))
    labelled = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(late, 1).otherwise(100))))
    model = secrets.fit(labelled, rows=30)
    judged = secrets.judge(found, model).collect()
    assert all((r["score"] >= 0.5) == (r["label"] == 1) for r in judged)
    none = secrets.fit(labelled.where(~late))
    assert none is None and {r["score"] for r in secrets.judge(found, none).collect()} == {0.0}


def test_every_piece_of_a_word_is_a_candidate(spark):
    key, jwt, b64 = "AKIA" + "QRST" * 4, "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.dBjftJeZ4CVP-mB92K27uh", "c2VjcmV0LXZhbHVlMQ"
    cases = [
        (f"see url?key={key}&x=1 now", key, "key"), ('{"token":"9f8e7d6c5b4a3f2e","b":"c"}', "9f8e7d6c5b4a3f2e", "token"),
        (f'{{"url":"https://h.org/?key={key}"}}', key, "key"), (f"{key},next", key, ""), (f"a {key}. End", key, ""), (f"key:{key}!", key, "key"),
        (f"data {b64}== end", b64 + "==", ""), (f"secret={b64}=", b64 + "=", "secret"), (f"x=[{b64}=,2]", b64 + "=", "x"),
        (f'{{"secret":"{b64}==","b":"$c"}}', b64 + "==", "secret"), (f'token="{b64}="', b64 + "=", "token"), ("token='$abcd1234'", "$abcd1234", "token"),
        ("password=p@ss#w%rd! x", "p@ss#w%rd", "password"), ('pwd="p@ss(w)rd!"', "p@ss(w)rd!", "pwd"), ("password='!Tr0ub4dor&3'", "!Tr0ub4dor", "password"),
        (f"bearer {jwt}", jwt, ""), (f'"jwt": "{jwt}",', jwt, ""), (f"user:{key}:9f8e7d6c5b4a", key, "user"), (f"{key}:9f8e7d6c5b4a", "9f8e7d6c5b4a", key.lower()),
        ("password[0]=9f8e7d6c5b4a", "9f8e7d6c5b4a", "password[0"), ("password=9f8e7d6c5b4a", "9f8e7d6c5b4a", "password"),
    ]
    found = secrets.candidates(frame(spark, [(k, t, None) for k, (t, _, _) in enumerate(cases)], "doc_id long, text string, source string"))
    got = {(r["doc_id"], r["value"], r["name"]) for r in found.collect()}
    assert [c for k, c in enumerate(cases) if (k, *c[1:]) not in got] == []
    both = secrets.candidates(frame(spark, [(0, f"a={key}&b={key}&c={key}", "")], "doc_id long, text string, source string"))
    assert sorted((r["place"], r["part"], r["name"]) for r in both.collect()) == [(0, 1, "a"), (0, 3, "b"), (0, 5, "c")]


def test_equal_hashes_remove_nothing_without_equal_bytes(spark, monkeypatch):
    """All windows get the same digest; only those with the bytes of the first place go."""
    real = lines.windows
    monkeypatch.setattr(lines, "windows", lambda *a: real(*a).withColumn("digest", F.lit(b"same")))
    rows = [(1, "a b\nc d"), (2, "x\na b\nc d\ny"), (3, "q r\ns t"), (4, "q r\ns t")]
    got = {r["doc_id"]: (r["text"], r["removed_lines"]) for r in lines.dedup_passages(frame(spark, rows)).collect()}
    assert got == {1: ("a b\nc d", 0), 2: ("x\ny", 2), 3: ("q r\ns t", 0), 4: ("q r\ns t", 0)}


def test_every_operator_is_registered():
    names = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES)
    assert names == list(range(1, 14))


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = queries.read(spark, SMALL, "documents")
    columns = docs.columns
    kept = p.drop_toxic(spark, docs, SMALL)
    assert kept.columns == columns and 0 < kept.count() <= docs.count()
    plain = p.dedup_lines(spark, kept, SMALL)
    assert plain.columns == columns and plain.count() == kept.count()
    one = p.join_near_duplicates(spark, plain, SMALL)
    rows = [(r["doc_id"], r["text"]) for r in plain.collect()]
    brute = jaccard_brute(rows)
    assert {r["doc_id"] for r in one.collect()} == {k for k, (_, c) in brute.items() if k == c}
    mixed = p.mix_sources(spark, one, SMALL)
    assert mixed.columns == columns
    packed = p.pack(spark, mixed, SMALL)
    texts = [(r["doc_id"], r["text"]) for r in mixed.collect()]
    check_packing(texts, packed.collect(), 2048)
    assert [f.name for f in p.run(spark, SMALL).schema] == packed.columns
