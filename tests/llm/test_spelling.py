"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from encore.llm import queries, spelling

SMALL = "/root/testdata/sf0.001"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def thinned(rows):
    out = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:p] + b[p + 1 :] == a for p in range(len(b)))


def brute(counts, factor=10):
    near = {w: [] for w in counts}
    words = sorted(counts)
    for i, a in enumerate(words):
        for b in words[:i]:
            if abs(len(a) - len(b)) < 2 and one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= factor * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def found(df):
    rows = df.collect()
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(got) == len(rows)
    return got


def test_query_matches_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert found(queries.op11(spark, SMALL)) == brute(thinned(docs))


def crowd(seed, n=400):
    """Words close to each other, with long ones, other alphabets and code points above 16 bits."""
    rng = random.Random(seed)
    bases = ["".join(rng.choice("abé\U0001f600ж") for _ in range(rng.choice([1, 2, 7, 8, 9, 30, 200]))) for _ in range(12)]
    out = set(bases)
    while len(out) < n:
        w = list(rng.choice(sorted(out)))
        p = rng.randrange(len(w) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            w.insert(p, rng.choice("abé"))
        elif p < len(w) and kind == 1 and len(w) > 1:
            del w[p]
        elif p < len(w):
            w[p] = rng.choice("abxж")
        out.add("".join(w))
    return {w: rng.choice([2, 3, 30, 300, 3000]) for w in out}


@pytest.mark.parametrize("block", [2048, 5])
def test_any_words_match_brute_force(spark, block, monkeypatch):
    """With small blocks every key is compared as pairs of blocks."""
    monkeypatch.setattr(spelling, "BLOCK", block)
    counts = crowd(block)
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    expected = brute(counts)
    assert found(spelling.variants(words)) == expected
    assert sum(v[3] for v in expected.values()) > 1000 and len({v[1] for v in expected.values()}) < len(counts)


def test_small_tiles_give_the_same_pairs(spark, monkeypatch):
    monkeypatch.setattr(spelling, "CELLS", 64)
    counts = crowd(3, 80)
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert found(spelling.variants(words)) == brute(counts)


def test_words_that_share_a_key_need_not_be_near(spark):
    counts = {"abcdefg": 2, "abcxyzg": 50, "abcuvwgh": 9}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert found(spelling.variants(words)) == {w: (None, w, n, 0, None) for w, n in counts.items()}


def test_prefix_and_suffix_decide_single_edits():
    words = ["aab", "aaab", "aabb", "aab", "baa", "", "a", "ab", "x" * 9]
    left, right, lengths = spelling.matrices(words)
    i, j = np.arange(len(words))[:, None], np.arange(len(words))[None, :]
    near = spelling.single_edits(left, right, lengths, i, j)[0]
    assert [[bool(x) for x in row] for row in near] == [[one_edit(a, b) for b in words] for a in words]


def test_odd_rows(spark):
    long = "q" * 3000
    rows = [(k, "Overlord's overlord overlorx") for k in range(30)] + [(k, "overlard ÀÉtranger étranger") for k in (50, 51)]
    rows += [(60, None), (61, ""), (None, "overlard " + long), (62, long), (62, long), (63, long + "q"), (64, long + "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {c: F.lit("x") for c in ("word", "n", "key", "_run", "_owner", "_key", "_text", "form", "a", "b")}
    )
    expected = brute(thinned(rows))
    assert found(spelling.spelling_variants(df)) == expected
    assert long in expected and expected[long][3] == 1 and expected["overlard"][0] == "overlord"
    assert spelling.spelling_variants(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([], "word string, n long"), 1)
