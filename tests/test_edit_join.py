"""The piece index against brute force, and what it compares."""

import random

from pyspark.sql import functions as F

from encore.operators import edit_join


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        p, kind = rng.randrange(len(out) + 1), rng.randrange(3)
        if kind == 0:
            out.insert(p, rng.choice("abcü"))
        elif p < len(out):
            out[p : p + 1] = [rng.choice("abcü")] if kind == 1 else []
    return "".join(out)


def frames(spark, texts, asked):
    base = spark.createDataFrame([(t, f"{random.Random(t).random():.6f}", t) for t in texts], "name string, tie string, item string")
    return base, spark.createDataFrame([(q, q) for q in asked], "query string, item string")


def test_all_pairs_within_a_threshold_are_found(spark):
    rng = random.Random(6)
    seeds = ["".join(rng.choice("abcü") for _ in range(rng.choice([6, 9, 12, 20]))) for _ in range(25)]
    texts = sorted({edited(rng, s, rng.randrange(5)) for s in seeds for _ in range(8)})
    asked = sorted({edited(rng, s, rng.randrange(3)) for s in seeds})
    for t in (1, 2, 3):
        some = [q for q in asked if len(q) >= edit_join.PIECE * (t + 1) + t]
        base, queries = frames(spark, texts, some)
        got = {(r["query"], r["name"], r["cost"]) for r in edit_join.within(base, queries, t).collect()}
        assert got == {(q, n, float(d)) for q in some for n in texts if (d := distance(q, n)) <= t}


def test_nearest_is_exact_and_compares_few_pairs(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(14)) for _ in range(60)]
    texts = sorted({edited(rng, w, n) for w in words for n in (0, 1, 1, 1, 2, 2, 3)} | {"", "a"})
    asked = sorted({edited(rng, w, 1) for w in words[:30]} | {"", "ab", "zzzzzzzzzzzz"})
    base, queries = frames(spark, texts, asked)
    tie = {r["name"]: r["tie"] for r in base.collect()}
    got = {}
    for r in edit_join.edit_nearest(base, queries, 4).orderBy("rank").collect():
        got.setdefault(r["query"], []).append((r["name"], r["cost"]))
    for q in asked:
        best = sorted(texts, key=lambda n: (distance(q, n), tie[n], n))[:4]
        assert got[q] == [(n, float(distance(q, n))) for n in best]
    long = queries.where(F.char_length("item") >= 11)
    compared = edit_join.candidates(base, long, 3).count()
    assert compared < 0.1 * len(texts) * long.count()
    assert edit_join.edit_nearest(base.limit(0), queries, 4).count() == 0
    assert edit_join.edit_nearest(base, queries.limit(0), 4).count() == 0
