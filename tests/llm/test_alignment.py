"""Alignment of two tokenizers against a pair-by-pair brute force with the whole-text tokenizers."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from encore.llm import alignment, queries

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def whole():
    """Token ids of whole texts, and the bytes of each id."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    # The usual printable stand-ins of bytes in byte-level vocabularies.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}

    def a_bytes(k):
        return bytes(back[c] for c in a.id_to_token(k))

    def b_bytes(k):
        piece = b.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(k) else piece.replace("▁", " ").encode()

    def encode(text):
        x = [(k, a_bytes(k)) for k in a.encode(" " + text, add_special_tokens=False).ids]
        y = [(k, b_bytes(k)) for k in b.encode(text)]
        right = all(b"".join(p for _, p in z) == (" " + text).encode() for z in (x, y))
        return (x, y) if text and right else ([], [])

    return encode


def ranges(tokens):
    at, out = 0, []
    for k, raw in tokens:
        out.append((k, at, at + len(raw)))
        at += len(raw)
    return out


def brute(rows, encode):
    docs, holders = [], Counter()
    for key, text in rows:
        a, b = map(ranges, encode(text or ""))
        links = [(x, y) for x, lo, hi in a for y, lo2, hi2 in b if lo < hi2 and lo2 < hi]
        holders.update(set(links))
        common = sorted({hi for _, _, hi in a} & {hi for _, _, hi in b})
        groups = [
            ",".join(str(k) for k, _, end in a if lo < end <= hi) + "|" + ",".join(str(k) for k, _, end in b if lo < end <= hi)
            for lo, hi in zip([0, *common], common)
        ]
        docs.append((key, a, b, links, groups))
    most = defaultdict(int)
    for (x, _), n in holders.items():
        most[x] = max(most[x], n)
    return sorted(
        (
            (
                key, len(a), len(b), len(groups), len(links), sum(holders[l] == most[l[0]] for l in links),
                sum(holders[l] for l in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "",
            )
            for key, a, b, links, groups in docs
        ),
        key=repr,
    )


def found(df):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def strange(seed, n):
    rng = random.Random(seed)
    alphabet = [*"abcDEF 019.,'\n\t  ", " ", "▁", "　", "é", "ß", "ж", "日", "\U0001f600", "́", "<s>", "<|endoftext|>", "<0x41>", "'ll", "\r\n", "\0"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_query_matches_brute_force(spark, whole):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    some = sorted(docs, key=lambda r: len(r[1] or ""))[:150]
    df = spark.createDataFrame(some, "doc_id long, text string").repartition(3)
    assert found(alignment.align(df, A, B)) == brute(some, whole)
    assert len(found(queries.op12(spark, SMALL))) == len(docs)


def test_strange_texts_match_brute_force(spark, whole, monkeypatch):
    """Small blocks, so that the counts of many blocks meet."""
    monkeypatch.setattr(alignment, "COUNTED_BYTES", 1)
    monkeypatch.setattr(alignment, "HELD_PAIRS", 10)
    rows = list(enumerate(strange(1, 300)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    expected = brute(rows, whole)
    assert found(alignment.align(df, A, B)) == expected
    assert any(r[1] == 0 for r in expected) and any(r[3] < min(r[1], r[2]) for r in expected)


def test_units_give_the_ids_of_whole_texts(whole):
    """Every code point that a text may hold, in front of and behind spaces and letters."""
    units = alignment.units_of(A, B)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or c % 97 == 0)]
    texts = ["a ".join(f"{c} x{c}{c}  {c}" for c in points[k : k + 40]) for k in range(0, len(points), 40)]
    (a, n_a), (b, n_b) = units.tokens(texts)[0]
    at_a = at_b = wrong = 0
    for text, x, y in zip(texts, n_a, n_b):
        one, two = whole(text)
        wrong += [k for k, _ in one] != a[at_a : at_a + x].tolist() or [k for k, _ in two] != b[at_b : at_b + y].tolist()
        at_a, at_b = at_a + x, at_b + y
    assert wrong == 0


@pytest.mark.parametrize("lane", [1, 3, 1000])
def test_lanes_do_not_change_the_links(lane):
    rng = np.random.default_rng(lane)
    a, b, counts, at = [], [], [], 0
    for size in (1, 2, 50, 0, 400, 7):
        inner = [np.sort(rng.choice(np.arange(1, size), rng.integers(0, size), replace=False)) if size > 1 else np.empty(0, int) for _ in range(2)]
        ends = [np.append(x, size) if size else x for x in inner]
        a, b = a + (at + ends[0]).tolist(), b + (at + ends[1]).tolist()
        counts.append(len(ends[0]))
        at += size
    i, j, cut_i, cut_j = alignment.lockstep(np.array(a), np.array(b), np.array(counts), lane)
    starts = [[0, *x[:-1]] for x in (a, b)]
    links = {(x, y) for x in range(len(a)) for y in range(len(b)) if starts[0][x] < b[y] and starts[1][y] < a[x]}
    assert len(i) == len(links) and set(zip(i.tolist(), j.tolist())) == links
    assert {(a[x], b[y]) for x, y in zip(cut_i, cut_j)} == {(e, e) for e in set(a) & set(b)}


def test_odd_rows(spark, whole):
    long = "Some words, " * 20_000
    rows = [(1, None), (2, ""), (3, " "), (None, "the same text"), (4, "the same text"), (4, "the same text"), (5, "a▁b"), (6, "\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {c: F.lit("x") for c in ("block", "pair", "docs", "n", "best", "n_a", "_key", "_text", "pairs", "times")}
    )
    assert found(alignment.align(df, A, B)) == brute(rows, whole)
    last = found(alignment.align(spark.createDataFrame([(7, long)], "doc_id long, text string"), A, B))[0]
    assert last[1] == len(whole(long)[0]) and last[4] == last[6]
    assert alignment.align(df.limit(0), A, B).count() == 0
