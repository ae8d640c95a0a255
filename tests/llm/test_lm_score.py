import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from orrery.llm import lm_score
from orrery.llm.lm_score import packed, planes, scored, unpacked, unplaned


def brute(texts, order):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or "")) for t in texts]
    counts = Counter(tuple(w[i : i + n]) for w in docs for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(map(len, docs))
    out = []
    for w in docs:
        s = 0.0
        for i in range(len(w)):
            for n in range(order, 0, -1):
                gram = tuple(w[max(0, i - n + 1) : i + 1])
                if n == 1:
                    s += math.log(counts[gram] / total) + (order - 1) * math.log(0.4)
                elif len(gram) == n and counts[gram] >= 2:
                    s += math.log(counts[gram] / counts[gram[:-1]]) + (order - n) * math.log(0.4)
                    break
        out.append((len(w), s))
    return out


@pytest.mark.parametrize(("order", "block", "chars"), [(1, 10**6, 10**6), (2, 50, 500), (3, 200, 900), (4, 1, 10**6)])
def test_as_brute_force(spark, monkeypatch, order, block, chars):
    monkeypatch.setattr(lm_score, "BLOCK_WORDS", block)
    monkeypatch.setattr(lm_score, "PARTITION_CHARS", chars)
    rnd = random.Random(order)
    texts = [" ".join(rnd.choice(["The", "cat", "sat", "é", "on", "a"]) + rnd.choice(["", "", str(rnd.randrange(30))]) for _ in range(rnd.choice([1, 2, 9, 60]))) for _ in range(60)]
    texts += [None, "", "  \n", texts[0], "x" * 4000, "the " * 3000]
    rows = [(i if i else None, t, "x") for i, t in enumerate(texts)]
    got = scored(spark.createDataFrame(rows, "doc_id bigint, text string, score string").repartition(3), order).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    for (doc, _, _), (n, s) in zip(rows, brute(texts, order), strict=True):
        r = by_id[doc]
        assert r.n_words == n and math.isclose(r.score, s, rel_tol=1e-9, abs_tol=1e-9)
        assert (r["mean"] is None) == (n == 0)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert scored(docs).count() == 0
    assert [tuple(r) for r in scored(spark.createDataFrame([(1, None)], "doc_id bigint, text string")).collect()] == [(1, 0, 0.0, None)]


def test_packing():
    x = np.sort(np.random.default_rng(1).integers(0, (1 << 64) - 1, 999, np.uint64))
    assert np.array_equal(unpacked(packed(x)), x) and unpacked(b"").size == 0
    y = np.array([0, 1, 70000, (1 << 32) - 1])
    assert np.array_equal(unplaned(planes(y)), y) and unplaned(b"").size == 0


def test_totals_of_any_size():
    y = np.array([0, 1, (1 << 32) + 5, 1 << 50], np.int64)
    assert unplaned(planes(y)).tolist() == y.tolist()
    rows = pa.table({"block": [0, 1], "order": pa.array([1, 1], pa.int32()), "bucket": pa.array([0, 0], pa.int32()), "hashes": [packed(np.array([3, 9], np.uint64)), packed(np.array([9], np.uint64))], "counts": [planes(np.array([1, 1 << 32])), planes(np.array([1 << 32]))]})
    got = {r["block"]: unplaned(r["totals"]).tolist() for r in lm_score._sums(rows).to_pylist()}
    assert got == {0: [1, 1 << 33], 1: [1 << 33]}


def test_words_that_polynomials_confuse(spark):
    x, y = "a", "b"
    for _ in range(10):
        x, y = x + y, y + x
    texts = [f"{x} red fox", f"{y} red fox", f"{x} dog", "red fox red fox"]
    got = {r.doc_id: r.score for r in scored(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), 3).collect()}
    for i, (_, s) in enumerate(brute(texts, 3)):
        assert math.isclose(got[i], s, rel_tol=1e-9)


def test_checksum_tells_hashes_apart():
    a, b = np.array([3, 9], np.uint64), np.array([3, 10], np.uint64)
    assert lm_score.checksum(a) != lm_score.checksum(b) and lm_score.checksum(a[:0]) == 0
