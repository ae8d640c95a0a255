import math
import random
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from orrery.llm import vector_search
from orrery.llm.vector_search import Cells, top_k, usable, whole


def ints(v):
    return [math.floor(1024 * Fraction(x)) for x in v]


def brute(rows, asking, k=10):
    """(query_id, rank, vec_id, score) of each asking row; rows are numbered, so that only the row itself is left out."""
    out = []
    whole_rows = [(i, ints(v)) for i, v in rows]
    for n, (q, qv) in enumerate(whole_rows):
        if asking(q):
            scores = sorted((-sum(a * b for a, b in zip(qv, v)), i) for m, (i, v) in enumerate(whole_rows) if m != n)
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def table(spark, rows, more=()):
    df = spark.createDataFrame([(*r, "x") for r in [*rows, *more]], "vec_id bigint, embedding array<double>, rank string")
    return df.where(usable(F.col("embedding"))).select("vec_id", F.col("embedding").alias("vector"))


def test_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "SHARD_BYTES", 8_000)
    rnd = random.Random(4)
    rows = [(i, [float(np.float32(rnd.gauss(0, 1))) for _ in range(6)]) for i in range(500)]
    rows += [(1000 + i, [0.5, -0.25, 0.0, 1.0, 0.0, 2.0]) for i in range(60)] + [(2000, []), (2001, [1.5])]
    odd = [(3000, None), (3001, [math.nan] * 6), (3002, [1.0, None]), (3003, [math.inf])]
    vectors = table(spark, rows, odd)
    got = sorted(map(tuple, top_k(vectors, vectors.where("vec_id % 10 = 0")).collect()))
    assert got == brute(rows, lambda i: i % 10 == 0)


def test_repeated_ids_and_rows_all_ask(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "SHARD_BYTES", 200)
    rows = [(100, [1.0, 0.0]), (100, [0.0, 1.0]), (100, [1.0, 0.0]), (7, [0.5, 0.5]), (7, [0.5, 0.5]), (8, [2.0, -1.0]), (0, [0.0])]
    vectors = table(spark, rows)
    assert sorted(map(tuple, top_k(vectors, vectors.where("vec_id % 100 = 0"), 4).collect())) == brute(rows, lambda i: i % 100 == 0, 4)


def test_large_components_are_exact(spark):
    rnd = random.Random(8)
    big = [(i, [rnd.choice([-1, 1]) * float((1 << 19) + rnd.randrange(1 << 12)) / (1 << rnd.randrange(3)) for _ in range(64)]) for i in range(60)]
    vectors = table(spark, big)
    assert sorted(map(tuple, top_k(vectors, vectors.where("vec_id % 10 = 0")).collect())) == brute(big, lambda i: i % 10 == 0)
    # 64 components of 2^29 give 2^64, of 2^900 far more: beyond a long
    vast = [(0, [float(1 << 19)] * 64), (1, [float(1 << 19)] * 64), (2, [-float(1 << 900)] * 64), (3, [1.0] * 64), (4, [1.7e308] * 64)]
    vectors = table(spark, vast)
    got = [(r["rank"], r.vec_id, r.score) for r in top_k(vectors, vectors.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(1, 4, (1 << 63) - 1), (2, 1, (1 << 63) - 1), (3, 3, 64 << 39), (4, 2, -(1 << 63))]


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (1, [3.0])], "vec_id bigint, vector array<double>")
    got = top_k(df, df.where("vec_id = 0")).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(1, 1, 3 << 20), (2, 1, 2 << 20)]
    assert top_k(df.limit(0), df.limit(0)).count() == 0
    assert top_k(df, df.limit(0)).count() == 0


def test_reads_few_exact_vectors():
    rng = np.random.default_rng(3)
    v = whole(rng.normal(size=(5000, 16)))
    ids = np.arange(5000)

    class Seen(np.ndarray):
        read = 0

        def __getitem__(self, key):
            if isinstance(key, np.ndarray):
                Seen.read += len(key)
            return np.asarray(super().__getitem__(key))

    cells = Cells(ids, v, np.ones(5000, int), ids)
    cells.vectors = v.view(Seen)
    for i, rows, scores in cells.nearest(v[:20], ids[:20], 10):
        want = sorted(((-int(v[j] @ v[i]), j) for j in ids if j != i))[:10]
        assert [(-s, r) for r, s in zip(rows, scores, strict=True)] == want
    assert Seen.read < 20 * 500


def test_rows_without_an_id_are_candidates(spark):
    rows = [(100, [1.0, 0.0], 0), (None, [5.0, 0.0], 1), (None, [2.0, 1.0], 2), (7, [2.0, 1.0], 3), (8, [-1.0, 0.0], 4)]
    df = spark.createDataFrame(rows, "vec_id bigint, vector array<double>, score int")
    got = top_k(df, df.where("vec_id % 100 = 0")).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in got] == [(100, None, 5 << 20), (100, 7, 2 << 20), (100, None, 2 << 20), (100, 8, -(1 << 20))]
    assert top_k(df, df.where("vec_id is null"), 1).where("query_id is null").count() == 2
