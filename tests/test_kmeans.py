import itertools

import numpy as np
import pytest

from orrery.operators import clusters, kmeans


def blobs(seed, sizes, dim=12, noise=0.15):
    rng = np.random.default_rng(seed)
    centres = np.eye(dim)[: len(sizes)]
    x = np.vstack([c + noise * rng.standard_normal((n, dim)) for c, n in zip(centres, sizes, strict=True)])
    return x / np.linalg.norm(x, axis=1)[:, None]


def frame(spark, families):
    rows = [(f, f"{f}-{i:05d}", v.tolist()) for f, x in families.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "family int, id string, embedding array<double>")


def groups(rows):
    out = {}
    for r in rows:
        out.setdefault((r.family, r.cluster), set()).add(r.id)
    return {k: frozenset(v) for k, v in out.items()}


def test_passes_give_what_one_task_gives(spark):
    """36 chips in separate groups, and a family of its own beside them."""
    df = frame(spark, {64: blobs(1, [12, 12, 12], noise=0.05), 128: blobs(2, [10, 6], noise=0.05)})
    plain, passes = clusters.built(df).collect(), clusters.built(df, plain=0).collect()
    assert groups(plain) == groups(passes)
    by_id = {r.id: r for r in plain}
    for r in passes:
        assert abs(r.sim - by_id[r.id].sim) < 1e-6 and abs(r.silhouette - by_id[r.id].silhouette) < 1e-6


def test_any_partitions_give_the_same(spark):
    df = frame(spark, {1: blobs(3, [60, 50, 40, 30], noise=0.4)})
    seen = [sorted(map(tuple, clusters.built(df.repartition(n), plain=0).collect())) for n in (1, 5)]
    assert seen[0] == seen[1]


def brute(x, ids, k, seed):
    """The rounds from the same start, row by row."""
    keys = ids
    run = kmeans.Run(0, k, seed)
    drawn = None
    for draw in range(kmeans.DRAWS + 1):
        want = k if draw else 1
        away = np.ones(len(x)) if drawn is None else np.clip(1 - kmeans.similarities(x, drawn).max(1), 0, None) ** 2
        u = kmeans.uniform(keys, run.seed * 1_000_003 + run.k * 101 + draw + 1)
        order = sorted((-np.log(u[i]) / away[i], keys[i], i) for i in range(len(x)) if away[i] > 0)[:want]
        new = x[[i for *_, i in order]]
        drawn = new if drawn is None else np.vstack([drawn, new])
    near = kmeans.similarities(x, drawn).argmax(1)
    centres = kmeans.plus_plus(drawn, np.bincount(near, minlength=len(drawn)), k, seed)
    labels = None
    for _ in range(100):
        now = kmeans.similarities(x, centres).argmax(1)
        if labels is not None and (now == labels).all():
            break
        labels = now
        for c in range(len(centres)):
            if (labels == c).any():
                m = np.rint(x[labels == c] * kmeans.SCALE).sum(0)
                centres[c] = m / np.linalg.norm(m)
    return labels, centres


@pytest.mark.parametrize("k", [2, 5, 9])
def test_as_brute_force(spark, k):
    from pyspark.sql import functions as F

    x = blobs(k, [30, 25, 20, 15, 10], noise=0.5)
    df = frame(spark, {0: x})
    keys = np.array([r.h for r in df.select("id", F.xxhash64("id").alias("h")).orderBy("id").collect()])
    members, chosen = kmeans.fitted(df.repartition(3), {0: [k]}, range(2, 3), 100, "family", "id", "embedding")
    labels, centres = brute(x, keys, k, 2)
    assert [r.cluster for r in members.orderBy("id").collect()] == labels.tolist()
    assert np.allclose(chosen[0][0], centres, atol=1e-8)
    assert abs(chosen[0][1] - clusters.silhouette(x, labels)) < 1e-6


def test_runs_that_do_not_fit_together(spark, monkeypatch):
    df = frame(spark, {1: blobs(5, [20, 20, 9], noise=0.3)})
    whole = sorted(map(tuple, clusters.built(df, plain=0).collect()))
    monkeypatch.setattr(kmeans, "CENTRE_BYTES", 1)
    assert sorted(map(tuple, clusters.built(df, plain=0).collect())) == whole


def test_few_and_equal_members(spark):
    same = np.tile(blobs(1, [1]), (30, 1))
    df = frame(spark, {1: same, 2: blobs(1, [1, 1]), 3: blobs(2, [1])})
    got = groups(clusters.built(df, plain=0).collect())
    assert {f: len(list(g)) for f, g in itertools.groupby(sorted(f for f, _ in got))} == {1: 1, 2: 1, 3: 1}
    assert clusters.built(df.where("false"), plain=0).count() == 0


def test_a_version_in_passes(spark):
    df = frame(spark, {64: blobs(1, [12, 12, 12], noise=0.05)})
    name, members, found = clusters.version(df, 2, plain=0)
    assert name == clusters.version(df.repartition(3), 2)[0]
    assert sorted(r["size"] for r in found.collect()) == [12, 12, 12] and members.count() == 36
