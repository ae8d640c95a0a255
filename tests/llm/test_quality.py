import numpy as np

from orrery.llm import quality
from orrery.llm.quality import _Chunks, buckets, counted, fitted, index_vectors, pooled, temperature, word_vectors


def test_buckets_split_word_and_affix():
    w, a = buckets("The cat, the CAT!! the.  ")
    assert len(w) == 5 and w[0] == w[2] == w[4] and w[1] == w[3]
    assert a[0] == a[2] == 0 and a[1] != 0 and a[3] != 0
    assert buckets(None)[0].size == buckets(" \n")[0].size == 0
    assert _Chunks(1000)["%%%"] % quality.AFFIXES != 0


def test_counts_are_the_neighbours_index_vectors():
    places, signs = index_vectors()
    sums = np.zeros((quality.IDS + 1, quality.SIZE))
    texts = ["a b, c", None, "b"]
    counted(texts, sums, places, signs)
    want = np.zeros_like(sums)
    for t in texts:
        w, f = buckets(t)
        ids = np.stack([w, f + quality.BUCKETS], 1).ravel()
        for i in range(len(ids)):
            for j in range(max(0, i - quality.REACH), min(len(ids), i + quality.REACH + 1)):
                if i != j:
                    np.add.at(want[ids[i]], places[ids[j]], signs[ids[j]])
    assert np.array_equal(sums[: quality.IDS], want[: quality.IDS])


def test_network_learns_and_is_calibrated():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, 6))
    y = (rng.random(6000) < 1 / (1 + np.exp(-3 * x[:, 0] * np.sign(x[:, 1])))).astype(int)
    p = fitted(x, y).probabilities(x)
    assert ((p > 0.5) == y).mean() > 0.75
    for low in (0.1, 0.6):
        part = (p > low) & (p < low + 0.3)
        assert abs(p[part].mean() - y[part].mean()) < 0.12
    # one label in twenty is flipped: sigmoid(4 / t) = 0.95
    got = temperature(np.array([4.0, -4, 4, -4] * 50), np.array([1, 0, 1, 0] * 45 + [0, 1, 1, 0] * 5))
    assert abs(np.log(got / (4 / np.log(19)))) < np.log(8 / 0.25) / 100
    assert np.allclose(fitted(x, np.ones(6000, int)).probabilities(x), 1, atol=1e-3)
    assert np.allclose(fitted(x[:0], y[:0]).probabilities(x), 0.5)


def test_rows(spark):
    rows = [(i, "good words stand here " * 3 if i % 3 else "BAD!! %%% " * 9, "x") for i in range(300)] + [(None, None, "x"), (7, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(None, 1)], "doc_id bigint, quality int")
    vectors, network = quality.train(docs, labels)
    got = quality.scored(docs, vectors, network).collect()
    assert len(got) == len(rows)
    assert all((r.score > 0.5) == (r.doc_id % 3 > 0) for r in got if r.doc_id is not None and r.doc_id != 7)
    assert np.array_equal(vectors, word_vectors(docs.repartition(5)))
    assert not pooled(None, vectors).any()
    assert quality.scored(docs.limit(0), vectors, network).count() == 0
    assert not word_vectors(docs.limit(0)).any()
    assert 0.49 < quality.scored(docs, *quality.train(docs, labels.limit(0))).first().score < 0.51


def test_query(spark, tmp_path):
    import random
    from zlib import crc32

    rnd = random.Random(6)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(900):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(20, 60))]
        good = i % 3 > 0
        rows.append((i, " ".join(words) + "." if good else " ".join(f"{w.upper()}!!" if rnd.random() < 0.7 else "$$$" for w in words), "kept"))
        labels.append((i, int(good)))
    rows += [(900, None, "x"), (901, "", "x"), (902, "BUY!! $$$ NOW!! " * 30_000, "x"), (5, rows[5][1], "again"), (None, rows[0][1], "x")]
    spark.createDataFrame(rows, "doc_id bigint, text string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = quality.op10_quality(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    assert all(r.held_out == (crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    by = {r.doc_id: r for r in got}
    held = [(by[i].predicted, t) for i, t in labels if by[i].held_out]
    assert len(held) > 120 and sum(p == t for p, t in held) >= 0.97 * len(held)
    assert by[900].score == by[901].score and by[902].predicted == 0
    twice = [r.score for r in got if r.doc_id == 5]
    assert len(twice) == 2 and twice[0] == twice[1]
