import random

from orrery.llm import toxicity
from orrery.llm.toxicity import Model, fitted, risk, scored

RND = random.Random(2)
CLEAN = ["".join(RND.choice("abcdefgh") for _ in range(RND.randint(2, 8))) for _ in range(400)]


def doc(*more):
    return set(RND.sample(CLEAN, 40)) | set(more)


def test_learns_words_and_stems_without_negatives():
    bad = lambda: doc(RND.choice(["vile", "nasty"])) if RND.random() < 0.5 else doc(*["bad" + "stem" + RND.choice(CLEAN) for _ in range(2)])
    positive = [bad() for _ in range(300)]
    unlabelled = [bad() if RND.random() < 0.1 else doc() for _ in range(1500)]
    score = fitted(positive, unlabelled, 0.1).scorer()
    text = lambda bag: " ".join(sorted(bag))
    assert sum(score(text(bad())) >= 0.7 for _ in range(200)) >= 190
    assert sum(score(text(doc())) >= 0.7 for _ in range(200)) <= 2
    assert score(text(doc("badstemzzz", "badstemyyy"))) >= 0.7
    assert score(None) == score("") < 0.5


def test_risk_is_corrected_for_the_prior():
    import numpy as np

    g = np.array([5.0, 5.0])
    kept, negative = risk(g, g, 0.9)
    assert kept > 0 and 0 < negative < np.logaddexp(0, 5.0)
    assert risk(g, np.array([-9.0]), 0.9)[1] < 0


def test_nothing_to_learn_from():
    assert fitted([], [{"a"}], 0.2).weights == {}
    assert 0.19 < fitted([], [{"a"}], 0.2).scorer()("a") < 0.21


def test_rows(spark):
    docs = spark.createDataFrame([(1, "vile x", 0.5), (2, None, None), (2, "", 0.1), (None, "vile x", 0.1)], "doc_id bigint, text string, score double")
    got = scored(docs, Model({"vile": 5.0}, -1.0)).collect()
    assert len(got) == 4 and sum(r.score > 0.9 for r in got) == 2
    assert scored(docs.limit(0), Model({}, 0.0)).count() == 0


def test_training_reads_no_held_out_label(spark):
    texts = [(i, "vile thing here" if i % 4 == 0 else f"good thing {i}") for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1)], "doc_id bigint, toxic int")
    from pyspark.sql import functions as F

    from orrery.llm.common import fold

    flipped = labels.withColumn("toxic", F.when(fold(F.col("doc_id"), toxicity.FOLDS) == toxicity.HELD, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train(docs, labels) == toxicity.train(docs, flipped)
    assert toxicity.train(docs, labels.limit(0)).weights == {}


def test_model_depends_on_values_alone(spark):
    texts = [(i, f"vile thing w{i % 50} x{i}" if i % 5 == 0 else f"good thing w{i % 50} y{i}") for i in range(600)] + [(i, "one and the same text") for i in range(600, 900)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)], "doc_id bigint, toxic int")
    assert toxicity.train(docs.repartition(2), labels) == toxicity.train(docs.repartition(7).orderBy("text"), labels.repartition(3))


def test_slices_mix_to_one_model(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"vile thing w{i}" if i % 5 == 0 else f"good thing w{i}") for i in range(1000)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(1000)], "doc_id bigint, toxic int")
    whole = toxicity.train(docs, labels)
    monkeypatch.setattr(toxicity, "SLICE", 200)
    mixed = toxicity.train(docs, labels)
    assert set(mixed.weights) == set(whole.weights) == {"vile"}
    assert mixed.scorer()("vile") > 0.9 and mixed.scorer()("good") < 0.1


def test_query(spark, tmp_path):
    from zlib import crc32

    rnd = random.Random(5)
    rows, labels = [], []
    for i in range(900):
        words = [rnd.choice(CLEAN) for _ in range(30)]
        toxic = i % 6 == 0
        if toxic:
            words[rnd.randrange(30)] = rnd.choice(["vile", "nasty", "vileness"])
        rows.append((i, " ".join(words), "kept"))
        labels.append((i, int(toxic)))
    rows += [(900, None, "x"), (901, "", "x"), (902, ("calm words only " * 20_000) + "vile", "x"), (903, "calm words only " * 20_000, "x"), (5, rows[5][1], "again"), (None, rows[0][1], "x")]
    spark.createDataFrame(rows, "doc_id bigint, text string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.op2_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    assert all(r.held_out == (crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    by = {r.doc_id: r for r in got}
    held = [(by[i].predicted, t) for i, t in labels if by[i].held_out]
    assert len(held) > 200 and sum(p == t for p, t in held) >= 0.97 * len(held)
    assert by[900].score == by[901].score and by[902].predicted == 1 and by[903].predicted == 0


def planted(n):
    rnd = random.Random(9)
    clean = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(300)]
    rows = []
    for i in range(n):
        toxic = i % 5 == 0
        rows.append((i, " ".join([*rnd.sample(clean, 30), *([rnd.choice(["vile", "nasty", "badstem" + rnd.choice(clean)])] * toxic)]), int(toxic)))
    return rows


def test_training_equals_the_plain_version_of_one_slice(spark):
    rows = planted(600)
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string"), spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id bigint, toxic int")
    import zlib

    learnt = [(i, text, t) for i, text, t in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    prior = sum(t for *_, t in learnt) / len(learnt)
    plain = fitted([set(toxicity.words(text)) for _, text, t in learnt if t], [set(toxicity.words(text)) for _, text, _ in rows], prior)
    model = toxicity.train(docs, labels)
    assert model.weights.keys() == plain.weights.keys()
    assert all(abs(model.weights[f] - plain.weights[f]) < 1e-3 for f in plain.weights) and abs(model.bias - plain.bias) < 1e-3


def test_several_slices_judge_as_one(spark, monkeypatch):
    rows = planted(1500)
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string"), spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id bigint, toxic int")
    joint = toxicity.train(docs, labels).scorer()
    monkeypatch.setattr(toxicity, "SLICE", 300)
    sliced = toxicity.train(docs, labels).scorer()
    for score in (joint, sliced):
        assert sum((score(text) >= 0.7) == bool(t) for _, text, t in rows) >= 0.98 * len(rows)
    assert sum((joint(text) >= 0.7) != (sliced(text) >= 0.7) for _, text, _ in rows) <= 0.02 * len(rows)
