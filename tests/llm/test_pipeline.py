import random

import public_tokenizers as P


def test_stages_and_rows(spark, tmp_path):
    import corpus_pipeline
    from orrery.llm import bpe

    rows, labels, rnd = [], [], random.Random(9)
    for i in range(240):
        words = " ".join(f"w{rnd.randrange(3000)}" for _ in range(40))
        kind = i % 6
        text = {0: words, 1: words, 2: words + " vile", 3: " ".join(w + "!!" for w in words.upper().split()), 4: words, 5: words}[kind]
        if i % 40 == 4:
            text = rows[i - 4][1] + " end"
        if i % 40 == 5:
            text = "before " + "the item of the benchmark is seven words long" + " after " + words
        rows.append((i, text, "en", "src0", len(text)))
        labels.append((i, int(kind != 3), int(kind == 2)))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, "The item of the benchmark is seven words long")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    texts = {r[0]: r[1] for r in rows}
    rejected = {i for i, q, t in labels if (t or not q) and i % 40 not in (4, 5)}
    copies = {i for i in texts if i % 40 == 4}  # of i - 4: gone with it, or after it
    leaks = {i for i in texts if i % 40 == 5}
    assert set(got) == set(texts) - rejected - copies - leaks
    codec = bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for i, r in got.items():
        assert bytes(r.ids) == codec.encode_bytes(texts[i]) and r.n_tokens * 4 == len(r.ids)

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "decontamination", "byte_bpe"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_stages_take_odd_rows(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([(1, 1, 0), (None, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "x", "y", 0), (None, "a b c d e f", None, None, 1), (5, "p q r s t u", None, None, 1), (5, "p q r s t u", None, None, 1)], schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, str(tmp_path)).count() == (4 if name == "near_dedup" else 5), name
        assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0, name


def test_stages_take_very_long_texts_and_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(3)
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, key bigint, component string, hash bigint, words string"
    item = "the item of the benchmark is seven words long"
    long = " ".join(f"w{rnd.randrange(5000)}" for _ in range(120_000))
    texts = {1: long, 2: long + " end", 3: "x" * 700_000, 4: long.replace("w1", "v1") + " " + item, 5: "short and plain"}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), 0.5, 7, "c", 8, "w") for i, t in texts.items()], schema)
    spark.createDataFrame([(i, 1, 0) for i in texts], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {"toxicity": {1, 2, 3, 4, 5}, "quality": {1, 2, 3, 4, 5}, "near_dedup": {1, 3, 4, 5}, "decontamination": {1, 2, 3, 5}}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == kept[name], name
    assert {r.doc_id: r.n_tokens > 0 for r in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()} == dict.fromkeys(texts, True)
