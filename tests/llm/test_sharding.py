import hashlib
import zlib
from collections import Counter

from orrery.llm import sharding


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def key(doc_id):
    return int(hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()[:15], 16)


def test_shards_and_slots(spark):
    rows = [(i, f"text {i % 7}é", "s") for i in range(3000)] + [(5, None, "s"), (5, "text 5é", "s"), (5, "text 5é", "s"), (None, "", None)]
    got = sharding.sharded(spark.createDataFrame(rows, "doc_id bigint, text string, shard string")).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    for r in got:
        assert r.law == "key" and r.shard == jump(key(r.doc_id), 8) and r.grown_shard == jump(key(r.doc_id), 9)
        assert r.grown_shard in (r.shard, 8)
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert 0.05 < sum(r.grown_shard == 8 for r in got) / len(got) < 0.18


def test_many_shards_and_empty(spark):
    ids = spark.range(500).withColumnRenamed("id", "doc_id")
    for n in (1, 2, 100):
        assert all(r.shard == jump(key(r.doc_id), n) for r in sharding.with_shard(ids, "doc_id", n).collect())
    assert sharding.sharded(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_very_long_texts(spark):
    docs = spark.createDataFrame([(1, "é" * 2_000_000), (2, "")], "doc_id bigint, text string")
    assert sorted((r.doc_id, r["size"]) for r in sharding.sharded(docs).collect()) == [(1, 4_000_001), (2, 1)]
