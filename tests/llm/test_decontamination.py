import random
import re

from orrery.llm import decontamination
from orrery.llm.decontamination import HASHES, SMALL, decontaminated, item_shingles, least_hits, matches, signatures


def brute(docs, items, width=5, percent=80):
    split = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if w]
    grams = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    out = {}
    for item, t in items:
        w = split(t)
        if w:
            k = min(width, len(w))
            own = grams(w, k)
            for doc, text in docs:
                n = len(own & grams(split(text), k))
                if n * 100 >= percent * len(own):
                    out[doc, item] = max(out.get((doc, item), (0, 0)), (len(own), n))
    return out


def case():
    rnd = random.Random(6)
    say = lambda n: [rnd.choice("abcdefghijklmnop") + str(rnd.randrange(60)) for _ in range(n)]
    items = [(i, " ".join(say(n))) for i, n in enumerate([1, 2, 4, 5, 6, 9, 14, 40, 41, 90, 400, 400])]
    items += [(20, None), (21, ""), (22, " \n"), (23, items[6][1]), (23, items[6][1]), (None, items[7][1]), (24, "A  b\tC d e F g"), (25, "a a a a a a a a")]
    docs = []
    for i in range(120):
        w = say(rnd.choice([0, 3, 20, 300]))
        if i % 2:
            piece = (rnd.choice(items)[1] or "").split()
            for _ in range(rnd.choice([0, 0, 1, 2, 5])):
                if piece:
                    piece[rnd.randrange(len(piece))] = "edit"
            at = rnd.randrange(len(w) + 1)
            w[at:at] = piece
        docs.append((i, " ".join(w)))
    docs += [(500, None), (501, ""), (None, items[8][1]), (502, "x A B c D\x0be f G y"), (3, items[9][1]), (3, items[9][1]), (503, "a " * 3000)]
    return docs, items


def test_as_brute_force(spark, monkeypatch):
    docs, items = case()
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id bigint, text string, item string, key int")
    b = spark.createDataFrame([(*r, "y") for r in items], "item_id bigint, text string, doc_id string")
    want = brute(docs, items)
    for limit in (decontamination.BROADCAST_ROWS, 0):
        monkeypatch.setattr(decontamination, "BROADCAST_ROWS", limit)
        got = {(r.doc_id, r.item_id): (r.n_shingles, r.n_common) for r in matches(d, b).collect()}
        assert got == want
    bad = {doc for doc, _ in want}
    kept = decontaminated(d, b)
    assert kept.columns == d.columns
    # of rows with one id, only those that hold an item go
    single = [(i, t) for i, t in docs if i != 3]
    assert sorted(r.doc_id or -1 for r in kept.collect() if r.doc_id != 3) == sorted(i or -1 for i, _ in single if i not in bad)


def test_empty(spark):
    docs, items = case()
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert matches(d, b.limit(0)).count() == matches(d.limit(0), b).count() == 0
    assert decontaminated(d, b.limit(0)).count() == len(docs)


def test_signatures_are_partitioned_by_size(spark):
    long = " ".join(f"w{i}" for i in range(300))
    shingled = item_shingles(spark.createDataFrame([("a b c d e f",), (long,)], "text string"))
    got = {r["size"]: (r.n, r.weight) for r in signatures(shingled).groupBy("size").agg({"*": "count", "weight": "sum"}).toDF("size", "n", "weight").collect()}
    by_size = {size: sorted(x) for size, x in got.items()}
    assert by_size[2] == [2, 2] and by_size[296][1] == HASHES and by_size[296][0] <= HASHES
    assert SMALL >= HASHES and 10 <= least_hits() <= 14
