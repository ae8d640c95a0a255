import random
import re
from collections import Counter
from itertools import permutations

import pytest

from orrery.llm import filter_audit as fa

DOCS = "doc_id bigint, text string, source string, mask string, good string, part string"
LABELS = "doc_id bigint, quality int, toxic int, n string"


def brute(docs, labels):
    """Every document through every order, one by one."""
    good = {i for i, q, _, *_ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t, *_ in labels if t == 1 and i is not None}
    texts = [t or "" for _, t, *_ in docs]
    least = {}
    for (i, *_), t in zip(docs, texts, strict=True):
        if i is not None:
            least[t] = min(least.get(t, i), i)
    out, share = Counter(), Counter()
    parts = {d[2] or "" for d in docs}
    for (i, _, source, *_), t in zip(docs, texts, strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t)}
        fails |= {"D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t]}
        for order in permutations("ABCDE"):
            gone = False
            for k, f in enumerate(order, 1):
                key = (source or "", "".join(order), k)
                here = fails[f] and not gone
                out[*key, "removed"] += here
                out[*key, "redundant"] += fails[f] and gone
                out[*key, "unique"] += fails[f] and sum(fails.values()) == 1
                out[*key, "good"] += here and i in good
                out[*key, "toxic"] += here and i in toxic
                gone |= here
                out[*key, "kept"] += not gone
                share[source or "", f] += here
    rows = set()
    for p in parts:
        for order in permutations("ABCDE"):
            for k, f in enumerate(order, 1):
                key = (p, "".join(order), k)
                rows.add((*key, *[out[*key, c] for c in ("kept", "removed", "redundant", "unique", "good", "toxic")], share[p, f]))
    return rows


def run(spark, docs, labels):
    rows = fa.facts(spark.createDataFrame(docs, DOCS))
    counted = fa.tabulated(rows, spark.createDataFrame(labels, LABELS), 16)
    return [tuple(r) for r in fa.audited(fa.coalitions(counted, 5), "ABCDE").collect()]


def test_as_brute_force(spark):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["a", "B", "cc", "Dd", "é", "x#", "yy"]) + rnd.choice(["", str(rnd.randrange(40))]) for _ in range(rnd.choice([3, 60, 90]))) for _ in range(25)]
    texts += [None, "", " \t\n", "\x0b", "word " * 70, " lead and trail "]
    docs = [(i, rnd.choice(texts), rnd.choice(["s1", "s1", "s2", None, ""]), "m", "g", "p") for i in range(80)]
    docs += [docs[0], docs[0], (None, texts[0], "s1", None, None, None), (None, texts[0], "s1", None, None, None), (7, texts[1], "s3", "", "", "")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1]), "z") for i in range(0, 80, 2)] + [(0, 1, 1, ""), (0, 0, 0, ""), (None, 1, 1, "")]
    got = run(spark, docs, labels)
    assert len(got) == len(set(got)) and set(got) == brute(docs, labels)


def test_empty_and_very_long(spark):
    assert run(spark, [], []) == []
    got = run(spark, [(1, "word " * 500_000, "s", "", "", ""), (2, "Ä" * 1_000_000, "s", "", "", "")], [])
    assert set(got) == brute([(1, "word " * 500_000, "s"), (2, "Ä" * 1_000_000, "s")], [])


@pytest.mark.parametrize("players", [1, 2, 3, 5])
def test_shapley_by_all_orders(players):
    rnd = random.Random(players)
    value = [0, *[rnd.randrange(1 << 40) for _ in range((1 << players) - 1)]]
    total, orders = [0] * players, list(permutations(range(players)))
    for order in orders:
        before = 0
        for i in order:
            total[i] += value[before | 1 << i] - value[before]
            before |= 1 << i
    assert [x * len(orders) for x in fa.shapley(value)] == total
