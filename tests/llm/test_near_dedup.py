import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from orrery.llm import near_dedup
from orrery.llm.components import components
from orrery.llm.near_dedup import HASHES, least_equal, near_duplicates, packed
from orrery.llm.shingles import factors, minima, shingle_sets, word_hashes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, width, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        near = Counter(j for x in s for j in holders[x])
        for j, k in near.items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                root[find(i)] = find(j)
        for x in s:
            holders[x].append(i)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(doc, len(sets[i]), least.get(find(i), doc) if sets[i] else doc) for i, (doc, _) in enumerate(rows)]


def edited(rnd, words, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"w{rnd.randrange(10**6)}"
    return words


@pytest.mark.parametrize(("width", "percent", "block"), [(3, 85, 8), (5, 80, 2048)])
def test_as_brute_force(spark, monkeypatch, width, percent, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rnd, rows = random.Random(8), []
    for g in range(14):
        base = [f"{g}x{i}" for i in range(rnd.choice([8, 40, 200]))]
        for _ in range(rnd.choice([1, 2, 30])):
            rows.append((len(rows), " ".join(edited(rnd, base, rnd.choice([0, 0, 1, 2, len(base) // 12])))))
    chain = [f"c{i}" for i in range(100)]
    for _ in range(40):  # each like the one before, the ends unlike
        chain = edited(rnd, chain, 1)
        rows.append((len(rows), " ".join(chain)))
    rows += [(len(rows) + 5, None), (len(rows) + 6, ""), (len(rows) + 7, " \n\t"), (len(rows) + 8, "two words"), (len(rows) + 9, "TWO\x0bwords "), (None, "two words"), (None, "alone here")]
    rows += [rows[0], rows[0]]
    rnd.shuffle(rows)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, kept string")
    got = near_duplicates(docs, width, percent).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(brute(rows, width, percent), key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_one_row_of_each_group_stays(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(7, base, "x"), (3, base + " end", "y"), (None, base, "n"), (3, base, "z"), (9, "", "e"), (9, "", "e"), (None, "alone in all the world here", "a"), (5, "another text of its own stays", "b"), (5, "another text of its own stays", "b"), (None, None, "o")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, name string")
    got = near_dedup.deduplicated(docs).collect()
    assert sorted(r.name for r in got if r.doc_id != 3) == ["a", "b", "e", "e", "o"]
    assert [r.doc_id for r in got].count(3) == 1
    assert near_dedup.deduplicated(docs.limit(0)).count() == 0


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_words_hash_alike_wherever_they_stand():
    hashes, owner = word_hashes(["a bc A".encode(), b"", "é bc\x85x \x0b".encode()])
    assert owner.tolist() == [0, 0, 0, 2, 2] and hashes[0] == hashes[2] and len({*hashes.tolist()}) == 4
    assert [len(s) for s in shingle_sets(["a b c d", None, "x", "a  B\tc"], 3)] == [2, 0, 1, 1]
    assert shingle_sets(["a b c d"], 3)[0].tolist() != shingle_sets(["x", "d a b c"], 3)[1].tolist()
    words = " ".join(str(i) for i in range(30000))
    assert len(shingle_sets([words], 3)[0]) == 29998


def test_signatures_estimate_similarity():
    f, universe = factors(HASHES), np.random.default_rng(1).integers(0, 1 << 63, 3000).astype(np.uint64)
    for share in (0.0, 0.5, 0.85, 1.0):
        n = int(2000 * share / (1 + share)) if share < 1 else 1000
        a, b = universe[:1000], np.concatenate([universe[:n], universe[1000 : 2000 - n]])
        bits = [np.unpackbits(packed(minima(x, f)).view(np.uint8), bitorder="little").reshape(2, HASHES) for x in (a, b)]
        equal = (bits[0] == bits[1]).all(0).sum()
        assert abs((equal / HASHES - 0.25) / 0.75 - share) < 0.16
        assert share < 0.85 or equal >= least_equal(0.85)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 102)], "a bigint, b bigint")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}


def test_very_long_texts(spark):
    rnd = random.Random(11)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(150_000)]
    near = words.copy()
    near[::200] = ["changed"] * len(near[::200])
    far = words.copy()
    far[::5] = ["changed"] * len(far[::5])
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), (4, "x" * 3_000_000)], "doc_id bigint, text string")
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in near_dedup.near_duplicates(docs, 5, 80).collect()}
    assert {i: c for i, (c, _) in got.items()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert got[4][1] == 1 and got[1][1] == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})


def thue_morse(k):
    """Two words of 2^k letters that every polynomial modulo 2^64 takes for one, from k = 10 on."""
    x, y = "a", "b"
    for _ in range(k):
        x, y = x + y, y + x
    return x, y


@pytest.mark.parametrize("k", [10, 11, 12])
def test_words_that_polynomials_confuse(spark, k):
    x, y = thue_morse(k)
    assert len(set(word_hashes([f"{x} {y}".encode()])[0].tolist())) == 2
    rows = [(1, f"{x} red fox"), (2, f"{y} red fox"), (3, f"{x} RED\tfox"), (4, "some other words")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows, 3, 85)) == [(1, 1, 1), (2, 1, 2), (3, 1, 1), (4, 1, 4)]


def test_one_set_in_two_orders(spark):
    rows = [(1, "a b c a b c a"), (2, "b c a b c a b"), (3, "c a b c a b"), (4, "a b c a b"), (5, "a b c")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows, 3, 85))


def test_spans_cut_between_words(monkeypatch):
    from orrery.llm import shingles

    whole = word_hashes([b"aa bb  cc\x0bdd " * 9, b"", b"x" * 40 + b" y"])
    monkeypatch.setattr(shingles, "SPAN", 7)
    cut = word_hashes([b"aa bb  cc\x0bdd " * 9, b"", b"x" * 40 + b" y"])
    assert np.array_equal(whole[0], cut[0]) and np.array_equal(whole[1], cut[1])
