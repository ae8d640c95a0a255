import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from orrery.llm import packing as pk

PATH = public_tokenizers.path("byte_bpe_50k.json")


def best_fit_decreasing(sizes, capacity):
    """One piece after the other."""
    left = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, x in enumerate(left) if x >= s]
        if fits:
            left[min(fits, key=lambda i: left[i])] -= s
        else:
            left.append(capacity - s)
    return len(left)


def totals(packing):
    out = Counter()
    for p, c in packing.items():
        for s in p:
            out[s] += c
    return out


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_of_counts_is_best_fit_of_pieces(seed):
    rnd = random.Random(seed)
    sizes = [rnd.choice([rnd.randint(1, 100), rnd.randint(30, 50), 7]) for _ in range(300)]
    counts = Counter(sizes)
    found = pk.best_fit(100, sorted(counts.items(), reverse=True))
    assert totals(found) == counts and all(sum(p) <= 100 for p in found)
    assert sum(found.values()) == best_fit_decreasing(sizes, 100)


@pytest.mark.parametrize("seed", range(6))
def test_children_hold_every_piece_once(seed):
    rnd = random.Random(seed)
    counts = {s: rnd.randint(1, 10 ** rnd.randint(0, 6)) for s in rnd.sample(range(1, 101), 40)}
    people = pk.founders(counts, 100, 0, 4, rnd)
    for child in [pk.crossed(people[0], people[1], counts, 100, rnd), pk.mutated(people[2], 100, rnd), *pk.bred(people, counts, 100, 3, 4, rnd)]:
        assert totals(child) == counts and all(sum(p) <= 100 and c > 0 for p, c in child.items())


def test_crossover_injects_whole_bins():
    one, other = {(6, 3): 2, (5,): 1}, {(6, 4 - 1): 1, (5, 3): 1, (6,): 1}
    counts = {6: 2, 3: 2, 5: 1}
    for seed in range(20):
        child = pk.crossed(one, other, counts, 10, random.Random(seed))
        assert totals(child) == counts


def test_islands_beat_best_fit_decreasing(spark):
    rnd, counts = random.Random(1), Counter()
    for _ in range(20):  # bins of 100 that three pieces fill
        a = rnd.randint(38, 49)
        b, copies = rnd.randint(25, (100 - a) // 2), rnd.randint(1, 20)
        counts.update({a: copies})
        counts.update({b: copies})
        counts.update({100 - a - b: copies})
    best = pk.evolved(spark, dict(counts), 100)
    assert totals(best) == counts and all(sum(p) <= 100 for p in best)
    sizes = list(counts.elements())
    assert sum(sizes) // 100 <= sum(best.values()) < best_fit_decreasing(sizes, 100)
    assert pk.evolved(spark, dict(counts), 100) == best


def test_elites_migrate(spark):
    best = pk.evolved(spark, {7: 5, 5: 9, 3: 11, 2: 4}, 11, islands=3, population=2, generations=1, epochs=3)
    assert totals(best) == {7: 5, 5: 9, 3: 11, 2: 4}


def check(spark, rows, capacity):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, length string, offset string").repartition(3)
    got = [r.asDict() for r in pk.packed(docs, PATH, capacity).collect()]
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    want = Counter()
    for doc, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % capacity + 1
        for k, (a, b) in enumerate(zip([0, *range(first, len(ids), capacity)], [*range(first, len(ids), capacity), len(ids)], strict=True)):
            want[doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return got, bins


def test_pieces_and_places(spark):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice(["the", "été", "don't", "x\ny", "1234", "…", "<|endoftext|>", "longer words"]) for _ in range(rnd.choice([1, 5, 30, 80]))) for _ in range(90)]
    texts += [None, "", " ", "  two  spaces ", "a \n b", "tab\tx", "　wide 　 x", "z" * 3000, "\x1c a \x85b"]
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(3, texts[3], None, None)] * 2 + [(None, texts[4], None, None)] * 2
    got, bins = check(spark, rows, 64)
    lengths = [r["length"] for r in got]
    assert len(bins) <= best_fit_decreasing(lengths, 64)


def test_edges(spark):
    empty = pk.packed(spark.createDataFrame([], "doc_id bigint, text string"), PATH)
    assert empty.count() == 0 and empty.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    check(spark, [(1, "word " * 60_000, "", ""), (2, None, "", "")], 1024)
    _, bins = check(spark, [(i, "same text", "", "") for i in range(500)], 16)
    assert len(bins) == -(-500 // (16 // len(Tokenizer.from_file(PATH).encode("same text").ids + [2])))


def test_ids_are_the_librarys():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    rnd, e = random.Random(2), pk.Encoder(PATH)
    assert e.plain
    alphabet = ["a", "B", "é", "ß", "1", "²", "'s", "'ll", ".", "…", "中", "😀", "\n", "\t", " ", " ", "  ", " ", "​", "\x1c", "<|endoftext|>", "ǅ", "ـ"]
    for _ in range(3000):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(12)))
        assert np.frombuffer(e.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
