import random
import re
from collections import Counter

import pytest

from orrery.llm import collocations as co


def grams(rows, longest):
    f, total = Counter(), Counter()
    for lang, text, *_ in rows:
        lang, text = lang or "und", "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, longest + 1):
                f.update((lang, *w[i : i + n]) for i in range(len(w) - n + 1))
    return f, total


def brute(f, least):
    f = {k: n for k, n in f.items() if n >= least}
    out = {}
    for (lang, *w), a in f.items():
        inside = lambda v: any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))  # noqa: E731,B023
        if len(w) < 2 or any(x == lang and len(v) > len(w) and inside(v) and 100 * n >= 80 * a for (x, *v), n in f.items()):
            continue
        cuts = [(2_000_000 * a // (f[lang, *w[:k]] + f[lang, *w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out[lang, " ".join(w)] = (a, f[lang, *w[:k]], f[lang, *w[k:]], score)
    return out


def texts(seed, n):
    rnd = random.Random(seed)
    fixed = ["New York city Hall", "the the the the the", "ab-c d", "été à la", "x\x01 y", "\x00 z"]
    words = ["a", "b", "A", "c", "d\x01", "e.", "f,", "g\n", "h\t", "é", "i"]
    return [(rnd.choice(["en", "en", None, "fr"]), rnd.choice(["", " ", "!"]).join(rnd.choice(fixed) if rnd.random() < 0.3 else rnd.choice(words) + " " for _ in range(rnd.randint(0, 30))), "x") for _ in range(n)]


def same(spark, rows, least):
    docs = spark.createDataFrame(rows, "lang string, text string, phrase string")
    counts, totals = co.counted(docs, least=least)
    f, total = grams(rows, 4)
    assert {(r.lang, *r.words): r.n for r in counts.collect()} == {k: n for k, n in f.items() if n >= least}
    assert {r.lang: r.n for r in totals.collect() if r.n} == {k: n for k, n in total.items() if n}
    got = co.collocations(counts).collect()
    assert {(r.lang, r.phrase): (r.a, r.l, r.r, r.score) for r in got} == brute(f, least) and len(got) == len(brute(f, least))


@pytest.mark.parametrize(("seed", "span", "words"), [(1, 4_000_000, 1 << 21), (2, 100, 1 << 21), (3, 1000, 1)])
def test_as_brute_force(spark, monkeypatch, seed, span, words):
    monkeypatch.setattr(co, "SPAN", span)
    monkeypatch.setattr(co, "MOST_WORDS", words)  # a full filter lets all pass, and counts stay right
    same(spark, [*texts(seed, 120), ("en", None, None), (None, "", None)], 5)


@pytest.mark.parametrize("size", [1, 7, 40])
def test_ranges_begin_anywhere(spark, monkeypatch, size):
    monkeypatch.setattr(co, "RANGE", size)
    same(spark, texts(9, 60), 4)


def test_lockstep_across_any_cut():
    rows = [(("l", *k.split()), n) for k, n in [("a", 90), ("a b", 50), ("a b c", 40), ("a b c d", 30), ("a b e", 45), ("b", 20), ("b c", 12)]]
    whole = co.lockstep(rows, {})
    assert whole[0] == [[], [90], [90, 50], [90, 50, 40], [90, 50], [], [20]] and whole[1] == [50, 45, 30, 0, 0, 12, 0]
    for cut in range(1, len(rows)):
        known = dict(rows)
        first = rows[cut][0]
        carried = {first[:i]: known[first[:i]] for i in range(2, len(first))}
        left, right = co.lockstep(rows[:cut], {}), co.lockstep(rows[cut:], carried)
        longer = dict(zip([k for k, _ in rows], left[1] + right[1], strict=True))
        for k, n in right[2].items():
            longer[k] = max(longer[k], n)
        assert left[0] + right[0] == whole[0] and list(longer.values()) == whole[1]


def test_counts_of_any_size(spark):
    big = 1 << 62
    counts = [(["a"], big), (["b"], big - 1), (["a", "b"], big // 2), (["b", "a"], 30), (["a", "b", "a"], 29)]
    frame = spark.createDataFrame([("en", w, n) for w, n in counts], "lang string, words array<string>, n bigint")
    got = {r.phrase: r for r in co.collocations(frame).collect()}
    assert got["a b"].score == 2_000_000 * (big // 2) // (2 * big - 1) and "b a" not in got


def test_empty_and_very_long(spark):
    counts, totals = co.counted(spark.createDataFrame([], "lang string, text string"))
    assert co.collocations(counts).count() == 0 and totals.count() == 0
    same(spark, [("en", "one two three four five. " * 40_000, ""), ("en", "z" * 1_000_000, "")], 30)
