"""Phrase collocations from sorted streams of counts, after Heafield et al. (2013): external estimation.

1. ``counted``: phrases of 1, 2, 3 and 4 words, one order after the other. A phrase that occurs LEAST times
   has parts that do, so an order reads the texts again and takes up only phrases whose two parts, one
   word shorter, pass a Bloom filter of the counted ones; what it lets through wrongly is counted and
   drops out. The filter is 16 MB at most: beyond that it passes more, and counts stay exact.
2. Counts are put in prefix order (by first word, second word, ...): ranges of the order are written to
   the shared folder, and a pass over each keeps the open prefixes of the current phrase in a stack, so a
   phrase meets the counts of all its first parts, and a first part its longest extensions, in lockstep
   and without a table of hashes. Then the same in suffix order, with what the first pass found.
3. A range may begin inside what an earlier one opened. Those open prefixes, at most three a range, are
   looked up beforehand, and what the range adds to them is handed back: ranges hold about as many
   phrases each, however many begin with one word.

A phrase lies inside a longer one with almost its count only if it does inside one that is one word
longer, so the extensions by one word decide which candidates drop.

Defined results: a null text is empty, a null lang is ``und``; words keep what is not ``[.,;:!?]``, white
space or A-Z as it is; repeated rows count again; other columns are not read; a lang without candidates,
and an empty table, give no rows. Counts and scores are whole numbers of any size.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm.common import dropped, pieces, released, small_batches, staged, table, tidy
from orrery.llm.shingles import mixed

LONGEST, LEAST, TOP, COVERED, SCALE = 4, 30, 2000, 80, 2_000_000
#: Words that a task holds before it counts them.
SPAN = 1_500_000
#: Bits of the filter for each phrase; 64-bit words of it at most.
BITS, MOST_WORDS = 16, 1 << 21
#: Phrases of a range of an order.
RANGE = 200_000
#: What ends a piece becomes one byte that no UTF-8 text holds, a tab a space, A-Z a-z.
EDGE = b"\xff"
TABLE = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\x09" + bytes(range(65, 91)), EDGE * 10 + b" " + bytes(range(97, 123)))


class Words:
    """Words of one lang as numbers; 0 is the edge of a piece."""

    def __init__(self) -> None:
        self.numbers: defaultdict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.numbers[EDGE]  # noqa: B018  (takes number 0)
        self.runs: list[np.ndarray] = []
        self.held = 0

    def add(self, texts: list[bytes]) -> None:
        tokens = EDGE.join([b"", *texts, b""]).translate(TABLE).replace(EDGE, b" \xff ").split()
        run = np.fromiter(map(self.numbers.__getitem__, tokens), np.int64, len(tokens))
        self.runs.append(run)
        self.held += len(run)


def hashes(words: list[bytes], lang: str) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.array([xxhash.xxh64_intdigest(w, seed) for w in words], np.uint64)


def chained(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase from that of its words but the last, and that of the last."""
    return mixed(before * np.uint64(3) + word)


def _places(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each hash: the word of a filter of size words, and the four bits there."""
    bits = np.zeros(len(keys), np.uint64)
    for i in range(4):
        bits |= np.uint64(1) << ((keys >> np.uint64(6 * i)) & np.uint64(63))
    return (mixed(keys) % np.uint64(size)).astype(np.int64), bits


def maybe(keys: np.ndarray, bloom: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each hash."""
    place, bits = _places(keys, len(bloom))
    return bloom[place] & bits == bits


def phrases(words: Words, lang: str, order: int, blooms: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct phrases of an order, as columns of numbers of words, and how often each occurs.

    blooms: of the phrases counted so far, by order; phrases with a part that is in none are left out.
    """
    run = np.concatenate(words.runs)
    if order == 1:
        counts = np.bincount(run, minlength=len(words.numbers))
        known = np.flatnonzero(counts)
        known = known[known > 0]
        return [known], counts[known]
    word = hashes(list(words.numbers), lang)
    good = maybe(word, blooms[0])
    good[0] = False
    # of the phrases of n words that are still taken up: where they begin, and the number of each
    start = np.flatnonzero(good[run])
    number, key = run[start], word
    for n in range(2, order + 1):
        both = np.flatnonzero(np.diff(start) == 1)  # the next one begins one word later: all but one word are shared
        code = number[both] * np.int64(len(words.numbers)) + run[start[both] + n - 1]
        start = start[both]
        if n == order:
            _, first, counts = np.unique(code, return_index=True, return_counts=True)
            return [run[start[first] + i] for i in range(n)], counts
        _, first, number = np.unique(code, return_index=True, return_inverse=True)
        key = word[run[start[first]]]
        for i in range(1, n):
            key = chained(key, word[run[start[first] + i]])
        passed = maybe(key, blooms[n - 1])[number]
        start, number = start[passed], number[passed]
    raise ValueError("order must be at least 1")


COUNTS = "lang string, phrase string, n bigint"


def _counts(docs: DataFrame, order: int, blooms: list[np.ndarray]) -> DataFrame:
    """lang, phrase and n of the phrases of an order that blooms leave; order 1: and, with a null phrase, of all words."""
    given = docs.sparkSession.sparkContext.broadcast(blooms)

    def flushed(held: dict[str, Words]) -> Iterator[pa.RecordBatch]:
        for lang, words in held.items():
            columns, counts = phrases(words, lang, order, given.value)
            names = pa.array(list(words.numbers), pa.binary())
            for at in range(0, len(counts), 20_000):
                n = pa.array(counts[at : at + 20_000], pa.int64())
                each = [names.take(pa.array(c[at : at + 20_000])) for c in columns]
                text = pc.binary_join_element_wise(*each, b" ") if order > 1 else each[0]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), text.cast(pa.string()), n], names=["lang", "phrase", "n"])
            if order == 1:
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([None], pa.string()), pa.array([int(counts.sum())], pa.int64())], names=["lang", "phrase", "n"])
        held.clear()
        released()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Words] = {}
        for batch in pieces(batches, 1):
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                held.setdefault(lang, Words()).add(texts)
            if sum(w.held for w in held.values()) >= SPAN:
                yield from flushed(held)
        yield from flushed(held)

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(tidy(run), COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def bloom_of(counts: DataFrame) -> np.ndarray:
    """A filter of the phrases of counts: bits by words of it, or'ed in Spark."""
    size = min(MOST_WORDS, max(1, -(-counts.count() * BITS // 64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                first, *rest = hashes(phrase.encode().split(b" "), lang)
                key = np.array([first])
                for word in rest:
                    key = chained(key, word)
                keys.append(key[0])
            place, bits = _places(np.array(keys, np.uint64), size)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(bits.view(np.int64))], names=["place", "bits"])

    found = counts.select("lang", "phrase").mapInArrow(run, "place bigint, bits bigint").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    bloom = np.zeros(size, np.uint64)
    bloom[found["place"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return bloom


def counted(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """lang, words (an array) and n of all phrases up to longest that occur least times; lang and n of all words."""
    small_batches(docs.sparkSession)
    every, blooms, totals = None, [], None
    for order in range(1, longest + 1):
        found = staged(_counts(docs, order, blooms).where((F.col("n") >= least) | F.col("phrase").isNull()), f"phrases{order}")
        if totals is None:
            totals = found.where("phrase is null").select("lang", "n")
        known = found.where("phrase is not null")
        every = known if every is None else every.union(known)
        if order < longest:
            blooms.append(bloom_of(known))
    return every.select("lang", F.split("phrase", " ").alias("words"), "n"), totals


def lockstep(rows: list[tuple], carried: dict[tuple, int]) -> tuple[list[list[int]], list[int], dict[tuple, int]]:
    """For sorted rows (key, n), keys being tuples: the counts of the key's proper beginnings of two items or more, and
    the greatest count of a key that is one item longer; likewise for carried keys, which an earlier range holds."""
    stack: list[tuple[tuple, int, int | None]] = [(k, n, None) for k, n in sorted(carried.items())]
    before, longer, handed = [], [0] * len(rows), {}
    for i, (key, n) in enumerate(rows):
        while stack and stack[-1][0] != key[: len(stack[-1][0])]:
            stack.pop()
        before.append([c for _, c, _ in stack])
        if stack:
            above, _, at = stack[-1]
            if at is None:
                handed[above] = max(handed.get(above, 0), n)
            else:
                longer[at] = max(longer[at], n)
        stack.append((key, n, i))
    return before, longer, handed


def passed(stream: DataFrame, backwards: bool, carry: list[str]) -> DataFrame:
    """stream (lang, words, n and the columns carry) with parts and longer: the counts of each phrase's first parts, or last
    ones, shorter first, and the greatest count of a phrase that has one word more at the other end."""
    spark = stream.sparkSession
    key = F.reverse("words") if backwards else F.col("words")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-stream.count() // RANGE))
    dealt = staged(stream.withColumn("key", F.concat(F.array("lang"), key)).repartitionByRange(ranges, "key").withColumn("part", F.spark_partition_id()), "ordered")
    firsts = [(r["part"], tuple(r["key"])) for r in dealt.groupBy("part").agg(F.min("key").alias("key")).collect()]  # one for each range
    wanted = sorted({k[:i] for _, k in firsts for i in range(2, len(k))})
    known: dict[tuple, int] = {}
    if wanted:
        asked = F.broadcast(spark.createDataFrame([(list(k),) for k in wanted], "key array<string>"))
        known = {tuple(r["key"]): r["n"] for r in dealt.join(asked, "key").select("key", "n").collect()}
    start = {part: {k[:i]: known[k[:i]] for i in range(2, len(k)) if k[:i] in known} for part, k in firsts}
    columns = ["key", "n", *carry]
    out = "key array<string>, n bigint, parts array<bigint>, longer bigint, handed boolean" + "".join(f", {c} {stream.schema[c].dataType.simpleString()}" for c in carry)

    def run(t: pa.Table) -> pa.Table:
        part = t["part"][0].as_py()
        keys = [tuple(k) for k in t["key"].to_pylist()]
        order = sorted(range(len(keys)), key=keys.__getitem__)
        n = t["n"].to_pylist()
        before, longer, handed = lockstep([(keys[i], n[i]) for i in order], start[part])
        own = t.select(columns).take(pa.array(order, pa.int64()))
        own = own.append_column("parts", pa.array(before, pa.list_(pa.int64()))).append_column("longer", pa.array(longer, pa.int64()))
        own = own.append_column("handed", pa.array([False] * len(order)))
        back = pa.Table.from_pylist([{"key": list(k), "longer": m, "handed": True} for k, m in handed.items()], schema=own.schema)
        names = [f.split()[0] for f in out.split(", ")]
        return pa.concat_tables([own, back]).select(names)

    found = staged(dealt.select("part", *columns).groupBy("part").applyInArrow(run, out), "passed")
    dropped(dealt)
    # at most three rows of each range
    handed = F.broadcast(found.where("handed").groupBy("key").agg(F.max("longer").alias("more")))
    words = F.slice("key", 2, F.size("key") - 1)
    return found.where("not handed").join(handed, "key", "left").select(
        F.element_at("key", 1).alias("lang"), (F.reverse(words) if backwards else words).alias("words"), "n", "parts", F.greatest("longer", F.coalesce("more", F.lit(0))).alias("longer"), *carry
    )


def collocations(counts: DataFrame, covered: int = COVERED) -> DataFrame:
    """lang, phrase, a, l, r and score of the candidates that no longer phrase covers. counts: lang, words and n, with every part of a phrase."""
    first = passed(counts, False, []).withColumnsRenamed({"parts": "lefts", "longer": "right_longer"})
    both = passed(first, True, ["lefts", "right_longer"])
    wide = lambda c: c.cast("decimal(20,0)")
    words = F.size("words")
    cuts = F.transform(
        F.sequence(F.lit(1), words - 1),
        lambda k: F.struct(
            F.call_function("div", F.lit(SCALE).cast("decimal(8,0)") * wide(F.col("n")), wide(F.element_at("lefts", k)) + wide(F.element_at("parts", words - k))).alias("score"),
            k.alias("k"), F.element_at("lefts", k).alias("l"), F.element_at("parts", words - k).alias("r"),
        ),
    )
    longer = wide(F.greatest("longer", "right_longer"))
    left = both.where((words > 1) & (longer * 100 < wide(F.col("n")) * covered)).withColumn("best", F.array_min(cuts))
    return left.select("lang", F.array_join("words", " ").alias("phrase"), F.col("n").alias("a"), "best.l", "best.r", F.col("best.score").cast("bigint").alias("score"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of each lang."""
    counts, totals = counted(table(spark, sf_dir, "documents").select("lang", "text"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = collocations(counts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle_sql() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({lower}, '[.,;:!?\\n\\v\\f\\r]')) AS piece FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM t),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
f AS (
  SELECT lang, w[i : i + k - 1] AS w, k, count(*) AS f FROM places, (VALUES (1), (2), (3), (4)) AS o(k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= {LEAST}),
cuts AS (
  SELECT c.lang, c.w, c.k, c.f AS a, x.f AS l, y.f AS r, j, {SCALE} * CAST(c.f AS HUGEINT) // (x.f + y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM f WHERE k > 1) AS c
  JOIN f AS x ON x.lang = c.lang AND x.w = c.w[1 : j] JOIN f AS y ON y.lang = c.lang AND y.w = c.w[j + 1 : c.k]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, j) = 1),
parts AS (
  SELECT DISTINCT lang, w[s : s + m - 1] AS part, f
  FROM (SELECT lang, w, k, f, m, unnest(range(1, k - m + 2)) AS s FROM f, (VALUES (2), (3)) AS o(m) WHERE m < k)),
kept AS (SELECT * FROM best WHERE NOT EXISTS (SELECT 1 FROM parts WHERE parts.lang = best.lang AND part = best.w AND 100 * parts.f >= {COVERED} * best.a)),
named AS (SELECT *, array_to_string(w, ' ') AS phrase FROM kept),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM named)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}
"""
