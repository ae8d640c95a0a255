"""Packing documents into sequences of tokens by a grouping genetic algorithm (Falkenauer 1996).

1. ``cut``: texts become ids; what is longer than a sequence is cut into whole sequences, behind a first
   piece that may be shorter. A row for each piece, numbered among the pieces of its length that its
   partition has; the table is written once, so the numbers hold whatever is lost later.
2. Pieces of one length are interchangeable. The problem is how many there are of each length: as many
   numbers as a sequence has tokens, whatever the input. Likewise a bin is a pattern of lengths with a
   number of copies, and a packing a few thousand patterns.
3. ``evolved``: islands, a task each, breed packings. A crossover injects whole well-filled bins of one
   parent, removes the other's bins that hold the same pieces, and places what is displaced by best fit;
   a mutation empties some of the worst-filled bins and does the same. After each epoch, which is
   written to the shared folder, an island's elite goes to the next one. The first individuals are
   best fits in random orders, and one best fit in falling order.
4. ``placed``: pieces of a length are numbered through by the counts of the partitions before, and the
   numbers are dealt over the copies of the patterns of the best packing. Pieces do not move.

Defined results: a null or empty text is one piece, the closing id alone; repeated rows are packed
each; a null doc_id stays null; columns besides doc_id and text are not read; special tokens' strings
are ordinary text; an empty table gives no rows. Outcomes depend on the lengths and the seed alone.
"""

from __future__ import annotations

import json
import os
import random
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm.common import Memo, dropped, pieces, small_batches, staged, table, tidy

CAPACITY, END = 1024, 2
ISLANDS, POPULATION, GENERATIONS, EPOCHS, SEED = 6, 6, 6, 3, 11
#: Counts of pieces for each partition and length that are broadcast; beyond, they are joined by hash.
BROADCAST_COUNTS = 1_000_000
#: A space run or other white space before a word: there the pattern's matches do not start at each single space.
RUN = re.compile(r"\s[^\S ]|[^\S ]\s|  ")

FAR = re.compile("[^\x00-\u024f]")
#: The pattern of byte-level models, and the characters that stand for bytes in their vocabularies.
MATCHES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: b for b in SHOWN} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in SHOWN)}
#: Bytes of chunks that a worker remembers, over all its partitions.
MEMO_BYTES = 80 << 20

Packing = dict[tuple[int, ...], int]


class Chunks(Memo):
    """Ids of what follows a space, up to the next one, worked out once while there is room."""

    def __init__(self, limit: int, work: Callable[[str], bytes]):
        super().__init__(limit)
        self.work = work

    def __missing__(self, chunk: str) -> bytes:
        found = self.work(" " + chunk)
        if self.held < self.limit:
            self.held += len(chunk) + len(found) + 180  # and what the objects take
            self[chunk] = found
        return found


class Encoder:
    """A tokenizer of the tokenizers library, faster where it is a plain byte-level BPE model.

    Where its merges come in the order of their ids, the ids of a chunk between single spaces are those that ranks
    give, and the tiktoken library, which takes ranks, gives them in a third of the time; chunks are remembered.
    Characters from U+0250 on, whose classes may differ between libraries, and runs of white space go to the
    tokenizer itself, as does every text of another kind of model.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), Chunks(MEMO_BYTES, self.chunk)
        self.tokenizer.encode_special_tokens = True
        told = json.loads(self.tokenizer.to_str())
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        before, model = told["pre_tokenizer"] or {}, told["model"]
        self.plain = told["normalizer"] is None and {k: before.get(k) for k in plain} == plain and model["type"] == "BPE" and not model["dropout"]
        merged = [model["vocab"].get(a + b) for a, b in model["merges"]] if self.plain else [None]
        self.plain = self.plain and merged == list(range(256, 256 + len(merged)))
        if self.plain:
            import tiktoken

            byte = {chr(c): b for b, c in BYTES.items()}
            special = {t["content"] for t in told["added_tokens"]}
            ranks = {bytes(map(byte.__getitem__, t)): i for t, i in model["vocab"].items() if t not in special}
            self.ordinary = tiktoken.Encoding("ranks", pat_str=MATCHES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def chunk(self, text: str) -> bytes:
        if FAR.search(text):
            return self.whole(text)
        ids = self.ordinary(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.plain or RUN.search(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        return self.chunk(first) + b"".join(map(self.known.__getitem__, rest))


@cache
def encoder(path: str) -> Encoder:
    """One for each worker and vocabulary."""
    return Encoder(path)


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, number bigint"


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """A row for each piece of every document, numbered by part and length."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, e = TaskContext.get().partitionId(), {}, encoder(path)
        for batch in pieces(batches, 1):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = e.encode(text.as_py() or "") + end.to_bytes(4, "little")
                n = len(ids) // 4
                stops = range((n - 1) % capacity + 1, n + 1, capacity)
                for k, stop in enumerate(stops):
                    start = stops[k - 1] if k else 0
                    number = seen[stop - start] = seen.get(stop - start, -1) + 1
                    rows.append((doc, k, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop]), part, number))
            names = [f.split()[0] for f in PIECES.split(", ")]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(tidy(run), PIECES)


class Open:
    """Bins by what is left in them."""

    def __init__(self, capacity: int, packing: Packing | None = None):
        self.capacity, self.left, self.mask = capacity, {}, 0
        for pattern, copies in (packing or {}).items():
            self.add(pattern, copies, capacity - sum(pattern))

    def add(self, pattern: tuple[int, ...], copies: int, left: int) -> None:
        bins = self.left.setdefault(left, {})
        bins[pattern] = bins.get(pattern, 0) + copies
        self.mask |= 1 << left

    def fit(self, size: int, count: int) -> None:
        """Place count pieces of a size, each where the least is left behind it."""
        while count:
            above = self.mask >> size
            if above:
                left = size + (above & -above).bit_length() - 1
                bins = self.left[left]
                pattern, copies = bins.popitem()
            else:
                left, bins, pattern, copies = self.capacity, {}, (), count
            each = min(left // size, count)
            used = min(copies, count // each)
            if copies > used and above:
                bins[pattern] = copies - used
            if above and not bins:
                self.mask ^= 1 << left
            self.add(tuple(sorted((*pattern, *[size] * each), reverse=True)), used, left - size * each)
            count -= used * each

    def packing(self) -> Packing:
        return {p: c for bins in self.left.values() for p, c in bins.items()}


def best_fit(capacity: int, items: list[tuple[int, int]], start: Packing | None = None) -> Packing:
    """start with items (size, count) placed in that order."""
    bins = Open(capacity, start)
    for size, count in items:
        bins.fit(size, count)
    return bins.packing()


def value(packing: Packing, capacity: int) -> tuple[int, float]:
    """What is to be least: the number of bins, then how evenly they are filled."""
    return sum(packing.values()), -sum(c * (sum(p) / capacity) ** 2 for p, c in packing.items())


def by_fill(packing: Packing) -> list[tuple[int, ...]]:
    return sorted(packing, key=lambda p: (-sum(p), p))


def without(packing: Packing, room: dict[int, int]) -> tuple[Packing, dict[int, int]]:
    """The bins of packing, best-filled first, whose pieces room still has, and the pieces that no bin took."""
    kept, room = {}, dict(room)
    for p in by_fill(packing):
        need = {s: p.count(s) for s in set(p)}
        copies = min(packing[p], *[room.get(s, 0) // k for s, k in need.items()])
        if copies:
            kept[p] = copies
            for s, k in need.items():
                room[s] -= copies * k
    return kept, {s: c for s, c in room.items() if c}


def crossed(one: Packing, other: Packing, counts: dict[int, int], capacity: int, rnd: random.Random) -> Packing:
    """A child of two packings: bins of other injected whole, those of one that hold none of their pieces, the rest by best fit."""
    ranked = by_fill(other)
    most = rnd.randint(1, max(1, len(ranked) // 2))
    chosen = [p for p in ranked[:most] if rnd.random() < 0.8] or ranked[:1]
    injected, room = without({p: rnd.randint(1, other[p]) for p in chosen}, counts)
    kept, displaced = without(one, room)
    for p, c in injected.items():
        kept[p] = kept.get(p, 0) + c
    return best_fit(capacity, sorted(displaced.items(), reverse=True), kept)


def mutated(packing: Packing, capacity: int, rnd: random.Random) -> Packing:
    """Some of the worst-filled bins emptied, their pieces placed by best fit in an order that is nearly falling."""
    ranked = by_fill(packing)
    gone = set(rnd.sample(ranked[len(ranked) // 2 :], max(1, len(ranked) // 20)))
    items: dict[int, int] = {}
    for p in sorted(gone):
        for s in p:
            items[s] = items.get(s, 0) + packing[p]
    order = sorted(items.items(), key=lambda x: -x[0] * rnd.uniform(0.8, 1.0))
    return best_fit(capacity, order, {p: c for p, c in packing.items() if p not in gone})


def founders(counts: dict[int, int], capacity: int, island: int, population: int, rnd: random.Random) -> list[Packing]:
    out = []
    for i in range(population):
        strength = 0.0 if island == i == 0 else rnd.random()
        out.append(best_fit(capacity, sorted(counts.items(), key=lambda x: -x[0] * rnd.uniform(1 - strength, 1.0))))
    return out


def bred(people: list[Packing], counts: dict[int, int], capacity: int, generations: int, population: int, rnd: random.Random) -> list[Packing]:
    """The fittest after some generations; a child takes the place of the worst that it beats, if no other is its like."""
    people = sorted(people, key=lambda p: value(p, capacity))[:population]
    for _ in range(generations * population):
        one, other = (min(rnd.sample(range(len(people)), min(2, len(people)))) for _ in "ab")
        child = crossed(people[one], people[other], counts, capacity, rnd)
        if rnd.random() < 0.3:
            child = mutated(child, capacity, rnd)
        if child not in people:
            people = sorted([*people, child], key=lambda p: value(p, capacity))[:population]
    return people


PEOPLE = "island int, rank int, bins bigint, evenness double, patterns array<array<int>>, copies array<bigint>"


def _rows(island: int, people: list[Packing], capacity: int) -> pa.Table:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.list_(pa.int32())), pa.list_(pa.int64())]
    rows = [(island, i, *value(p, capacity), [list(k) for k in p], list(p.values())) for i, p in enumerate(people)]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in PEOPLE.split(", ")])


def evolved(spark: SparkSession, counts: dict[int, int], capacity: int, islands: int = ISLANDS, population: int = POPULATION, generations: int = GENERATIONS, epochs: int = EPOCHS, seed: int = SEED) -> Packing:
    """The best packing that the islands find. counts: of each size. Epochs end when the bins reach the sum of sizes."""
    least = -(-sum(s * c for s, c in counts.items()) // capacity)

    def breeding(epoch: int) -> Callable[[pa.Table], pa.Table]:
        def work(rows: pa.Table) -> pa.Table:
            told = rows.to_pylist()
            island = told[0]["island"]
            rnd = random.Random(f"{seed} {epoch} {island}")
            if epoch:
                people = [dict(zip(map(tuple, r["patterns"]), r["copies"], strict=True)) for r in sorted(told, key=lambda r: (r["came"], r["rank"]))]
            else:
                people = founders(counts, capacity, island, population, rnd)
            return _rows(island, bred(people, counts, capacity, generations, population, rnd), capacity)

        return work

    old = None
    for epoch in range(epochs):
        if old is None:
            rows = spark.range(islands).select(F.col("id").cast("int").alias("island"))
        else:  # elites migrate to the next island
            elite = old.where("rank = 0").withColumns({"island": F.pmod(F.col("island") + 1, F.lit(islands)), "came": F.lit(1)})
            rows = old.withColumn("came", F.lit(0)).unionByName(elite)
        now = staged(rows.groupBy("island").applyInArrow(breeding(epoch), PEOPLE), "islands")
        if old is not None:
            dropped(old)
        old = now
        best = old.orderBy("bins", "evenness", "island", "rank").limit(1).first()
        if best["bins"] == least:
            break
    dropped(old)
    return dict(zip(map(tuple, best["patterns"]), best["copies"], strict=True))


def slots(packing: Packing) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each size: the numbers at which its ranges begin, and each range's first bin and place in the bin."""
    taken: dict[int, int] = {}
    out: dict[int, list[tuple[int, int, int]]] = {}
    first = 0
    for pattern in by_fill(packing):
        offset = 0
        for size in pattern:
            out.setdefault(size, []).append((taken.get(size, 0), first, offset))
            taken[size] = taken.get(size, 0) + packing[pattern]
            offset += size
        first += packing[pattern]
    return {s: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for s, rows in out.items()}


def placed(cut_rows: DataFrame, packing: Packing) -> DataFrame:
    """cut_rows, a written table, with sequence_id and offset in place of part and number."""
    per = staged(cut_rows.groupBy("part", "length").agg(F.count(F.lit(1)).alias("rows")), "counts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("part", "length", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    if per.count() <= BROADCAST_COUNTS:
        offsets = F.broadcast(offsets)
    given = cut_rows.sparkSession.sparkContext.broadcast(slots(packing))
    out = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            bins, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for size in np.unique(length):
                here = np.flatnonzero(length == size)
                begin, first, at = given.value[int(size)]
                which = np.searchsorted(begin, number[here], "right") - 1
                bins[here], offset[here] = first[which] + number[here] - begin[which], at[which]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(bins), pa.array(offset)], names=[*out, "sequence_id", "offset"])

    numbered = cut_rows.join(offsets, ["part", "length"]).select(*out, (F.col("before") + F.col("number")).alias("number"))
    return numbered.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of docs."""
    rows = staged(cut(docs, path, capacity, end), "pieces")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    return placed(rows, evolved(docs.sparkSession, counts, capacity) if counts else {})


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens."""
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
