"""Language-model scores by stupid backoff (Brants et al. 2007), relationally and in blocks.

The relations are those of the plain plan: a count table of n-grams partitioned by hash, joined to the
documents' n-grams, summed per document. A row for every n-gram of every document would move the text
many times over, so rows are packed: documents are read in blocks of ``BLOCK_WORDS`` words, and

1. a block sends each hash partition the sorted distinct hashes of its n-grams there and how often it
   has them (one message for each block, order and partition where it has any);
2. a partition adds up the counts of each hash over all blocks and sends each block its totals back,
   in the order of the block's own message, so that hashes travel once, and a sum of those hashes, by
   which the block knows that they are the ones it has;
3. the block's words, as numbers into the block's list of words, meet the totals, and every document's
   words are scored and summed.

The number of partitions grows with the text, so each holds about as much whatever the input. An
n-gram that all documents share is one number in each block's message. Every word of every document
counts; nothing is collected on the driver.

Score of a word: the count of the longest n-gram ending there that occurs ``LEAST`` times at least,
over the count of its words but the last, times 0.4 for each word of history given up; a single word:
its count over all words. ``score`` is the sum of the logarithms, ``mean`` that sum per word.

Defined results: words are what stands between white space, A-Z lower-cased; a document without words
(null, empty, blank) has n_words 0, score 0.0 and a null mean; repeated rows count and are scored
each; columns besides doc_id and text are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import WORD, pieces, small_batches, table, tidy
from orrery.llm.shingles import mixed, word_hashes

ORDER, LEAST, BACKOFF = 3, 2, 0.4
BLOCK_WORDS = 1_500_000
#: Characters of text for each hash partition.
PARTITION_CHARS = 12_000_000
TOTALS = "block bigint, order int, bucket int, totals binary, check bigint"
MESSAGE = "block bigint, order int, bucket int, hashes binary, counts binary"
STREAM = "block bigint, doc_ids binary, known binary, lengths binary, words binary, hashes binary"


def _squeezed(data: bytes) -> bytes:
    """Entropy-coded, behind its length: most bytes of differences and counts are alike, which block compression misses."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True) if data else b""


def _spread(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint8)
    return np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd"), np.uint8)


def packed(x: np.ndarray) -> bytes:
    """Rising numbers, as differences, their first bytes first: the high bytes are mostly zeros then."""
    return _squeezed(np.diff(x, prepend=x.dtype.type(0)).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())


def unpacked(data: bytes, kind: type = np.uint64) -> np.ndarray:
    size, flat = np.dtype(kind).itemsize, _spread(data)
    return np.cumsum(np.ascontiguousarray(flat.reshape(size, len(flat) // size).T).view(kind).ravel(), dtype=kind)


def planes(x: np.ndarray) -> bytes:
    """Numbers under 2^64, their bytes in eight planes; those that are all zero take next to nothing."""
    return _squeezed(x.astype("<u8").view(np.uint8).reshape(len(x), 8).T.tobytes())


def unplaned(data: bytes) -> np.ndarray:
    flat = _spread(data)
    return np.ascontiguousarray(flat.reshape(8, len(flat) // 8).T).view("<i8").ravel()


def ngrams(words: np.ndarray, lengths: np.ndarray, order: int) -> list[np.ndarray]:
    """For each order up to order, a hash for the n-gram that ends at each word; those that a document's start cuts short are 0."""
    if not len(words):
        return [words] * order
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(len(words)) - np.repeat(starts, lengths)
    out = [words]
    for n in range(2, order + 1):
        longer = np.zeros_like(words)
        longer[1:] = mixed(out[-1][:-1] * np.uint64(3) + words[1:])
        longer[place < n - 1] = 0
        out.append(longer)
    return out


def _blocks(batches: Iterator[pa.RecordBatch], words_each: int) -> Iterator[tuple[int, list, np.ndarray, np.ndarray]]:
    """Number, doc_ids, lengths and word hashes of each block; the same each time the partition is read."""
    part, seq = TaskContext.get().partitionId(), 0
    ids: list = []
    lengths: list[np.ndarray] = []
    words: list[np.ndarray] = []
    held = 0
    for batch in pieces(batches, 1):
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
        hashes, owner = word_hashes(texts)
        ids += batch.column(0).to_pylist()
        lengths.append(np.bincount(owner, minlength=len(texts)))
        words.append(hashes)
        held += len(hashes)
        if held >= words_each:
            yield part << 32 | seq, ids, np.concatenate(lengths), np.concatenate(words)
            ids, lengths, words, held, seq = [], [], [], 0, seq + 1
    if ids:
        yield part << 32 | seq, ids, np.concatenate(lengths), np.concatenate(words)


def _cut(distinct: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's part of sorted hashes begins; buckets are ranges of the hash."""
    step = (1 << 64) // buckets
    return np.append(np.searchsorted(distinct, np.array([i * step for i in range(buckets)], np.uint64)), len(distinct))


def checksum(hashes: np.ndarray) -> int:
    return int(mixed(hashes).sum(dtype=np.uint64).astype(np.int64))


def _sums(data: pa.Table) -> pa.Table:
    """Totals of a bucket's hashes of one order, for each block's message."""
    rows = data.to_pylist()
    sets = [unpacked(r["hashes"]) for r in rows]
    counts = np.concatenate([unplaned(r["counts"]) for r in rows]).astype(np.int64)
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])[: len(ranked)]
    totals = np.zeros(len(every), np.int64)
    if len(every):
        totals[order] = np.add.reduceat(counts[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    ends = np.cumsum([len(s) for s in sets])
    return pa.Table.from_pylist(
        [{"block": r["block"], "order": r["order"], "bucket": r["bucket"], "totals": planes(totals[e - len(s) : e]), "check": checksum(s)} for r, s, e in zip(rows, sets, ends, strict=True)],
        schema=pa.schema([("block", pa.int64()), ("order", pa.int32()), ("bucket", pa.int32()), ("totals", pa.binary()), ("check", pa.int64())]),
    )


def backoff(totals: list[np.ndarray], all_words: int) -> np.ndarray:
    """The logarithm of every word's score. totals: for each order, the count of the n-gram ending at each word, 0 where there is none."""
    before = lambda c: np.concatenate([[0], c[:-1]])
    score = np.log(totals[0] / all_words) + (len(totals) - 1) * np.log(BACKOFF)
    for n in range(2, len(totals) + 1):
        history = before(totals[n - 2])
        seen = totals[n - 1] >= LEAST
        better = np.log(np.maximum(totals[n - 1], 1)) - np.log(np.maximum(history, 1)) + (len(totals) - n) * np.log(BACKOFF)
        score = np.where(seen, better, score)
    return score


def scored(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, n_words, score and mean of every row.

    docs are read twice and must come in the same order both times: a table, not the outcome of a shuffle.
    A block that comes otherwise raises an error.
    """
    small_batches(docs.sparkSession)
    docs = docs.selectExpr("cast(doc_id as bigint) as doc_id", "text")
    size = docs.agg(F.sum(F.length("text")).alias("chars"), F.sum(F.regexp_count("text", F.lit(WORD))).alias("words")).first()
    buckets, words_each, all_words = max(1, -(-(size["chars"] or 0) // PARTITION_CHARS)), BLOCK_WORDS, size["words"] or 0

    def messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, lengths, words in _blocks(batches, words_each):
            for n, hashes in enumerate(ngrams(words, lengths, order), 1):
                distinct, counts = np.unique(hashes[hashes != 0], return_counts=True)
                cut = _cut(distinct, buckets)
                parts = [(b, slice(cut[b], cut[b + 1])) for b in range(buckets) if cut[b] < cut[b + 1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block] * len(parts), pa.int64()),
                        pa.array([n] * len(parts), pa.int32()),
                        pa.array([b for b, _ in parts], pa.int32()),
                        pa.array([packed(distinct[s]) for _, s in parts], pa.binary()),
                        pa.array([planes(counts[s]) for _, s in parts], pa.binary()),
                    ],
                    names=["block", "order", "bucket", "hashes", "counts"],
                )

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, lengths, words in _blocks(batches, words_each):
            distinct, numbers = np.unique(words, return_inverse=True)
            known = np.array([i is not None for i in ids])
            row = [block, np.array([i or 0 for i in ids], "<i8").tobytes(), known.tobytes(), planes(lengths), planes(numbers), packed(distinct)]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["block", "doc_ids", "known", "lengths", "words", "hashes"])

    def score(stream: pa.Table, replies: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        parts: list[dict[int, tuple[np.ndarray, int]]] = [{} for _ in range(order)]
        for r in replies.to_pylist():
            parts[r["order"] - 1][r["bucket"]] = (unplaned(r["totals"]), r["check"])
        for s in stream.to_pylist():
            lengths, hashes = unplaned(s["lengths"]), unpacked(s["hashes"])
            words = hashes[unplaned(s["words"])]
            totals = []
            for n, grams in enumerate(ngrams(words, lengths, order)):
                distinct, numbers = np.unique(grams, return_inverse=True)
                mine = [parts[n][b] for b in sorted(parts[n])]
                none = int(len(distinct) > 0 and distinct[0] == 0)
                found = np.concatenate([np.zeros(none, np.int64), *[t for t, _ in mine]])
                ends = none + np.cumsum([len(t) for t, _ in mine], dtype=np.int64)
                same = all(checksum(distinct[e - len(t) : e]) == check for e, (t, check) in zip(ends, mine, strict=True))
                if len(found) != len(distinct) or not same:
                    raise RuntimeError("a block was read otherwise than before")
                totals.append(found[numbers] if len(words) else np.zeros(0, np.int64))
            logs = backoff(totals, all_words) if len(words) else np.zeros(0)
            sums = np.bincount(np.repeat(np.arange(len(lengths)), lengths), logs, len(lengths))
            known = np.frombuffer(s["known"], bool)
            ids = np.frombuffer(s["doc_ids"], "<i8")
            out[0] += [int(i) if k else None for i, k in zip(ids, known, strict=True)]
            out[1] += lengths.tolist()
            out[2] += sums.tolist()
        return pa.Table.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["doc_id", "n_words", "score"])

    sums = docs.mapInArrow(tidy(messages), MESSAGE).groupBy("bucket", "order").applyInArrow(_sums, TOTALS)
    result = docs.mapInArrow(tidy(streams), STREAM).groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(score, "doc_id bigint, n_words bigint, score double")
    return result.withColumn("mean", F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words")))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under a trigram model of all documents; scores to three decimals."""
    found = scored(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", F.round("score", 3).alias("score"), F.round("mean", 3).alias("mean"))


def oracle_sql() -> str:
    """Trigrams, as the query has them."""
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w
  FROM documents),
p AS (
  SELECT rid, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS a
  FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
c1 AS (SELECT c AS x, count(*) AS n FROM p GROUP BY c),
c2 AS (SELECT b AS x, c AS y, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY b, c),
c3 AS (SELECT a AS x, b AS y, c AS z, count(*) AS n FROM p WHERE a IS NOT NULL GROUP BY a, b, c),
s AS (
  SELECT rid, CASE
    WHEN t.n >= {LEAST} THEN ln(t.n) - ln(h.n)
    WHEN g.n >= {LEAST} THEN ln(g.n) - ln(o.n) + ln({BACKOFF}::DOUBLE)
    ELSE ln(u.n / (SELECT count(*) FROM p)::DOUBLE) + 2 * ln({BACKOFF}::DOUBLE) END AS v
  FROM p JOIN c1 AS u ON u.x = p.c LEFT JOIN c1 AS o ON o.x = p.b
  LEFT JOIN c2 AS g ON g.x = p.b AND g.y = p.c LEFT JOIN c2 AS h ON h.x = p.a AND h.y = p.b
  LEFT JOIN c3 AS t ON t.x = p.a AND t.y = p.b AND t.z = p.c),
sums AS (SELECT rid, sum(v) AS score, count(*) AS n FROM s GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, round(coalesce(score, 0.0), 3) AS score, round(score / n, 3) AS mean
FROM d LEFT JOIN sums USING (rid)
"""
