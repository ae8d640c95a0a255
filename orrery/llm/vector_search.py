"""Exact top-k search by vector-approximation files (Weber, Schek and Blott 1998).

Components become whole numbers, floor(1024 * x). Vectors are dealt once, into shards of bounded size;
the queries pass each shard's vectors as a stream, sorted behind them in one partition, so a task holds
one shard and one batch of queries, however many there are. Of a shard, every component is quantised to
one of ``CELLS`` cells, a byte, with bounds of its own. The scan reads cells alone: the inner product with
the cells' centres is off by at most the query's reach, the sum of |q| times half a cell's width, so it
bounds the score from both sides. Exact vectors are then read in the order of their upper bounds, a batch
at a time, until no bound left reaches the kth exact score. The k best of each shard are merged by query.

A vector moves once; a query moves once for each shard, of which there is one for ``SHARD_BYTES`` of
vectors. Equal rows (id and vector) are one row with a number of copies from the start.

Defined results: a vector that is null, or holds a null or a component that is not finite, takes no
part, as query or as candidate; a shorter vector is filled up with zeros; an empty one scores 0; a row
without an id is a candidate, named by null, behind equal scores with one (in the query it asks nothing, as
no number divides it; an id of 2^63 - 1 cannot be told from none); other columns are not read; of repeated rows each asks and each is a candidate of the others, whether only the id or
the whole row repeats; fewer than k candidates are returned all; an empty table gives no rows. Scores are
exact in whole numbers of any size; one beyond a long is given as the nearest long, and those are told
apart by their first 53 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm.common import small_batches, table, tidy

SCALE, TOP, EVERY = 1024, 10, 100
CELLS = 256
#: Bytes of a shard's vectors, on average.
SHARD_BYTES = 32 << 20
#: Exact vectors read at once, in the order of their bounds; queries whose bounds are worked out at once.
STEP, TOGETHER = 64, 64
LONG = (-(1 << 63), (1 << 63) - 1)
OUT = "query_id bigint, query bigint, asked bigint, vec_id bigint, high double, score bigint"


def usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return vector.isNotNull() & F.forall(vector, finite)


def whole(x: np.ndarray) -> np.ndarray:
    """floor(1024 * x), exact in doubles; what they cannot hold is their greatest."""
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(x * SCALE))


def dense(vectors: pa.ListArray) -> np.ndarray:
    """A row for each vector, short ones filled up with zeros."""
    lengths, values = np.asarray(vectors.value_lengths()), np.asarray(vectors.flatten(), float)
    width = int(lengths.max(initial=0))
    if (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = values
    return out


def fitted(rows: np.ndarray, width: int) -> np.ndarray:
    """rows, cut or filled up to a width."""
    out = np.zeros((len(rows), width))
    out[:, : min(width, rows.shape[1])] = rows[:, :width]
    return out


class Cells:
    """The approximation file of a shard. vectors: whole numbers as doubles; copies: how many rows each stands for."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, copies: np.ndarray, keys: np.ndarray):
        self.ids, self.vectors, self.copies, self.keys = ids, vectors, copies, keys
        self.low, high = vectors.min(0), vectors.max(0)
        with np.errstate(over="ignore", invalid="ignore"):
            self.width = np.maximum((high - self.low) / CELLS, 1e-9)
            self.cells = np.nan_to_num(np.clip((vectors - self.low) / self.width, 0, CELLS - 1)).astype(np.uint8)
        self.most = np.abs(vectors).max(0)

    def scores(self, rows: np.ndarray, query: np.ndarray) -> list[int]:
        """Exact inner products."""
        with np.errstate(over="ignore"):
            bound = float(np.abs(query) @ self.most)
        if bound < 1 << 53:  # every partial sum is a whole number that a double holds
            return (self.vectors[rows] @ query).astype(np.int64).tolist()
        q = [int(x) for x in query]
        return [sum(a * int(b) for a, b in zip(q, v, strict=True) if a) for v in self.vectors[rows].tolist()]

    def nearest(self, queries: np.ndarray, keys: np.ndarray, k: int) -> Iterator[tuple[int, list[int], list[int]]]:
        """For each query: its number, and ids and scores of the k best rows but its own."""
        queries = fitted(queries, self.vectors.shape[1])
        with np.errstate(over="ignore", invalid="ignore"):
            # distance of a component from its cell's centre: half a cell, and what rounding may add
            reach = np.abs(queries) @ (self.width * (0.5 + 1e-6)) + 1e-12 * (np.abs(queries) @ self.most) + 1.0
            upper = (self.cells + 0.5) @ (queries * self.width).T + queries @ self.low + reach
        upper[np.isnan(upper)] = np.inf
        for i, query in enumerate(queries):
            mine = self.copies - (self.keys == keys[i])
            some = np.flatnonzero(mine > 0)
            if len(some) > k:  # what cannot reach the kth least score need not be ordered
                least = upper[some, i] - 2 * reach[i]
                least[np.isnan(least)] = -np.inf
                some = some[upper[some, i] >= np.partition(least, -k)[-k]]
            order = some[np.argsort(-upper[some, i], kind="stable")]
            best: list[tuple[int, int]] = []
            for at in range(0, len(order), STEP):
                if len(best) == k and upper[order[at], i] < -best[-1][0]:
                    break
                more = order[at : at + STEP]
                each = zip(self.scores(more, query), self.ids[more].tolist(), mine[more].tolist(), strict=True)
                best = sorted(best + [(-s, v) for s, v, n in each for _ in range(min(n, k))])[:k]
            yield i, [v for _, v in best], [-s for s, _ in best]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """query_id, rank, vec_id and score, for each row of queries. vectors and queries: vec_id and vector; queries are rows of vectors."""
    small_batches(vectors.sparkSession)
    once = lambda df: df.select("vec_id", F.col("vector").cast("array<double>").alias("vector")).groupBy("vec_id", "vector").agg(F.count(F.lit(1)).alias("copies"))
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width")).first()
    shards = max(1, -(-size["n"] * 8 * max(1, size["width"] or 0) // SHARD_BYTES))
    key, name = F.xxhash64("vec_id", "vector").alias("key"), F.coalesce("vec_id", F.lit(LONG[1])).alias("vec_id")
    held = once(vectors).select(F.pmod(key, F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("asks"), name, key, "vector", "copies")
    asked = once(queries).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("asks"), name, key, "vector", "copies")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, cells = None, [], None
        for batch in batches:
            which, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(which) != 0) | (np.diff(asks) != 0)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(which)], strict=True):
                ids, keys, copies = (batch.column(c).slice(start, end - start).to_numpy() for c in (2, 3, 5))
                rows = whole(dense(batch.column(4).slice(start, end - start)))
                if which[start] != shard:
                    shard, parts, cells = which[start], [], None
                if not asks[start]:
                    parts.append((ids, rows, copies, keys))
                    continue
                if parts:
                    width = max(p[1].shape[1] for p in parts)
                    cells = Cells(np.concatenate([p[0] for p in parts]), np.concatenate([fitted(p[1], width) for p in parts]), *[np.concatenate([p[j] for p in parts]) for j in (2, 3)])
                    parts = []
                for at in range(0, len(ids) if cells else 0, TOGETHER):
                    now = slice(at, at + TOGETHER)
                    found = [(ids[at + i], keys[at + i], copies[at + i], v, float(s) if abs(s) < 1 << 1023 else np.sign(s) * np.finfo(float).max, min(max(s, LONG[0]), LONG[1])) for i, vs, ss in cells.nearest(rows[now], keys[now], k) for v, s in zip(vs, ss, strict=True)]
                    columns = list(zip(*found, strict=True)) or [[]] * 6
                    kinds = [pa.int64()] * 4 + [pa.float64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["query_id", "query", "asked", "vec_id", "high", "score"])

    streams = held.union(asked).repartition(shards, "shard").sortWithinPartitions("shard", "asks")
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("high"), F.desc("score"), "vec_id")
    ranked = streams.mapInArrow(tidy(search), OUT).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    each = ranked.withColumn("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("asked"))))
    named = lambda c: F.nullif(c, F.lit(LONG[1])).alias(c)
    return each.select(named("query_id"), "rank", named("vec_id"), "score")


def op9_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of all vectors for every hundredth."""
    vectors = table(spark, sf_dir, "embeddings").where(usable(F.col("embedding"))).select("vec_id", F.col("embedding").alias("vector"))
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


def oracle_sql() -> str:
    return f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(v.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id IS DISTINCT FROM v.vec_id WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM scored) WHERE rank <= {TOP}
"""
