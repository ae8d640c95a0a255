"""Retrieval over unit vectors: exact top k, examples, similarity with explanations."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import geo, vector
from orrery.staging import staged

#: Centroids that may be broadcast together: 16 MB at 512 components.
FEW_CENTROIDS = 4_000
#: Rows of a shard of nearest_rows, and least rows of a slice of queries.
SHARD_ROWS, SLICE_ROWS = 20_000, 2_000
#: Scores of a block, rows that one of its maxima stands for, a length to divide by, and less than any score of unit vectors.
SCORES, PARTS, LEAST, NONE = 1 << 22, 32, 1e-150, np.float32(-2)
#: Side of a tile of spaced_per_group, in spacings; rows of a group that is one tile; rows of a task.
TILE, WHOLE, TASK = 8, 20_000, 20_000


def top_k(rows: DataFrame, query: list[float], k: int, column: str = "embedding", key: str = "id") -> DataFrame:
    """The k rows most similar to a query vector, ties to the smaller key: each task keeps k."""
    scored = rows.withColumn("score", vector.dot(vector.doubles(F.col(column)), vector.literal(query)))
    return scored.orderBy(F.desc("score"), key).limit(k)


def nearest_rows(rows: DataFrame, queries: DataFrame, k: int, column: str = "embedding", apart: str | None = None) -> DataFrame:
    """query, id, score and rank: for each query, the k other rows most similar to it, ties to the smaller id.

    apart: a column; rows with the query's own value of it are left out (neighbours at other places).
    """
    return nearest_by(rows, queries, k, column, [apart]).drop("apart")


def nearest_by(rows: DataFrame, queries: DataFrame, k: int, column: str, aparts: list[str | None]) -> DataFrame:
    """nearest_rows for each of aparts in one pass: query, apart (its number in the list), id, score and rank.

    rows, queries: id and a vector; rows without one take no part. Rows are dealt into shards of bounded size,
    and queries into slices where shards alone are fewer than cores. A task has a shard and a slice: queries
    pass its rows as a stream, a block at a time, as a product of matrices; what its rounding leaves open is
    settled by sums in the order of components, as SQL adds them up.
    """
    n, spark = rows.count(), rows.sparkSession
    shards = max(1, -(-n // SHARD_ROWS))
    slices = max(1, min(-(-2 * spark.sparkContext.defaultParallelism // shards), -(-n // SLICE_ROWS)))
    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    slice_ = F.pmod(F.hash("id"), F.lit(slices)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    groups = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in aparts if c is not None]).cast("array<string>").alias("groups")
    given = ["id", F.col(column).alias("v"), groups]
    some = F.col(column).isNotNull()
    held = rows.where(some).select(every(slices).alias("slice"), shard.alias("shard"), F.lit(0).alias("asks"), *given)
    asked = queries.where(some).select(every(shards).alias("shard"), slice_.alias("slice"), F.lit(1).alias("asks"), *given).select(held.columns)
    streams = held.union(asked).withColumn("task", F.col("shard") * slices + F.col("slice")).select("task", "asks", "id", "v", "groups")
    streams = streams.repartitionById(shards * slices, "task").sortWithinPartitions("task", "asks")
    kind = dict(rows.dtypes)["id"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, parts, block = None, [], None
        for batch in batches:
            turn = np.stack([batch.column(i).to_numpy() for i in range(2)])
            cuts = [0, *(np.flatnonzero((turn[:, 1:] != turn[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for start, end in zip(cuts, cuts[1:], strict=False):
                if start == end:
                    continue
                if turn[0, start] != task:
                    task, parts, block = turn[0, start], [], None
                part = batch.slice(start, end - start)
                if not turn[1, start]:
                    parts.append(part)
                    continue
                if parts:
                    block, parts = _Shard(pa.Table.from_batches(parts), aparts, k), []
                if block is not None:
                    yield from block.asked(part)

    found = streams.mapInArrow(search, f"query {kind}, apart int, near array<struct<far:double,id:{kind}>>")
    best = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k)
    each = found.groupBy("query", "apart").agg(best.alias("near")).select("query", "apart", F.posexplode("near").alias("at", "n"))
    return each.select("query", "apart", F.col("n.id").alias("id"), (-F.col("n.far")).alias("score"), (F.col("at") + 1).alias("rank"))


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


class _Shard:
    """The rows of a task in the order of their ids, asked by blocks of queries.

    Products of matrices in single precision, of rows over the greatest length and queries over their own, find
    the candidates: what lies within twice the bound of their rounding of the k-th best. Vectors that are not
    finite are judged by sums alone.
    """

    def __init__(self, rows: pa.Table, aparts: list[str | None], k: int) -> None:
        rows = rows.take(pc.sort_indices(rows["id"])).combine_chunks()
        self.k, self.aparts = k, aparts
        self.names: list[dict[str, int]] = [{} for c in aparts if c is not None]
        ids, x, codes = (rows[c].combine_chunks() for c in ("id", "v", "groups"))
        x, codes = _vectors(x), self._codes(codes)
        self.held = ids.unique()
        if len(self.held) == len(ids):
            keep = _first(x, codes, k + 1)
            ids, x, codes = ids.take(pa.array(keep)), x[keep], codes[:, keep]
            self.held = ids
        norm = np.sqrt((x * x).sum(1))
        finite = np.isfinite(norm)
        self.ids, self.x, self.odd, self.width = ids, x, np.flatnonzero(~finite), -(-len(x) // PARTS)
        spare = PARTS * self.width - len(x)
        self.number = np.pad(pc.index_in(ids, value_set=self.held).to_numpy(), (0, spare), constant_values=-2)
        self.codes = np.pad(codes, ((0, 0), (0, spare)), constant_values=-1)
        self.scaled = np.pad(np.where(finite[:, None], x, 0.0) / max(norm[finite].max(initial=0.0), LEAST), ((0, spare), (0, 0))).astype(np.float32)

    def _codes(self, groups: pa.Array) -> np.ndarray:
        """A number for each name, by group and row."""
        flat, wide = groups.flatten().to_pylist(), len(self.names)
        return np.array([[names.setdefault(g, len(names)) for g in flat[i::wide]] for i, names in enumerate(self.names)], np.int64).reshape(wide, len(groups))

    def asked(self, queries: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """query, apart and near: the k best of the shard."""
        ids, v, codes = queries.column(2), _vectors(queries.column(3)), self._codes(queries.column(4))
        own = pc.index_in(ids, value_set=self.held).fill_null(-1).to_numpy(zero_copy_only=False)
        step = max(1, SCORES // len(self.scaled))
        for start in range(0, len(v), step):
            some = slice(start, start + step)
            for apart, (q, r, score) in enumerate(self._best(v[some], own[some], codes[:, some])):
                ends = np.cumsum(np.bincount(q, minlength=len(v[some])))
                near = pa.StructArray.from_arrays([pa.array(0.0 - score), self.ids.take(pa.array(r))], names=["far", "id"])
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), near)
                yield pa.RecordBatch.from_arrays([ids[some], pa.array(np.full(len(ends), apart, np.int32)), lists], names=["query", "apart", "near"])

    def _best(self, v: np.ndarray, own: np.ndarray, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each of aparts: queries, rows and scores of the k best, in this order."""
        norm = np.sqrt((v * v).sum(1))
        finite = np.isfinite(norm)
        s = (np.where(finite[:, None], v, 0.0) / np.maximum(np.where(finite, norm, 0.0), LEAST)[:, None]).astype(np.float32) @ self.scaled.T
        alone = len(self.held) == len(self.ids)
        s[(np.flatnonzero(own >= 0), own[own >= 0]) if alone else np.nonzero(own[:, None] == self.number)] = -np.inf
        s[:, self.odd] = -np.inf
        s[:, len(self.x) :] = -np.inf
        odd, even = np.flatnonzero(~finite), np.flatnonzero(finite)
        more = np.repeat(odd, len(self.x)), np.tile(np.arange(len(self.x)), len(odd))
        more = np.append(more[0], np.repeat(even, len(self.odd))), np.append(more[1], np.tile(self.odd, len(even)))
        slack = np.float32(2.0**-22 * (v.shape[1] + 4))
        groups = iter(zip(codes, self.codes, strict=True))
        for column in self.aparts:
            want = self.k if column is None else 2 * self.k
            q, r, least = _candidates(s, want, PARTS, slack)
            if column is not None:
                here, there = next(groups)
                sure = (here[q] != there[r]) & (s[q, r] >= least[q] + slack)
                short = np.flatnonzero((np.bincount(q[sure], minlength=len(v)) < self.k) & (least > NONE))
                if len(short):  # the best are all of the query's own group: without them
                    others = np.where(here[short, None] == there, -np.inf, s[short]).astype(np.float32)
                    q2, r2, _ = _candidates(others, self.k, PARTS, slack)
                    rest = ~np.isin(q, short)
                    q, r = np.append(q[rest], short[q2]), np.append(r[rest], r2)
            kept = finite[q]
            q, r = np.append(q[kept], more[0]), np.append(r[kept], more[1])
            fits = own[q] != self.number[r]
            if column is not None:
                fits &= here[q] != there[r]
            q, r = q[fits], r[fits]
            score = _sums(v, q, self.x, r)
            some = score > -np.inf
            q, r, score = q[some], r[some], score[some]
            order = np.lexsort((r, -score, q))
            q, r, score = q[order], r[order], score[order]
            first = np.flatnonzero(np.diff(q, prepend=-1))
            top = np.arange(len(q)) - np.repeat(first, np.diff(first, append=len(q))) < self.k
            yield q[top], r[top], score[top]


def _first(x: np.ndarray, codes: np.ndarray, most: int) -> np.ndarray:
    """Of equal vectors in equal groups the first most: no other is among most - 1 nearest, whoever asks."""
    both = np.ascontiguousarray(np.hstack([x, codes.T]))
    at = np.unique(both.view(np.dtype((np.void, both.itemsize * both.shape[1]))).ravel(), return_inverse=True)[1]
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.diff(at[order], prepend=-1))
    return np.sort(order[np.arange(len(order)) - np.repeat(first, np.diff(first, append=len(order))) < most])


def _candidates(s: np.ndarray, want: int, parts: int, slack: np.float32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query, row) that may be among the want best, and the score from which on they are.

    The want best of the maxima of small sets are no better than the want best of all.
    """
    highest = s.reshape(len(s), parts, -1).max(1)
    width = highest.shape[1]
    least = np.full(len(s), NONE, np.float32)
    if want < width:
        least = np.maximum(np.partition(highest, width - want, axis=1)[:, width - want] - slack, NONE)
    q, at = np.nonzero(highest >= least[:, None])
    r = at[:, None] + width * np.arange(parts)
    hit = s[q[:, None], r] >= least[q, None]
    return np.repeat(q, hit.sum(1)), r[hit], least


def _sums(v: np.ndarray, q: np.ndarray, x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Inner products, added up from the first component to the last."""
    step = max(1, SCORES // 8 // x.shape[1])
    return np.concatenate([np.zeros(0)] + [np.cumsum(v[q[i : i + step]] * x[r[i : i + step]], axis=1)[:, -1] for i in range(0, len(q), step)])


def example_query(rows: DataFrame, positive: Column, negative: Column, column: str = "embedding") -> list[float] | None:
    """Mean of the positives less half the mean of the negatives, of unit length: one small row on the driver."""
    kind = F.when(positive, "p").when(negative, "n")
    means = {r.kind: r["mean"] for r in vector.element_means(rows.withColumn("kind", kind).where("kind is not null"), ["kind"], column).collect()}
    if "p" not in means:
        return None
    q = [p - 0.5 * n for p, n in zip(means["p"], means.get("n", [0.0] * len(means["p"])), strict=True)]
    length = sum(x * x for x in q) ** 0.5
    return [x / length for x in q] if length else None


def best_per_place(scored: DataFrame, place: list[str], key: str = "id") -> DataFrame:
    """The best-scoring row of each place."""
    order = Window.partitionBy(*place).orderBy(F.desc("score"), key)
    return scored.withColumn("r__", F.row_number().over(order)).where("r__ = 1").drop("r__")


def assigned(rows: DataFrame, centroids: DataFrame, family: list[str], column: str = "embedding") -> DataFrame:
    """rows with the nearest centroid of their family, its similarity, and the cluster if it lies within the radius.

    centroids: family, cluster, centroid, radius. The centroids of a family become one array, which each
    row scans by itself: rows stay in place while the centroids, counted, are few enough to broadcast.
    """
    options = centroids.groupBy(*family).agg(F.collect_list(F.struct("cluster", "centroid", "radius")).alias("options__"))
    if centroids.count() <= FEW_CENTROIDS:
        options = F.broadcast(options)
    keys = [c for c in rows.columns if c != column]
    own = rows.join(options, family).withColumn("v__", vector.doubles(F.col(column)))
    best = F.array_max(F.transform("options__", lambda o: F.struct(vector.dot(F.col("v__"), o["centroid"]).alias("sim"), (-o["cluster"]).alias("late"), o["cluster"].alias("cluster"), o["radius"].alias("radius"))))
    found = own.select(*keys, best.alias("b"))
    return found.select(*keys, F.col("b.cluster").alias("nearest"), F.col("b.sim").alias("sim"), F.when(F.col("b.sim") >= F.col("b.radius"), F.col("b.cluster")).alias("cluster"))


def radii(members: DataFrame, family: list[str], column: str = "sim") -> DataFrame:
    """Radius of each cluster: the lower of the least similarity and the mean less three deviations."""
    return members.groupBy(*family, "cluster").agg(F.least(F.min(column), F.avg(column) - 3 * F.stddev_pop(column)).alias("radius"))


def spaced(ranked: pd.DataFrame, metres: float = 300.0, taken: pd.DataFrame | None = None, k: int | None = None) -> pd.DataFrame:
    """Best first, without rows closer than metres to one taken already; for a short ranked list."""
    import numpy as np

    xs, ys = ([], []) if taken is None else (list(taken["lon"]), list(taken["lat"]))
    keep = []
    for i, (x, y) in enumerate(zip(ranked["lon"], ranked["lat"], strict=True)):
        if xs:
            a, b = np.radians(np.array(ys)), np.radians(y)
            h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(np.array(xs) - x) / 2) ** 2
            if (2 * geo.EARTH_RADIUS_M * np.arcsin(np.sqrt(h)) < metres).any():
                continue
        keep.append(i)
        xs.append(x)
        ys.append(y)
        if k is not None and len(keep) == k:
            break
    return ranked.iloc[keep]


def spaced_per_group(ranked: DataFrame, group: str, metres: float) -> DataFrame:
    """The spaced rows of each group, best first over its whole ranking; ranked: group, id, lon, lat, score.

    The greedy pass runs in tiles of space (a small group is one tile) and in rounds. A tile sees its own rows and those within metres
    around it; it keeps a row once all better ones near it are known to be dropped, drops it once one of
    them is kept, and leaves it to the next round while one from outside is open. The best open row of a
    group is always decided, so the rounds end. Rows without a place are near nothing and kept.
    """
    kept_cols = ranked.columns
    lon, lat = F.radians(F.col("lon").cast("double")), F.radians(F.col("lat").cast("double"))
    score = F.col("score").cast("double")
    placed = ~(F.isnan(lon) | F.isnan(lat) | lon.isNull() | lat.isNull())
    reach = 2 * math.sin(min(metres / (2 * geo.EARTH_RADIUS_M), math.pi / 2)) * (1 + 1e-9) + 1e-12
    side = TILE * reach
    sizes = ranked.groupBy(F.col(group).alias("of__")).agg(F.count(F.lit(1)).alias("rows__")).select("of__", "rows__", (F.col("rows__") <= WHOLE).alias("whole__"))
    tasks = max(1, -(-(sizes.agg(F.sum("rows__")).first()[0] or 0) // TASK))
    rows = ranked.where(placed).join(sizes, F.col(group).eqNullSafe(F.col("of__"))).drop("of__", "rows__").withColumns(
        {
            "x__": F.cos(lat) * F.cos(lon),
            "y__": F.cos(lat) * F.sin(lon),
            "z__": F.sin(lat),
            "class__": F.when(score.isNull(), 2).when(F.isnan(score), 0).otherwise(1),
            "score__": F.coalesce(F.nanvl(score, F.lit(0.0)), F.lit(0.0)),
            "kept__": F.lit(False),
        }
    )
    tile = lambda c: F.when(F.col("whole__"), F.lit(0).cast("bigint")).otherwise(F.floor(c / side))
    names = ["tile_x__", "tile_y__", "tile_z__"]
    own = F.lit(True)
    for c in ("x__", "y__", "z__"):
        own = own & (tile(F.col(c)) == F.col(f"tile_{c}"))

    def decided(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["class__", "score__", "id"], ascending=[True, False, True])
        return pd.concat([_decided(t, metres) for _, t in f.groupby([group, *names], sort=False, dropna=False)]).drop(columns=["own__", "task__", *names])

    while True:
        tiles = rows
        for c in ("x__", "y__", "z__"):
            tiles = tiles.withColumn(f"tile_{c}", F.explode(F.sequence(tile(F.col(c) - reach), tile(F.col(c) + reach))))
        tiles = tiles.withColumns({"own__": own, "task__": F.pmod(F.xxhash64(group, *names), F.lit(tasks))})
        rows = staged(tiles.groupBy("task__").applyInPandas(decided, rows.schema), "spaced")
        if not rows.where("not kept__").limit(1).count():
            return rows.select(*kept_cols).union(ranked.where(~placed))


def _decided(f: pd.DataFrame, metres: float) -> pd.DataFrame:
    """A tile's own rows that are kept or still open; f: best first."""
    import numpy as np

    xs, ys, was, own = f["lon"].to_numpy(float), f["lat"].to_numpy(float), f["kept__"].to_numpy(bool), f["own__"].to_numpy(bool)
    a, cos, kept = np.empty((2, len(f))), np.empty(len(f)), np.zeros(len(f), bool)
    left: list[int] = []
    for i in range(len(f)):
        m, b = len(left), np.radians(ys[i])
        now = was[i]
        if not now:
            h = np.sin((b - a[1, :m]) / 2) ** 2 + cos[:m] * np.cos(b) * np.sin(np.radians(a[0, :m] - xs[i]) / 2) ** 2
            near = 2 * geo.EARTH_RADIUS_M * np.arcsin(np.sqrt(h)) < metres
            if (near & kept[:m]).any():
                continue
            now = own[i] and not near.any()
        a[:, m], cos[m], kept[m] = (xs[i], b), np.cos(b), now
        left.append(i)
    out = f.iloc[left].assign(kept__=kept[: len(left)])
    return out[own[left]]


def standard_embedding(rows: DataFrame, features: list[str], name: str = "features") -> DataFrame:
    """rows with their features as one array, each less its mean and over its deviation (over 1 where it has none)."""
    facts = rows.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(features) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    scale = lambda i: facts[f"s{i}"] or 1.0
    return rows.withColumn(name, F.array(*[(F.col(c).cast("double") - F.lit(facts[f"m{i}"])) / F.lit(scale(i)) for i, c in enumerate(features)]))


def cosine(column: str, query: list[float]) -> Column:
    """Cosine of an array and a fixed vector; 0 for a null vector."""
    length = math.sqrt(sum(q * q for q in query)) or 1.0
    own = F.sqrt(vector.dot(F.col(column), F.col(column)))
    return F.when(own > 0, vector.dot(F.col(column), vector.literal(query)) / (own * F.lit(length))).otherwise(0.0)


def distribution(scored: DataFrame) -> DataFrame:
    """Median, least and greatest of all scores, and how many there are."""
    return scored.agg(F.median("score").alias("median"), F.min("score").alias("least"), F.max("score").alias("greatest"), F.count("score").alias("n"))


def explained(rows: DataFrame, query: dict[str, float], most: int = 3) -> DataFrame:
    """rows with the names of the features closest to the query's."""
    gaps = F.array_sort(F.array(*[F.struct(F.abs(F.col(f) - F.lit(v)).alias("gap"), F.lit(f).alias("feature")) for f, v in query.items()]))
    return rows.withColumn("because", F.transform(F.slice(gaps, 1, most), lambda g: g["feature"]))
