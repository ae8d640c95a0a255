"""Spherical k-means of any size: k-means|| starts, rounds as sums by cluster, silhouettes from the sums.

All runs (a family, a k, a seed) go through the rows together: a pass gives each task the centres of the
runs, and takes back what it adds up, a number for each run, cluster and component. So a family is dealt
over all tasks, and the driver holds centres alone; runs whose centres together would pass
``CENTRE_BYTES`` go one after the other. Sums are whole numbers (of 2^-30), so they are the same in any
order and on any partitions, and similarities are told apart by nine decimals, ties to the first centre.

Starts follow Bahmani et al. (2012): a few passes draw points with a chance by squared distance from the
points drawn so far, each pass the ``k`` least of -ln(u) / d^2 with u hashed from the row's id; the points,
weighted by the rows nearest to them, become k by k-means++ on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.staging import dropped, staged

SCALE, DRAWS, CENTRE_BYTES = 1 << 30, 3, 64 << 20


class Run(NamedTuple):
    family: object
    k: int
    seed: int


Centres = dict[Run, np.ndarray]


def uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1] from 64-bit keys (splitmix64's finaliser)."""
    x = keys.view(np.uint64) ^ np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53) + 2.0**-54


def similarities(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.round(x @ centres.T, 9)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def _by_family(batch: pa.RecordBatch) -> Iterator[tuple[object, np.ndarray, np.ndarray]]:
    """Family, row numbers and vectors; batch: family, key, vector, id."""
    families = np.array(batch.column(0).to_pylist(), object)
    for family in dict.fromkeys(families.tolist()):
        rows = np.flatnonzero(families == family)
        yield family, rows, _matrix(batch.column(2).take(pa.array(rows)))


def _parts(centres: Centres) -> Iterator[Centres]:
    """Runs whose centres fit together."""
    part, held = {}, 0
    for run, c in centres.items():
        if part and held + c.nbytes > CENTRE_BYTES:
            yield part
            part, held = {}, 0
        part[run], held = c, held + c.nbytes
    if part:
        yield part


def _summed(data: DataFrame, centres: Centres, add: Callable[[np.ndarray, np.ndarray, Run], np.ndarray], width: int) -> dict[Run, np.ndarray]:
    """For each run, whole numbers by centre: what add gives for the vectors of a batch, added up over all rows."""
    out: dict[Run, np.ndarray] = {}
    for part in _parts(centres):
        runs = list(part)
        given = data.sparkSession.sparkContext.broadcast(part)

        def work(batches: Iterator[pa.RecordBatch], given=given, runs=runs) -> Iterator[pa.RecordBatch]:
            sums = {run: np.zeros((len(c), width), np.int64) for run, c in given.value.items()}
            for batch in batches:
                for family, _, x in _by_family(batch):
                    for run in sums:
                        if run.family == family:
                            sums[run] += add(x, given.value[run], run)
            for number, run in enumerate(runs):
                flat = sums[run].ravel()
                some = np.flatnonzero(flat)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), number, np.int32)), pa.array(some), pa.array(flat[some])], names=["run", "at", "n"])

        found = data.mapInArrow(work, "run int, at bigint, n bigint").groupBy("run", "at").agg(F.sum("n").alias("n")).toArrow()
        number, at, n = (found[c].to_numpy() for c in ("run", "at", "n"))
        for i, run in enumerate(runs):
            total = np.zeros(len(part[run]) * width, np.int64)
            total[at[number == i]] = n[number == i]
            out[run] = total.reshape(len(part[run]), width)
        given.unpersist()
    return out


def _members(x: np.ndarray, centres: np.ndarray, run: Run | None = None) -> np.ndarray:
    """For each centre: how many rows it has, the sum of their similarities, and of their components."""
    s = similarities(x, centres)
    label = s.argmax(1)
    out = np.zeros((len(centres), 2 + x.shape[1]), np.int64)
    fixed = np.column_stack([np.ones(len(x), np.int64), np.rint(s.max(1) * SCALE).astype(np.int64), np.rint(x * SCALE).astype(np.int64)])
    np.add.at(out, label, fixed)
    return out


def members_summed(data: DataFrame, centres: Centres) -> dict[Run, np.ndarray]:
    return _summed(data, centres, _members, 2 + next(iter(centres.values())).shape[1])


def moved(centres: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The unit means of the members; a centre without any stays."""
    mean = sums[:, 2:].astype(float)
    norm = np.linalg.norm(mean, axis=1)
    keep = (sums[:, 0] == 0) | (norm == 0)
    return np.where(keep[:, None], centres, mean / np.where(keep, 1, norm)[:, None])


def drawn(data: DataFrame, runs: dict[Run, int], centres: Centres, draw: int) -> Centres:
    """For each run, as many rows as it says, drawn by squared distance from its centres (all alike without any)."""
    order = list(runs)
    given = data.sparkSession.sparkContext.broadcast(centres)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {run: (np.zeros(0), np.zeros(0, np.int64), None) for run in order}
        for batch in batches:
            keys = batch.column(1).to_numpy()
            for family, rows, x in _by_family(batch):
                for run in order:
                    if run.family != family:
                        continue
                    c = given.value.get(run)
                    away = np.ones(len(x)) if c is None else np.clip(1 - similarities(x, c).max(1), 0, None) ** 2
                    u = uniform(keys[rows], run.seed * 1_000_003 + run.k * 101 + draw + 1)
                    with np.errstate(divide="ignore"):
                        p = np.where(away > 0, -np.log(u) / away, np.inf)
                    old_p, old_k, old_x = best[run]
                    p, k, v = np.concatenate([old_p, p]), np.concatenate([old_k, keys[rows]]), x if old_x is None else np.vstack([old_x, x])
                    first = np.lexsort((k, p))[: runs[run]]
                    first = first[p[first] < np.inf]
                    best[run] = (p[first], k[first], v[first])
        for i, run in enumerate(order):
            p, k, v = best[run]
            if len(p):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), i, np.int32)), pa.array(p), pa.array(k), pa.array(v.tolist(), pa.list_(pa.float64()))], names=["run", "p", "key", "x"])

    rank = F.row_number().over(Window.partitionBy("run").orderBy("p", "key"))
    most = F.element_at(F.array(*[F.lit(n) for n in runs.values()]), F.col("run") + 1)
    rows = data.mapInArrow(work, "run int, p double, key bigint, x array<double>").withColumn("rank", rank).where(F.col("rank") <= most).orderBy("run", "rank").toArrow()
    found: Centres = dict(centres)
    number = rows["run"].to_numpy()
    for i, run in enumerate(order):
        own = rows.filter(pa.array(number == i))
        if own.num_rows:
            x = np.array(own["x"].to_pylist())
            found[run] = np.vstack([found[run], x]) if run in found else x
    given.unpersist()
    return found


def plus_plus(points: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k of weighted points by k-means++; fewer if there are fewer different ones."""
    rng = np.random.default_rng(seed)
    p, chosen = weights.astype(float), []
    while len(chosen) < k and p.sum() > 0:
        chosen.append(rng.choice(len(points), p=p / p.sum()))
        p = weights * np.clip(1 - similarities(points, points[chosen]).max(1), 0, None) ** 2
    return points[chosen]


def started(data: DataFrame, runs: list[Run]) -> Centres:
    centres = drawn(data, dict.fromkeys(runs, 1), {}, 0)
    for draw in range(1, DRAWS + 1):
        centres = drawn(data, {r: r.k for r in runs}, centres, draw)
    weights = members_summed(data, centres)
    return {r: plus_plus(c, weights[r][:, 0], r.k, r.seed) for r, c in centres.items()}


def converged(data: DataFrame, centres: Centres, rounds: int) -> tuple[Centres, dict[Run, np.ndarray]]:
    """Centres that no round moves any more (or the last), and the sums of their members."""
    now, sums = dict(centres), {}
    done: Centres = {}
    for _ in range(rounds):
        found = members_summed(data, now)
        for run, s in found.items():
            if run in sums and np.array_equal(sums[run], s):
                done[run] = now.pop(run)
            else:
                now[run] = moved(now[run], s)
            sums[run] = s
        if not now:
            return done, sums
    return done | now, sums | members_summed(data, now)


def silhouettes(data: DataFrame, centres: Centres, sums: dict[Run, np.ndarray]) -> dict[Run, float]:
    """Mean cosine silhouette of each run; members alone in their cluster count 0."""

    def add(x: np.ndarray, c: np.ndarray, run: Run) -> np.ndarray:
        sizes, total = sums[run][:, 0], x @ (sums[run][:, 2:].astype(float) / SCALE).T
        used, rows = sizes > 0, np.arange(len(x))
        own = similarities(x, c).argmax(1)
        inside = 1 - (total[rows, own] - (x * x).sum(1)) / np.maximum(sizes[own] - 1, 1)
        mean = np.where(used, 1 - total / np.maximum(sizes, 1), np.inf)
        mean[rows, own] = np.inf
        other = mean.min(1)
        with np.errstate(invalid="ignore"):
            s = np.where((sizes[own] > 1) & (used.sum() > 1), (other - inside) / np.maximum(np.maximum(inside, other), 1e-12), 0.0)
        out = np.zeros((len(c), 2), np.int64)
        out[0] = np.rint(s.sum() * SCALE), len(x)
        return out

    return {run: float(t[0, 0] / SCALE / max(t[0, 1], 1)) for run, t in _summed(data, centres, add, 2).items()}


def fitted(rows: DataFrame, ks: dict[object, list[int]], seeds: range, rounds: int, family: str, key: str, column: str) -> tuple[DataFrame, dict[object, tuple[np.ndarray, float]]]:
    """family, id, cluster (of the chosen run's centres, from 0) and sim of rows; and each family's centres and silhouette.

    ks: what k may be for each family, a few of them. Of the seeds, the run of the greatest similarity counts; of the
    ks, the least whose silhouette no other beats by 1e-9.
    """
    given = rows.select(F.col(family).alias("family"), F.xxhash64(key).alias("key"), F.col(column).cast("array<double>").alias("x"), F.col(key).alias("id"))
    data = staged(given, "vectors")
    runs = [Run(f, k, s) for f, choice in ks.items() for k in choice for s in (seeds if k > 1 else range(1))]
    centres, sums = converged(data, started(data, runs), rounds)
    best = {(r.family, r.k): max((x for x in runs if x[:2] == r[:2]), key=lambda x: (sums[x][:, 1].sum(), -x.seed)) for r in runs}
    scores = silhouettes(data, {r: centres[r] for r in best.values()}, sums)
    chosen: dict[object, tuple[np.ndarray, float]] = {}
    for (f, _), run in sorted(best.items(), key=lambda x: x[0][1]):
        if f not in chosen or scores[run] > chosen[f][1] + 1e-9:
            chosen[f] = (centres[run], scores[run])
    told = data.sparkSession.sparkContext.broadcast({f: c for f, (c, _) in chosen.items()})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, sim = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for f, rows_, x in _by_family(batch):
                s = similarities(x, told.value[f])
                label[rows_], sim[rows_] = s.argmax(1), s.max(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(label), pa.array(sim)], names=[family, key, "cluster", "sim"])

    kinds = {f.name: f.dataType.simpleString() for f in data.schema.fields}
    found = staged(data.mapInArrow(work, f"{family} {kinds['family']}, {key} {kinds['id']}, cluster int, sim double"), "clustered")
    dropped(data)
    return found, chosen
