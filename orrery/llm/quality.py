"""Quality classifier: random-indexing word vectors, pooled, under a two-layer numpy network.

Random indexing (Kanerva et al. 2000; Sahlgren 2005) gives each word a sparse random index vector; a
word's own vector is the sum of the index vectors of its neighbours all over the corpus. Words are
hashed into ``BUCKETS`` and the affixes that stand around them (punctuation, letter case) into
``AFFIXES`` buckets, so the table of vectors has a fixed size: each task adds up whole numbers for its
texts, Spark sums them by bucket, and the sums don't depend on the order of tasks. Every document
counts. A document is pooled whole: the means of its words' and of its affixes' vectors, their lengths,
the share of words that repeat the word before, and the logarithm of its number of words.

The network learns from at most ``SAMPLE`` labelled documents in expectation, drawn by hash; a fifth
of them only sets the temperature that calibrates its probabilities.

Defined results: a null or empty text is pooled as no words (all zeros) and scored like any other;
repeated rows get equal scores; with no label to learn from, or labels of one kind, every score is
their mean (0.5 without labels); of several labels for one document, 1 wins; an empty table gives no
rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import Memo, fold, pieces, small_batches, table, tidy
from orrery.llm.sampling import sampled, trainable

FOLDS, HELD, THRESHOLD = 5, 0, 0.3
BUCKETS, AFFIXES, SIZE, NONZERO, REACH = 1 << 14, 64, 32, 2, 2
IDS = BUCKETS + AFFIXES
SAMPLE, HIDDEN, STEPS, RATE, DECAY, SEED = 8000, 24, 600, 0.01, 1e-4, 5
#: Bytes that a worker may remember of chunks and their buckets.
MEMORY = 16 << 20


class _Chunks(Memo):
    """Chunk between white space -> bucket of its word and bucket of its affix, as one number."""

    def __missing__(self, chunk: str) -> int:
        core = chunk.strip("".join({c for c in chunk if not c.isalnum()}))
        left = chunk.find(core) if core else len(chunk)
        around = chunk[:left] + "_" + chunk[left + len(core) :]
        case = "U" if len(core) > 1 and core.isupper() else ""
        affix = 0 if around == "_" and not case else 1 + zlib.crc32((around[:8] + around[-8:] + case).encode("utf-8", "surrogatepass")) % (AFFIXES - 1)
        word = zlib.crc32(core.lower().encode("utf-8", "surrogatepass")) % BUCKETS
        self.keep(chunk, word * AFFIXES + affix)
        return word * AFFIXES + affix


_chunks = _Chunks(MEMORY)
Work = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def buckets(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and of their affixes."""
    chunks = (text or "").split()
    both = np.fromiter(map(_chunks.__getitem__, chunks), np.int64, len(chunks))
    return both // AFFIXES, both % AFFIXES


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzeros of each id's index vector; the last id, a gap, has none."""
    rng = np.random.default_rng(SEED)
    places, signs = rng.integers(0, SIZE, (IDS + 1, NONZERO)), rng.choice([-1.0, 1.0], (IDS + 1, NONZERO))
    signs[IDS] = 0
    return places, signs


def counted(texts: list[str | None], sums: np.ndarray, places: np.ndarray, signs: np.ndarray) -> None:
    """Adds to sums (IDS + 1, SIZE) the index vectors of the neighbours of every word and affix."""
    gap = np.full(2 * REACH, IDS)
    streams = []
    for t in texts:
        w, a = buckets(t)
        streams += [np.stack([w, a + BUCKETS], 1).ravel(), gap]
    ids = np.concatenate(streams)
    flat = sums.reshape(-1)
    for reach in range(1, REACH + 1):
        for one, other in ((ids[reach:], ids[:-reach]), (ids[:-reach], ids[reach:])):
            base = one * SIZE
            for k in range(NONZERO):
                flat += np.bincount(base + places[other, k], signs[other, k], len(flat))


def word_vectors(docs: DataFrame) -> np.ndarray:
    """(IDS, SIZE) vectors of unit length, or zero, over all of docs."""
    small_batches(docs.sparkSession)
    columns = ", ".join(f"c{i} bigint" for i in range(SIZE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        sums, any_text = np.zeros((IDS + 1, SIZE)), False
        for batch in pieces(batches, 0):
            any_text = True
            counted(batch.column(0).to_pylist(), sums, places, signs)
        if any_text:
            rows = np.flatnonzero(np.abs(sums[:IDS]).sum(1))
            values = sums[rows].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int32()), *[pa.array(values[:, i], pa.int64()) for i in range(SIZE)]],
                names=["bucket", *[f"c{i}" for i in range(SIZE)]],
            )

    sums = docs.select("text").mapInArrow(_tidy(run), f"bucket int, {columns}").groupBy("bucket").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(SIZE)]).toArrow()
    out = np.zeros((IDS, SIZE))
    if sums.num_rows:
        out[sums["bucket"].to_numpy()] = np.stack([sums[f"c{i}"].to_numpy() for i in range(SIZE)], 1)
    length = lambda v: np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    used = np.abs(out).sum(1) > 0
    for part in (slice(0, BUCKETS), slice(BUCKETS, IDS)):
        if used[part].any():
            unit = out[part] / length(out[part])
            # what all share says nothing about one
            unit[used[part]] -= unit[used[part]].mean(0)
            out[part] = unit / length(unit)
    return out.astype(np.float32)


def pooled(text: str | None, vectors: np.ndarray) -> np.ndarray:
    w, a = buckets(text)
    if not len(w):
        return np.zeros(2 * SIZE + 4, np.float32)
    words, affixes = vectors[w].mean(0), vectors[BUCKETS + a].mean(0)
    again = float((w[1:] == w[:-1]).mean()) if len(w) > 1 else 0.0
    return np.concatenate([words, affixes, [np.linalg.norm(words), np.linalg.norm(affixes), again, np.log1p(len(w))]]).astype(np.float32)


@dataclass(frozen=True)
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def _constant(x: np.ndarray, p: float) -> Network:
    n, p = x.shape[1], float(np.clip(p, 1e-6, 1 - 1e-6))
    return Network(np.zeros(n), np.ones(n), np.zeros((n, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, from a grid."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 101))
    losses = [np.logaddexp(0, np.where(y == 1, -1, 1) * logits / t).mean() for t in grid]
    return float(grid[int(np.argmin(losses))])


def fitted(x: np.ndarray, y: np.ndarray) -> Network:
    """Adam on the log loss over four fifths; the temperature from the rest."""
    if not len(y) or y.min() == y.max():
        return _constant(x, float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(y))
    rest, use = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[use].mean(0), x[use].std(0) + 1e-3
    z, t = (x[use] - mean) / scale, y[use].astype(float)
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    moment, square = [np.zeros_like(v) for v in p], [np.zeros_like(v) for v in p]
    for step in range(1, STEPS + 1):
        h = np.tanh(z @ p[0] + p[1])
        d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -50, 50))) - t) / len(t)
        dh = np.outer(d, p[2]) * (1 - h * h)
        for i, g in enumerate((z.T @ dh + DECAY * p[0], dh.sum(0), h.T @ d + DECAY * p[2], np.array([d.sum()]))):
            moment[i], square[i] = 0.9 * moment[i] + 0.1 * g, 0.999 * square[i] + 0.001 * g * g
            p[i] = p[i] - RATE * (moment[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8)
    raw = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    warmth = temperature(raw.logits(x[rest]), y[rest]) if len(rest) else 1.0
    return Network(raw.mean, raw.scale, raw.w1, raw.b1, raw.w2, raw.b2, warmth)


def _remembered() -> Memo:
    """The worker's own memo, not a copy that came with a function."""
    return _chunks


def _tidy(work: Work) -> Work:
    """work on a partition, after which the worker forgets its chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from tidy(work, _remembered())(batches)

    return run


def _with_pools(batches: Iterator[pa.RecordBatch], vectors: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Each batch, whose last column is the text, with its pooled vectors."""
    for batch in pieces(batches, -1):
        pools = [pooled(t.as_py(), vectors) for t in batch.column(batch.num_columns - 1)]
        yield batch, np.array(pools, np.float32).reshape(len(pools), 2 * SIZE + 4)


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, Network]:
    """Word vectors of all docs and a network from a sample of the labels outside the held-out fold."""
    small_batches(docs.sparkSession)
    spark, vectors = docs.sparkSession, word_vectors(docs)
    shared = spark.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, pools in _with_pools(batches, shared.value):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p.tobytes() for p in pools], pa.binary())], names=["label", "pool"])

    found = sampled(docs, trainable(labels, "quality", FOLDS, HELD), SAMPLE).select("label", "text").mapInArrow(_tidy(run), "label int, pool binary").toArrow()
    rows = sorted(zip(found["pool"].to_pylist(), found["label"].to_pylist(), strict=True))
    x = np.frombuffer(b"".join(p for p, _ in rows), np.float32).reshape(len(rows), 2 * SIZE + 4).astype(float)
    return vectors, fitted(x, np.array([y for _, y in rows], int))


def scored(docs: DataFrame, vectors: np.ndarray, network: Network, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and score of every document."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network))
    picked = docs.select(*keep, F.col("text").alias("text__"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, pools in _with_pools(batches, shared.value[0]):
            scores = shared.value[1].probabilities(pools.astype(float))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "score"])

    return picked.mapInArrow(_tidy(run), schema)


def accepted(docs: DataFrame, vectors: np.ndarray, network: Network, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score threshold or more, with all their columns."""
    small_batches(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast((vectors, network)), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, at):
            pools = np.array([pooled(t.as_py(), shared.value[0]) for t in batch.column(at)], float).reshape(batch.num_rows, 2 * SIZE + 4)
            yield batch.filter(pa.array(shared.value[1].probabilities(pools) >= threshold, pa.bool_()))

    return docs.mapInArrow(_tidy(run), docs.schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document."""
    docs = table(spark, sf_dir, "documents")
    vectors, network = train(docs, table(spark, sf_dir, "labels"))
    return scored(docs, vectors, network).select(
        "doc_id",
        (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
