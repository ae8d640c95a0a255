"""Bounded samples of labelled and unlabelled documents for training classifiers on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import fold

GRAIN = 1 << 30


def _share(key: Column, rate: float, seed: int) -> Column:
    """True for about rate of the keys, the same ones each time."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(GRAIN)) < int(min(1.0, rate) * GRAIN)


def trainable(labels: DataFrame, label: str, folds: int, held: int) -> DataFrame:
    """doc_id, label: labels that may be learnt from; of several for one document, the greatest."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(F.col("doc_id"), folds) != held))
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("label"))
    )


def sampled(docs: DataFrame, wanted: DataFrame, bound: int, seed: int = 1) -> DataFrame:
    """doc_id, text and the other columns of wanted, for about bound documents at most.

    Ids are drawn by hash, so about bound rows are broadcast; if an id stands for many rows of docs,
    its rows are thinned by a second draw, by hash of the text; so the draw depends on values alone.
    """
    n = wanted.count()
    ids = F.broadcast(wanted.where(_share(F.col("doc_id"), bound / max(n, 1), seed)))
    rows = docs.select("doc_id").join(ids, "doc_id").count()
    return docs.select("doc_id", "text").join(ids, "doc_id").where(_share(F.concat_ws("|", F.col("doc_id").cast("string"), "text"), bound / max(rows, 1), seed + 1))
