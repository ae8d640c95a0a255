"""Connected cells of grids of any size, over the eight neighbours.

Cells are dealt into square blocks; a task labels the cells of one block. Cells at the edges of blocks
meet their neighbours in the next block by an equi-join on the place, which links labels of blocks, and
these, far fewer than cells, are joined in rounds that grow with the logarithm of the longest way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from orrery.staging import dropped, staged

#: Rows and columns of a block: what a task holds at most.
BLOCK = 256
#: Links between blocks that one task joins; a link takes some 200 bytes there.
FEW_LINKS = 500_000
AROUND = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if r or c]


def joined(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of the numbers 0 to count - 1 that each one reaches by the links a - b."""
    root = np.arange(count)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(before, root):
            return root
    return root


def block_roots(row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """For each cell, the place in the list of the first cell, by row and column, that it reaches."""
    width = int(col.max() - col.min()) + 3
    key = (row - row.min()) * width + (col - col.min()) + 1
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    starts, ends = [], []
    for step in (1, width - 1, width, width + 1):
        at = np.minimum(np.searchsorted(ranked, ranked + step), len(ranked) - 1)
        hit = np.flatnonzero(ranked[at] == ranked + step)
        starts.append(hit)
        ends.append(at[hit])
    root = joined(len(key), np.concatenate(starts), np.concatenate(ends))
    out = np.empty(len(key), np.int64)
    out[order] = order[root]
    return out


def _at_once(t: pa.Table) -> pa.Table:
    names, number = np.unique(np.concatenate([t["a"].to_numpy(), t["b"].to_numpy()]).astype(str), return_inverse=True)
    root = joined(len(names), number[: t.num_rows], number[t.num_rows :])
    return pa.table({"node": pa.array(names), "root": pa.array(names[root])})


def components(links: DataFrame, few: int | None = None) -> DataFrame:
    """node and root, the least node that it reaches, of every node of links (a, b), texts.

    Up to few links are joined in one task; more in rounds over all tasks.
    """
    if links.count() <= (FEW_LINKS if few is None else few):
        return links.select("a", "b", F.lit(True).alias("all")).groupBy("all").applyInArrow(_at_once, "node string, root string")
    both = staged(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    roots = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root"))
    old: list[DataFrame] = []
    while True:
        roots = staged(roots, "roots")
        dropped(*old)
        near = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low"))
        lower = staged(near.join(roots, "node").select("node", F.least("low", "root").alias("root"), (F.col("low") < F.col("root")).alias("moved")), "lower")
        if not lower.where("moved").limit(1).count():
            dropped(lower, both)
            return roots
        old = [roots, lower]
        onward = lower.select(F.col("node").alias("root"), F.col("root").alias("next"))
        roots = lower.select("node", "root").join(onward, "root").select("node", F.least("root", "next").alias("root"))


def place(row: Column, col: Column) -> Column:
    """Row and column as one number."""
    return row.cast("bigint") * (1 << 32) + (col.cast("bigint") + (1 << 31))


def neighbours(cells: DataFrame, at: list[tuple[int, int]] = AROUND) -> DataFrame:
    """A row for each cell and neighbour's place (near_row, near_col)."""
    steps = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in at])
    return cells.withColumn("s__", F.explode(steps)).withColumns({"near_row": F.col("row") + F.col("s__.r"), "near_col": F.col("col") + F.col("s__.c")}).drop("s__")


def labelled(cells: DataFrame, by: list[str], block: int | None = None) -> DataFrame:
    """cells with component: a number that the cells of one by that reach each other share.

    cells: by, row and col (int), each place once for each by; other columns stay. The number is the place of the first
    cell, by row and column, of the component's first block: the same whatever the partitions.
    """
    size = block or BLOCK
    part = {"br__": F.floor(F.col("row") / size).cast("int"), "bc__": F.floor(F.col("col") / size).cast("int")}
    dealt = cells.withColumns(part)
    schema = StructType([*dealt.schema.fields, StructField("local", LongType())])

    def local(t: pa.Table) -> pa.Table:
        row, col = t["row"].to_numpy().astype(np.int64), t["col"].to_numpy().astype(np.int64)
        first = block_roots(row, col)
        return t.append_column("local", pa.array(row[first] * (1 << 32) + col[first] + (1 << 31)))

    found = staged(dealt.groupBy(*by, "br__", "bc__").applyInArrow(local, schema), "blocks")
    edge = (F.pmod("row", F.lit(size)).isin(0, size - 1)) | (F.pmod("col", F.lit(size)).isin(0, size - 1))
    rim = found.where(edge).select(*by, "row", "col", "br__", "bc__", "local")
    # half of the neighbours will do: the others find their way back
    out = neighbours(rim, [(0, 1), (1, -1), (1, 0), (1, 1)]).where((F.floor(F.col("near_row") / size) != F.col("br__")) | (F.floor(F.col("near_col") / size) != F.col("bc__")))
    node = lambda name: F.to_json(F.struct(*by, F.col(name).alias("local")))
    other = rim.select(*by, F.col("row").alias("near_row"), F.col("col").alias("near_col"), F.col("local").alias("there"))
    links = staged(out.join(other, [*by, "near_row", "near_col"]).select(node("local").alias("a"), node("there").alias("b")).distinct(), "links")
    kept = [c for c in cells.columns if c != "component"]
    if not links.limit(1).count():
        return found.select(*kept, F.col("local").alias("component"))
    shape = StructType([*[cells.schema[c] for c in by], StructField("local", LongType())])
    roots = components(links).select(F.from_json("node", shape).alias("node"), F.from_json("root", shape)["local"].alias("root")).select("node.*", "root")
    return found.join(roots, [*by, "local"], "left").select(*kept, F.coalesce("root", "local").alias("component"))
