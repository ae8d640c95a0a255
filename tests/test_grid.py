import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from orrery.operators import change, grid


def flood(cells):
    """Components of places, one place after the other."""
    left, out = set(cells), {}
    for start in sorted(cells):
        if start in left:
            left.discard(start)
            front = [start]
            while front:
                r, c = front.pop()
                out[r, c] = start
                for p in [(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                    if p in left:
                        left.discard(p)
                        front.append(p)
    return out


@pytest.mark.parametrize(("block", "share"), [(4, 0.4), (7, 0.3), (256, 0.4)])
def test_components_of_cells(spark, block, share):
    rnd = random.Random(block)
    cells = {k: {(r, c) for r in range(-20, 25) for c in range(-15, 20) if rnd.random() < share} for k in ("x", "y")}
    cells["y"] |= {(0, c) for c in range(-100, 100)}  # a long line through many blocks
    df = spark.createDataFrame([(k, r, c, f"{r}") for k, s in cells.items() for r, c in s], "kind string, row int, col int, component string")
    got = defaultdict(dict)
    for x in grid.labelled(df, ["kind"], block).collect():
        got[x.kind][x.row, x.col] = x.component
    for k, s in cells.items():
        want = flood(s)
        assert got[k].keys() == s
        pairs = {(want[p], got[k][p]) for p in s}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_links_in_rounds(spark, monkeypatch):
    links = [(i, i + 1) for i in range(40)] + [(100, 50), (7, 60), (200, 201), (201, 202), (202, 200)]
    df = spark.createDataFrame([(f"{a:03d}", f"{b:03d}") for a, b in links], "a string, b string")
    at_once = {r.node: r.root for r in grid.components(df).collect()}
    assert at_once == {r.node: r.root for r in grid.components(df, few=0).collect()}
    assert at_once["040"] == at_once["060"] == "000" and at_once["100"] == "050" and at_once["202"] == "200"


def test_no_cells(spark):
    assert grid.labelled(spark.createDataFrame([], "kind string, row int, col int"), ["kind"]).count() == 0


def grown(tiles):
    """The sequential rule: seeds in the order of ids, breadth first."""
    at = {(t["row"], t["col"]): t for t in tiles}
    seed_of = {}
    for t in sorted(tiles, key=lambda t: t["tile_id"]):
        if t["tile_id"] in seed_of:
            continue
        seed_of[t["tile_id"]] = t["tile_id"]
        queue = deque([t])
        while queue:
            here = queue.popleft()
            for i in (-1, 0, 1):
                for j in (-1, 0, 1):
                    near = at.get((here["row"] + i, here["col"] + j))
                    if near and near["tile_id"] not in seed_of and near["kind"] == t["kind"] and abs(near["year"] - t["year"]) <= 1:
                        seed_of[near["tile_id"]] = t["tile_id"]
                        queue.append(near)
    return seed_of


def tiles_of(seed, height, width, share, years, kinds=1):
    rnd = random.Random(seed)
    return [{"row": r, "col": c, "kind": rnd.randrange(kinds), "year": 2018 + rnd.randrange(years), "tile_id": f"a:{r}:{c}"} for r in range(height) for c in range(width) if rnd.random() < share]


def seeds(spark, tiles, **how):
    df = spark.createDataFrame([("a", t["tile_id"], t["row"], t["col"], "open", f"k{t['kind']}", t["year"]) for t in tiles], "aoi string, tile_id string, row int, col int, from_class string, to_class string, year int")
    rows = change.grouped(df, **how).collect()
    assert len(rows) == len(tiles)
    return {r.tile_id: r.seed for r in rows}


@pytest.mark.parametrize("how", [{}, {"most": 60, "block": 8}])
def test_groups_as_the_sequential_rule(spark, how):
    tiles = tiles_of(1, 24, 20, 0.8, 4, 2)
    assert seeds(spark, tiles, **how) == grown(tiles)


def test_groups_of_a_large_area(spark):
    tiles = tiles_of(7, 600, 600, 0.3, 6)
    assert len(tiles) > 100_000
    assert seeds(spark, tiles, most=20_000, block=128) == grown(tiles)
