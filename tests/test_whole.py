"""Queries that read whole tables: rows that a cap, a filter or a short list would lose."""

import datetime

import numpy as np
import pandas as pd
import pytest

from orrery.operators import governance, vectors
from orrery.queries import QUERIES


@pytest.fixture
def staged(spark, tmp_path):
    """Writes a table of rows under a folder that a query reads."""

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write


def test_audit_chain_behind_20000(spark, staged):
    keys = [*range(1, 1700), *range(4090, 4100), *range(19_400, 21_600), 30_000, 30_001, *range(65_530, 65_540)]
    day = datetime.date(2024, 1, 1)
    d = staged("orders", [(k, k % 7, day) for k in keys], "o_orderkey bigint, o_custkey bigint, o_orderdate date")
    assert sorted(r.id for r in QUERIES["audit_chain_verify"](spark, d).collect()) == [k for k in keys if k % 500 == 0]


def test_chain_over_ranges_of_ids(spark):
    rows, prev = [], governance.GENESIS
    for i in range(3 * governance.BLOCK):
        h = governance.entry_hash(prev, f"t{i}", "me", "look", None, None)
        rows.append((i, f"t{i}", "me", "look", None, None, prev, h))
        prev = h
    schema = "id bigint, at string, actor string, action string, target string, details string, prev_hash string, hash string"
    cut = governance.BLOCK * 2
    check = lambda r: sorted(tuple(x) for x in governance.verified_chain(spark.createDataFrame(r, schema)).collect())
    assert check(rows) == []
    assert check(rows[: cut - 1] + rows[cut:]) == [(cut, "broken link")]


def test_greedy_over_more_than_200(spark, staged):
    keys = range(1, 1401)
    d = staged("customer", [(k, k % 2, float(k * 37 % 911)) for k in keys], "c_custkey bigint, c_nationkey int, c_acctbal double")
    f = pd.DataFrame([(k % 2, k, 68 + k * 7919 % 2900 / 100, 8 + k * 104729 % 2900 / 100, float(k * 37 % 911)) for k in keys], columns=["nation", "id", "lon", "lat", "score"])
    want = pd.concat(vectors.spaced(g.sort_values(["score", "id"], ascending=[False, True]), 150_000.0) for _, g in f.groupby("nation"))
    got = [r.id for r in QUERIES["greedy_dedup"](spark, d).collect()]
    assert sorted(got) == sorted(want["id"]) and len(set(got)) == len(got)


@pytest.mark.parametrize("whole", [0, 20_000])
def test_spaced_per_group_anywhere(spark, monkeypatch, whole):
    monkeypatch.setattr(vectors, "WHOLE", whole)
    monkeypatch.setattr(vectors, "TASK", 500)
    rng = np.random.default_rng(3)
    rows = [(0, i, float(x), float(y), float(s)) for i, (x, y, s) in enumerate(zip(179 + 2 * rng.random(600), 66 + 2 * rng.random(600), rng.integers(0, 40, 600), strict=True))]
    rows += [(1, i, float(x), float(89 + y), float(i)) for i, (x, y) in enumerate(zip(360 * rng.random(300) - 180, rng.random(300), strict=True))]
    # a chain in which each row hangs on the one before, through many tiles; then rows without a place or a score.
    rows += [(2, i, i * 0.008, 0.0, -float(i)) for i in range(60)]
    rows += [(3, 0, None, 1.0, 1.0), (3, 1, 5.0, 1.0, None), (3, 2, 5.0, 1.0, 0.0), (None, 3, 5.0, 1.0, 0.0)]
    schema = "g int, id int, lon double, lat double, score double"
    got = sorted((str(r.g), r.id) for r in vectors.spaced_per_group(spark.createDataFrame(rows, schema), "g", 1000.0).collect())
    f = pd.DataFrame([r for r in rows if r[0] in (0, 1, 2)], columns=["g", "id", "lon", "lat", "score"])
    want = [(str(g), i) for g, x in f.groupby("g") for i in vectors.spaced(x.sort_values(["score", "id"], ascending=[False, True]), 1000.0)["id"]]
    assert got == sorted([*want, ("3", 0), ("3", 2), ("None", 3)])


def test_season_pairs_of_every_key(spark, staged):
    days = [(k, datetime.date(1992 + (k * i) % 5, 1 + (k * 7 + i * 5) % 12, 1 + i)) for k in range(1, 60) for i in range(8)]
    d = staged("orders", days, "o_custkey bigint, o_orderdate date")
    seen = {(k, day.year, day.month) for k, day in days}
    gap = lambda a, b: min(abs(a - b), 12 - abs(a - b))
    want = sorted((k, y, m, z, n) for k, y, m in seen for j, z, n in seen if j == k and y < z and gap(m, n) <= 1)
    got = sorted(tuple(r[c] for c in ("k", "y1", "m1", "y2", "m2")) for r in QUERIES["circular_month_gap_pairs"](spark, d).collect())
    assert got == want


def test_dates_of_odd_tiles(spark, staged):
    # tiles 0 to 15 of blocks 0 to 3, two dry-season looks and one in the monsoon a year
    looks = [(4 * t, datetime.date(y, m, 1 + t), i, 0.01, 0.01, 1.0) for t in range(16) for y in range(1995, 2002) for i, m in enumerate((2, 4, 8), 1)]
    d = staged("lineitem", looks, "l_partkey bigint, l_shipdate date, l_linenumber int, l_discount double, l_tax double, l_quantity double")
    want = []
    for t in range(16):
        block = t // 4
        kinds = {0: ("vegetation", "water"), 1: ("vegetation", "soil"), 2: ("soil", "built")}
        year = 1997 + block % 3
        if block in kinds:
            want.append((t, *kinds[block], f"{year - 1}-04-{1 + t:02d}", f"{year}-02-{1 + t:02d}"))
    got = QUERIES["refine_dates"](spark, d).select("tile_id", "from_class", "to_class", "last_clean_before", "earliest_after")
    assert sorted(tuple(r) for r in got.collect()) == want


def test_places_of_every_region_and_nation(spark, staged):
    staged("region", [(i, n) for i, n in enumerate(("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"))], "r_regionkey int, r_name string")
    staged("nation", [(0, "FRANCE", 3), (1, "UNITED STATES", 1), (2, "UNITED KINGDOM", 3), (3, "INDIA", 2)], "n_nationkey int, n_name string, n_regionkey int")
    texts = ["Ships left the Middle-East, then Asia.", "from FRANCE of the north", "United States, not India", "united kingdoms and Indiana", "the africa", "", None, "and the", "Asia", "united", "in europe", "the america"]
    d = staged("documents", list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.place for r in QUERIES["place_in_text"](spark, d).collect()}
    assert got == {0: "the middle east", 1: "of the", 2: "united states", 4: "the africa", 7: "and the", 8: "asia", 10: "europe", 11: "the america"}
