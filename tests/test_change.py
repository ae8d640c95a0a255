"""The change engine's rules, on series of classes written as letters: one letter a year, from 2018 on."""

import json
import random
from collections import Counter

from pyspark.sql import functions as F

from orrery.operators import change

KEYS = ("aoi", "tile_id")
#: What a letter stands for: the look's class and its shares of water, vegetation and open land.
LETTERS = {"w": ("water", 0.8, 0.15, 0.05), "v": ("vegetation", 0.05, 0.8, 0.15), "o": ("bare", 0.05, 0.15, 0.8), "x": ("mixed", 0.35, 0.35, 0.3)}
CLASSES = {"w": "water", "v": "vegetation", "o": "soil", "x": "mixed"}


def looks_of(spark, tiles, days=("01-20", "03-05", "05-11"), red_over_blue=None, satellites=("S2B", "S2A")):
    """Looks at tiles (name: letters), on the same days of every year, the satellites by turns."""
    rows = []
    for tile, letters in tiles.items():
        for year, letter in enumerate(letters, 2018):
            for n, day in enumerate(days):
                red = 0.05 * (red_over_blue or {}).get(year, 1.6)
                rows.append(("a", tile, f"{year}-{day}", f"{satellites[n % len(satellites)]}_T{n}_{year}-{day}", *LETTERS[letter], red, 0.05))
    return spark.createDataFrame(rows, "aoi string, tile_id string, date string, scene_id string, land_class string, water double, vegetation double, open double, red double, blue double")


def typical(spark, colours):
    return spark.createDataFrame([("a", y, t) for y, t in colours.items()], "aoi string, year int, typical double")


def changes(looks, colours=()):
    references = typical(looks.sparkSession, dict(colours))
    return change.transitions(change.split_open(change.composites(looks, KEYS), references, ["aoi"]), KEYS)


def best_split(letters):
    """The rule in words: try every split with two years on each side; the commonest classes must differ, be no
    mixture, hold for three quarters of their side, and the later one for the first and the last year after."""
    found = []
    kinds = [CLASSES[c] for c in letters]
    for k in range(2, len(kinds) - 1):
        before, after = kinds[:k], kinds[k:]
        old, new = (max((n, c) for c, n in Counter(side).items())[1] for side in (before, after))
        held = before.count(old) / len(before), after.count(new) / len(after)
        if old != new and "mixed" not in (old, new) and after[0] == after[-1] == new and min(held) >= 0.75:
            found.append((sum(held), -k, old, new))
    if found:
        _, k, old, new = max(found)
        return old, new, 2018 - k, -k
    return None


def test_transitions_as_the_rule_in_words(spark):
    rnd = random.Random(12)
    tiles = {f"t{i}": "".join(rnd.choice(["v", "w", "o", "x"]) * rnd.choice([1, 2, 3]) for _ in range(rnd.randint(1, 4))) for i in range(150)}
    got = {r.tile_id: (r.from_class, r.to_class, r.first_year_after, r.years_before) for r in changes(looks_of(spark, tiles)).collect()}
    want = {t: best_split(s) for t, s in tiles.items()}
    assert got == {t: w for t, w in want.items() if w} and 20 < len(got) < 130


def test_composites_take_the_dry_season_with_two_looks(spark):
    wet = looks_of(spark, {"t": "o"}, days=("08-01", "09-01"))
    dry = looks_of(spark, {"t": "vv"}).where("date <> '2019-03-05' and date <> '2019-05-11'")
    got = {r.year: r for r in change.composites(wet.union(dry), KEYS).collect()}
    assert (got[2018]["class"], got[2018].looks, got[2019]["class"], got[2019].water) == ("vegetation", 3, None, None)


def test_the_window_of_a_change(spark):
    looks = looks_of(spark, {"t": "vvvww"})
    r = change.refined(looks, changes(looks), KEYS).first()
    assert (r.last_clean_before, r.earliest_after, r.years_before, r.years_after, len(r.after_scene_ids)) == ("2020-05-11", "2021-01-20", 3, 2, 6)
    assert (round(r.share_before, 6), round(r.share_after, 6)) == (0.05, 0.8)


def test_open_land_is_split_by_its_own_year(spark):
    c = spark.createDataFrame([("a", 2020, "open", 1.3), ("a", 2021, "open", 1.3), ("a", 2022, "open", None), ("a", 2020, "water", 1.0)], "aoi string, year int, class string, red_blue double")
    refs = spark.createDataFrame([("a", 2020, 1.6), ("a", 2021, 1.35), ("a", 2022, 1.6)], "aoi string, year int, typical double")
    got = {(r.year, r.red_blue): r["class"] for r in change.split_open(c, refs, ["aoi"]).collect()}
    assert got == {(2020, 1.3): "built", (2021, 1.3): "soil", (2022, None): "soil", (2020, 1.0): "water"}


def test_pavement_is_told_by_colour_and_its_window_by_years(spark):
    colours = dict.fromkeys(range(2018, 2023), 1.6)
    looks = looks_of(spark, {"t": "ooooo"}, red_over_blue={2021: 1.1, 2022: 1.1})
    r = change.refined(looks, changes(looks, colours), KEYS).first()
    assert (r.from_class, r.to_class, r.last_clean_before, r.earliest_after) == ("soil", "built", "2020-05-11", "2021-01-20")
    assert abs(r.red_blue_before - r.red_blue_after - 0.5) < 1e-9


def gated(spark, letters, tiles=3, **how):
    found = changes(looks_of(spark, {f"a:0:{i}": letters for i in range(tiles)}, **how), dict.fromkeys(range(2018, 2024), 1.6))
    placed = found.withColumns({"row": F.lit(0), "col": F.element_at(F.split("tile_id", ":"), 3).cast("int")})
    r = change.gates(change.events(placed, ("aoi", "from_class", "to_class"))).first()
    return r, {g.gate for g in r.gates if not g.passed}


def test_gates_and_score(spark):
    r, failed = gated(spark, "vvwww")
    assert r.accepted and not failed and len(r.gates) == 6 and r.score == 1.0
    assert gated(spark, "vvww")[0].score == round((1 + 1 + 2 / 3 + 1) / 4, 3)  # two of three years
    assert gated(spark, "vvww", satellites=("S2B",))[1] == {"3 radiometric"}
    assert gated(spark, "vvww", tiles=1)[1] == {"5 size/shape"}
    r, failed = gated(spark, "oooo", red_over_blue={2020: 1.45, 2021: 1.45})
    assert failed == {"2 geometry"} and r.score == round((1 + 1 + 2 / 3 + 0.15 / 0.5) / 4, 3)


def test_classes_and_strips(spark):
    cases = {("water", "soil", False): ("water-extent", "contraction"), ("soil", "water", False): ("water-extent", "expansion"), ("soil", "built", True): ("road-development", "appearance"), ("soil", "built", False): ("construction", "appearance"), ("vegetation", "soil", False): ("clearance", "disappearance"), ("soil", "vegetation", False): ("other", "appearance"), ("built", "soil", False): ("other", "disappearance")}
    df = spark.createDataFrame(list(cases), "b string, a string, s boolean")
    assert {(r.b, r.a, r.s): (r.k["class"], r.k.direction) for r in df.withColumn("k", change.change_class(F.col("b"), F.col("a"), F.col("s"))).collect()} == cases
    e = spark.range(1).select(*[change.elongated(F.lit(h), F.lit(w), F.lit(n)) for h, w, n in ((1, 6, 6), (2, 2, 4), (6, 6, 6), (1, 3, 3))]).first()
    assert tuple(e) == (True, False, True, False)


def test_whole_engine(spark):
    tiles = {"a:3:4": "vvww", "a:3:5": "vvww", "a:4:4": "vvww", "a:7:1": "vvww", "a:9:9": "vvvv"}
    looks = looks_of(spark, tiles)
    square = json.dumps({"type": "Polygon", "coordinates": [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]})
    at = [(t, *map(int, t.split(":")[1:])) for t in tiles]
    placed = spark.createDataFrame([("a", t, r, c, float(c), float(r), square) for t, r, c in at], "aoi string, tile_id string, row int, col int, lon double, lat double, geometry string")
    got = {tuple(r.tile_ids): r for r in change.candidates(looks, placed).collect()}
    assert set(got) == {("a:3:4", "a:3:5", "a:4:4"), ("a:7:1",)}
    group, alone = got["a:3:4", "a:3:5", "a:4:4"], got[("a:7:1",)]
    assert (group.status, group.change_class, group.direction, group.area_m2, group.last_clean_before, group.earliest_supported_after) == ("accepted", "water-extent", "expansion", 30_000, "2019-05-11", "2020-01-20")
    assert alone.status == "suppressed" and group.id.startswith("chg-") and len(json.loads(group.geometry)["coordinates"]) == 3
    left = change.candidates(looks, placed, spark.createDataFrame([(group.id,)], "id string"))
    assert [r.id for r in left.collect()] == [alone.id]
    assert change.candidates(looks.where("date < '2021'"), placed).count() == 0
