"""From a plan to rows: what can be answered, where, and the DataFrame that answers it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import geo
from orrery.operators import spatial, timeline, vectors
from orrery.plans import vocabulary as v
from orrery.plans.parser import Plan

EVENT_CAP, ENTITY_CAP, CHANGE_CAP, IMAGE_CAP, RELATED_M, SPACING_M = 200, 200, 100, 30, 50_000.0, 300.0


@dataclass(frozen=True)
class Area:
    """Where a plan looks: everywhere, a circle, or a polygon."""

    kind: str
    lon: float | None = None
    lat: float | None = None
    radius_m: float | None = None
    polygons: list | None = None

    def contains(self, lon: Column, lat: Column) -> Column:
        """A box that Parquet can prune by, then the exact test."""
        if self.kind == "operating-area":
            return F.lit(True)
        if self.kind == "circle":
            return geo.in_bbox(lon, lat, *geo.circle_bbox(self.lon, self.lat, self.radius_m)) & (geo.haversine(lon, lat, self.lon, self.lat) <= self.radius_m)
        xs, ys = zip(*[q for p in self.polygons for q in p[0]], strict=True)
        point = lambda q: F.struct(F.lit(float(q[0])).alias("x"), F.lit(float(q[1])).alias("y"))
        shape = F.array(*[F.array(*[F.array(*map(point, ring)) for ring in p]) for p in self.polygons])
        return geo.in_bbox(lon, lat, min(xs), min(ys), max(xs), max(ys)) & geo.in_multipolygon(lon, lat, shape)


def area_of(plan: Plan, polygons: dict[str, list] | None = None) -> Area | None:
    """None if the plan names a place that has neither a point nor a polygon."""
    place = plan.place
    if not place:
        return Area("operating-area")
    if place.get("kind") in ("state", "district") and place["name"] in (polygons or {}) and not (plan.distance and not plan.distance["assumed"]):
        return Area("polygon", polygons=polygons[place["name"]])
    if place.get("lon") is None:
        return None
    return Area("circle", place["lon"], place["lat"], float((plan.distance or {}).get("value_m") or v.RADIUS_M))


@dataclass
class Capability:
    issues: list[str] = field(default_factory=list)
    not_staged: list[str] = field(default_factory=list)
    partial: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    @property
    def state(self) -> str:
        return "UNSUPPORTED" if self.issues else "NOT STAGED" if self.not_staged else "PARTIAL" if self.partial else "SUPPORTED"

    @property
    def supported(self) -> bool:
        return not (self.issues or self.not_staged)


def capability(plan: Plan, sources: dict[str, str], staged: dict[str, int]) -> Capability:
    """Whether the staged data can answer. sources: id -> freshness state; staged: counts of scenes, chips and records by type."""
    c = Capability()
    if plan.intent == "unknown":
        c.issues.append("The question was not understood well enough to search.")
    if plan.unrecognised:
        c.warnings.append("Ignored words: " + ", ".join(plan.unrecognised))
    if plan.place and plan.place.get("kind") == "map-selection" and plan.place.get("lon") is None:
        c.issues.append("Nothing is selected on the map.")
    kinds = {"find-events": ("types", v.EVENT_SOURCES), "find-entities": ("types", v.ENTITY_SOURCES)}.get(plan.intent)
    for kind in plan.target["types"] if kinds else ():
        providers = kinds[1].get(kind)
        if not providers:
            c.issues.append(f"No source provides '{kind}'.")
            continue
        for s in providers if plan.intent == "find-events" else ():
            state = sources.get(s, "NOT STAGED")
            if state in ("KEY REQUIRED", "UNAVAILABLE", "NOT STAGED", "NOT IMPLEMENTED"):
                c.partial.append(f"'{kind}' source {s} is {state}.")
            elif state == "STALE":
                c.warnings.append(f"{s} is stale.")
    if plan.intent in ("find-changes", "find-similar"):
        if not staged.get("scenes"):
            c.issues.append("No imagery is staged.")
        if plan.sensor not in (None, "sentinel-2"):
            c.issues.append(f"Sensor '{plan.sensor}' is not staged.")
        if plan.intent == "find-similar" and not plan.examples:
            if staged.get("chips") and by_image(plan):
                c.warnings.append("Images are compared as a model sees them: what looks alike need not be the same.")
            else:
                c.issues.append("Similarity needs example sites.")
    if plan.intent == "search-imagery":
        if not plan.semantic_text:
            c.issues.append("No image description given.")
        elif not staged.get("chips"):
            c.not_staged.append("No image index is staged.")
    if plan.reference and plan.reference["kind"].startswith("campus:"):
        c.not_staged.append(plan.reference["note"])
    elif plan.reference and plan.reference["kind"] in ("coast", "road", "railway") and plan.intent != "find-changes":
        c.warnings.append(f"A relation to '{plan.reference['kind']}' is not applied to this search.")
    if plan.operation and plan.operation["status"] == "NOT STAGED":
        if plan.operation["fallback"] and plan.intent in ("find-changes", "find-similar"):
            c.partial.append(f"{plan.operation['name']} is not staged; rules are used instead: {plan.operation['fallback']}.")
        elif plan.intent == "analyse-imagery" or (not plan.operation["fallback"] and plan.intent in ("find-changes", "find-similar", "search-imagery")):
            c.not_staged.append(f"{plan.operation['name']} is not staged.")
    return c


def by_image(plan: Plan) -> bool:
    """Whether "like this place" can be asked of image chips: a place is selected, in the default study area."""
    place = plan.place or {}
    return place.get("kind") == "map-selection" and place.get("lon") is not None and (plan.study_area or {}).get("level", "country") == "country"


def reasons(*parts: Column) -> Column:
    """The reasons that hold."""
    return F.filter(F.array(*parts), lambda r: r.isNotNull())


def search_events(plan: Plan, events: DataFrame, area: Area) -> DataFrame:
    """Matching events, nearest first in a circle, else newest first, with reasons; at most EVENT_CAP."""
    t = plan.time or {}
    rows = events.where(F.col("type").isin(plan.target["types"]) & timeline.within(F.col("start_time"), t.get("start"), t.get("end")))
    least = plan.filters.get("min_magnitude")
    if least:
        rows = rows.where(F.coalesce(F.get_json_object("attributes", "$.magnitude").try_cast("double"), F.lit(0.0)) >= least["value"])
    rows = rows.where(area.contains(F.col("lon"), F.col("lat")))
    far = geo.haversine(F.col("lon"), F.col("lat"), area.lon, area.lat) if area.kind == "circle" else F.lit(None).cast("double")
    why = reasons(
        F.format_string("type is %s", F.col("type")),
        F.when(F.lit(bool(t.get("start"))), F.concat(F.lit("starts at or after "), F.lit(t.get("start") or ""))),
        F.when(F.col("distance_m").isNotNull(), F.format_string("%.1f km away", F.col("distance_m") / 1000)),
        F.when(F.lit(bool(least)), F.lit("magnitude is high enough")),
    )
    return rows.withColumn("distance_m", far).withColumn("why", why).orderBy(F.col("distance_m").asc_nulls_last(), F.desc("start_time"), "id").limit(EVENT_CAP)


def search_entities(plan: Plan, entities: DataFrame, area: Area) -> DataFrame:
    rows = entities.where(F.col("type").isin(plan.target["types"]) & area.contains(F.col("lon"), F.col("lat")))
    far = geo.haversine(F.col("lon"), F.col("lat"), area.lon, area.lat) if area.kind == "circle" else F.lit(None).cast("double")
    why = reasons(F.format_string("type is %s", F.col("type")), F.when(F.col("distance_m").isNotNull(), F.format_string("%.1f km away", F.col("distance_m") / 1000)))
    return rows.withColumn("distance_m", far).withColumn("why", why).orderBy(F.coalesce("distance_m", F.lit(0.0)), "name", "id").limit(ENTITY_CAP)


def search_changes(plan: Plan, candidates: DataFrame, area: Area, water: DataFrame | None = None, events: DataFrame | None = None) -> DataFrame:
    """Change candidates by score; with related events, those with more of them first."""
    rows = candidates if plan.include_suppressed else candidates.where("accepted")
    if plan.change["class"] != "any":
        rows = rows.where(F.col("class") == plan.change["class"])
    if plan.change["direction"]:
        rows = rows.where(F.col("direction") == plan.change["direction"])
    t = plan.time or {}
    rows = rows.where(timeline.within(F.col("earliest_after"), t.get("start"), t.get("end")))
    if plan.reference and plan.reference["kind"] in ("river", "lake") and water is not None:
        limit = None if plan.distance is None or (plan.distance["assumed"] and area.kind == "circle") else plan.distance["value_m"]
        rows = spatial.water_distance(rows, water, limit)
        area = Area("operating-area") if area.kind == "circle" and plan.distance and not plan.place else area
    rows = rows.where(area.contains(F.col("lon"), F.col("lat")))
    if plan.related_events and events is not None:
        rows = spatial.related(rows, events.where(F.col("type").isin(plan.related_events["types"])), RELATED_M)
        return rows.orderBy(F.desc(F.size("related")), F.desc("score"), "id").limit(CHANGE_CAP)
    return rows.orderBy(F.desc("score"), "id").limit(CHANGE_CAP)


def _ranked_chips(plan: Plan, chips: DataFrame, query: list[float], what: str) -> DataFrame:
    """The IMAGE_CAP chips most similar to a vector, inside the plan's time (both ends included), with reasons."""
    t = plan.time or {}
    rows = chips.where(F.lit(True) if not t.get("start") else F.col("acquired_at") >= t["start"])
    rows = rows.where(F.lit(True) if not t.get("end") else F.col("acquired_at") <= t["end"])
    why = F.array(F.lit(what), F.format_string("cosine similarity %.3f, no probability", F.col("score")))
    return vectors.top_k(rows, query, IMAGE_CAP).withColumn("score", F.round("score", 4)).withColumns({"kind": F.lit("chip"), "evidence_type": F.lit("MODEL SIMILARITY"), "why": why})


def search_imagery(plan: Plan, chips: DataFrame, encode: Callable[[str], list[float]]) -> DataFrame:
    """Image chips by their similarity to the plan's description. encode: a text encoder that shares the chips' space.

    chips: id, lon, lat, acquired_at, place, half_deg and embedding (unit vectors).
    """
    return _ranked_chips(plan, chips, encode(plan.semantic_text), f"like '{plan.semantic_text}'")


def search_similar_images(plan: Plan, chips: DataFrame) -> DataFrame | None:
    """Chips that look like the one at the selected place, from other places; None if none lies there.

    The chip there is the smallest that covers the point, then the newest.
    """
    lon, lat = plan.place["lon"], plan.place["lat"]
    there = chips.where((F.abs(F.col("lon") - lon) <= F.col("half_deg")) & (F.abs(F.col("lat") - lat) <= F.col("half_deg")))
    example = there.orderBy("half_deg", F.desc("acquired_at"), "id").limit(1).collect()
    if not example:
        return None
    return _ranked_chips(plan, chips.where(~F.col("place").eqNullSafe(F.lit(example[0].place))), list(example[0].embedding), f"like {example[0].id}")


def search_similar(plan: Plan, tiles: DataFrame, features: list[str], rejected: list[str] = (), most: int = 10) -> DataFrame | None:
    """Tiles like the plan's examples in standardised features, away from rejected ones, none within 300 m of a better one or of an example."""
    examples, rejected = list(plan.examples), list(rejected)
    z = vectors.standard_embedding(tiles, features)
    query = vectors.example_query(z, F.col("id").isin(examples), F.col("id").isin(rejected), "features") if examples else None
    if query is None:
        return None
    given = F.col("id").isin(examples + rejected)
    scored = z.withColumn("score", vectors.cosine("features", query))
    near = spatial.proximity(scored.where(~given), scored.where(given), SPACING_M).select(F.col("a").alias("id")).distinct()
    open_ = scored.where(~given).join(near, "id", "left_anti").withColumn("all__", F.lit(0))
    kept = vectors.spaced_per_group(open_.select("all__", "id", "lon", "lat", "score"), "all__", SPACING_M)
    best = kept.orderBy(F.desc("score"), "id").limit(most)
    return best.drop("all__").withColumn("score", F.round("score", 3)).withColumn("why", F.array(F.lit("similar in standardised features; no probability")))


def located(plan: Plan, spark: SparkSession) -> DataFrame:
    """The place itself, from the gazetteer."""
    p = plan.place
    row = ("place", p["name"], p["name"], p.get("kind"), p.get("lon"), p.get("lat"), p.get("bbox"), "GIS-DERIVED", ["gazetteer match"])
    return spark.createDataFrame([row], "kind string, id string, title string, type string, lon double, lat double, bbox array<double>, evidence_type string, why array<string>")


def needs(plan: Plan, capabilities: DataFrame) -> DataFrame:
    """The capability that an analysis of imagery asks for, with its state: what is staged and what stands in for it."""
    return capabilities.where(F.col("id") == plan.operation["id"]).withColumn("why", F.array(F.lit("named by the question")))


def run(
    plan: Plan,
    tables: dict[str, DataFrame],
    sources: dict[str, str] | None = None,
    staged: dict[str, int] | None = None,
    polygons: dict[str, list] | None = None,
    encode: Callable[[str], list[float]] | None = None,
) -> dict:
    """plan, capability, area and rows (None where nothing can be answered).

    tables, as far as the intents asked for need them: events, entities, changes, water, chips, tiles (with
    the feature columns named in ``staged["features"]``), capabilities. encode: the text encoder of chips.
    """
    staged = staged or {}
    c = capability(plan, sources or {}, staged)
    area = area_of(plan, polygons)
    if area is None and plan.intent != "locate":
        c.issues.append(f"'{plan.place['name']}' has neither a point nor a polygon.")
    if plan.intent == "search-imagery" and encode is None:
        c.not_staged.append("No text encoder is staged.")
    answers: dict[str, Callable[[], DataFrame | None]] = {
        "find-events": lambda: search_events(plan, tables["events"], area),
        "find-entities": lambda: search_entities(plan, tables["entities"], area),
        "find-changes": lambda: search_changes(plan, tables["changes"], area, tables.get("water"), tables.get("events")),
        "find-similar": lambda: search_similar(plan, tables["tiles"], staged["features"], staged.get("rejected", ())) if plan.examples else search_similar_images(plan, tables["chips"]),
        "search-imagery": lambda: search_imagery(plan, tables["chips"], encode),
        "analyse-imagery": lambda: needs(plan, tables["capabilities"]) if "capabilities" in tables else None,
        "locate": lambda: located(plan, SparkSession.active()),
    }
    rows = answers[plan.intent]() if c.supported and plan.intent in answers else None
    return {"plan": plan.as_dict(), "capability": c, "area": area, "rows": rows}
