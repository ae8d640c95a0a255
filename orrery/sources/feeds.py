"""Feeds as projections: raw JSON or CSV in, normalised events or entities out.

Every reader takes a path that Spark can open, reads with an explicit schema, and gives the columns of
``EVENT`` or ``ENTITY``. Values that a feed lacks stay null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "source_id record_id type category title start_time end_time status evidence_type lon lat scope attributes".split()
ENTITY = "source_id record_id type category name lon lat attributes".split()
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def feed(name: str) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        READERS[name] = f
        return f

    return register


def read(spark: SparkSession, name: str, path: str) -> DataFrame:
    """The records of a feed's snapshot."""
    if name not in READERS:
        raise ValueError(f"no adapter for feed '{name}'")
    return READERS[name](spark, path)


def iso_seconds(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso_text(text: Column, assume_utc: bool = False) -> Column:
    """ISO UTC of a zoned text; one without a zone counts only where it is documented as UTC."""
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    plain = F.date_format(F.to_utc_timestamp(F.try_to_timestamp(text), F.lit("UTC")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    with_zone = F.date_format(F.try_to_timestamp(text), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.when(zoned, with_zone).when(F.lit(assume_utc), plain)


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def _whole_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """_json of documents of which parts or numbers stay texts: for each such one, a reader of files would go back into the file."""
    whole = spark.read.text(path, wholetext=True).select(F.ltrim("value", F.lit("\ufeff")).alias("value"))
    return whole.select(F.from_json("value", schema).alias("document")).select("document.*")


def _event(df: DataFrame, source: str, **columns: Column) -> DataFrame:
    base = {"source_id": F.lit(source), "end_time": F.lit(None).cast("string"), "status": F.lit(None).cast("string"), "evidence_type": F.lit("OBSERVED"), "scope": F.lit("spatial"), "lon": F.lit(None).cast("double"), "lat": F.lit(None).cast("double"), "attributes": F.lit("{}")}
    return df.select(*[(base | columns)[c].alias(c) for c in EVENT])


def _entity(df: DataFrame, source: str, **columns: Column) -> DataFrame:
    return df.select(*[({"source_id": F.lit(source), "attributes": F.lit("{}")} | columns)[c].alias(c) for c in ENTITY])


def _facts(**columns: Column) -> Column:
    """Attributes as JSON; what a record lacks stays, as null."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in columns.items()]), {"ignoreNullFields": "false"})


def _said(value: Column) -> Column:
    """A value inside an id or a title, where one that is absent reads None."""
    return F.coalesce(value.cast("string"), F.lit("None"))


def _or(*values: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def _place(geometry: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a GeoJSON geometry as text: of its point, or the middle of its box."""
    points = F.transform(F.regexp_extract_all(F.get_json_object(geometry, "$.coordinates"), F.lit(r"\[\s*(-?[\d.eE+-]+)\s*,\s*-?[\d.eE+-]+"), 1), lambda x: x.cast("double"))
    others = F.transform(F.regexp_extract_all(F.get_json_object(geometry, "$.coordinates"), F.lit(r"\[\s*-?[\d.eE+-]+\s*,\s*(-?[\d.eE+-]+)"), 1), lambda x: x.cast("double"))
    middle = lambda v: (F.array_min(v) + F.array_max(v)) / 2
    return middle(points), middle(others)


@feed("earthquakes")
def earthquakes(spark: SparkSession, path: str) -> DataFrame:
    """What a seismologist has reviewed is a verified record, the rest observed."""
    f = _whole_json(spark, path, "features array<struct<id:string,geometry:struct<coordinates:array<double>>,properties:struct<mag:string,place:string,time:bigint,status:string,magType:string,url:string,tsunami:bigint,alert:string>>>")
    f = f.select(F.explode("features").alias("f")).select("f.*")
    p = lambda n: F.col(f"properties.{n}")
    return _event(
        f, "earthquakes", record_id=F.col("id"), type=F.lit("earthquake"), category=F.lit("DISASTERS"),
        title=F.concat(F.lit("M"), _said(p("mag")), F.lit(" earthquake - "), F.coalesce(_or(p("place")), F.lit("location text not given"))),
        start_time=iso_seconds(p("time") / 1000), status=p("status"), evidence_type=F.when(p("status") == "reviewed", "VERIFIED RECORD").otherwise("OBSERVED"),
        lon=F.get("geometry.coordinates", 0), lat=F.get("geometry.coordinates", 1),
        attributes=_facts(magnitude=p("mag").try_cast("double"), magnitude_type=p("magType"), depth_km=F.get("geometry.coordinates", 2), tsunami_flag=p("tsunami"), alert=p("alert"), source_url=p("url")),
    )


#: Type and group of natural events by category, and of disaster alerts by code.
NATURAL = {
    "wildfires": ("wildfire", "ENVIRONMENT"), "floods": ("flood", "DISASTERS"), "severeStorms": ("severe-storm", "WEATHER"), "volcanoes": ("volcano", "DISASTERS"),
    "landslides": ("landslide", "DISASTERS"), "earthquakes": ("earthquake", "DISASTERS"), "drought": ("drought", "ENVIRONMENT"), "dustHaze": ("dust-haze", "ENVIRONMENT"),
    "seaLakeIce": ("sea-lake-ice", "ENVIRONMENT"), "snow": ("snow", "WEATHER"), "tempExtremes": ("temperature-extreme", "WEATHER"), "waterColor": ("water-colour", "ENVIRONMENT"), "manmade": ("manmade", "PUBLIC EVENTS"),
}
ALERTS = {"EQ": ("earthquake", "DISASTERS"), "TC": ("cyclone", "WEATHER"), "FL": ("flood", "DISASTERS"), "DR": ("drought", "ENVIRONMENT"), "WF": ("wildfire", "ENVIRONMENT"), "VO": ("volcano", "DISASTERS")}
#: Sources of outage signals, and names of how sure a fire is.
SIGNALS = {"bgp": "BGP routing visibility", "ping-slash24": "Active probing", "merit-nt": "Network telescope", "gtr": "Google Transparency Report traffic", "gtr-norm": "Google traffic (normalised)"}
CONFIDENCE = {"l": "low", "n": "nominal", "h": "high"}


def _lookup(key: Column, values: dict[str, str], default: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), default)


def _kind(key: Column, values: dict[str, tuple[str, str]], default: tuple[str, str]) -> tuple[Column, Column]:
    return tuple(_lookup(key, {k: v[i] for k, v in values.items()}, F.lit(default[i])) for i in range(2))


@feed("natural-events")
def natural_events(spark: SparkSession, path: str) -> DataFrame:
    """The latest geometry says where, the first one since when."""
    f = _whole_json(spark, path, "events array<struct<id:string,title:string,closed:string,link:string,categories:array<struct<id:string>>,sources:array<struct<id:string,url:string>>,geometry:array<string>>>")
    f = f.select(F.explode("events").alias("e")).select("e.*").where(F.size("geometry") > 0)
    last, group = F.element_at("geometry", -1), F.coalesce(F.get("categories", 0)["id"], F.lit("other"))
    kind, category = _kind(group, NATURAL, ("natural-event", "DISASTERS"))
    lon, lat = _place(last)
    closed = _or(F.col("closed"))
    return _event(
        f, "natural-events", record_id=F.col("id"), type=kind, category=category, title=F.col("title"),
        start_time=iso_text(F.get_json_object(F.get("geometry", 0), "$.date"), True), end_time=iso_text(closed, True), status=F.when(closed.isNull(), "open").otherwise("closed"), lon=lon, lat=lat,
        attributes=_facts(
            eonet_category=group, magnitude=F.get_json_object(last, "$.magnitudeValue").try_cast("double"), magnitude_unit=F.get_json_object(last, "$.magnitudeUnit"), geometry_count=F.size("geometry"),
            upstream_sources=F.coalesce(F.transform("sources", lambda s: s["id"]), F.array().cast("array<string>")), source_url=F.col("link"),
        ),
    )


@feed("disaster-alerts")
def disaster_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Levels are estimates of a model, so alerts are inferred; their times are in UTC."""
    f = _whole_json(spark, path, "features array<struct<geometry:string,properties:struct<eventtype:string,eventid:string,episodeid:string,name:string,description:string,alertlevel:string,alertscore:double,country:string,source:string,fromdate:string,todate:string,iscurrent:string,url:struct<report:string>>>>")
    f = f.select(F.explode("features").alias("f")).select("f.*")
    p = lambda n: F.col(f"properties.{n}")
    kind, category = _kind(p("eventtype"), ALERTS, ("disaster-alert", "DISASTERS"))
    lon, lat = _place(F.col("geometry"))
    return _event(
        f, "disaster-alerts", record_id=F.concat_ws("-", *[_said(p(n)) for n in ("eventtype", "eventid", "episodeid")]), type=kind, category=category,
        title=F.coalesce(_or(p("name"), p("description")), F.lit("GDACS alert")), start_time=iso_text(p("fromdate"), True), end_time=iso_text(p("todate"), True),
        status=F.when(p("iscurrent") == "true", "current").otherwise("past"), evidence_type=F.lit("INFERRED"), lon=lon, lat=lat,
        attributes=_facts(alert_level=p("alertlevel"), alert_score=p("alertscore"), country=p("country"), upstream_source=p("source"), source_url=p("url.report")),
    )


@feed("aircraft")
def aircraft(spark: SparkSession, path: str) -> DataFrame:
    """Positional arrays; a time of 0 counts as absent."""
    f = _json(spark, path, "time bigint, states array<array<string>>").select("time", F.explode("states").alias("s"))
    at = lambda i: F.get("s", i)
    num = lambda i: at(i).try_cast("double")
    f = f.where(num(5).isNotNull() & num(6).isNotNull())
    seen, sign = F.coalesce(F.nullif(num(3), F.lit(0.0)), num(4)), _or(F.trim(at(1)))
    return _event(
        f, "aircraft", record_id=at(0), type=F.lit("aircraft-position"), category=F.lit("AVIATION"), title=F.concat(F.lit("Aircraft "), F.coalesce(sign, _said(at(0)))), start_time=iso_seconds(seen),
        status=F.when(at(8).try_cast("boolean"), "on-ground").otherwise("airborne"), lon=num(5), lat=num(6),
        attributes=_facts(icao24=at(0), callsign=sign, origin_country=at(2), baro_altitude_m=num(7), velocity_m_s=num(9), track_deg=num(10), vertical_rate_m_s=num(11)),
    )


#: What is asked about the weather of a city.
WEATHER = ("temperature_2m", "relative_humidity_2m", "precipitation", "cloud_cover", "pressure_msl", "wind_speed_10m", "wind_direction_10m", "weather_code")


@feed("weather")
def weather(spark: SparkSession, path: str) -> DataFrame:
    """Cities and responses come as parallel arrays; what a model says is inferred. A record for each city and time."""
    fields, units = (",".join(f"{c}:string" for c in ("time", *WEATHER)), ",".join(f"{c}:string" for c in ("time", *WEATHER)))
    f = _whole_json(spark, path, f"cities array<struct<name:string,state:string,coordinates:array<double>>>, response array<struct<current:struct<{fields}>,current_units:struct<{units}>>>")
    both = F.least(F.size("cities"), F.size("response"))
    f = f.select(F.explode(F.arrays_zip(F.slice("cities", 1, both).alias("city"), F.slice("response", 1, both).alias("told"))).alias("z")).select("z.city", "z.told.current", F.col("z.told.current_units").alias("units"))
    now = lambda c: F.col(f"current.{c}")
    unit = lambda c: F.coalesce(F.col(f"units.{c}"), F.lit(""))
    return _event(
        f, "weather", record_id=F.concat(_said(F.col("city.name")), F.lit("-"), _said(now("time"))), type=F.lit("weather-current"), category=F.lit("WEATHER"),
        title=F.concat(_said(F.col("city.name")), F.lit(": "), _said(now("temperature_2m")), unit("temperature_2m"), F.lit(", wind "), _said(now("wind_speed_10m")), F.lit(" "), unit("wind_speed_10m")),
        start_time=iso_text(now("time"), True), status=F.lit("model-analysis"), evidence_type=F.lit("INFERRED"), lon=F.get("city.coordinates", 0), lat=F.get("city.coordinates", 1),
        attributes=_facts(**{c: now(c).try_cast("double") for c in WEATHER}, units=F.col("units"), city=F.col("city.name"), state=F.col("city.state")),
    )


@feed("outages")
def outages(spark: SparkSession, path: str) -> DataFrame:
    """Anomalies about the country as a whole; a start and a duration make an interval."""
    f = _json(spark, path, "data array<struct<datasource:string,start:bigint,duration:bigint,method:string,score:double>>").select(F.explode("data").alias("d")).select("d.*")
    lasting = F.coalesce("duration", F.lit(0))
    name = _said(_lookup(F.col("datasource"), SIGNALS, F.col("datasource")))
    return _event(
        f, "outages", record_id=F.concat(_said(F.col("datasource")), F.lit("-"), _said(F.col("start"))), type=F.lit("internet-outage-signal"), category=F.lit("CONNECTIVITY"),
        title=F.concat(F.lit("Internet outage signal in India ("), name, F.lit(")")), start_time=iso_seconds(F.col("start")), end_time=F.when(F.col("start") != 0, iso_seconds(F.col("start") + lasting)),
        status=F.lit("detected"), evidence_type=F.lit("INFERRED"), scope=F.lit("national"), attributes=_facts(datasource=F.col("datasource"), method=F.col("method"), ioda_score=F.col("score"), duration_s=lasting),
    )


@feed("kp-index")
def kp_index(spark: SparkSession, path: str) -> DataFrame:
    """Either a table whose first row names its columns, or objects."""
    from orrery.functions.text import fixed

    raw = spark.read.text(path, wholetext=True)
    items = raw.select(F.from_json("value", "array<string>").alias("items")).where(F.size("items") > 0)
    header = F.from_json(F.get("items", 0), "array<string>")
    rows = items.select(F.when(F.get("items", 0).startswith("["), header).alias("header"), F.posexplode("items").alias("i", "r")).where("header is null or i > 0")
    cells = F.from_json("r", "array<string>")
    of = lambda n: F.when(F.col("header").isNull(), F.get_json_object("r", f"$.{n}")).otherwise(F.get(cells, F.array_position("header", n).cast("int") - 1))
    f = rows.select(of("time_tag").alias("t"), of("Kp").try_cast("double").alias("kp"), of("station_count").alias("stations")).where("kp is not null")
    return _event(
        f, "kp-index", record_id=F.col("t"), type=F.lit("geomagnetic-kp"), category=F.lit("SPACE"), title=F.concat(F.lit("Planetary Kp "), fixed(F.col("kp"), 2, even=True), F.when(F.col("kp") >= 5, " (storm level)").otherwise("")),
        start_time=iso_text(F.replace("t", F.lit(" "), F.lit("T")), True), status=F.lit("observed"), scope=F.lit("global"), attributes=_facts(kp=F.col("kp"), station_count=F.col("stations")),
    )


@feed("launches")
def launches(spark: SparkSession, path: str) -> DataFrame:
    """Launches to come and past ones, two documents in one snapshot, where their pads are."""
    named = "struct<name:string>"
    one = f"array<struct<id:string,name:string,net:string,url:string,status:struct<name:string,abbrev:string,description:string>,net_precision:{named},launch_service_provider:{named},mission:{named},pad:struct<name:string,longitude:string,latitude:string>>>"
    f = _json(spark, path, f"upcoming struct<results:{one}>, previous struct<results:{one}>")
    both = f.select(F.explode("upcoming.results").alias("l"), F.lit(True).alias("upcoming")).unionByName(f.select(F.explode("previous.results").alias("l"), F.lit(False).alias("upcoming")))
    both = both.where(F.col("l.pad.longitude").try_cast("double").isNotNull() & F.col("l.pad.latitude").try_cast("double").isNotNull())
    of = lambda n: F.col(f"l.{n}")
    return _event(
        both, "launches", record_id=of("id"), type=F.lit("launch"), category=F.lit("SPACE"), title=of("name"), start_time=iso_text(of("net"), True), status=_or(of("status.abbrev"), of("status.name")), evidence_type=F.lit("VERIFIED RECORD"),
        lon=of("pad.longitude").try_cast("double"), lat=of("pad.latitude").try_cast("double"),
        attributes=_facts(
            status=of("status.name"), status_description=of("status.description"), time_precision=of("net_precision.name"), pad=of("pad.name"), provider=of("launch_service_provider.name"), mission=of("mission.name"),
            upcoming=F.col("upcoming"), source_url=of("url"),
        ),
    )


@feed("satellites")
def satellites(spark: SparkSession, path: str) -> DataFrame:
    """Positions in TEME, km, at a Julian date: orbits themselves need a propagator, which is not staged."""
    from orrery.functions.geo import teme_to_geodetic

    f = _json(spark, path, "satellites array<struct<id:string,name:string,jd:double,x:double,y:double,z:double,at:string>>").select(F.explode("satellites").alias("s")).select("s.*").where("x is not null")
    f = f.dropDuplicates(["id"]).withColumn("g", teme_to_geodetic(F.col("x"), F.col("y"), F.col("z"), F.col("jd")))
    return _event(
        f, "satellites", record_id=F.col("id"), type=F.lit("satellite-position"), category=F.lit("SPACE"), title=F.concat(F.col("name"), F.lit(" (NORAD "), F.col("id"), F.lit(")")), start_time=iso_text(F.col("at"), True),
        status=F.lit("computed"), evidence_type=F.lit("INFERRED"), lon=F.col("g.lon"), lat=F.col("g.lat"), attributes=_facts(norad_id=F.col("id"), altitude_km=F.round("g.alt_km", 1)),
    )


def _csv(spark: SparkSession, path: str, *optional: str) -> DataFrame:
    """A table of texts under its header; optional columns that it lacks are null."""
    f = spark.read.csv(path, header=True, inferSchema=False)
    return f.withColumns({c: F.lit(None).cast("string") for c in optional if c not in f.columns})


@feed("fires")
def fires(spark: SparkSession, path: str) -> DataFrame:
    f = _csv(spark, path, "satellite", "instrument", "daynight", "confidence", "frp", "bright_ti4")
    clock = F.lpad("acq_time", 4, "0")
    start = F.concat(F.col("acq_date"), F.lit("T"), F.substring(clock, 1, 2), F.lit(":"), F.substring(clock, 3, 2), F.lit(":00Z"))
    seen = F.concat(F.lit("Thermal anomaly ("), F.coalesce("instrument", F.lit("VIIRS")), F.lit(", "), F.when(F.col("daynight") == "D", "day").otherwise("night"), F.lit(")"))
    return _event(
        f, "fires", record_id=F.concat_ws("-", "latitude", "longitude", "acq_date", clock, _said(F.col("satellite"))), type=F.lit("fire-detection"), category=F.lit("ENVIRONMENT"), title=seen,
        start_time=iso_text(start), status=F.lit("detected"), lon=F.col("longitude").try_cast("double"), lat=F.col("latitude").try_cast("double"),
        attributes=_facts(frp_mw=F.col("frp").try_cast("double"), source_confidence=_lookup(F.col("confidence"), CONFIDENCE, F.col("confidence")), satellite=F.col("satellite"), bright_ti4_k=F.col("bright_ti4")),
    )


@feed("airports")
def airports(spark: SparkSession, path: str) -> DataFrame:
    """Of a world's table, one country's airports of three sizes."""
    f = _csv(spark, path, "iata_code", "gps_code", "municipality", "iso_region", "scheduled_service", "elevation_ft")
    f = f.where((F.col("iso_country") == "IN") & F.col("type").isin("large_airport", "medium_airport", "small_airport"))
    return _entity(
        f, "airports", record_id=F.col("ident"), type=F.lit("airport"), category=F.lit("AVIATION"), name=F.col("name"), lon=F.col("longitude_deg").try_cast("double"), lat=F.col("latitude_deg").try_cast("double"),
        attributes=_facts(
            airport_type=F.replace("type", F.lit("_"), F.lit(" ")), iata=_or(F.col("iata_code")), icao=_or(F.col("gps_code")), municipality=_or(F.col("municipality")), region=F.col("iso_region"),
            scheduled_service=F.coalesce(F.col("scheduled_service") == "yes", F.lit(False)), elevation_ft=F.col("elevation_ft").try_cast("bigint"),
        ),
    )


@feed("power-plants")
def power_plants(spark: SparkSession, path: str) -> DataFrame:
    """The plants of one country, from a zipped table."""
    from orrery.sources.rasters import zipped_csv

    texts = ["country", "gppd_idnr", "name", "longitude", "latitude", "primary_fuel", "capacity_mw", "commissioning_year", "owner", "year_of_capacity_data", "geolocation_source", "source"]
    f = zipped_csv(spark, path, ".csv", texts).where("country = 'IND'")
    number = lambda c, name=None: F.col(c).try_cast("double").alias(name or c)
    facts = F.struct("primary_fuel", number("capacity_mw"), number("commissioning_year"), "owner", number("year_of_capacity_data", "capacity_data_year"), "geolocation_source", F.col("source").alias("original_source"))
    return _entity(
        f, "power-plants", record_id=F.col("gppd_idnr"), type=F.lit("power-plant"), category=F.lit("INFRASTRUCTURE"), name=F.col("name"), lon=F.col("longitude").try_cast("double"), lat=F.col("latitude").try_cast("double"),
        attributes=F.to_json(facts),
    )


@feed("ports")
def ports(spark: SparkSession, path: str) -> DataFrame:
    """A port for each point of a zipped shapefile; one without a name is numbered."""
    from orrery.sources.shapefile import read as shapes

    f = shapes(spark, path)
    of = lambda name: F.nullif(F.get_json_object("properties", f"$.{name}"), F.lit(""))
    number = F.col("ordinal").cast("string")
    name = F.coalesce(of("name"), F.concat(F.lit("Unnamed port "), number))
    at = F.from_json("geometry", "coordinates array<double>")["coordinates"]
    return _entity(
        f, "ports", record_id=F.concat_ws("-", name, number), type=F.lit("port"), category=F.lit("MARITIME"), name=name, lon=F.get(at, 0), lat=F.get(at, 1),
        attributes=F.to_json(F.struct(of("website").alias("website"), of("scalerank").try_cast("double").alias("scale_rank"))),
    )


#: What a reference layer keeps of its records, and how coarse its lines may be, in degrees.
LAYER_FIELDS, LAYER_TOLERANCE = ("name", "name_en", "featurecla", "scalerank", "type", "category", "label"), 0.002


def layer(spark: SparkSession, path: str, west: float, south: float, east: float, north: float) -> DataFrame:
    """ordinal, lines and properties of the lines and polygons (rivers, lakes, roads, rail) whose box meets an area's.

    lines: an array of simplified lines; rings count as lines.
    """
    from orrery.functions import geo
    from orrery.sources.shapefile import read as shapes

    kind = F.get_json_object("geometry", "$.type")
    coordinates = lambda t: F.from_json("geometry", f"coordinates {t}")["coordinates"]
    one, many, deep = "array<array<double>>", "array<array<array<double>>>", "array<array<array<array<double>>>>"
    lines = F.when(kind == "LineString", F.array(coordinates(one))).when(kind.isin("Polygon", "MultiLineString"), coordinates(many)).when(kind == "MultiPolygon", F.flatten(coordinates(deep)))
    points = F.transform(lines, lambda line: F.transform(line, lambda q: F.struct(q[0].alias("x"), q[1].alias("y"))))
    f = shapes(spark, path).withColumn("lines", points).where("lines is not null").withColumn("box", geo.bbox_of(F.flatten("lines")))
    box = F.col("box")
    f = f.where(geo.bboxes_meet([box["west"], box["south"], box["east"], box["north"]], [F.lit(float(v)) for v in (west, south, east, north)]))
    kept = F.to_json(F.struct(*[F.nullif(F.get_json_object("properties", f"$.{c}"), F.lit("")).alias(c) for c in LAYER_FIELDS]))
    each = f.select("ordinal", kept.alias("properties"), F.posexplode("lines").alias("i", "line"))
    simple = each.withColumn("line", geo.simplify_line("line", F.lit(LAYER_TOLERANCE)))
    return simple.groupBy("ordinal", "properties").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]).alias("lines"))


def vessel_reports(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid and rejected vessel reports; sentinels for unknown become null, problems are listed."""
    from orrery.operators.governance import contract_problems

    clean = rows.withColumns({"course_deg": F.nullif("course_deg", F.lit(360.0)), "speed_kn": F.nullif("speed_kn", F.lit(102.3)), "heading_deg": F.nullif("heading_deg", F.lit(511.0))})
    checks = [
        (F.col("identifier").rlike("^[0-9]{9}$"), "identifier has not nine digits"),
        (F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90), "position out of range"),
        (F.col("observed_at").rlike(r"(Z|[+-]\d{2}:?\d{2})$") & F.try_to_timestamp("observed_at").isNotNull(), "time without a zone"),
        (F.coalesce(F.col("course_deg").between(0, 359.999), F.lit(True)), "course out of range"),
        (F.coalesce(F.col("speed_kn").between(0, 102.2), F.lit(True)), "speed out of range"),
    ]
    marked = clean.withColumn("problems", contract_problems(checks))
    return marked.where(F.size("problems") == 0).drop("problems"), marked.where(F.size("problems") > 0)
