"""Words and phrases the planner understands. All of these are fixed values; order decides between them."""

from __future__ import annotations

CHANGES = [
    (r"\bnew(ly)?\s+(built|constructed)\b|\bconstruct\w*\b|\bnew\s+buildings?\b|\bbuildings?\s+(added|built|constructed|appeared)\b|\bbuilt[- ]up\b|\burban(isation|ization)\b", ("construction", "appearance")),
    (r"\bnew\s+roads?\b|\broad\s+(development|construction|building)\b", ("road-development", "appearance")),
    (r"\bclear(ed|ing|ance)\b|\bdeforest\w*\b|\btree\s+loss\b|\bvegetation\s+loss\b", ("clearance", "disappearance")),
    (r"\bwater\s+(expansion|increase|growth|gain)\b|\bexpanding\s+water\b|\bnew\s+water\b|\bwater\s+extent\s+increase\b", ("water-extent", "expansion")),
    (r"\bwater\s+(loss|decrease|shrink\w*|contraction)\b|\bdrying\b|\bshrinking\s+(lakes?|reservoirs?|water)\b", ("water-extent", "contraction")),
    (r"\bwater\s+(changes?|extent)\b", ("water-extent", None)),
    (r"\bchanges?\b|\bchanged\b", ("any", None)),
]
EVENTS = [
    (r"\bearthquakes?\b|\bquakes?\b|\bseismic\b", ["earthquake"]),
    (r"\b(wild)?fires?\b|\bburning\b|\bthermal anomal\w*\b", ["fire-detection", "wildfire"]),
    (r"\bfloods?\b|\bflooding\b", ["flood"]),
    (r"\bcyclones?\b|\bstorms?\b|\btyphoons?\b", ["cyclone", "severe-storm"]),
    (r"\blandslides?\b", ["landslide"]),
    (r"\bdroughts?\b", ["drought"]),
    (r"\baircraft\b|\bflights?\b|\bplanes?\b|\baviation\b", ["aircraft-position"]),
    (r"\blaunch(es)?\b|\brockets?\b", ["launch"]),
    (r"\bsatellites?\b|\bspacecraft\b|\bovers?head\b", ["satellite-position"]),
    (r"\b(internet|network)\s+(outages?|disruptions?|shutdowns?)\b|\boutages?\b", ["internet-outage-signal"]),
    (r"\bweather\b|\btemperatures?\b|\brain(fall)?\b|\bwind\b", ["weather-current"]),
    (r"\bspace weather\b|\bgeomagnetic\b|\bkp\b", ["geomagnetic-kp"]),
    (r"\bvessels?\b|\bships?\b|\bboats?\b|\bmaritime traffic\b", ["vessel-position"]),
]
ENTITIES = [
    (r"\bairports?\b|\bairfields?\b", ["airport"]),
    (r"\bports?\b|\bharbou?rs?\b", ["port"]),
    (r"\bpower\s+(plants?|stations?)\b|\bpower\b", ["power-plant"]),
]
REFERENCES = [
    (r"\brivers?\b|\briverside\b|\bwater\s*bod(y|ies)\b", "river"),
    (r"\blakes?\b|\breservoirs?\b", "lake"),
    (r"\bcoast(s|al|line)?\b", "coast"),
    (r"\broads?\b|\bhighways?\b", "road"),
    (r"\brail(way|road)s?\b", "railway"),
]
SENSORS = [
    (r"\bsentinel[- ]?2\b|\bs2\b", "sentinel-2"),
    (r"\bsentinel[- ]?1\b|\bs1\b|\bsar\b|\bradar\b", "sentinel-1"),
    (r"\blandsat\b", "landsat"),
]
SURFACES = [
    (r"\bbuildings?\b", "building"),
    (r"\bvegetation\b|\btrees?\b|\bgreen\s+cover\b|\bgreenery\b", "vegetation"),
    (r"\bponds?\b|\bwater\s+bod(y|ies)\b", "water"),
    (r"\bpaths?\b|\bpathways?\b", "road"),
]
OPERATIONS = [
    (r"\bsegment\w*\b|\boutline\w*\b|\bfootprints?\b", "segmentation"),
    (r"\bland[- ](cover|use)\b", "land-cover"),
    (r"\bsummar\w*\b", "analyst-summary"),
    (r"\btrends?\b|\bover\s+time\b|\bseasonal\w*\b", "temporal-analysis"),
]
SIMILAR = r"\bsimilar\b|\bmore like\b|\blike this\b|\blook(s)? like\b"
HERE = r"\b(this|selected|current)\s+(location|place|area|site|aoi)\b|\bhere\b"
NEAR = r"\b(near|nearby|around|close to|within)\b"
RECENT = r"\b(recent(ly)?|latest|current(ly)?|active|ongoing)\b"
#: A fixed value: a request for images, and what they should show.
IMAGE_REQUEST = (
    r"^\s*(?:please\s+)?(?:(?:find|show|search(?:\s+for)?|get|look\s+for|display)\s+(?:me\s+)?)?"
    r"(?:(?:satellite|sentinel(?:-2)?)\s+)?(?:images?|imagery|image\s+chips?|scenes?)\s+"
    r"(?:of|showing|that\s+shows?|with|containing|that\s+contains?)\s+(?P<what>.+?)\s*[.?!]?\s*$"
)
STOPWORDS = frozenset(
    """
show find list get display give me all any the a an of in on at to for from with within around near nearby
by and or that which where what are is was were be been this these those areas area sites site locations
location places place recent recently new newly since last past during between before after until please
there their its into over about than more most activity activities reported report imagery image images
showing happening occurred occurring
""".split()
)
UNDEFINED = {"significant": "No limit goes with 'significant': candidates stand in the order of their scores, and you decide."}
RADIUS_M, RECENT_DAYS = 50_000, 30
#: Which feeds provide which kinds of records.
EVENT_SOURCES = {
    "earthquake": ["earthquakes", "disaster-alerts", "natural-events"],
    "fire-detection": ["fires"],
    "wildfire": ["natural-events", "disaster-alerts"],
    "flood": ["disaster-alerts", "natural-events"],
    "cyclone": ["disaster-alerts"],
    "severe-storm": ["natural-events"],
    "landslide": ["natural-events"],
    "drought": ["disaster-alerts", "natural-events"],
    "volcano": ["disaster-alerts", "natural-events"],
    "disaster-alert": ["disaster-alerts"],
    "natural-event": ["natural-events"],
    "aircraft-position": ["aircraft"],
    "launch": ["launches"],
    "satellite-position": ["satellites"],
    "internet-outage-signal": ["outages"],
    "weather-current": ["weather"],
    "geomagnetic-kp": ["kp-index"],
}
ENTITY_SOURCES = {"airport": ["airports"], "port": ["ports"], "power-plant": ["power-plants"]}
