"""Text as column expressions: folding, ordered vocabularies, numbers in phrases, formats, ids."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fold_text(text: str | None) -> str | None:
    """Without accents, lower case, anything else than letters and digits one space."""
    if text is None:
        return None
    plain = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower()
    return " ".join("".join(c if c.isalnum() else " " for c in plain).split())


@F.pandas_udf(T.StringType())
def fold(text: pd.Series) -> pd.Series:
    return text.map(fold_text, na_action="ignore")


def fold_ascii(text: Column) -> Column:
    """The same for text that is ASCII already, inside the JVM."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def first_match(text: Column, table: list[tuple[str, str]]) -> Column:
    """The value of the first pattern of the table that is found: order of the table, not of the text."""
    return F.coalesce(*[F.when(text.rlike(pattern), F.lit(value)) for pattern, value in table], F.lit(None).cast("string"))


def matched_words(text: Column, table: list[tuple[str, str]]) -> Column:
    """What that pattern matched."""
    return F.coalesce(*[F.when(text.rlike(pattern), F.regexp_extract(text, f"({pattern})", 1)) for pattern, _ in table], F.lit(None).cast("string"))


#: How distances and magnitudes are written.
DISTANCE = r"(\d+(?:\.\d+)?)\s*(km|kms|kilomet(?:er|re)s?|m|meters?|metres?)\b"
MAGNITUDE = r"\b(?:magnitude|mag|m)\s*(\d(?:\.\d)?)\s*(?:\+|and above|or (?:more|greater|higher))?"
MAGNITUDE_ABOVE = r"\b(?:above|over|greater than)\s+(?:magnitude\s+)?(\d(?:\.\d)?)\b"


def distance_m(text: Column) -> Column:
    value = F.nullif(F.regexp_extract(text, DISTANCE, 1), F.lit("")).cast("double")
    return value * F.when(F.regexp_extract(text, DISTANCE, 2).startswith("k"), F.lit(1000.0)).otherwise(F.lit(1.0))


def min_magnitude(text: Column) -> Column:
    found = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")).cast("double") for p in (MAGNITUDE, MAGNITUDE_ABOVE)]
    return F.coalesce(*found)


def leftover_words(text: Column, used: list[Column], stopwords: list[str]) -> Column:
    """Words that no used span and no stopword covers; longer spans go first."""
    rest = F.concat(F.lit(" "), text, F.lit(" "))
    for span in used:
        rest = F.when(F.coalesce(span, F.lit("")) != "", F.replace(rest, F.concat(F.lit(" "), span, F.lit(" ")), F.lit(" "))).otherwise(rest)
    return F.array_except(F.regexp_extract_all(rest, F.lit(r"([a-z][a-z\-]+)"), 1), F.array(*map(F.lit, stopwords)))


def fixed(value: Column, digits: int, even: bool = False) -> Column:
    """A number of zero or more with so many digits, rounded as the exact value of the double says; ties go up, or to even.

    Twice the digits' power times the value is a double and its rounding error (Dekker's product), so a
    value is told from the middle between two results however near it is.
    """
    scale = float(2 * 10**digits)
    high = value * 134217729.0 - (value * 134217729.0 - value)
    product = value * scale
    error = (high * scale - product) + (value - high) * scale
    n = F.floor((product + 1) / 2)  # of what is rounded up or in the middle
    middle = product == n * 2 - 1
    down = middle & ((error < 0) | ((error == 0) & (n % 2 == 1) & F.lit(even)))
    whole = F.when(down, n - 1).otherwise(n).cast("bigint")
    if not digits:
        return whole.cast("string")
    return F.concat(F.call_function("div", whole, F.lit(10**digits).cast("bigint")).cast("string"), F.lit("."), F.lpad((whole % 10**digits).cast("string"), digits, "0"))


def human_bytes(n: Column) -> Column:
    kb, mb, gb = 1024.0, 1024.0**2, 1024.0**3
    with_unit = lambda unit, size, digits: F.concat(fixed(n / size, digits), F.lit(f" {unit}"))
    return F.when(n < kb, F.format_string("%d B", n)).when(n < mb, with_unit("KB", kb, 1)).when(n < gb, with_unit("MB", mb, 1)).otherwise(with_unit("GB", gb, 2))


def human_age(hours: Column) -> Column:
    """18 min, 5.2 h, 2.1 d; never less than a minute."""
    minutes = F.greatest(F.lit(1), F.bround(hours * 60).cast("int"))
    return F.when(hours < 1, F.format_string("%d min", minutes)).when(hours < 48, F.concat(fixed(hours, 1, even=True), F.lit(" h"))).otherwise(F.concat(fixed(hours / 24, 1, even=True), F.lit(" d")))


def human_distance(metres: Column) -> Column:
    return F.when(metres < 1000, F.concat(F.floor(metres + 0.5).cast("string"), F.lit(" m"))).otherwise(F.concat(fixed(metres / 1000, 1), F.lit(" km")))


def human_area(square_metres: Column) -> Column:
    return F.concat(fixed(square_metres / 10_000, 1), F.lit(" ha"))


def latlon_text(lon: Column, lat: Column) -> Column:
    side = lambda v, plus, minus: F.concat(F.format_string("%.4f° ", F.abs(v)), F.when(v < 0, minus).otherwise(plus))
    return F.concat_ws(" ", side(lat, "N", "S"), side(lon, "E", "W"))


def bearing_text(degrees: Column) -> Column:
    return F.concat(F.lpad(F.pmod(F.round(degrees).cast("int"), F.lit(360)).cast("string"), 3, "0"), F.lit("°"))


def record_key(source: Column, record: Column) -> Column:
    return F.concat(source, F.lit(":"), record)


def tile_parts(tile_id: Column) -> Column:
    """Struct aoi, row, col of ``aoi:row:col``; the area's name may hold colons."""
    parts = F.split(tile_id, ":")
    n = F.size(parts)
    return F.struct(
        F.array_join(F.slice(parts, 1, n - 2), ":").alias("aoi"), F.element_at(parts, -2).cast("int").alias("row"), F.element_at(parts, -1).cast("int").alias("col")
    )


def satellite(scene_id: Column) -> Column:
    return F.split_part(scene_id, F.lit("_"), F.lit(1))
