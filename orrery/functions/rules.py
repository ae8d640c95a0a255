"""Rules of the imagery chain: reflectance, indices, classes, stretches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scene classes that are no clear ground, and thresholds of the rules.
INVALID_SCL = [0, 1, 3, 8, 9, 10, 11]
WATER_MNDWI, WATER_NDVI, VEGETATION_NDVI, VALID_SHARE = 0.1, 0.2, 0.35, 0.8
BUILT_BRIGHTNESS, BUILT_TEXTURE, STRETCH = 0.16, 0.035, 0.3


def ratio(a: Column, b: Column) -> Column:
    """Normalised difference, 0 where it is undefined."""
    return F.when(a + b != 0, (a - b) / (a + b)).otherwise(F.lit(0.0))


def reflectance(dn: Column, offset: Column) -> Column:
    return dn * 0.0001 + offset


def offset_of(baseline: Column, applied: Column) -> Column:
    """Offset of a product: none before baseline 04.00; from then on -0.1, or none where it is applied already.

    Null where the tags don't decide: no baseline or one under 02.00, or a new one without the flag.
    """
    b = baseline.try_cast("double")
    return F.when(b < 2.0, F.lit(None).cast("double")).when(b < 4.0, F.lit(0.0)).when(b.isNotNull() & applied, F.lit(0.0)).when(b.isNotNull() & ~applied, F.lit(-0.1))


def tile_class(valid: Column, water: Column, vegetation: Column, open_: Column, brightness: Column, texture: Column) -> Column:
    """Class of a tile in one look: null under too much cloud; open land that is bright or rough counts as built."""
    built = (brightness >= BUILT_BRIGHTNESS) | (texture >= BUILT_TEXTURE)
    return (
        F.when(valid < VALID_SHARE, F.lit(None).cast("string"))
        .when(water >= 0.5, "water")
        .when(vegetation >= 0.5, "vegetation")
        .when((open_ >= 0.5) & built, "built")
        .when(open_ >= 0.5, "bare")
        .otherwise("mixed")
    )


def pixel_class(green: Column, red: Column, nir: Column, swir: Column, scl: Column) -> Column:
    ndvi, mndwi = ratio(nir, red), ratio(green, swir)
    return (
        F.when(scl.isin(INVALID_SCL), F.lit(None).cast("string"))
        .when((mndwi > WATER_MNDWI) & (ndvi < WATER_NDVI), "water")
        .when(ndvi >= VEGETATION_NDVI, "vegetation")
        .otherwise("open")
    )


def stretched(value: Column) -> Column:
    """A reflectance as a byte of a picture; the cast cuts."""
    return F.least(F.lit(255.0), F.greatest(F.lit(0.0), value / STRETCH * 255)).cast("int")


def quality_status(valid_share: Column) -> Column:
    return F.when(valid_share >= 0.9, "usable").when(valid_share >= 0.6, "degraded").otherwise("rejected")


def month_gap(a: Column, b: Column) -> Column:
    """Months between two months of the year, the short way round."""
    return F.least(F.abs(a - b), 12 - F.abs(a - b))
