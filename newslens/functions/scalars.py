"""Small functions of values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Earth's mean radius in kilometres, and kilometres to a mile.
EARTH_KM = 6371.0
MILE_KM = 1.609344


def tone_label(tone: Column) -> Column:
    """In words; 0 counts as slightly negative, and so does what is above -2. A value that is no number is negative."""
    odd = F.isnan(tone)
    return (
        F.when(tone.isNull(), None)
        .when(odd, "NEGATIVE")
        .when(tone > 2, "POSITIVE")
        .when(tone > 0, "SLIGHTLY POSITIVE")
        .when(tone > -2, "SLIGHTLY NEGATIVE")
        .otherwise("NEGATIVE")
    )


def whole(value: Column) -> Column:
    """A number, cut toward zero; null where it isn't one."""
    return value.cast("string").try_cast("double").try_cast("bigint")


def country_key(name: Column) -> Column:
    """``unitedstates`` from ``United States``."""
    return F.lower(F.replace(name, F.lit(" "), F.lit("")))


def split_list(text: Column) -> Column:
    """Items between commas, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), F.trim), lambda x: x != "")


def shorten(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def first_of(*values: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.when(v != "", v) for v in values])


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/:?#]+)", 1))


def display(text: str | None) -> str:
    """A text as a terminal with Windows' western code page shows it; others become question marks."""
    return (text or "").encode("cp1252", "replace").decode("cp1252")


def signed(value: Column) -> Column:
    """+1.50"""
    return F.format_string("%+.2f", value)


def rounded(value: Column) -> Column:
    """Whole, half to even."""
    return F.bround(value, 0)


def distance_km(lat: Column, lon: Column, to_lat: float, to_lon: float) -> Column:
    """Great-circle distance."""
    a = F.radians(lat)
    b = F.radians(F.lit(float(to_lat)))
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(F.lit(float(to_lon)) - lon) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def within(lat: Column, lon: Column, to_lat: float, to_lon: float, km: float) -> Column:
    """Within a radius. A range of latitudes comes first: it can be pushed to the scan."""
    reach = km / 111.0
    return lat.between(to_lat - reach, to_lat + reach) & (distance_km(lat, lon, to_lat, to_lon) <= km)
