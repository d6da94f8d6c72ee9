"""Scalar rules as column expressions: sunrise, prices as text, fingerprints of
settings, evenly spaced places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the general solar position equations: coefficients of 1, cos x,
# sin x, cos 2x, sin 2x, cos 3x, sin 3x in the fractional year x.
EQUATION_OF_TIME = (0.000075, 0.001868, -0.032077, -0.014615, -0.040849)
DECLINATION = (0.006918, -0.399912, 0.070257, -0.006758, 0.000907, -0.002697, 0.00148)
ZENITH = 90.833


def _series(coefficients, x: Column) -> Column:
    total = F.lit(coefficients[0])
    for i, c in enumerate(coefficients[1:]):
        total = total + c * (F.cos if i % 2 == 0 else F.sin)((i // 2 + 1) * x)
    return total


def sunrise_minutes(day: Column, latitude: Column, longitude: Column) -> Column:
    """Minutes from UTC midnight of a local day to its sunrise, negative where that
    lies on the UTC day before; null in polar day or night and outside the globe."""
    days = F.dayofyear(F.make_date(F.year(day), F.lit(12), F.lit(31)))
    x = 2 * F.pi() * (F.dayofyear(day) - 1) / days
    sun, lat = _series(DECLINATION, x), F.radians(latitude)
    cosine = F.cos(F.radians(F.lit(ZENITH))) / F.nullif(F.cos(lat) * F.cos(sun), F.lit(0.0)) - F.tan(lat) * F.tan(sun)
    there = latitude.between(-90, 90) & longitude.between(-180, 180) & cosine.between(-1, 1)
    return F.when(there, 720 - 4 * (longitude + F.degrees(F.acos(cosine))) - 229.18 * _series(EQUATION_OF_TIME, x))


def sunrise(day: Column, latitude: Column, longitude: Column, zone: str = "UTC") -> Column:
    """The instant of a local day's sunrise (sessions run in UTC). A zone beyond the
    date line moves it by a day, back to the local date."""
    at = F.timestamp_micros((F.unix_date(day) * F.lit(86_400_000_000) + F.round(sunrise_minutes(day, latitude, longitude) * 60_000_000)).cast("long"))
    off = F.datediff(day, F.to_date(F.from_utc_timestamp(at, zone)))
    return F.timestamp_micros(F.unix_micros(at) + off * F.lit(86_400_000_000))


def price_text(text: Column) -> Column:
    """A price as canonical decimal text: one separator (comma or point), at most 18
    digits, 6 of them after the point, without spare zeros; null where it is no such
    number. Spellings with an exponent or a minus sign are null too."""
    raw = F.trim(text)
    point = F.replace(raw, F.lit(","), F.lit("."))
    plain = point.rlike(r"^\+?(\d+\.?\d*|\.\d+)$") & (F.length(raw) <= 64) & ~(raw.contains(",") & raw.contains("."))
    whole = F.regexp_replace(F.regexp_extract(point, r"^\+?(\d*)", 1), "^0+", "")
    given = F.regexp_extract(point, r"\.(\d*)$", 1)
    digits = F.regexp_replace(F.concat(whole, given), "^0+", "")
    fits = (F.length(given) <= 6) & (F.length(digits) <= 18) & (F.length(whole) <= 18)
    part = F.regexp_replace(given, "0+$", "")
    shown = F.concat(F.when(whole == "", "0").otherwise(whole), F.when(part == "", "").otherwise(F.concat(F.lit("."), part)))
    return F.when(plain & fits, shown)


def number_text(value: Column) -> Column:
    """A finite number as JSON text, whole ones without a point; else null."""
    whole = (value == F.floor(value)) & (F.abs(value) < 2.0**53)
    known = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(known, F.when(whole, value.cast("long").cast("string")).otherwise(value.cast("string")))


def fingerprint(contract: str, **fields: Column) -> Column:
    """contract:sha256 of an object as JSON with sorted keys and no blanks, from
    fields already in JSON (``number_text``, ``text_value``); null is JSON's null.
    Equal numbers hash alike, whether spelled 1 or 1.0."""
    shown = [F.concat(F.lit(f'"{name}":'), F.coalesce(fields[name], F.lit("null"))) for name in sorted(fields)]
    return F.concat(F.lit(f"{contract}:"), F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *shown), F.lit("}")), 256))


def text_value(value: Column) -> Column:
    """Text as a JSON string (quotes, backslashes and line breaks escaped)."""
    escaped = F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def bounded_text(value: Column, most: int) -> Column:
    """Text of at most ``most`` bytes of UTF-8; a longer one is cut between characters
    and ends in a colon and 12 digits of its hash."""
    raw, room = value.cast("binary"), max(0, most - 13)
    cuts = [F.substring(raw, 1, max(0, room - k)).cast("string") for k in range(4)]  # a character has four bytes at most
    kept = F.coalesce(*[F.when(F.is_valid_utf8(c), c) for c in cuts], F.lit(""))
    return F.when(F.octet_length(value) <= most, value).otherwise(F.concat(kept, F.lit(":"), F.substring(F.sha2(raw, 256), 1, 12)))
