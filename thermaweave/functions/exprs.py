"""Scalar Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit offsets, plausibility bands per unit, sphere radius (km), metres per
# degree, seasonal period (days), MAD consistency factor.
KELVIN_OFFSET = 273.15
UNIT_BANDS = {"K": (150.0, 400.0), "C": (-125.0, 125.0), "F": (-190.0, 260.0)}
EARTH_RADIUS_KM = 6371.0
METRES_PER_DEGREE = 111320.0
SEASON_DAYS = 365.25
MAD_FACTOR = 1.4826


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def linear_unit_map(src: str, dst: str) -> tuple[float, float]:
    """``(scale, shift)`` such that ``dst = scale * src + shift``."""
    to_kelvin = {"K": (1.0, 0.0), "C": (1.0, KELVIN_OFFSET), "F": (5.0 / 9.0, KELVIN_OFFSET - 160.0 / 9.0)}
    s1, t1 = to_kelvin[src]
    s2, t2 = to_kelvin[dst]
    return s1 / s2, (t1 - t2) / s2


def convert_unit(c, src: str, dst: str) -> Column:
    """Temperature conversion between K, C and F."""
    src, dst = src.upper(), dst.upper()
    for u in (src, dst):
        if u not in UNIT_BANDS:
            raise ValueError(f"unit must be one of K, C, F, not {u!r}")
    c = _col(c)
    if src == dst:
        return c
    scale, shift = linear_unit_map(src, dst)
    out = c if scale == 1.0 else c * F.lit(scale)
    return out + F.lit(shift)


def wrap_hours(c) -> Column:
    """Hours folded into [0, 24)."""
    return F.pmod(_col(c), F.lit(24.0))


def solar_hour(hour, lon) -> Column:
    """Local solar time from decimal UTC hour and longitude (degrees east, either convention)."""
    return wrap_hours(_col(hour) + _col(lon) / F.lit(15.0))


def harmonic_terms(date, harmonics: int = 1, period: float = SEASON_DAYS) -> dict[str, Column]:
    """``sin1, cos1, sin2, ...`` of day of year; non-finite values become 0."""
    if harmonics < 1:
        raise ValueError("harmonics must be at least 1")
    if not (period > 0 and math.isfinite(period)):
        raise ValueError("period must be a positive number of days")
    doy = F.dayofyear(_col(date)).cast("double")
    terms: dict[str, Column] = {}
    for k in range(1, harmonics + 1):
        angle = F.lit(2.0 * math.pi * k) * doy / F.lit(float(period))
        terms[f"sin{k}"] = F.when(F.isnan(F.sin(angle)), F.lit(0.0)).otherwise(F.sin(angle))
        terms[f"cos{k}"] = F.when(F.isnan(F.cos(angle)), F.lit(0.0)).otherwise(F.cos(angle))
    return terms


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance on a sphere of radius 6371 km."""
    lat1, lon1, lat2, lon2 = map(_col, (lat1, lon1, lat2, lon2))
    half_lat = F.radians(lat2 - lat1) / F.lit(2.0)
    half_lon = F.radians(lon2 - lon1) / F.lit(2.0)
    chord = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    return F.lit(2.0 * EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(chord)))


def metres_east(lon, lon0, lat0) -> Column:
    """Metres east of a local origin."""
    return (_col(lon) - _col(lon0)) * F.lit(METRES_PER_DEGREE) * F.cos(F.radians(_col(lat0)))


def metres_north(lat, lat0) -> Column:
    """Metres north of a local origin."""
    return (_col(lat) - _col(lat0)) * F.lit(METRES_PER_DEGREE)


def slug(c) -> Column:
    """File-name-safe label."""
    return F.regexp_replace(_col(c), "[^A-Za-z0-9._-]+", "_")


def percent(part, whole, digits: int | None = None) -> Column:
    """``100 * part / max(whole, 1)``, optionally rounded."""
    out = F.lit(100.0) * _col(part) / F.greatest(_col(whole), F.lit(1)).cast("double")
    return out if digits is None else F.round(out, digits)


def md5_int(*parts) -> Column:
    """Non-negative integer below 2**60 from the md5 of the '|'-joined parts."""
    text = F.concat_ws("|", *[_col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


#: The prime of :func:`stir`, and the starts of the two streams of a draw.
PRIME = 2_147_483_647
STREAMS = (12_345, 987_654_321)


def stir(state, part) -> Column:
    """One step of an integer hash below :data:`PRIME`: cheap, and the same in any engine with 64-bit integers."""
    big = lambda n: F.lit(n).cast("bigint")
    x = (_col(state) * big(48_271) + _col(part) % big(PRIME) + big(11)) % big(PRIME)
    return (x * (x + big(12_345)) % big(PRIME) * big(69_621) + big(7)) % big(PRIME)


def draw(first, second) -> Column:
    """A number below 2**62 from two stirred streams."""
    return _col(first).cast("bigint") * F.lit(PRIME) + _col(second)


def warming_covariate(hour, wind) -> Column:
    """Afternoon warming shape damped by wind: ``max(0, cos(2 pi (h-14)/24)) * exp(-w/2)``."""
    shape = F.greatest(F.lit(0.0), F.cos(F.lit(2.0 * math.pi / 24.0) * (_col(hour) - F.lit(14.0))))
    return shape * F.exp(-_col(wind) / F.lit(2.0))


def finite(c) -> Column:
    """The value, or NULL where it is NULL or NaN or infinite."""
    c = _col(c)
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def correlation(y, x) -> Column:
    """Pearson correlation of paired, non-NULL columns as an aggregate; NULL when either is constant."""
    return F.try_divide(F.covar_pop(_col(y), _col(x)), F.stddev_pop(_col(y)) * F.stddev_pop(_col(x)))
