"""Explicit schemas of the external tables."""

from pyspark.sql import types as T

_S, _D, _I, _DATE = T.StringType(), T.DoubleType(), T.IntegerType(), T.DateType()


def _struct(**cols) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in cols.items()])


RAW_LONG = _struct(point_id=_S, lat=_D, lon=_D, aoi=_S, time=_DATE, variable=_S, stat=_S, radius_m=_I, value=_D)
RAW_LONG_TEXT_TIME = _struct(point_id=_S, lat=_D, lon=_D, aoi=_S, time=_S, variable=_S, stat=_S, radius_m=_I, value=_D)
CLEAN_LONG = _struct(point_id=_S, lat=_D, lon=_D, aoi=_S, time=_DATE, variable=_S, value=_D)
STATES = _struct(date=_DATE, site=_S, variable=_S, value=_D, se=_D)
VALIDATION = _struct(date=_DATE, site=_S, variable=_S, value=_D)
SITE_LOCATIONS = _struct(id=_S, site_name=_S, site_type=_S, lat=_D, lon=_D, region=_S, notes=_S)
PARAMS = _struct(name=_S, value=_D)
