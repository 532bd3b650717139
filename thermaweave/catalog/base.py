"""Query registry, and the observation tables that the queries run on.

The given tables hold no point observations, so a view over lineitem, supplier and nation takes
their shape: 25 sites, daily rows, three instruments, two statistics, padded with NULLs. Every
query reads all rows of the view. The same view is written once in SQL for the oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import convert_unit
from ..functions.lineage import staged
from ..operators.labelling import label_variables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; doubles are compared at six decimals on both sides."""

    def keep(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(spark, sf_dir))

        run.__name__ = fn.__name__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.col(c), 6).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def R(expr: str) -> str:
    """SQL rounding that matches :func:`rounded` (and has no negative zero)."""
    return f"(round(CAST({expr} AS DOUBLE), 6) + 0.0)"


def P(expr: str, digits: int) -> str:
    """SQL rounding of a percentage, half up on its decimal digits."""
    return f"CAST(round(CAST({expr} AS DECIMAL(28, 12)), {digits}) AS DOUBLE)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- the observation view -------------------------------------------------------------------

IDS = ["point_id", "lat", "lon", "aoi", "time"]
# Kelvin per unit of quantity: many digits, so that no average ends on a rounding tie.
SLOPE = 0.8512345677
TEMPERATURES = ["eco_sst", "lst_sst", "ref_sst"]


def raw_wide(spark: SparkSession, sf_dir: str, site: str = "s_nationkey") -> DataFrame:
    """One row per site, date, instrument and statistic, with hour and wind as columns.

    Sites are nations, or with ``s_suppkey`` suppliers, whose number grows with the scale factor.
    """
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    su = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    na = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    rows = li.join(su, F.col("l_suppkey") == F.col("s_suppkey")).join(na, F.col("s_nationkey") == F.col("n_nationkey"))
    cells = rows.groupBy(F.col(site).alias("_site"), "n_regionkey", F.to_date("l_shipdate").alias("time"), "l_returnflag", "l_linestatus").agg(
        F.max(F.when(F.col("l_tax") == 0.08, 1).otherwise(0)).alias("gap"), F.avg("l_quantity").alias("q"),
        F.min("l_orderkey").alias("k"), F.avg("l_discount").alias("d"))
    return cells.select(
        F.concat(F.lit("P"), F.col("_site").cast("string")).alias("point_id"),
        (F.lit(-43.0) + F.col("_site") % 400 * F.lit(0.1)).alias("lat"), (F.lit(147.0) + F.col("_site") % 1000 * F.lit(0.12)).alias("lon"),
        F.concat(F.lit("A"), F.col("n_regionkey").cast("string")).alias("aoi"), "time",
        F.when(F.col("l_returnflag") == "A", "eco_sst").when(F.col("l_returnflag") == "N", "lst_sst").otherwise("ref_sst").alias("variable"),
        F.when(F.col("l_linestatus") == "O", "nanmean").otherwise("nearest").alias("stat"), F.lit(300).alias("radius_m"),
        F.when(F.col("gap") == 0, F.lit(273.15) + F.lit(SLOPE) * F.col("q")).alias("value"),
        (F.col("k") % 24).cast("double").alias("hour"), F.round(F.col("d") * 100.0, 6).alias("wind"),
    )


def raw_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw extract: temperature rows only."""
    return raw_wide(spark, sf_dir).drop("hour", "wind")


def raw_extended(spark: SparkSession, sf_dir: str, site: str = "s_nationkey") -> DataFrame:
    """The raw extract with hour and wind as rows of their own, from one scan."""
    w = raw_wide(spark, sf_dir, site)
    cells = F.array(*[
        F.struct(F.concat(F.col("variable"), F.lit(tail)).alias("variable"), F.col(c).alias("value"))
        for tail, c in (("", "value"), ("_hour", "hour"), ("_wind", "wind"))
    ])
    return w.select(*IDS, "stat", "radius_m", F.explode(cells).alias("c")).select(*IDS, "c.variable", "stat", "radius_m", "c.value")


SPECS = {
    "eco_sst": {"variable": "eco_sst", "stat": "nanmean", "radius_m": [0, 300]},
    "eco_hour": {"variable": "eco_sst_hour", "stat": "nanmean", "radius_m": [0, 300]},
    "eco_wind": {"variable": "eco_sst_wind", "stat": "nanmean", "radius_m": [0, 300]},
    "lst_sst": {"variable": "lst_sst", "stat": "nanmean", "radius_m": [0, 300]},
    "lst_hour": {"variable": "lst_sst_hour", "stat": "nanmean", "radius_m": [0, 300]},
    "lst_wind": {"variable": "lst_sst_wind", "stat": "nanmean", "radius_m": [0, 300]},
    "ref_sst": {"variable": "ref_sst", "stat": "nanmean", "radius_m": [0, 300]},
}


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_extended(spark, sf_dir)
    # Extracts write some missing values as NaN; labelling folds them, so the SQL view has NULL there.
    gap = F.col("value").isNull() & (F.dayofmonth("time") % 2 == 0)
    return label_variables(rows.withColumn("value", F.when(gap, F.lit(float("nan"))).otherwise(F.col("value"))), SPECS)


def celsius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows in Celsius (the conversion alone; its guard has queries of its own)."""
    hot = F.col("variable").isin(TEMPERATURES)
    return labelled(spark, sf_dir).withColumn("value", F.when(hot, convert_unit("value", "K", "C")).otherwise(F.col("value")))


def celsius_temperatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the temperature rows, without the covariates."""
    rows = raw_long(spark, sf_dir).where(F.col("stat") == "nanmean")
    return rows.select(*IDS, "variable", convert_unit("value", "K", "C").alias("value"))


def extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The temperature rows written once as a table, for queries that pass over them several times."""
    return staged(celsius_temperatures(spark, sf_dir), "extract", ["variable"])


CTES = {
    "raw": """SELECT concat('P', CAST(s_nationkey AS VARCHAR)) AS point_id,
  CAST(-43.0 AS DOUBLE) + s_nationkey * CAST(0.1 AS DOUBLE) AS lat,
  CAST(147.0 AS DOUBLE) + s_nationkey * CAST(0.12 AS DOUBLE) AS lon,
  concat('A', CAST(n_regionkey AS VARCHAR)) AS aoi, CAST(l_shipdate AS DATE) AS time,
  CASE l_returnflag WHEN 'A' THEN 'eco_sst' WHEN 'N' THEN 'lst_sst' ELSE 'ref_sst' END AS variable,
  CASE l_linestatus WHEN 'O' THEN 'nanmean' ELSE 'nearest' END AS stat, CAST(300 AS INTEGER) AS radius_m,
  CASE WHEN max(CASE WHEN l_tax = CAST(0.08 AS DOUBLE) THEN 1 ELSE 0 END) = 1 THEN NULL
       ELSE CAST(273.15 AS DOUBLE) + CAST(0.8512345677 AS DOUBLE) * avg(l_quantity) END AS value,
  CAST(min(l_orderkey) % 24 AS DOUBLE) AS hour, round(avg(l_discount) * CAST(100 AS DOUBLE), 6) AS wind
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
GROUP BY s_nationkey, n_regionkey, CAST(l_shipdate AS DATE), l_returnflag, l_linestatus""",
    "ext": """SELECT point_id, lat, lon, aoi, time, variable, stat, radius_m, value FROM raw
UNION ALL SELECT point_id, lat, lon, aoi, time, variable || '_hour', stat, radius_m, hour FROM raw
UNION ALL SELECT point_id, lat, lon, aoi, time, variable || '_wind', stat, radius_m, wind FROM raw""",
    "fmt": """SELECT point_id, lat, lon, aoi, time, replace(replace(variable, '_sst_hour', '_hour'), '_sst_wind', '_wind') AS variable, value
FROM ext WHERE stat = 'nanmean' AND radius_m IN (0, 300)
AND variable IN ('eco_sst', 'eco_sst_hour', 'eco_sst_wind', 'lst_sst', 'lst_sst_hour', 'lst_sst_wind', 'ref_sst')""",
    "conv": """SELECT point_id, lat, lon, aoi, time, variable,
CASE WHEN variable IN ('eco_sst', 'lst_sst', 'ref_sst') THEN value - CAST(273.15 AS DOUBLE) ELSE value END AS value FROM fmt""",
}


def with_ctes(final: str, upto: str = "conv", extra: list[tuple[str, str]] = ()) -> str:
    """``WITH`` the view's tables up to one of them, then extra ones, then the final select."""
    parts = []
    for name, body in CTES.items():
        parts.append(f"{name} AS ({body})")
        if name == upto:
            break
    parts += [f"{n} AS ({b})" for n, b in extra]
    return "WITH " + ",\n".join(parts) + "\n" + final
