"""Reading extracts, run outputs and grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage import small_side
from ..operators.grid import TimeAxis
from ..operators.labelling import missing_as_null
from ..schemas import RAW_LONG, RAW_LONG_TEXT_TIME, STATES


def read_long(spark: SparkSession, path, fmt: str = "csv", schema: T.StructType = RAW_LONG) -> DataFrame:
    """A long table with an explicit schema: no inference pass, and only the needed columns are read."""
    reader = spark.read.schema(schema)
    if fmt == "csv":
        rows = reader.option("header", True).option("nullValue", "NA").option("emptyValue", "").csv(path)
    else:
        rows = reader.format(fmt).load(path)
    # NaN stands for a missing value, like NULL.
    return rows.select(*[missing_as_null(rows, c).alias(c) for c in rows.columns])


def read_long_parse_time(spark: SparkSession, path, fmt: str = "csv") -> DataFrame:
    """The same with ``time`` as text turned into a date; an unreadable one becomes NULL, to be counted."""
    return parse_time(read_long(spark, path, fmt, RAW_LONG_TEXT_TIME))


def parse_time(df: DataFrame, column: str = "time") -> DataFrame:
    return df.withColumn(column, F.try_to_date(F.substring(F.col(column), 1, 10), "yyyy-MM-dd"))


def read_runs(spark: SparkSession, paths: list[str], fmt: str = "parquet", schema: T.StructType = STATES) -> DataFrame:
    """Reconstructions of several runs in one read, tagged from ``.../<model>/<run>/...`` paths."""
    reader = spark.read.schema(schema)
    rows = reader.option("header", True).csv(paths) if fmt == "csv" else reader.format(fmt).load(paths)
    where = F.col("_metadata.file_path")
    pattern = r"/([^/]+)/([^/]+)/[^/]+(?:/[^/]+)?$"
    return rows.select(
        F.regexp_extract(where, pattern, 1).alias("model"), F.regexp_extract(where, pattern, 2).alias("run"), *schema.names)


def read_axis(spark: SparkSession, root: str) -> TimeAxis:
    """The time axis beside a grid or a run."""
    r = spark.read.parquet(f"{root}/axis").first()
    return TimeAxis(r["start"], r["time_step"], r["last_bin"])


def list_runs(spark: SparkSession, root: str) -> DataFrame:
    """The complete runs below ``root`` (:func:`thermaweave.sources.writers.write_runs`): a row of the manifest each, with ``file``."""
    return spark.read.parquet(f"{root}/manifest").select("model", "run", F.lit("states").alias("file"), "n_rows", "first_date", "last_date", "n_dates", "time_step", "columns")


def read_listed_runs(spark: SparkSession, root: str, schema: T.StructType = STATES) -> DataFrame:
    """Rows of every complete run, with its model and run."""
    named = T.StructType([*schema.fields, T.StructField("model", T.StringType()), T.StructField("run", T.StringType())])
    rows = spark.read.schema(named).parquet(f"{root}/states")
    return rows.join(small_side(list_runs(spark, root).select("model", "run").distinct()), ["model", "run"], "left_semi").select("model", "run", *schema.names)


def run_registry(spark: SparkSession, root: str) -> DataFrame:
    """(model, run, file) of everything under ``<root>/<model>/<run>/<file>``, from the file listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    pattern = r"/([^/]+)/([^/]+)/([^/]+)/[^/]+$"
    return files.select(*[F.regexp_extract("path", pattern, g).alias(n) for g, n in ((1, "model"), (2, "run"), (3, "file"))]).distinct()
