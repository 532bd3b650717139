"""Writing results. Every writer refuses a non-empty target unless told to overwrite."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.combine import COMBINED_COLUMNS
from ..functions.lineage import small_side
from ..operators.grid import Grid, TimeAxis


def _mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "errorifexists"


def write_table(df: DataFrame, path: str, overwrite: bool = False, fmt: str = "parquet", partition_by: list[str] = ()) -> str:
    writer = df.write.mode(_mode(overwrite))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).option("nullValue", "NA").csv(path)
    else:
        writer.format(fmt).save(path)
    return path


def write_preprocessing(root: str, clean: DataFrame, removed: DataFrame, tables: dict[str, DataFrame], overwrite: bool = False) -> None:
    """Clean data and the removal log as parquet, summary tables as CSV."""
    write_table(clean, f"{root}/clean", overwrite, partition_by=["variable"])
    write_table(removed, f"{root}/removed", overwrite)
    for name, table in tables.items():
        write_table(table, f"{root}/tables/{name}", overwrite, "csv")


def write_grid(grid: Grid, root: str, overwrite: bool = False) -> None:
    """Observed cells partitioned by variable, row metadata, and the dropped-series list."""
    write_table(grid.long(), f"{root}/grid", overwrite, partition_by=["variable"])
    write_table(grid.series, f"{root}/rows", overwrite)
    write_table(grid.dropped, f"{root}/dropped", overwrite)
    write_axis(grid.time_axis, grid.cells.sparkSession, root, overwrite)


def write_axis(axis: TimeAxis, spark: SparkSession, root: str, overwrite: bool = False) -> None:
    """The time axis in one row, written last: a folder without it is not complete."""
    row = spark.createDataFrame([(axis.start, axis.time_step, axis.last_bin)], "start date, time_step int, last_bin int")
    write_table(row.coalesce(1), f"{root}/axis", overwrite)


def write_runs(states: DataFrame, root: str) -> None:
    """Reconstructions of any number of models and runs, in one write each for rows and manifest.

    ``states`` has model, run and the columns of a view. The manifest has a row for each run (rows, first and last date, time step,
    columns) and is written after all rows, so a run whose writing broke off is never listed.
    """
    cols = [c for c in states.columns if c not in ("model", "run")]
    states.write.mode("append").partitionBy("model", "run").parquet(f"{root}/states")
    written = states.sparkSession.read.schema(states.schema).parquet(f"{root}/states")
    runs = states.select("model", "run").distinct()
    facts = written.join(small_side(runs), ["model", "run"], "left_semi").groupBy("model", "run").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count_distinct("date").alias("n_dates"))
    step = F.floor(F.datediff("last_date", "first_date") / F.nullif(F.col("n_dates") - 1, F.lit(0))).cast("int")
    facts.withColumns({"time_step": step, "columns": F.lit(",".join(cols))}).write.mode("append").parquet(f"{root}/manifest")


def write_views(views: dict[str, DataFrame], root: str, formats: list[str] = ("parquet",), overwrite: bool = False) -> None:
    """``states`` for the site view and ``states_<tag>_only`` for instrument views, in each format."""
    for tag, view in views.items():
        name = "states" if tag == "" else f"states_{tag}_only"
        for fmt in formats:
            write_table(view, f"{root}/{name}.{fmt}", overwrite, fmt)


def write_model_inputs(root: str, scales: DataFrame, design: DataFrame, observations: DataFrame, holdout: DataFrame | None, overwrite: bool = False, dates: DataFrame | None = None) -> bool:
    """Scales, design, observations and (if given) the dates of the states; the hold-out only when it has rows. Returns whether it was written."""
    write_table(scales, f"{root}/scales", overwrite)
    write_table(design, f"{root}/design", overwrite)
    if dates is not None:
        write_table(dates, f"{root}/dates", overwrite)
    write_table(observations, f"{root}/observations", overwrite, partition_by=["variable"])
    if holdout is None or holdout.isEmpty():
        return False
    write_table(holdout, f"{root}/validation", overwrite)
    return True


def write_scores(root: str, tables: dict[str, DataFrame], overwrite: bool = False, fmt: str = "csv") -> None:
    for name, table in tables.items():
        write_table(table, f"{root}/{name}", overwrite, fmt)


def write_combined(df: DataFrame, path: str, overwrite: bool = False) -> str:
    """The combined table: fixed column order, empty text for missing values."""
    df.select(*COMBINED_COLUMNS).write.mode(_mode(overwrite)).option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)
    return path
