"""Regular site-by-date grids, kept long.

A grid is a sparse table of observed cells plus two small dimensions (series, dates). The dense
form, with a NULL row for every gap, is produced only on request.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import SEASON_DAYS, finite, harmonic_terms
from ..functions.lineage import cut, null_safe_join, small_side
from ..functions.quantiles import quantile_table
from ..functions.ranking import number_rows
from .labelling import require_columns

AGGREGATES = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class TimeAxis:
    """Bins of ``time_step`` days from ``start``, numbered from 0 to ``last_bin``."""

    start: dt.date
    time_step: int
    last_bin: int

    def within(self, after=None, until=None) -> "TimeAxis":
        """The bins that begin after ``after`` and no later than ``until``: what :func:`select_period` keeps of a grid."""
        first, last = 0, self.last_bin
        if after is not None:
            first = max(first, (_day(after) - self.start).days // self.time_step + 1)
        if until is not None:
            last = min(last, (_day(until) - self.start).days // self.time_step)
        if last < first:
            raise ValueError("no bin of the time axis lies in the chosen period")
        return TimeAxis(self.start + dt.timedelta(days=first * self.time_step), self.time_step, last - first)

    def dates(self, spark: SparkSession) -> DataFrame:
        """One row per bin: its number and its first day."""
        return spark.range(self.last_bin + 1).select(F.col("id").cast("int").alias("bin"), F.date_add(F.lit(self.start), F.col("id").cast("int") * F.lit(self.time_step)).alias("date"))


def _day(d) -> dt.date:
    return d if isinstance(d, dt.date) else dt.date.fromisoformat(str(d)[:10])


class Grid:
    """Observed cells, the series dimension and the date axis."""

    def __init__(self, cells: DataFrame, series: DataFrame, sites: DataFrame, dropped: DataFrame, start: dt.date, last_bin: int, time_step: int):
        self.cells, self.series, self.sites, self.dropped = cells, series, sites, dropped
        self.start, self.last_bin, self.time_step = start, last_bin, time_step

    @property
    def time_axis(self) -> TimeAxis:
        return TimeAxis(self.start, self.time_step, self.last_bin)

    def date_of(self, b) -> Column:
        return F.date_add(F.lit(self.start), (F.col(b) if isinstance(b, str) else b) * F.lit(self.time_step))

    def long(self) -> DataFrame:
        """Observed cells with row number, key, site index and date."""
        slim = self.series.select("variable", "site", "row", "row_key", "site_index")
        out = self.cells.join(slim, ["variable", "site"])
        return out.select("row", "row_key", "variable", "site", "site_index", "bin", self.date_of("bin").alias("date"), "value")

    def dense(self) -> DataFrame:
        """A row for every series and bin; gaps are NULL."""
        frame = self.series.select("row", "row_key", "variable", "site", "site_index", F.explode(F.sequence(F.lit(0), F.lit(self.last_bin))).alias("bin"))
        out = frame.join(self.cells, ["variable", "site", "bin"], "left")
        return out.select("row", "row_key", "variable", "site", "site_index", "bin", self.date_of("bin").alias("date"), "value")

    def arrays(self) -> DataFrame:
        """One ordered array per series. A series holds at most one cell per bin of the axis."""
        cells = self.cells.groupBy("variable", "site").agg(F.map_from_entries(F.collect_list(F.struct("bin", "value"))).alias("_m"))
        filled = F.transform(F.sequence(F.lit(0), F.lit(self.last_bin)), lambda b: F.try_element_at(F.col("_m"), b))
        return self.series.join(cells, ["variable", "site"]).select("row", "row_key", "variable", "site", filled.alias("values"))

    def axis(self, spark) -> DataFrame:
        """The bin start dates."""
        return spark.range(self.last_bin + 1).select(F.col("id").cast("int").alias("bin")).withColumn("date", self.date_of("bin"))


def build_grid(
    df: DataFrame, variables: list[str] | None = None, time_step: int = 1, agg: str = "mean", site: str = "point_id", time: str = "time",
    value: str = "value", statistic_col: str | None = None, statistic=None, strict: bool = True,
) -> Grid:
    """Fixed-width bins of the selected variables.

    The origin and the last bin come from all selected rows, before missing values are dropped;
    a series without a value gets no row and is listed in ``dropped``. With ``strict`` a table without
    any value is an error; otherwise its grid has no series, on the axis of its dates (no bin, if there are none).
    """
    require_columns(df, ["variable", site, time, value])
    if time_step is None or time_step < 1:
        raise ValueError("time_step must be at least one day")
    if (statistic_col is None) != (statistic is None):
        raise ValueError("statistic_col and statistic go together")
    rows = df
    if statistic_col is not None:
        rows = rows.where(F.col(statistic_col).isin(statistic if isinstance(statistic, (list, tuple)) else [statistic]))
    if variables is None:
        variables = sorted(r[0] for r in rows.select("variable").distinct().collect() if r[0] is not None)
    rows = rows.where(F.col("variable").isin(variables)).select(
        "variable", F.col(site).cast("string").alias("site"), F.to_date(time).alias("date"), F.col(value).cast("double").alias("value"))
    span = rows.agg(F.min("date").alias("a"), F.max("date").alias("b"), F.count_if(F.col("date").isNull()).alias("bad"), F.count("value").alias("n")).first()
    if span["bad"]:
        raise ValueError(f"{span['bad']} dates could not be read")
    if strict and not span["n"]:
        raise ValueError("no non-missing values remain")
    start = span["a"] or dt.date(1970, 1, 1)
    last_bin = -1 if span["a"] is None else (span["b"] - start).days // time_step

    keys = ["variable", "site", "bin"]
    present = rows.where(finite("value").isNotNull() | F.col("value").isin(float("inf"), float("-inf")))
    present = present.select("variable", "site", F.floor(F.datediff("date", F.lit(start)) / F.lit(time_step)).cast("int").alias("bin"), "value")
    if agg == "median":
        cells = quantile_table(present, keys, "value", {"_q": 0.5}).select(*keys, F.col("_q").alias("value"))
    elif agg in AGGREGATES:
        cells = present.groupBy(*keys).agg(AGGREGATES[agg]("value").alias("value"))
    else:
        raise ValueError(f"agg must be one of median, {', '.join(AGGREGATES)}")

    pairs = cut(present.select("variable", "site").distinct())
    series = index_series(pairs, variables)
    sites = rows.select("site").distinct()
    wanted = sites.select("site", F.explode(F.array(*map(F.lit, variables))).alias("variable"))
    dropped = null_safe_join(wanted, pairs, ["variable", "site"], "left_anti").select("variable", "site")
    return Grid(cells, series, sites, dropped, start, int(last_bin), int(time_step))


def index_series(pairs: DataFrame, variables: list[str]) -> DataFrame:
    """Row numbers in caller's variable order, sites sorted inside, and the index of each site.

    ``pairs`` is the series dimension, ranked by range partitions.
    """
    order = F.array_position(F.array(*map(F.lit, variables)), F.col("variable"))
    rows = number_rows(pairs.select("variable", "site"), [], [order, "site"], "row")
    rows = rows.join(small_side(site_ranks(pairs)), "site")
    return small_side(rows.select("row", F.concat_ws("_", "variable", "site").alias("row_key"), "variable", "site", "site_index"))


def site_ranks(df: DataFrame, site: str = "site") -> DataFrame:
    """1..n over the distinct sites, in order: ranks the dimension, never the facts."""
    return number_rows(df.select(F.col(site).alias("site")).where(F.col("site").isNotNull()).distinct(), [], ["site"], "site_index")


def seasonal_basis(axis: DataFrame, harmonics: int = 2, period: float = SEASON_DAYS, date: str = "date") -> DataFrame:
    """The harmonic terms on a date axis, as columns."""
    return axis.select(date, *[c.alias(n) for n, c in harmonic_terms(date, harmonics, period).items()])


def seasonal_basis_long(axis: DataFrame, harmonics: int = 2, period: float = SEASON_DAYS, date: str = "date") -> DataFrame:
    """The same as (date, k, d) with k = 1..2H in the order sin1, cos1, sin2, ..."""
    terms = harmonic_terms(date, harmonics, period).values()
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), c.alias("d")) for i, c in enumerate(terms, start=1)]))
    return axis.select(date, cells.alias("c")).select(date, "c.k", "c.d")


# ---- model inputs ---------------------------------------------------------------------------


def select_period(df: DataFrame, sites: list[str] | None = None, start=None, end=None, site: str = "site", date: str = "date") -> DataFrame:
    """Chosen sites, dates after ``start`` (exclusive) up to ``end`` (inclusive)."""
    if sites is not None:
        df = df.where(F.col(site).isin(list(sites)))
    if start is not None:
        df = df.where(F.col(date) > F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col(date) <= F.lit(end).cast("date"))
    return df


def split_holdout(grid: DataFrame, sites: list[str], variables: list[str]) -> tuple[DataFrame, DataFrame]:
    """(fit rows, withheld rows). A site that would lose every row is an error."""
    held = F.col("site").isin(list(sites)) & F.col("variable").isin(list(variables))
    per_site = grid.where(F.col("site").isin(list(sites))).groupBy("site").agg(F.count_if(~held).alias("left"))
    emptied = [r[0] for r in per_site.where("left = 0").select("site").limit(20).collect()]
    if emptied:
        raise ValueError("the hold-out leaves no observations at: " + ", ".join(emptied))
    withheld = grid.where(held & F.col("value").isNotNull()).select("date", "site", "variable", "value")
    return grid.where(~held), withheld


def scale_constants(grid: DataFrame, reference: str, strict: bool = True) -> DataFrame:
    """Per site mean and spread of the reference variable.

    With ``strict`` a site whose pair is unusable is an error raised inside the job.
    """
    ref = F.when(F.col("variable") == reference, F.col("value"))
    out = grid.groupBy("site").agg(F.avg(ref).alias("mu"), F.stddev_samp(ref).alias("sigma"))
    ok = finite("mu").isNotNull() & finite("sigma").isNotNull() & (F.col("sigma") > 0)
    if not strict:
        return out.withColumn("usable", F.coalesce(ok, F.lit(False)))
    problem = F.raise_error(F.concat(F.lit("no usable scale at site "), F.col("site"))).cast("double")
    return out.select("site", F.when(ok, F.col("mu")).otherwise(problem).alias("mu"), "sigma")


def scale_values(grid: DataFrame, scales: DataFrame) -> DataFrame:
    """``(value - mu) / sigma`` with the pair of the site."""
    joined = grid.join(small_side(scales.select("site", "mu", "sigma")), "site")
    return joined.withColumn("y", (F.col("value") - F.col("mu")) / F.col("sigma")).drop("mu", "sigma")


def scale_each_series(grid: DataFrame) -> DataFrame:
    """Every series by its own mean and spread."""
    stats = grid.groupBy("variable", "site").agg(F.avg("value").alias("mu"), F.stddev_samp("value").alias("sigma"))
    joined = grid.join(small_side(stats), ["variable", "site"])
    return joined.withColumn("y", (F.col("value") - F.col("mu")) / F.col("sigma")).drop("mu", "sigma")


def scale_by_one_series(grid: DataFrame, variable: str, site: str) -> DataFrame:
    """The whole grid by the mean and spread of one series."""
    one = F.when((F.col("variable") == variable) & (F.col("site") == site), F.col("value"))
    pair = grid.agg(F.avg(one).alias("mu"), F.stddev_samp(one).alias("sigma")).first()
    return grid.withColumn("y", (F.col("value") - F.lit(pair["mu"])) / F.lit(pair["sigma"]))


def covariate_grid(df: DataFrame, variables: list[str], statistics: list[str], dates: DataFrame, site: str = "point_id", time: str = "time") -> Grid:
    """Covariates averaged over duplicates, limited to an existing date axis, on the same kind of grid."""
    mean = df.where(F.col("variable").isin(variables) & F.col("stat").isin(statistics)).groupBy(
        F.to_date(time).alias(time), site, "variable", "stat").agg(F.avg("value").alias("value"))
    on_axis = mean.join(small_side(dates.select(F.col("date").alias(time)).distinct()), time, "left_semi")
    return build_grid(on_axis, variables, 1, "mean", site, time, statistic_col="stat", statistic=statistics)


def coverage(grid: Grid) -> DataFrame:
    """Observed cells, all cells and percent per variable block, with a pooled row."""
    cells = F.lit(grid.last_bin + 1)
    seen = grid.cells.groupBy("variable").agg(F.count("value").alias("n_observed"))
    rows = grid.series.groupBy("variable").agg(F.count(F.lit(1)).alias("n_series"), F.min("row").alias("first_row"), F.max("row").alias("last_row"))
    both = rows.join(seen, "variable", "left").select("variable", "n_series", "first_row", "last_row", "n_observed", (F.col("n_series") * cells).alias("n_cells"))
    level = F.explode(F.array(F.lit("(all)"), F.col("variable")))
    out = both.withColumn("block", level).groupBy("block").agg(
        F.sum("n_series").alias("n_series"), F.min("first_row").alias("first_row"), F.max("last_row").alias("last_row"),
        F.sum("n_observed").alias("n_observed"), F.sum("n_cells").alias("n_cells"))
    return out.withColumn("pct_observed", F.lit(100.0) * F.col("n_observed") / F.col("n_cells"))


def thin_columns(grid: Grid, max_columns: int = 1500) -> DataFrame:
    """Observed cells on at most ``max_columns`` evenly spaced columns (for display)."""
    total = grid.last_bin + 1
    if total <= max_columns:
        return grid.cells
    # Counting columns from 1, pick j of n is round(1 + j * (total-1) / (n-1)); a bin is shown when
    # the nearest j maps back to it.
    gap = F.lit((total - 1) / (max_columns - 1))
    j = F.round(F.col("bin") / gap)
    return grid.cells.where(F.bround(F.lit(1.0) + j * gap).cast("int") - 1 == F.col("bin"))


# ---- series statistics ----------------------------------------------------------------------


def in_time_blocks(df: DataFrame, at: Column, before: int, after: int, size: int) -> DataFrame:
    """Rows in blocks of ``size`` steps, copied into the neighbouring blocks whose rows look at them; ``_block`` and ``_own`` are added.

    A row at ``t`` looks at ``[t - before, t + after]``, so it is needed from ``t - after`` to ``t + before``. A window by key and ``_block`` then
    holds a block and its margins, never a whole series.
    """
    def block(c: Column) -> Column:
        return F.floor(c / F.lit(float(size))).cast("bigint")

    out = df.withColumn("_block", F.explode(F.sequence(block(at - F.lit(after)), block(at + F.lit(before)))))
    return out.withColumn("_own", F.col("_block") == block(at))


def rolling_mean(df: DataFrame, keys: list[str], date: str = "date", values: list[str] = ("value",), before: int = 1, after: int = 1, block_days: int = 4096) -> DataFrame:
    """Means of all values within a calendar-day window, one row per key and date present.

    Values are first summed per date; a series is cut into blocks of days, so that it spans tasks.
    """
    sums = [c for v in values for c in (F.sum(v).alias(f"_s_{v}"), F.count(v).alias(f"_n_{v}"))]
    daily = in_time_blocks(df.groupBy(*keys, date).agg(*sums), F.unix_date(date), before, after, block_days)
    near = Window.partitionBy(*keys, "_block").orderBy(F.unix_date(date)).rangeBetween(-before, after)
    means = [(F.sum(f"_s_{v}").over(near) / F.nullif(F.sum(f"_n_{v}").over(near), F.lit(0))).alias(f"{v}_mean") for v in values]
    return daily.select(*keys, date, "_own", *means).where("_own").drop("_own")


def date_gaps(df: DataFrame, keys: list[str], date: str = "date") -> DataFrame:
    """Days between consecutive distinct dates per key."""
    order = Window.partitionBy(*keys).orderBy(date)
    dates = df.select(*keys, date).distinct()
    return dates.withColumn("gap", F.datediff(date, F.lag(date).over(order))).where(F.col("gap").isNotNull())


def modal_gap(df: DataFrame, keys: list[str], date: str = "date") -> DataFrame:
    """Most frequent gap per key; ties take the smallest."""
    counts = date_gaps(df, keys, date).groupBy(*keys, "gap").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.max_by("gap", F.struct("n", -F.col("gap"))).alias("step_days"))


def autocorrelation(cells: DataFrame, keys: list[str], max_lag: int, bin_col: str = "bin", value: str = "value", block_bins: int = 4096) -> DataFrame:
    """Autocorrelation by lag with gaps passed over.

    Deviations are from the series mean; a lag's sum over observed pairs is divided by
    (pairs + lag), lag 0 by its own count. A series has one cell per bin and is cut into blocks of bins with a margin of the
    largest lag, so all lags are windows over one shuffle and a series spans tasks; lags without a pair give no row.
    """
    seen = cells.where(F.col(value).isNotNull()).select(*keys, bin_col, F.col(value).alias("_v"))
    means = small_side(seen.groupBy(*keys).agg(F.avg("_v").alias("_m")))
    x = null_safe_join(seen, means, keys).select(*keys, bin_col, (F.col("_v") - F.col("_m")).alias("_x"))
    ahead = Window.partitionBy(*keys, "_block").orderBy(F.col(bin_col))
    lags = range(max_lag + 1)
    products = in_time_blocks(x, F.col(bin_col), 0, max_lag, block_bins).select(*keys, "_own", *[(F.col("_x") * F.sum("_x").over(ahead.rangeBetween(k, k))).alias(f"_p{k}") for k in lags])
    sums = products.where("_own").groupBy(*keys).agg(*[c for k in lags for c in (F.sum(f"_p{k}").alias(f"_s{k}"), F.count(f"_p{k}").alias(f"_n{k}"))])
    first = F.try_divide("_s0", "_n0")
    rows = F.explode(F.array(*[
        F.struct(F.lit(k).alias("lag"), F.col(f"_n{k}").alias("n_pairs"), F.try_divide(F.try_divide(f"_s{k}", F.col(f"_n{k}") + k), first).alias("acf"))
        for k in lags
    ]))
    return sums.select(*keys, rows.alias("r")).select(*keys, "r.*").where("n_pairs > 0")


def calibrate(pairs: DataFrame, target: str, predictor: str) -> tuple[float, float]:
    """(intercept, slope) of target on predictor, for applying to another series."""
    row = pairs.agg(F.regr_intercept(target, predictor).alias("a"), F.regr_slope(target, predictor).alias("b")).first()
    return row["a"], row["b"]


def spatial_bins(df: DataFrame, size_m: float = 2000.0, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Square cells in local metres around the mean position, with cell centres."""
    from ..functions.exprs import METRES_PER_DEGREE, metres_east, metres_north

    origin = df.agg(F.avg(lat).alias("lat0"), F.avg(lon).alias("lon0")).first()
    lat0, lon0 = F.lit(origin["lat0"]), F.lit(origin["lon0"])
    size, north = F.lit(float(size_m)), F.lit(METRES_PER_DEGREE)
    east = north * F.cos(F.radians(lat0))
    out = df.withColumn("bin_x", F.floor(metres_east(lon, lon0, lat0) / size)).withColumn("bin_y", F.floor(metres_north(lat, lat0) / size))
    return out.withColumns({
        "bin_id": F.concat_ws("_", "bin_x", "bin_y"),
        "bin_lon": lon0 + (F.col("bin_x") + F.lit(0.5)) * size / east,
        "bin_lat": lat0 + (F.col("bin_y") + F.lit(0.5)) * size / north,
    })


def with_distinct_dates(df: DataFrame, keys: list[str], date: str = "date") -> DataFrame:
    """Each row with its group's number of distinct dates.

    Dates are bits of a map per group, merged before the shuffle: a task sends a bitmap for each group (4 KB for every 90 years), not its dates.
    """
    day = F.unix_date(date).cast("bigint")
    maps = df.groupBy(*keys, F.bitmap_bucket_number(day).alias("_b")).agg(F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position(day))).alias("_n"))
    n = maps.groupBy(*keys).agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("n_dates"))
    return null_safe_join(df, small_side(n), keys)


def profile_series(df: DataFrame, size_m: float = 2000.0, min_dates: int = 150, max_depth: float = 5.0, date: str = "date", depth: str = "depth_m", value: str = "value") -> DataFrame:
    """Daily means of shallow values in well-visited cells."""
    cells = with_distinct_dates(spatial_bins(df, size_m), ["bin_x", "bin_y"], date)
    rows = cells.where((F.col("n_dates") > min_dates) & (F.col(depth) < max_depth))
    return rows.groupBy("bin_id", "bin_lat", "bin_lon", date).agg(F.avg(value).alias(value))
