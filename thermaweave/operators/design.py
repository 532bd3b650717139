"""Named parameters and sparse observation designs as tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage import small_side
from .labelling import require_columns

# Instrument kinds and the name pattern of triangular parameters.
INTERCEPTS = ("site", "site+instrument", "independent", "zero")
SEASONALITIES = ("shared", "independent")
CELL_NAME = "^(.+)_([0-9]+)_([0-9]+)$"

INSTRUMENT_SCHEMA = T.StructType([
    T.StructField("variable", T.StringType()), T.StructField("tag", T.StringType()), T.StructField("intercept", T.StringType()),
    T.StructField("seasonality", T.StringType()), T.StructField("error", T.StringType()), T.StructField("site_state", T.BooleanType()),
])


def instrument_table(spark, instruments: dict[str, dict]) -> DataFrame:
    """The instrument specification as a small table."""
    rows = []
    for v, s in instruments.items():
        if s["intercept"] not in INTERCEPTS or s["seasonality"] not in SEASONALITIES:
            raise ValueError(f"unknown intercept or seasonality kind for {v}")
        rows.append((v, s["tag"], s["intercept"], s["seasonality"], s.get("error", f"r_{s['tag']}"), bool(s.get("site_state", True))))
    return spark.createDataFrame(rows, INSTRUMENT_SCHEMA)


def loading_names(sites: DataFrame, m: int, prefix: str = "lambda", fixed_diag: bool = False) -> DataFrame:
    """Non-zero loading cells (site_index, factor, name or fixed value): the upper triangle is absent."""
    if m < 1:
        raise ValueError("m must be at least 1")
    require_columns(sites, ["site_index"])
    n = sites.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    if m > n:
        raise ValueError(f"m ({m}) cannot exceed the number of sites ({n})")
    cells = sites.select("site_index", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.col("site_index").cast("bigint"), F.lit(m).cast("bigint")))).alias("factor"))
    diagonal = F.lit(fixed_diag) & (F.col("site_index") == F.col("factor"))
    return cells.select("site_index", "factor", F.when(~diagonal, F.concat_ws("_", F.lit(prefix), "site_index", "factor")).alias("name"),
                        F.when(diagonal, F.lit(1.0)).alias("fixed_value"))


def cells_from_names(params: DataFrame, lower: bool = True, fold: bool = True, n_rows: int | None = None, n_cols: int | None = None) -> DataFrame:
    """(param, row, col, value) from names like ``lambda_2_1``; names of other shapes are dropped.

    Folding moves entries to one triangle. Two names on one cell, or an index beyond the given
    dimensions, is an error raised inside the job.
    """
    rows = params.where(F.col("name").rlike(CELL_NAME))
    i, j = (F.regexp_extract("name", CELL_NAME, g).cast("int") for g in (2, 3))
    rows = rows.select(F.regexp_extract("name", CELL_NAME, 1).alias("param"), i.alias("i"), j.alias("j"), "value")
    if fold:
        big, small = F.greatest("i", "j"), F.least("i", "j")
        r, c = (big, small) if lower else (small, big)
    else:
        r, c = F.col("i"), F.col("j")
    out = rows.groupBy("param", r.alias("row"), c.alias("col")).agg(F.count(F.lit(1)).alias("_n"), F.max("value").alias("value"))
    beyond = F.lit(False)
    if n_rows is not None:
        beyond = beyond | (F.col("row") > n_rows)
    if n_cols is not None:
        beyond = beyond | (F.col("col") > n_cols)
    checked = F.when(F.col("_n") > 1, F.raise_error("two entries map to the same cell").cast("double"))
    checked = checked.when(beyond, F.raise_error("an index exceeds the requested dimensions").cast("double"))
    return out.select("param", "row", "col", checked.otherwise(F.col("value")).alias("value"))


def intercept_name(site_index: str = "site_index") -> Column:
    """The intercept parameter of a series; a sum is written ``mu_<tag>+mu_<i>``; NULL when fixed at zero."""
    i, kind = F.col(site_index).cast("string"), F.col("intercept")
    own = F.concat(F.lit("mu_"), i)
    return (
        F.when(kind == "site", own)
        .when(kind == "site+instrument", F.concat(F.lit("mu_"), F.col("tag"), F.lit("+"), own))
        .when(kind == "independent", F.concat(F.lit("mu_"), F.col("tag"), F.lit("_"), i))
    )


def seasonal_name(k, site_index: str = "site_index") -> Column:
    infix = F.when(F.col("seasonality") == "independent", F.concat(F.col("tag"), F.lit("_"))).otherwise(F.lit(""))
    return F.concat(F.lit("c"), (k if isinstance(k, Column) else F.lit(k)).cast("string"), F.lit("_"), infix, F.col(site_index).cast("string"))


def observation_design(series: DataFrame, instruments: DataFrame, m: int, n_terms: int, site_plus_factors: bool = True) -> DataFrame:
    """Non-zero entries of every series: (row, variable, site, block, target, name).

    Blocks are site_state, loading, intercept, season and error. A site whose state nobody observes
    is an error raised inside the job.
    """
    spec = small_side(instruments)
    s = series.select("row", "variable", "site", F.col("site_index").cast("bigint").alias("site_index")).join(spec, "variable")
    if site_plus_factors:
        seen = s.groupBy("site").agg(F.max("site_state").alias("_seen"))
        s = s.join(small_side(seen), "site")
        guard = F.when(~F.col("_seen"), F.raise_error(F.concat(F.lit("no instrument observes the state of "), F.col("site"))).cast("string"))
    else:
        guard = F.lit(None).cast("string")

    def term(block: str, target: Column, name: Column, when: Column | None = None):
        t = F.struct(F.lit(block).alias("block"), target.cast("bigint").alias("target"), name.cast("string").alias("name"))
        return t if when is None else F.when(when, t)

    i = F.col("site_index")
    terms = [
        term("intercept", F.lit(None), intercept_name(), intercept_name().isNotNull()),
        term("error", F.lit(None), F.col("error")),
        *[term("season", F.lit(k), seasonal_name(k)) for k in range(1, n_terms + 1)],
        *[term("loading", F.lit(j), F.concat_ws("_", F.lit("lambda"), i, F.lit(j)), F.lit(j) <= i) for j in range(1, m + 1)],
    ]
    if site_plus_factors:
        terms.append(term("site_state", i, F.coalesce(guard, F.lit("1")), F.col("site_state")))
        s = s.withColumn("site", F.coalesce(guard, F.col("site")))
    out = s.select("row", "variable", "site", F.explode(F.array_compact(F.array(*terms))).alias("t"))
    return out.select("row", "variable", "site", "t.*")


def require_names(wanted: DataFrame, params: DataFrame, optional: bool = False) -> DataFrame:
    """``wanted`` (with ``name``) joined to its value. A missing name is an error raised inside the
    job; with ``optional`` a set that is missing altogether gives zeros."""
    table = small_side(params.select("name", F.col("value").alias("_v")))
    out = wanted.join(table, "name", "left")
    if optional:
        hits = wanted.select("name").distinct().join(table, "name", "left_semi").limit(1).count()
        if not hits:
            return out.select(*wanted.columns, F.lit(0.0).alias("value"))
    problem = F.raise_error(F.concat(F.lit("no parameter named "), F.col("name"))).cast("double")
    return out.select(*wanted.columns, F.coalesce(F.col("_v"), problem).alias("value"))


# ---- seed regressions -----------------------------------------------------------------------


def seasonal_regressions(scaled: DataFrame, harmonics: int, period: float, min_obs: int, keys: list[str] = ("variable", "site"), y: str = "y", date: str = "date") -> DataFrame:
    """Intercept and 2H seasonal coefficients per series.

    One aggregate collects the centred sums of each series; all systems of an Arrow batch are solved at once.
    Series that are too short or rank deficient are left out.
    """
    from ..functions.exprs import harmonic_terms

    keys = list(keys)
    terms = harmonic_terms(date, harmonics, period)
    names = list(terms)
    rows = scaled.where(F.col(y).isNotNull()).select(*keys, F.col(y).alias("_y"), *[c.alias(n) for n, c in terms.items()])
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.array(F.avg("_y"), *[F.avg(n) for n in names]).alias("means"),
        F.array(*[F.covar_pop(a, b) for a in names for b in names]).alias("gram"), F.array(*[F.covar_pop(a, "_y") for a in names]).alias("cross"),
    ).where(F.col("n") >= max(min_obs, 1))
    solve = _solver(len(names))
    out = sums.withColumn("beta", solve("means", "gram", "cross")).where(F.col("beta").isNotNull())
    return out.select(*keys, "n", F.col("beta")[0].alias("mu"), *[F.col("beta")[k].alias(f"c{k}") for k in range(1, len(names) + 1)])


def _solver(size: int):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def solve(means: pd.Series, gram: pd.Series, cross: pd.Series) -> pd.Series:
        import numpy as np

        n = len(means)
        m, g, c = (np.array(x.tolist(), dtype=float).reshape(n, *shape) for x, shape in ((means, (size + 1,)), (gram, (size, size)), (cross, (size,))))
        usable = np.isfinite(g).all(axis=(1, 2))
        g[~usable] = 0.0
        singular = np.linalg.svd(g, compute_uv=False)
        floor = 1e-10 * np.maximum(1.0, np.abs(g).max(axis=(1, 2)))
        usable &= (singular > floor[:, None]).all(axis=1)
        b = np.linalg.solve(g[usable], c[usable][:, :, None])[:, :, 0]
        mu = m[usable, 0] - (b * m[usable, 1:]).sum(axis=1)
        out = pd.Series([None] * n, dtype=object)
        out[np.flatnonzero(usable)] = list(np.column_stack([mu, b]))
        return out

    return solve


def seed_table(regressions: DataFrame, sites: DataFrame, instruments: DataFrame, shared_from: str, n_terms: int, seed_independent: bool = True) -> DataFrame:
    """Named start values (name, value): shared site terms from one instrument, own terms for
    instruments declared independent."""
    r = regressions.join(small_side(sites), "site").join(small_side(instruments), "variable")
    i = F.col("site_index").cast("string")
    shared = F.col("variable") == shared_from

    def cell(name: Column, value: str, when: Column):
        return F.when(when & F.col(value).isNotNull(), F.struct(name.alias("name"), F.col(value).alias("value")))

    terms = ["mu", *[f"c{k}" for k in range(1, n_terms + 1)]]
    cells = [cell(F.concat_ws("_", F.lit(t), i), t, shared) for t in terms]
    if seed_independent:
        for t in terms:
            own = (F.col("intercept") if t == "mu" else F.col("seasonality")) == "independent"
            cells.append(cell(F.concat_ws("_", F.lit(t), F.col("tag"), i), t, own))
    return r.select(F.explode(F.array_compact(F.array(*cells))).alias("c")).select("c.*")
