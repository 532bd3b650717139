"""Rebuilding series in physical units from states and parameters.

The standard error treats states as independent, by design: the covariance between a site state
and the shared factors is not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import SEASON_DAYS, harmonic_terms
from ..functions.lineage import cut, small_side


def view_coefficients(
    sites: DataFrame, params: DataFrame, n_terms: int, m: int, intercept: str = "site", seasonality: str = "shared", tag: str | None = None,
    optional: bool = False,
) -> DataFrame:
    """One row per site: scale pair, intercept, and arrays of seasonal and loading coefficients.

    ``sites`` has (site, site_index, mu, sigma). A missing name is an error, except that a shared
    set missing altogether counts as zeros when ``optional``. Absent loadings are structural zeros.
    """
    infix = "" if seasonality == "shared" else f"{tag}_"
    if seasonality not in ("shared", "independent"):
        raise ValueError(f"unknown seasonality kind: {seasonality}")
    slots = {
        "zero": {}, "site": {"mu_a": ("mu_{i}", optional)}, "independent": {"mu_a": (f"mu_{tag}_{{i}}", False)},
        "site+instrument": {"mu_a": ("mu_{i}", optional), "mu_b": (f"mu_{tag}", False)},
    }
    if intercept not in slots:
        raise ValueError(f"unknown intercept kind: {intercept}")
    chosen = {**slots[intercept], **{f"c{k}": (f"c{k}_{infix}{{i}}", optional) for k in range(1, n_terms + 1)}}
    i = F.col("site_index").cast("string")

    def fill(template: str) -> Column:
        head, brace, tail = template.partition("{i}")
        return F.concat(F.lit(head), i, F.lit(tail)) if brace else F.lit(template)

    base = cut(sites.select("site", "site_index", "mu", "sigma"))
    table = small_side(params.select("name", "value"))
    wanted = F.explode(F.array(*[F.struct(F.lit(s).alias("slot"), fill(t).alias("name"), F.lit(o).alias("optional")) for s, (t, o) in chosen.items()]))
    named = cut(base.select("site", wanted.alias("w")).select("site", "w.*").join(table, "name", "left"))
    # At most 2H + 2 rows: which coefficient sets the parameters do not have at all.
    empty = [r["slot"] for r in named.groupBy("slot").agg(F.count("value").alias("n")).where("n = 0").collect()]
    problem = F.raise_error(F.concat(F.lit("no parameter named "), F.col("name"))).cast("double")
    value = F.coalesce(F.col("value"), F.when(F.col("optional") & F.col("slot").isin(empty), F.lit(0.0)).otherwise(problem))
    rows = named.select("site", "slot", value.alias("value"))
    pattern = r"^lambda_([0-9]+)_([0-9]+)$"
    lam = table.where(F.col("name").rlike(pattern)).select(
        F.regexp_extract("name", pattern, 1).cast("bigint").alias("_i"), F.regexp_extract("name", pattern, 2).cast("int").alias("_j"), "value")
    lam = lam.where(F.col("_j") <= m).join(base.select("site", F.col("site_index").cast("bigint").alias("_i")), "_i")
    rows = rows.unionByName(lam.select("site", F.concat(F.lit("l"), F.col("_j").cast("string")).alias("slot"), "value"))

    def slot(name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("slot") == name, F.col("value"))), F.lit(0.0))

    coefs = rows.groupBy("site").agg(
        (slot("mu_a") + slot("mu_b")).alias("intercept"), F.array(*[slot(f"c{k}") for k in range(1, n_terms + 1)]).alias("season"),
        F.array(*[slot(f"l{j}") for j in range(1, m + 1)]).alias("loading"),
    )
    return base.join(coefs, "site").select("site", "mu", "sigma", "intercept", "season", "loading")


#: Factors whose products are summed in one expression.
FACTOR_BLOCK = 32


def loadings(sites: DataFrame, params: DataFrame, m: int) -> DataFrame:
    """The non-zero loadings (site, factor, value) of the first ``m`` factors, from parameters named ``lambda_<site>_<factor>``."""
    pattern = r"^lambda_([0-9]+)_([0-9]+)$"
    lam = params.where(F.col("name").rlike(pattern)).select(
        F.regexp_extract("name", pattern, 1).cast("bigint").alias("_i"), F.regexp_extract("name", pattern, 2).cast("int").alias("factor"), "value")
    own = sites.select("site", F.col("site_index").cast("bigint").alias("_i"))
    return lam.where(F.col("factor") <= m).join(own, "_i").select("site", "factor", "value")


def shared_part(cells: DataFrame, loads: DataFrame, factors: DataFrame) -> DataFrame:
    """What the shared factors add at each (site, date) of ``cells``: (site, date, shared, shared_var).

    A sparse product in blocks of ``FACTOR_BLOCK`` factors: a site meets only the blocks in which it has loadings, a block is one
    expression of a row, and the sums of a cell's blocks are combined before the shuffle. Nothing is as long as the number of factors.
    """
    size = F.lit(FACTOR_BLOCK)
    block, place = F.floor((F.col("factor") - 1) / size).cast("int").alias("_block"), F.pmod(F.col("factor") - 1, size).cast("int")

    def dense(name: str) -> Column:
        """A block's values in order, zero where there is none."""
        entries = F.map_from_entries(F.collect_list(F.struct(place.alias("k"), F.col(name).alias("v"))))
        return F.transform(F.sequence(F.lit(0), size - 1), lambda k: F.coalesce(F.try_element_at(entries, k), F.lit(0.0)))

    own = loads.groupBy("site", block).agg(dense("value").alias("_l"))
    both = factors.groupBy("date", block).agg(dense("x").alias("_x"), dense("se").alias("_se"))
    parts = cells.select("site", "date").join(small_side(own), "site").join(small_side(both), ["date", "_block"])
    return parts.groupBy("site", "date").agg(F.sum(_dot("_l", "_x")).alias("shared"), F.sum(_dot_squares("_l", "_se")).alias("shared_var"))


def factor_table(factors: DataFrame, m: int) -> DataFrame:
    """Factor states (factor, date, x, se) as one row of arrays per date."""
    def pick(c: str) -> Column:
        return F.array(*[F.max(F.when(F.col("factor") == j, F.col(c))) for j in range(1, m + 1)])

    return factors.groupBy("date").agg(pick("x").alias("fx"), pick("se").alias("fse"))


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def _dot_squares(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * x * y * y), F.lit(0.0), lambda acc, x: acc + x)


def reconstruct_view(
    site_states: DataFrame, factors: DataFrame | None, coefs: DataFrame, variable: str = "sst", harmonics: int = 1, period: float = SEASON_DAYS,
    site_state: bool = True, shared_cells: DataFrame | None = None,
) -> DataFrame:
    """``value = sigma * (Z x + season + intercept) + mu`` and its standard error, per (site, date).

    The factors' part comes either as ``factors`` (a few, as arrays by date) or, for any number, as ``shared_cells`` from :func:`shared_part`.

    Site states are the fact table; factor states join by date and coefficients by site, both small
    and checked, so the matrix products are expressions on one row and no product is shuffled.
    """
    rows = site_states.select("site", "date", "x", "se").join(small_side(coefs), "site")
    if factors is not None:
        rows = rows.join(small_side(factors), "date")
        shared, shared_var = _dot("loading", "fx"), _dot_squares("loading", "fse")
    elif shared_cells is not None:
        rows = rows.join(shared_cells, ["site", "date"], "left")
        shared, shared_var = (F.coalesce(c, F.lit(0.0)) for c in ("shared", "shared_var"))
    else:
        shared = shared_var = F.lit(0.0)
    own, own_var = (F.col("x"), F.col("se") * F.col("se")) if site_state else (F.lit(0.0), F.lit(0.0))
    basis = F.array(*harmonic_terms("date", harmonics, period).values())
    rows = rows.withColumn("basis", basis)
    value = F.col("sigma") * (own + shared + _dot("season", "basis") + F.col("intercept")) + F.col("mu")
    return rows.select("date", "site", F.lit(variable).alias("variable"), value.alias("value"), (F.col("sigma") * F.sqrt(own_var + shared_var)).alias("se"))


def climatology_view(site_dates: DataFrame, coefs: DataFrame, variable: str = "mean_sst", harmonics: int = 1, period: float = SEASON_DAYS) -> DataFrame:
    """Site mean and seasonal terms only, in physical units."""
    rows = site_dates.select("site", "date").join(small_side(coefs), "site").withColumn("basis", F.array(*harmonic_terms("date", harmonics, period).values()))
    value = F.col("sigma") * (_dot("season", "basis") + F.col("intercept")) + F.col("mu")
    return rows.select("date", "site", F.lit(variable).alias("variable"), value.alias("value"))


def contribution(fused: DataFrame, instrument: DataFrame) -> DataFrame:
    """Fused view minus instrument view, per site and date."""
    a = fused.select("site", "date", F.col("value").alias("fused"))
    b = instrument.select("site", "date", F.col("value").alias("instrument"))
    return a.join(b, ["site", "date"]).withColumn("diff", F.col("fused") - F.col("instrument"))
