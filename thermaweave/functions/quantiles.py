"""Exact quantiles that do not need a whole group in one task.

``percentile`` holds all distinct values of a group in one task. Here two passes do, for several value columns, all their quantiles
and further aggregates at once. The first is one aggregate by key: counts, and a mergeable sketch of what encloses each wanted rank, ``MARGIN``
times the sketch's error wide on either side. The second counts, for each bracket, the values below it as one cell and each distinct value inside
as a cell of its own (a value however frequent is one cell), and ranks these few. A group of at most ``RANKED`` values has one bracket that holds
all. Only where a bracket would still hold over ``CELLS`` values, in groups of some 10^8 values, is it narrowed by a sketch of its own first.

The input is read twice or more: write a narrow table first (:func:`narrow`). NULL and NaN are missing; a group without values has
NULL quantiles; NULL keys match each other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .exprs import MAD_FACTOR
from .lineage import BROADCAST_ROWS, cut, null_safe_join, staged

#: A group of so many values is ranked whole.
RANKED = 10_000
#: Values of one bracket that a task ranks.
CELLS = 1_000_000
#: Relative rank error of the sketch is one in so many.
ACCURACY = 10_000
#: A bracket reaches so many errors to either side of its rank.
MARGIN = 10
#: Steps of the sketch that narrows a wide bracket.
GRID = 128


def present(value) -> Column:
    """The column as a double with NaN folded to NULL."""
    v = F.col(value) if isinstance(value, str) else value
    return F.nanvl(v.cast("double"), F.lit(None).cast("double"))


def narrow(df: DataFrame, columns: list, label: str = "narrow") -> DataFrame:
    """The columns alone, written once for several passes."""
    return staged(df.select(*columns), label)


def _beside(rows: DataFrame, table: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """Rows with their key's row of a table of ``n`` keys."""
    return null_safe_join(rows, F.broadcast(table) if n <= BROADCAST_ROWS else table, keys, "inner")


def _written(table: DataFrame, **seen_columns: Column) -> tuple[DataFrame, dict]:
    """The table, written, and what was observed while writing (no extra job)."""
    seen = Observation()
    out = cut(table.observe(seen, *[c.alias(k) for k, c in seen_columns.items()]))
    return out, seen.get


def summarise(df: DataFrame, keys: list[str], wanted: dict[str, dict[str, float]], aggs: list[Column] = ()) -> tuple[DataFrame, int]:
    """One row per key, with linear-interpolation quantiles ``{column: {name: probability}}`` and the aggregates ``aggs``, written; and the number of keys."""
    by = list(keys) or ["_all"]
    rows = df if keys else df.withColumn("_all", F.lit(1))
    columns, probs = list(wanted), [(i, name, float(p)) for i, names in enumerate(wanted.values()) for name, p in names.items()]
    reach = MARGIN / ACCURACY
    ranked_whole = max(RANKED, math.ceil(4 / reach))  # in larger groups a rank's neighbour is within reach
    inf = F.lit(math.inf)

    first = [*aggs]
    for i, c in enumerate(columns):
        targets = [min(max(p + side * reach, 0.0), 1.0) for j, _, p in probs if j == i for side in (-1, 1)]
        first += [F.count(present(c)).alias(f"_n{i}"), F.percentile_approx(present(c), targets, ACCURACY).alias(f"_e{i}")]
    state, seen = _written(rows.groupBy(*by).agg(*first), keys=F.count(F.lit(1)), most=F.greatest(F.lit(0), *[F.max(f"_n{i}") for i in range(len(columns))]))
    n_keys, most = int(seen.get("keys") or 0), int(seen.get("most") or 0)

    def bracket(place: int, i: int, at: int, p: float) -> Column:
        """Bracket number ``place`` over the whole; the ``at``-th of its column. A small group's first bracket holds all values."""
        small = F.col(f"_n{i}") <= ranked_whole
        low = F.when(small, -inf if at == 0 else inf).otherwise(-inf if p - reach <= 0 else F.element_at(f"_e{i}", 2 * at + 1))
        high = F.when(small, inf if at == 0 else -inf).otherwise(inf if p + reach >= 1 else F.element_at(f"_e{i}", 2 * at + 2))
        return F.struct(F.lit(place).alias("_b"), low.alias("_lo"), high.alias("_hi"))

    places, at_of = [], {}
    for place, (i, _, p) in enumerate(probs):
        at_of[i] = at_of.get(i, -1) + 1
        places.append((place, i, at_of[i], p))
    first_of = {i: min(place for place, j, _, _ in places if j == i) for i in at_of}

    def cells(brackets: DataFrame, n: int) -> DataFrame:
        """Values (and one NULL cell for those below) of each bracket; ``brackets`` has ``_bs`` by key."""
        joined = _beside(rows.select(*by, F.array(*[present(c) for c in columns]).alias("_vs")), brackets, n, by)
        out = joined.select(*by, "_vs", F.explode("_bs").alias("b")).select(*by, "b.*", F.element_at("_vs", F.element_at(F.array(*[F.lit(i + 1) for i, _, _ in probs]), F.col("b._b") + 1)).alias("_v"))
        return out.where((F.col("_v") <= F.col("_hi")) & (F.col("_lo") <= F.col("_hi")))

    table = state.select(*by, *[f"_n{i}" for i in range(len(columns))], F.array(*[bracket(*p) for p in places]).alias("_bs"))
    if most * 2 * reach > CELLS:
        table = _narrowed(table, cells, by, n_keys, probs)
    inside = F.when(F.col("_v") >= F.col("_lo"), F.col("_v"))
    counted = cells(table.select(*by, "_bs"), n_keys).groupBy(*by, "_b", inside.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    order = Window.partitionBy(*by, "_b").orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = _beside(counted.withColumn("_to", F.sum("_c").over(order)), state.select(*by, *[f"_n{i}" for i in range(len(columns))]), n_keys, by)

    picks, ranks = [], {}
    for (place, i, _, p), (_, name, _) in zip(places, probs):
        n = F.col(f"_n{i}")
        position = (n - 1) * F.lit(p)
        mine = F.col("_b") == F.when(n <= ranked_whole, first_of[i]).otherwise(place)
        ranks[name] = (i, position)
        for side, rank in (("a", F.floor(position)), ("z", F.least(F.floor(position) + 1, n - 1))):
            picks.append(F.max(F.when(mine & (F.col("_to") - F.col("_c") <= rank) & (rank < F.col("_to")), F.col("_v"))).alias(f"_{side}_{name}"))
    found = ranked.groupBy(*by).agg(*picks)
    found = null_safe_join(state, found, by)
    out = []
    for name, (i, position) in ranks.items():
        a, z = F.col(f"_a_{name}"), F.col(f"_z_{name}")
        missed = F.raise_error("a quantile's bracket missed its rank").cast("double")
        between = F.when(a == z, a).otherwise(a + (position - F.floor(position)) * (z - a))
        out.append(F.when(F.col(f"_n{i}") > 0, F.when(a.isNotNull() & z.isNotNull(), between).otherwise(missed)).alias(name))
    own = [c for c in state.columns if c not in {*by, *[f"_{k}{i}" for k in "ne" for i in range(len(columns))]}]
    return cut(found.select(*keys, *own, *out)), n_keys


def _narrowed(table: DataFrame, cells, by: list[str], n_keys: int, probs: list) -> DataFrame:
    """Brackets narrowed until each should hold at most ``CELLS`` values apart from its two ends."""
    counts = [c for c in table.columns if c.startswith("_n")]
    n_of = F.element_at(F.array(*[F.col(f"_n{i}") for i, *_ in probs]), F.col("_b") + 1)
    p_of = F.element_at(F.array(*[F.lit(p) for *_, p in probs]), F.col("_b") + 1)
    reach = 2 * MARGIN / ACCURACY
    flat = table.select(*by, *counts, F.explode("_bs").alias("b")).select(*by, *counts, "b.*")
    flat = flat.withColumn("_open", F.when((F.col("_lo") < F.col("_hi")) & (n_of > max(RANKED, 8 / reach)), n_of * reach).otherwise(F.lit(0.0)))
    while True:
        flat, seen = _written(flat, most=F.max("_open"))
        if (seen.get("most") or 0) <= CELLS:
            return flat.groupBy(*by, *counts).agg(F.collect_list(F.struct("_b", "_lo", "_hi")).alias("_bs"))
        wide = F.col("_open") > CELLS
        v, low, high = F.col("_v"), F.col("_lo"), F.col("_hi")
        within = (v > low) & (v < high)
        sketch = cells(flat.where(wide).groupBy(*by).agg(F.collect_list(F.struct("_b", "_lo", "_hi")).alias("_bs")), n_keys).groupBy(*by, "_b").agg(
            F.count_if(v <= low).alias("_under"), F.count_if(within).alias("_in"), F.percentile_approx(F.when(within, v), [k / GRID for k in range(GRID + 1)], ACCURACY).alias("_e"))
        old = null_safe_join(flat.where(wide), sketch, [*by, "_b"])
        rank = F.floor((n_of - 1) * p_of) - F.col("_under")  # from the first value inside; -1 and below: the lower end
        first = F.floor(rank / F.col("_in") * GRID).cast("int") - 1
        last = F.ceil((rank + 2) / F.col("_in") * GRID).cast("int") + 1
        empty = F.coalesce(F.col("_in"), F.lit(0)) == 0
        fresh = old.select(
            *by, *counts, "_b", F.when(empty | (first < 1), low).otherwise(F.element_at("_e", F.greatest(first, F.lit(0)) + 1)).alias("_lo"),
            F.when(empty | (last > GRID), high).otherwise(F.element_at("_e", F.greatest(F.least(last, F.lit(GRID)), F.lit(0)) + 1)).alias("_hi"),
            F.when(empty, 0.0).otherwise(F.col("_in") * (F.least(last, F.lit(GRID)) - F.greatest(first, F.lit(0)) + 1) / GRID).alias("_open"),
        )
        flat = flat.where(~wide).unionByName(fresh)


def quantile_table(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """One row per key with exact quantiles of ``value``."""
    return summarise(narrow(df, [*keys, value]), keys, {value: probs})[0]


def pooled_quantiles(df: DataFrame, value: str, probs: dict[str, float]) -> dict[str, float]:
    """Quantiles over all rows as a handful of driver-side numbers."""
    row = quantile_table(df, [], value, probs).first()
    return {name: (row[name] if row else None) for name in probs}


def summarise_with_mad(df: DataFrame, keys: list[str], wanted: dict[str, dict[str, float]], value: str, median: str, mad: str, aggs: list[Column] = ()) -> tuple[DataFrame, int]:
    """:func:`summarise` with the scaled median absolute deviation of ``value`` from its quantile ``median``: two passes more."""
    table, n_keys = summarise(df, keys, wanted, aggs)
    centres = table.select(*keys, F.col(median).alias("_centre"))
    if keys:
        off = _beside(df.select(*keys, value), centres, n_keys, keys)
    else:
        row = centres.first()
        off = df.select(value, F.lit(row["_centre"] if row else None).cast("double").alias("_centre"))
    spread, _ = summarise(off.select(*keys, F.abs(present(value) - F.col("_centre")).alias("_dev")), keys, {"_dev": {mad: 0.5}})
    scaled = spread.select(*keys, (F.lit(MAD_FACTOR) * F.col(mad)).alias(mad))
    if keys:
        return null_safe_join(table, F.broadcast(scaled) if n_keys <= BROADCAST_ROWS else scaled, keys), n_keys
    row = scaled.first()
    return table.withColumn(mad, F.lit(row[mad] if row else None).cast("double")), n_keys


def attach_median_mad(df: DataFrame, keys: list[str], value: str, median: str = "median", mad: str = "mad") -> DataFrame:
    """Group median and scaled median absolute deviation as extra columns."""
    table, n_keys = summarise_with_mad(narrow(df, [*keys, value]), keys, {value: {median: 0.5}}, value, median, mad)
    return _beside(df, table, n_keys, keys).select(*df.columns, median, mad)


def median_within(df: DataFrame, value: str, *bands: tuple[float, float]) -> list[dict]:
    """For each closed band, whether the median lies in it: exact, from one partial aggregate.

    The median is below a bound when more than half of the values are; with exactly half, it is
    the mean of the two values around the cut. No quantile is needed.
    """
    v = F.col(value)
    aggs = [F.count(v).alias("n")]
    for i, (low, high) in enumerate(bands):
        aggs += [
            F.count_if(v < low).alias(f"under{i}"), F.max(F.when(v < low, v)).alias(f"under_top{i}"), F.min(F.when(v >= low, v)).alias(f"in_bottom{i}"),
            F.count_if(v > high).alias(f"over{i}"), F.min(F.when(v > high, v)).alias(f"over_bottom{i}"), F.max(F.when(v <= high, v)).alias(f"in_top{i}"),
        ]
    row = df.agg(*aggs).first()
    n, out = row["n"], []
    for i, (low, high) in enumerate(bands):
        under, over = row[f"under{i}"], row[f"over{i}"]
        below = 2 * under > n or (n and 2 * under == n and (row[f"under_top{i}"] + row[f"in_bottom{i}"]) / 2 < low)
        above = 2 * over > n or (n and 2 * over == n and (row[f"over_bottom{i}"] + row[f"in_top{i}"]) / 2 > high)
        out.append({"n": n, "below": bool(below), "above": bool(above), "inside": bool(n) and not below and not above})
    return out
