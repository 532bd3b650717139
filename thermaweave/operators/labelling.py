"""Turning a raw extract into labelled (variable, value) rows, and unit conversion."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import UNIT_BANDS, convert_unit, linear_unit_map
from ..functions.quantiles import median_within


def require_columns(df: DataFrame, columns) -> None:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError("columns not found: " + ", ".join(absent))


def id_columns(df: DataFrame, ids: list[str] | None = None) -> list[str]:
    """Columns identifying one observation: everything but ``variable`` and ``value`` unless given."""
    if ids is None:
        ids = [c for c in df.columns if c not in ("variable", "value")]
    if not ids:
        raise ValueError("no id columns")
    require_columns(df, ids)
    return list(ids)


def _listed(values) -> list:
    return list(values) if isinstance(values, (list, tuple, set)) else [values]


def missing_as_null(df: DataFrame, column: str) -> Column:
    """The column with NaN folded to NULL: both stand for a missing value, and NaN would sort above every number."""
    if df.schema[column].dataType.typeName() not in ("double", "float"):
        return F.col(column)
    return F.when(~F.isnan(column), F.col(column))


def spec_predicate(spec: dict) -> Column:
    """Conjunction of column memberships; a NULL cell never matches."""
    out = F.lit(True)
    for name, values in spec.items():
        out = out & F.coalesce(F.col(name).isin(_listed(values)), F.lit(False))
    return out


def label_variables(df: DataFrame, specs: dict[str, dict], value_col: str = "value") -> DataFrame:
    """Collapse the matching columns into one ``variable`` label; the last matching spec wins.

    Rows matching no spec are dropped, as is every column any spec names.
    """
    if not specs or not all(specs):
        raise ValueError("specs must be a non-empty mapping of label to column memberships")
    keys = list(dict.fromkeys(k for s in specs.values() for k in s))
    require_columns(df, keys + [value_col])
    shared = [k for k in keys if all(k in s for s in specs.values())]
    rows = df
    for k in shared:
        # Implied by the label test, but simple enough to reach the file scan.
        rows = rows.where(F.col(k).isin(sorted({v for s in specs.values() for v in _listed(s[k])}, key=str)))
    label = F.coalesce(*[F.when(spec_predicate(s), F.lit(name)) for name, s in reversed(list(specs.items()))])
    kept = [c for c in df.columns if c not in keys and c not in (value_col, "variable", "value")]
    return (
        rows.withColumn("_label", label)
        .where(F.col("_label").isNotNull())
        .select(*kept, F.col("_label").alias("variable"), missing_as_null(rows, value_col).alias("value"))
    )


def label_matches(df: DataFrame, specs: dict[str, dict]) -> DataFrame:
    """How many specs each row matches, counted: the basis of the multi-match / no-match warnings."""
    hits = sum((F.when(spec_predicate(s), 1).otherwise(0) for s in specs.values()), F.lit(0))
    return df.groupBy(hits.cast("bigint").alias("n_specs")).agg(F.count(F.lit(1)).alias("n_rows"))


def convert_temperature(
    df: DataFrame,
    variables: list[str],
    src: str = "K",
    dst: str = "C",
    value_col: str = "value",
    check_range: bool = True,
    strict: bool = True,
) -> DataFrame:
    """Convert named variables in place, guarding against converting twice.

    The guard asks whether the pooled median is plausible before (in ``src``) and after (in
    ``dst``). Conversion is increasing and linear, so both questions are about the unconverted
    median and are answered exactly by one partial aggregate.
    """
    src, dst = src.upper(), dst.upper()
    for u in (src, dst):
        if u not in UNIT_BANDS:
            raise ValueError(f"unit must be one of K, C, F, not {u!r}")
    require_columns(df, ["variable", value_col])
    if src == dst:
        return df
    variables = list(dict.fromkeys(variables))
    chosen = F.coalesce(F.col("variable").isin(variables), F.lit(False))
    if check_range:
        scale, shift = linear_unit_map(src, dst)
        low, high = UNIT_BANDS[dst]
        bands = [UNIT_BANDS[src], ((low - shift) / scale, (high - shift) / scale)]
        before, after = median_within(df.where(chosen), value_col, *bands)
        if before["n"] == 0:
            return df
        for verdict, label in ((before, f"values do not look like {src}"), (after, f"converted values are implausible as {dst}")):
            if not verdict["inside"]:
                if strict:
                    raise ValueError(label + "; already converted?")
                warnings.warn(label, stacklevel=2)
    return df.withColumn(value_col, F.when(chosen, convert_unit(value_col, src, dst)).otherwise(F.col(value_col)))


def conversion_report(df: DataFrame, variables: list[str], src: str = "K", dst: str = "C", value_col: str = "value") -> DataFrame:
    """Value count and range per variable, before and after conversion, to two decimals."""
    rows = df.where(F.col("variable").isin(variables) & F.col(value_col).isNotNull())
    out = convert_unit(value_col, src, dst)
    return rows.groupBy("variable").agg(
        F.count(value_col).alias("n"),
        F.round(F.min(value_col), 2).alias("from_min"),
        F.round(F.max(value_col), 2).alias("from_max"),
        F.round(F.min(out), 2).alias("to_min"),
        F.round(F.max(out), 2).alias("to_max"),
    )
