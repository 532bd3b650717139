"""Nearest and best-covered points on the sphere, by a tree whose leaves hold a bounded number of points.

Points are ordered along a space-filling curve and cut by count: ``LEAF`` points make a leaf, ``FANOUT`` nodes make a node above,
so dense areas get small leaves, sparse ones large, and no leaf is ever full of points however dense they lie. A node carries its
bounding box in space (a sphere has no seam there) and the largest coverage below it.

All recipients search at once, in rounds. A recipient's open nodes wait in order of what they promise; a round visits the best
few: inner nodes open their children, leaves compare their points. What cannot beat the recipient's ``k``-th best so far is dropped unseen.
The number visited doubles from round to round, so rounds are few, and a recipient meets some leaves, never all points of a region.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import EARTH_RADIUS_KM, haversine_km
from ..functions.lineage import cut, cut_counted, small_side
from ..functions.ranking import number_rows, top_per_group

LEAF = 32
FANOUT = 32
#: Open nodes that a recipient visits in the first round.
BEAM = 2
HALF_WAY_ROUND_KM = math.pi * EARTH_RADIUS_KM
#: A node is dropped only when its bound is over the limit by this much: haversines near the far side of the globe err by less.
SLACK_KM = 1e-3
#: Bits of a cell index on each axis, and the masks that spread them to every third bit.
BITS = 21
SPREAD = [(32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)]
AXES = ("x", "y", "z")


@dataclass(frozen=True)
class Tree:
    """Points by leaf, nodes by parent, and the few nodes of the top level."""

    points: DataFrame
    nodes: DataFrame
    top: list
    top_level: int


def _space(lat: Column, lon: Column) -> dict[str, Column]:
    """Position in km from the centre."""
    lat, lon, r = F.radians(lat), F.radians(lon), F.lit(EARTH_RADIUS_KM)
    return {"x": r * F.cos(lat) * F.cos(lon), "y": r * F.cos(lat) * F.sin(lon), "z": r * F.sin(lat)}


def _curve() -> Column:
    """Place of ``_x, _y, _z`` on the space-filling curve."""
    code = F.lit(0).cast("bigint")
    for k, axis in enumerate(AXES):
        v = F.least(F.floor((F.col(f"_{axis}") / (2.0 * EARTH_RADIUS_KM) + 0.5) * (1 << BITS)), F.lit((1 << BITS) - 1)).cast("bigint")
        for shift, mask in SPREAD:
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        code = code.bitwiseOR(F.shiftleft(v, k))
    return code


def _placed(df: DataFrame) -> DataFrame:
    """Rows with a position, which is a finite latitude and longitude."""
    finite = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in ("lat", "lon")]
    return df.where(finite[0] & finite[1]).select("*", *[c.alias(f"_{a}") for a, c in _space(F.col("lat"), F.col("lon")).items()])


def build_tree(points: DataFrame, most: str | None = None, leaf: int = LEAF) -> Tree:
    """Tree over ``site, lat, lon, ...``; ``most`` names the coverage whose largest value nodes carry."""
    placed = _placed(points).withColumn("_code", _curve())
    numbered = number_rows(placed, [], ["_code", "site"], "_no").withColumn("_node", F.floor((F.col("_no") - 1) / leaf).cast("bigint"))
    numbered = cut(numbered.drop("_no", "_code"))
    box = [f(c).alias(f"_{side}{a}") for a in AXES for side, f, c in (("lo", F.min, f"_{a}"), ("hi", F.max, f"_{a}"))]
    top_of = F.max(most).cast("double") if most else F.max(F.lit(0.0))
    level = cut(numbered.groupBy("_node").agg(*box, top_of.alias("_most")))
    levels, depth, n = [level], 0, level.count()
    while n > FANOUT:
        parents = levels[-1].groupBy(F.floor(F.col("_node") / FANOUT).cast("bigint").alias("_node")).agg(
            *[f(f"_{side}{a}").alias(f"_{side}{a}") for a in AXES for side, f in (("lo", F.min), ("hi", F.max))], F.max("_most").alias("_most"))
        levels.append(cut(parents))
        depth, n = depth + 1, -(-n // FANOUT)
    nodes = None
    for at, table in enumerate(levels[:-1]):
        rows = table.withColumn("_level", F.lit(at)).withColumn("_parent", F.floor(F.col("_node") / FANOUT).cast("bigint"))
        nodes = rows if nodes is None else nodes.unionByName(rows)
    if nodes is None:
        nodes = levels[0].limit(0).withColumn("_level", F.lit(0)).withColumn("_parent", F.lit(0).cast("bigint"))
    return Tree(numbered.withColumnRenamed("site", "donor"), nodes, levels[-1].collect(), depth)  # FANOUT rows at most


def _bound() -> Column:
    """Least distance from a recipient at ``_x, _y, _z`` to anything in a node's box."""
    gap = F.lit(0.0)
    for a in AXES:
        gap = gap + F.pow(F.greatest(F.col(f"_lo{a}") - F.col(f"_{a}"), F.col(f"_{a}") - F.col(f"_hi{a}"), F.lit(0.0)), 2)
    return F.lit(2.0 * EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(gap) / (2.0 * EARTH_RADIUS_KM)))


def search(recipients: DataFrame, donors: DataFrame, k: int = 1, limit_km: float | None = None, most: str | None = None, leaf: int = LEAF, visits: list | None = None) -> DataFrame:
    """The ``k`` first donors of every recipient no further than the limit: ``site, rank, donor, km`` and the donors' other columns.

    First means nearest, ties by id; with ``most``, largest in that column, ties to the nearer, then by id. A donor that is the recipient
    itself does not count. ``visits``, when given, receives the number of points compared in each round.
    """
    last = HALF_WAY_ROUND_KM * 1.0000001 if limit_km is None else float(limit_km)
    extra = [c for c in donors.columns if c not in ("site", "lat", "lon")]
    # At one position only the first few can be picked, however many there are (one more, for a recipient among them).
    best_first = [F.desc(most), "site"] if most else ["site"]
    tree = build_tree(top_per_group(donors, ["lat", "lon"], best_first, k + 1), most, leaf)
    points, nodes = small_side(tree.points.select(F.col("_node").alias("_leaf"), "donor", F.col("lat").alias("_lat2"), F.col("lon").alias("_lon2"), *extra)), small_side(tree.nodes)
    here = _placed(recipients.select("site", "lat", "lon"))
    at = ["site", "lat", "lon", *[f"_{a}" for a in AXES]]
    fields = ["_node", "_most", *[f"_{s}{a}" for a in AXES for s in ("lo", "hi")]]
    roots = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in fields]) for r in tree.top])
    kept = [*at, "_level", "_node", "_most", "_bound"]
    order = [F.desc(most), "km", "donor"] if most else ["km", "donor"]
    first = Window.partitionBy("site").orderBy(*([F.desc("_most")] if most else []), "_bound", "_level", "_node")
    out_cols = ["site", "donor", "km", *extra]

    if not tree.top:
        empty = recipients.select("site", F.lit(None).cast("string").alias("donor"), F.lit(0.0).alias("km"), F.lit(1).alias("rank")).where("false")
        return empty.join(donors.select(F.col("site").alias("donor"), *extra), "donor").select("site", "rank", "donor", "km", *extra)
    frontier = here.withColumn("_root", F.explode(roots)).select(*at, F.lit(tree.top_level).alias("_level"), *[F.col(f"_root.{c}").alias(c) for c in fields])
    frontier = frontier.withColumn("_bound", _bound()).where(F.col("_bound") <= last + SLACK_KM).select(*kept).withColumn("_rank", F.row_number().over(first))
    frontier, n = cut_counted(frontier)
    found, beam = None, BEAM
    while n:
        visit = frontier.where(F.col("_rank") <= beam)
        near = visit.where("_level = 0").join(points, F.col("_node") == F.col("_leaf")).withColumn("km", haversine_km("lat", "lon", "_lat2", "_lon2"))
        near = near.where((F.col("km") <= last) & (F.col("site") != F.col("donor"))).select(*out_cols)
        if visits is not None:
            visits.append(visit.where("_level = 0").join(points, F.col("_node") == F.col("_leaf")).count())
        near = near if found is None else found.drop("rank").unionByName(near)
        found = cut(near.withColumn("rank", F.row_number().over(Window.partitionBy("site").orderBy(*order))).where(F.col("rank") <= k))
        inner = visit.where("_level > 0").select(*at, (F.col("_level") - 1).alias("_below"), F.col("_node").alias("_above"))
        opened = inner.join(nodes, (F.col("_level") == F.col("_below")) & (F.col("_parent") == F.col("_above"))).withColumn("_bound", _bound()).select(*kept)
        still = frontier.where(F.col("_rank") > beam).select(*kept).unionByName(opened)
        worst = found.where(F.col("rank") == k).select("site", F.col("km").alias("_km"), (F.col(most).cast("double") if most else F.lit(0.0)).alias("_n"))
        close = F.col("_bound") <= F.coalesce("_km", F.lit(last)) + SLACK_KM
        if most:  # a larger coverage may lie further away
            close = F.when(F.col("_n").isNull() | (F.col("_most") > F.col("_n")), F.col("_bound") <= last + SLACK_KM).otherwise((F.col("_most") == F.col("_n")) & close)
        frontier, n = cut_counted(still.join(worst, "site", "left").where(close).select(*kept).withColumn("_rank", F.row_number().over(first)))
        beam *= 2
    if found is None:
        found = frontier.select("site").where("false").join(donors.select(F.col("site").alias("donor"), *extra), F.lit(False)).withColumn("km", F.lit(0.0)).withColumn("rank", F.lit(1))
    return found.select("site", "rank", *out_cols[1:])
