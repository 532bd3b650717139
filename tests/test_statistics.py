"""Distributed statistics against NumPy, with no, one and many rounds of narrowing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from thermaweave.functions import quantiles as q
from thermaweave.functions.ranking import number_rows, top_per_group

PROBS = {"p01": 0.01, "p25": 0.25, "med": 0.5, "p975": 0.975, "lo": 0.0, "hi": 1.0}


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    hot = rng.normal(size=30_000).tolist()  # a hot group, larger than the sketch resolution
    ties = rng.integers(0, 7, size=12_000).astype(float).tolist()
    return {"hot": hot, "ties": ties, "few": [3.0, 1.0, 2.0, 10.0], "one": [5.0], None: [1.0, 2.0]}


@pytest.fixture(scope="module")
def frame(spark, data):
    rows = [(k, v) for k, vs in data.items() for v in vs] + [("hot", None), ("void", None)]
    return spark.createDataFrame(rows, "g string, v double").repartition(8).cache()


#: Values of a group ranked whole, and of a bracket before it is narrowed.
LIMITS = pytest.mark.parametrize("limit", [(10**9, 10**6), (5000, 10**6), (20, 10**6), (20, 30)])


@LIMITS
def test_quantiles_are_exact(frame, data, limit, monkeypatch):
    monkeypatch.setattr(q, "RANKED", limit[0])
    monkeypatch.setattr(q, "CELLS", limit[1])
    got = {r["g"]: r for r in q.quantile_table(frame, ["g"], "v", PROBS).collect()}
    assert set(got) == {*data, "void"} and all(got["void"][name] is None for name in PROBS)
    for g, vs in data.items():
        for name, p in PROBS.items():
            assert got[g][name] == pytest.approx(np.quantile(vs, p), abs=1e-12), (g, name)


@LIMITS
def test_pooled_quantiles_are_exact(frame, data, limit, monkeypatch):
    monkeypatch.setattr(q, "RANKED", limit[0])
    monkeypatch.setattr(q, "CELLS", limit[1])
    every = [v for vs in data.values() for v in vs]
    got = q.pooled_quantiles(frame, "v", PROBS)
    for name, p in PROBS.items():
        assert got[name] == pytest.approx(np.quantile(every, p), abs=1e-12)


def test_a_value_that_most_rows_hold_is_one_cell(spark, monkeypatch):
    monkeypatch.setattr(q, "RANKED", 1000)
    rng = np.random.default_rng(8)
    values = np.concatenate([np.full(30_000, 4.0), rng.normal(4.0, 2.0, 20_000)])
    seen: list = []
    window = q.Window.partitionBy

    def watched(*by):
        seen.append(by)
        return window(*by)

    monkeypatch.setattr(q.Window, "partitionBy", watched)
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(8)
    probs = {f"p{k}": k / 40 for k in range(41)}
    got = q.pooled_quantiles(df, "v", probs)
    assert seen == [("_all", "_b")]  # one ranking, within brackets
    for name, p in probs.items():
        assert got[name] == pytest.approx(np.quantile(values, p), abs=1e-12)


def test_several_columns_and_aggregates_share_the_passes(spark):
    rows = [("a" if k % 2 else None, float(k), -float(k) if k % 3 else None) for k in range(200)]
    df = spark.createDataFrame(rows, "g string, v double, w double")
    table, n = q.summarise(df, ["g"], {"v": {"m": 0.5, "t": 0.9}, "w": {"wm": 0.5}}, [F.avg("v").alias("mean")])
    got = {r["g"]: r for r in table.collect()}
    assert n == 2 and set(got) == {"a", None}
    for g in got:
        vs, ws = [v for k, v, _ in rows if k == g], [w for k, _, w in rows if k == g and w is not None]
        assert (got[g]["m"], got[g]["t"], got[g]["wm"], got[g]["mean"]) == pytest.approx((np.median(vs), np.quantile(vs, 0.9), np.median(ws), np.mean(vs)))


def test_nan_is_missing(spark):
    rows = [("a", float(k)) for k in range(1, 10)] + [("a", float("nan"))] * 3 + [("b", float("nan"))]
    got = {r["g"]: (r["m"], r["t"]) for r in q.quantile_table(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"m": 0.5, "t": 0.99}).collect()}
    assert got == {"a": (5.0, pytest.approx(np.quantile(range(1, 10), 0.99))), "b": (None, None)}


@LIMITS
def test_median_and_mad_attach_to_every_row(frame, data, limit, monkeypatch):
    monkeypatch.setattr(q, "RANKED", limit[0])
    monkeypatch.setattr(q, "CELLS", limit[1])
    out = q.attach_median_mad(frame, ["g"], "v")
    assert out.count() == frame.count()
    got = {r["g"]: (r["m"], r["d"]) for r in out.groupBy("g").agg(F.max("median").alias("m"), F.max("mad").alias("d")).collect()}
    for g, vs in data.items():
        m = np.median(vs)
        assert got[g] == pytest.approx((m, 1.4826 * np.median(np.abs(np.array(vs) - m))), abs=1e-12)
    assert got["void"] == (None, None)


@pytest.mark.parametrize("values", [[1.0], [1.0, 3.0], [1.0, 2.0, 9.0], [0.0, 4.0, 4.0, 8.0], [-5.0, -5.0, 20.0, 20.0]])
@pytest.mark.parametrize("band", [(0.0, 5.0), (2.0, 7.5), (-6.0, 3.0), (4.0, 4.0)])
def test_median_band_test_needs_no_median(spark, values, band):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    m = np.median(values)
    got, wide = q.median_within(df, "v", band, (-100.0, 100.0))
    assert (got["below"], got["above"]) == (m < band[0], m > band[1]) and wide["inside"]


def test_row_numbers_cover_every_group(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 5000).alias("o")).repartition(7)
    got = number_rows(df, ["g"], ["o"])
    assert got.groupBy("g").agg(F.count_distinct("row_no").alias("d"), F.max("row_no").alias("m"), F.min("row_no").alias("f")).where("d <> m or f <> 1").count() == 0
    by = {}
    for r in got.collect():
        by.setdefault(r["g"], []).append((r["o"], r["row_no"]))
    assert all([n for _, n in sorted(v)] == list(range(1, len(v) + 1)) for v in by.values())


def test_top_per_group_matches_a_sort(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2000, 0).otherwise(F.col("id") % 5).alias("g"), F.md5(F.col("id").cast("string")).alias("o"))
    got = sorted((r["g"], r["o"]) for r in top_per_group(df, ["g"], ["o"], 4).collect())
    by = {}
    for r in df.collect():
        by.setdefault(r["g"], []).append(r["o"])
    assert got == sorted((g, o) for g, os in by.items() for o in sorted(os)[:4])


def test_a_cluster_needs_a_shared_folder():
    class Session:
        conf = {}

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            @staticmethod
            def getCheckpointDir():
                return None

    from thermaweave.functions.lineage import shared_dir

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session)
