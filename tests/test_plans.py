"""Plan shape: what must and must not appear."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from thermaweave.catalog import base, quality
from thermaweave.functions import quantiles
from thermaweave.operators import matchup, screening, summaries


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


CHECKED = ["P1_label_variables", "P4_range_screen", "P6_wind_screen", "A7_match_up_variance", "J9_fill_from_covered", "J10_dropped_series", "T4_dense_grid", "T8_scaled_observations",
           "N5_autocorrelation", "G14_reconstruct_site_view", "J4_joined_predictions", "A12_skill_by_level", "U4_key_difference", "V5_same_data_check"]


@pytest.mark.parametrize("name", CHECKED)
def test_no_nested_loops_and_no_row_python(spark, sf_dir, name):
    text = plan(entry.queries()[name](spark, sf_dir))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in text, bad
    if name != "V5_same_data_check":  # its result is one row of totals
        assert "SinglePartition" not in text


def test_both_wind_screens_share_one_shuffle(spark, sf_dir, tmp_path):
    path = str(tmp_path / "rows")
    base.celsius(spark, sf_dir).write.parquet(path)
    df = spark.read.parquet(path)
    for v in ("eco", "lst"):
        df = screening.screen_range(df, f"{v}_sst")
        df = screening.screen_wind(df, f"{v}_sst", f"{v}_wind", f"{v}_hour")
    text = plan(df)
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text


def test_filters_and_columns_reach_the_files(spark, sf_dir, tmp_path):
    path = str(tmp_path / "raw")
    base.raw_extended(spark, sf_dir).write.parquet(path)
    raw = spark.read.parquet(path)
    from thermaweave.operators.labelling import label_variables

    text = plan(label_variables(raw, base.SPECS).where("variable = 'eco_sst'").select("point_id", "value"))
    pushed = text.split("PushedFilters: [")[1].split("], ReadSchema")[0]
    assert "(stat" in pushed and "In(variable" in pushed
    schema = text.split("ReadSchema: struct<")[1].split(">")[0]
    assert "lat" not in schema and "time" not in schema


def test_row_local_screens_need_no_shuffle(spark, sf_dir, tmp_path):
    path = str(tmp_path / "rows")
    base.celsius(spark, sf_dir).write.parquet(path)
    df = screening.screen_range(spark.read.parquet(path), "eco_sst")
    assert "Exchange" not in plan(screening.kept(df)) and "Exchange" not in plan(screening.removed(df))


def test_a_summary_reads_a_narrow_table_in_six_jobs_at_most(spark, sf_dir, tmp_path, monkeypatch):
    path = str(tmp_path / "rows")
    base.celsius(spark, sf_dir).write.parquet(path)
    df = screening.screen_range(spark.read.parquet(path), "eco_sst")
    written = []
    for name in ("cut", "staged"):
        real = getattr(quantiles, name)
        monkeypatch.setattr(quantiles, name, lambda table, *a, real=real, name=name: written.append((name, table)) or real(table, *a))
    text = plan(summaries.variable_summary(summaries.kept_removed_frame(df, "aoi")))
    assert [n for n, _ in written] == ["staged", "cut", "cut", "cut", "cut"]  # the result is the sixth
    assert text.count("Exchange hashpartitioning") == 0  # everything left is small
    assert all(path not in plan(table) for _, table in written[1:])  # the input is read once


def test_streaming_frames_can_use_the_row_local_expressions(spark, sf_dir, tmp_path):
    path = str(tmp_path / "in")
    base.raw_extended(spark, sf_dir).write.parquet(path)
    from thermaweave.operators.labelling import label_variables

    live = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    out = screening.screen_range(label_variables(live, base.SPECS).withColumn("value", F.col("value") - 273.15), "eco_sst")
    q = out.writeStream.format("memory").queryName("live").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    want = screening.screen_range(label_variables(spark.read.parquet(path), base.SPECS).withColumn("value", F.col("value") - 273.15), "eco_sst")
    assert spark.table("live").where("stage is not null").count() == want.where("stage is not null").count() > 0
