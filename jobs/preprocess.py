"""spark-submit jobs/preprocess.py --config cfg.json --input DIR --output DIR [--format parquet] [--overwrite]"""

import argparse

from pyspark.sql import SparkSession

from thermaweave.plans.config import PreprocessConfig, load_json
from thermaweave.plans.preprocess import preprocess
from thermaweave.sources.readers import read_long
from thermaweave.sources.writers import write_grid, write_preprocessing, write_table

if __name__ == "__main__":
    p = argparse.ArgumentParser()
    p.add_argument("--config", required=True)
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--format", default="parquet")
    p.add_argument("--overwrite", action="store_true")
    a = p.parse_args()
    spark = SparkSession.builder.appName("preprocess").getOrCreate()
    result = preprocess(read_long(spark, a.input, a.format), load_json(PreprocessConfig, a.config))
    write_preprocessing(a.output, result.clean, result.removed, result.tables(), a.overwrite)
    grid = result.grid()
    if grid is not None:
        write_grid(grid, a.output, a.overwrite)
        write_table(result.basis(grid), f"{a.output}/basis", a.overwrite)
