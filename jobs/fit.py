"""spark-submit jobs/fit.py --config cfg.json --grid DIR --output DIR --shared-from VAR --reference VAR"""

import argparse

from pyspark.sql import SparkSession

from thermaweave.plans.config import ModelConfig, load_json
from thermaweave.plans.runs import run_fit

if __name__ == "__main__":
    p = argparse.ArgumentParser()
    for name in ("config", "grid", "output", "shared-from", "reference"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--overwrite", action="store_true")
    a = p.parse_args()
    spark = SparkSession.builder.appName("fit").getOrCreate()
    cfg = load_json(ModelConfig, a.config)
    run_fit(spark, cfg, a.grid, a.output, a.shared_from, a.reference, a.overwrite)
