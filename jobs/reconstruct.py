"""spark-submit jobs/reconstruct.py --config cfg.json --run DIR --output DIR"""

import argparse

from pyspark.sql import SparkSession

from thermaweave.plans.config import ModelConfig, load_json
from thermaweave.plans.runs import run_reconstruct

if __name__ == "__main__":
    p = argparse.ArgumentParser()
    for name in ("config", "run", "output"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--overwrite", action="store_true")
    a = p.parse_args()
    spark = SparkSession.builder.appName("reconstruct").getOrCreate()
    run_reconstruct(spark, load_json(ModelConfig, a.config), a.run, a.output, a.overwrite)
