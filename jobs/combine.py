"""spark-submit jobs/combine.py --runs DIR --locations CSV --output DIR --models m1,m2"""

import argparse

from pyspark.sql import SparkSession

from thermaweave.plans.runs import run_combine

if __name__ == "__main__":
    p = argparse.ArgumentParser()
    for name in ("runs", "locations", "output", "models"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--overwrite", action="store_true")
    a = p.parse_args()
    spark = SparkSession.builder.appName("combine").getOrCreate()
    run_combine(spark, a.runs, a.locations, a.output, a.models.split(","), a.overwrite)
