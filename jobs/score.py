"""spark-submit jobs/score.py --run DIR --reference VAR --tag TAG --sites a,b --variables v1,v2 [--group-var has_v1]"""

import argparse

from pyspark.sql import SparkSession

from thermaweave.plans.holdout import score_holdout
from thermaweave.sources.writers import write_scores

if __name__ == "__main__":
    p = argparse.ArgumentParser()
    for name in ("run", "reference", "tag", "sites", "variables"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--group-var")
    p.add_argument("--min-obs", type=int, default=1)
    p.add_argument("--replicates", type=int, default=10_000)
    p.add_argument("--overwrite", action="store_true")
    a = p.parse_args()
    spark = SparkSession.builder.appName("score").getOrCreate()
    read = lambda name: spark.read.parquet(f"{a.run}/{name}")
    tables = score_holdout(
        read("validation"), read("states.parquet"), read(f"states_{a.tag}_only.parquet"), read("observations"), a.reference,
        a.sites.split(","), a.variables.split(","), a.group_var, a.min_obs, a.replicates)
    write_scores(f"{a.run}/scores", tables, a.overwrite)
