"""spark-submit jobs/impute.py --extract PATH --output DIR --variable VAR --statistic STAT --prefix NAME [--limit-km 25] [--min-fraction 0.5] [--format csv]"""

import argparse

from pyspark.sql import SparkSession

from thermaweave.plans.runs import run_impute

if __name__ == "__main__":
    p = argparse.ArgumentParser()
    for name in ("extract", "output", "variable", "statistic", "prefix"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--limit-km", default="25", help="kilometres, or none")
    p.add_argument("--min-fraction", type=float)
    p.add_argument("--format", default="csv")
    p.add_argument("--overwrite", action="store_true")
    a = p.parse_args()
    spark = SparkSession.builder.appName("impute").getOrCreate()
    run_impute(spark, a.extract, a.output, a.variable, a.statistic, a.prefix, None if a.limit_km == "none" else float(a.limit_km), a.min_fraction, a.format, a.overwrite)
