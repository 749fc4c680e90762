"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Each query runs once to warm up and is then timed over its whole result, written to Spark's noop sink."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from tabloom.functions.clean import cat, num
from tabloom.operators import get
from tabloom.queries import QUERIES, flagship

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def scalar(spark, sf):
    return spark.read.parquet(f"{sf}/lineitem.parquet").select(get("log1p").build(num("l_extendedprice")).alias("v"))


def wide(spark, sf):
    x = num("l_extendedprice")
    return spark.read.parquet(f"{sf}/lineitem.parquet").select(*[get("log1p").build(x + i).alias(f"v{i}") for i in range(50)])


def sparse(spark, sf):
    x = F.when(F.pmod("l_orderkey", F.lit(10)) >= 4, num("l_extendedprice"))
    return spark.read.parquet(f"{sf}/lineitem.parquet").select(get("log1p").build(x).alias("v"))


def standardize(spark, sf):
    df, op = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_extendedprice"), get("standardize")
    return op.apply(df, ["l_extendedprice"], {}, op.fit(df, ["l_extendedprice"], {}), "v")


def rolling_mean(spark, sf):
    w = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    return spark.read.parquet(f"{sf}/lineitem.parquet").select(get("rolling_mean").build(num("l_quantity"), w).alias("v"))


def hash_encode(spark, sf):
    return spark.read.parquet(f"{sf}/lineitem.parquet").select(get("hash_encode").build(cat("l_returnflag")).alias("v"))


HEADLINES = {
    "scalar_log1p": scalar, "wide_50": wide, "nulls_40": sparse, "standardize": standardize, "rolling_mean": rolling_mean, "hash_encode": hash_encode, "flagship": flagship,
    **{n: QUERIES[n] for n in ("op_group_median", "op_ewma", "op_target_mean_crossfit", "op_quantile_normal", "op_robust_scale", "op_text_hashing", "op_tfidf_word", "leak_rank_auc", "split_stratified", "eda_histogram")},
}


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name, query in HEADLINES.items():
        for _ in range(2):
            began = time.time()
            query(spark, SF).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": SF}))


if __name__ == "__main__":
    main()
