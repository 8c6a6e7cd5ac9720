"""Times the headline queries and prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from mossgrid.plans.queries import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "impute_continuous", "knn_topk", "impute_categorical_majority", "local_accuracy", "error_matrix_binned", "species_accuracy", "ks_statistics",
    "weighted_histogram", "quantile_bins", "vegclass_error_matrix", "kappa_by_class", "olofsson_adjusted_area", "attribute_raster", "cca_eigenvalues", "cca_cross_products",
]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{SF_DIR}/orders.parquet").count()  # starts the engine
    took = {}
    for name in HEADLINE:
        best = None
        for _ in range(2):
            spark.catalog.clearCache()  # a run may not read what the one before has kept
            began = time.perf_counter()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            s = time.perf_counter() - began
            best = s if best is None else min(best, s)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
