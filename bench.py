"""Times the headline queries once warm; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from plumbline.plans import registry

HEADLINE = (
    "a1_agreement_matrix", "a6_confidence_gaps", "b3_stability", "b4_model_instability", "b5_sample_instability", "d1_reliability", "d10_trust",
    "r6_sample_risk", "c4_robustness", "c7_ece", "c15_auc", "p7_entropy", "e2_group_statistics", "g1_splits",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        for _ in range(2):  # the first run compiles
            spark.catalog.clearCache()  # each run reads the tables and deals the log anew
            began = time.time()
            registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
