"""Times the headline queries, once the session is warm; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from textlens.plans import queries as plans

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: Run before anything is timed, on the size below: together they load and compile nearly all that the headline queries use.
WARM = ["token_stream", "lint_findings", "paragraph_outline"]
SMALL = os.path.join(os.path.dirname(SF.rstrip("/")), "sf0.01")
HEADLINE = ["token_stream", "sentence_spans", "pos_class_counts", "visual_roles", "lint_findings", "paragraph_outline", "content_hashes"]


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.driver.memory", "16g").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    began = time.time()
    for name in WARM if os.path.isdir(SMALL) else ():
        plans.queries()[name](spark, SMALL).write.format("noop").mode("overwrite").save()
    warmed = round(time.time() - began, 3)
    took = {}
    for name in HEADLINE:
        began = time.time()
        plans.queries()[name](spark, SF).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "warm_up": warmed, "sf": SF.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
