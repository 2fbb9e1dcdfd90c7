"""Times the headline queries and prints one line of JSON."""

import json
import os
import time

from pyspark.sql import SparkSession

from quarry.queries import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "search_page", "search_totals", "search_sub_facet", "filter_tree", "facet_hierarchy", "facet_month", "facet_number_cells", "facet_drill_sideways", "sort_page", "custom_rank",
    "match_and", "match_exact", "match_nearby", "match_wand", "rank_bm25", "rank_kl", "rank_plm", "retrieve_svs", "suffix_longest", "rerank_products", "upserted", "scd_merged", "log_latest", "click_top", "ad_auction",
]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC").config("spark.sql.files.maxPartitionBytes", "8m").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()  # compiles
        start = time.perf_counter()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
