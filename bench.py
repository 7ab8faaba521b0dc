"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
import json
import os
import time

from labelforge.plans import catalog
from labelforge.runtime import session

HEADLINE = ["g2_segment_documents", "entry_known_ingredients", "f1_f2_f3_line_filters", "extract_pack_facts", "j1_static_ladder", "j3_fuzzy_topk", "j9_nearest_name",
            "m5_find_phrases", "w5_resolve_labels", "j10_avoid_matches", "c2_o4_check_claims", "a7_u1_compare_products", "a11_routine_report", "a12_reaction_patterns", "e3_threshold_sweep"]


def main():
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session("bench", cores=os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("labelforge.partitions", os.environ.get("BENCH_CPUS", "8"))  # the files have one row group each and cannot be split
    catalog.QUERIES["w6_first_per_key"](spark, d).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t = time.time()
        catalog.QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    labels = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey").distinct().count()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(d.rstrip("/")),
                      "labels_per_second": round(labels / times["w5_resolve_labels"], 1)}))
    spark.stop()


if __name__ == "__main__":
    main()
