"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from motorgrid.session import build_session  # noqa: E402

HEADLINE = (
    "evaluation_breakdown", "top_k_predictions", "class_prototypes", "view_prototypes",
    "recognize_binary_gate", "make_splits_images", "split_by_listing", "split_by_image",
    "split_summary", "canonicalize", "select_labelled_rows", "class_train_counts", "page_links",
    "discovered_urls", "parse_listings", "content_clusters", "ingest_images", "insert_new",
    "smooth_predictions", "queue_fold_events", "budgeted_batch", "source_report", "free_title",
    "parse_year",
)


def large_retrieval(spark, sf_dir):
    """Top-10 of about 20,000 queries per 600,000 line items against one class per part."""
    from pyspark.sql import functions as F

    from motorgrid.operators.similarity import score_top_k

    base = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    some = base.agg(F.count("*")).first()[0]

    def shifted(key):
        # A vector of its own for every key, near one of the given ones.
        return F.transform("embedding", lambda x, i: x + 0.2 * F.sin(key * (i + 1)))

    def near(rows, key, name):
        joined = rows.select(F.col(key).alias("_k")).withColumn("vec_id", F.pmod("_k", F.lit(some)))
        return joined.join(base, "vec_id").select(
            F.col("_k").cast("string").alias(name), shifted(F.col("_k")).alias("vector"))

    classes = near(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_partkey", "class_id")
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.abs(F.hash("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")).cast("long").alias("q"))
    queries = near(items.where("q % 30 = 0"), "q", "query_id")
    return score_top_k(queries.withColumnRenamed("vector", "embedding"),
                       classes.withColumnRenamed("vector", "prototype"), 10, scale=20.0)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", master=f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false", spark__driver__memory="16g",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    spark.sparkContext.setLogLevel("ERROR")
    from checks import QUERIES

    wanted = sys.argv[1:] or HEADLINE
    rate = None
    # Start the Python workers and the JIT before the clock runs.
    QUERIES["view_retrieval"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in wanted:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    if not sys.argv[1:]:
        start = time.perf_counter()
        found = large_retrieval(spark, sf_dir).count()
        times["large_retrieval"] = round(time.perf_counter() - start, 3)
        rate = round(found / times["large_retrieval"])
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "retrieval_queries_per_sec": rate, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
