"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from clipsift.operators import screening, selection, vectors
from clipsift.plans.queries import QUERIES
from clipsift.sources.clips import clips

HEADLINE = ("screen_topk", "cascade_topk_refined", "maxsim_topk", "exact_cosine_topk", "arrow_exact_scores", "dedupe_export_rerank", "intervals", "score_stats", "score_histogram", "pr_sweep", "knn_cosine", "lasso_polygon", "marks_latest", "top_queries")


#: Copies of the clips for the runs at scale: 500 make a million rows of sf0.1.
COPIES = int(os.environ.get("BENCH_COPIES", "500"))


def at_scale(spark: SparkSession, sf: str, folder: str) -> dict[str, float]:
    """Rows a second of a top 25 over many copies of the clips: from the stored int8 screen, and from exact vectors by Arrow
    batches and by built-in functions."""
    c = clips(spark, sf)
    one = c.count()
    c.crossJoin(F.broadcast(spark.range(COPIES))).withColumn("row", F.col("row") + F.col("id") * one).drop("id").repartition(spark.sparkContext.defaultParallelism).write.parquet(f"{folder}/exact")
    rows = spark.read.parquet(f"{folder}/exact")
    query = [float(x) for x in c.where("row = 0").first()["vec"]]
    screen = selection.Screen(vectors.directions([query]), vectors.scales(c))
    screening.store(rows, screen.scale).write.parquet(f"{folder}/stored")
    stored = screening.same_rows(spark.read.parquet(f"{folder}/stored"), one * COPIES)
    runs = {
        "stored_screen": lambda: screening.screened(stored.select("row", "i8"), screen),
        "exact_arrow": lambda: vectors.arrow_scores(rows, screen.queries),
        "exact_builtin": lambda: rows.select("row", screen.exact().alias("score")),
    }
    out = {}
    for name, make in runs.items():
        took = []
        for _ in range(3):
            began = time.perf_counter()
            selection.ordered(make()).limit(25).collect()
            took.append(time.perf_counter() - began)
        out[name] = round(one * COPIES / statistics.median(took))
    return out


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        runs = []
        for _ in range(3):
            began = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs), 4)
    with tempfile.TemporaryDirectory(prefix="clipsift-bench-") as folder:
        scale = at_scale(spark, sf, folder) if COPIES else {}
    scale_rows = clips(spark, sf).count() * COPIES
    print(json.dumps({"metric": "headline queries, sum of medians", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": sf, "rows": scale_rows, "rows_per_second": scale}))


if __name__ == "__main__":
    main()
