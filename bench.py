"""Headline queries, timed.  Prints one JSON line.

``BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``) names the tables, ``BENCH_CPUS``
(default 8) the local cores.  Every result is computed in full and discarded.  Each query
runs twice; the second run is reported, so that code generation and JIT warm-up of a fresh
JVM do not drown what the query itself costs.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

HEADLINE = (
    "t17_tokenize",               # tokens of whole documents
    "m03_expanded_jaccard",       # bilingual scores of all hits
    "j01_match_best",             # top-1 over the inverted index
    "j05_species_guard",
    "j08_block_fallback",
    "j12_image_tiebreak",
    "j16_early_stop",
    "j18_hit_selection",
    "j20_resolution_cascade",
    "j22_variant_images",
    "j23_similar_products",       # self-similarity
    "j23_similar_documents",
    "j29_marketplace_hits",
    "i03_dct_hash",
    "i04_dedupe_images",
    "i05_white_corners",
    "i12_image_audit",
    "s12_page_images",
    "u01_propose_groups",
    "u10_verify_plan",
    "v02_history_changes",
    "v06_dry_run_comparison",
    "v11_replacement_plan",
    "a02_audit",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from pyspark.sql import SparkSession

    from vitrina.plans import QUERIES

    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in names:
        cold = run(name)
        seconds[name] = round(run(name), 3)
        print(f"\n{name} cold {cold:.3f} warm {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
