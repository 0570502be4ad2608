"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    here = str(Path(__file__).resolve().parent)
    os.environ["PYTHONPATH"] = here + os.pathsep + os.environ.get("PYTHONPATH", "")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from snapdelta.operators.filters import is_empty
    from snapdelta.operators.near_dup import near_dup_join, with_signature
    from snapdelta.operators.scoring import score_contenders, score_features
    from snapdelta.plans.diff import Diff
    from snapdelta.plans.queries import QUERIES
    from snapdelta.sources.corpus import load

    took: dict[str, float] = {}

    def timed(name: str, df) -> None:
        began = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)

    QUERIES["signature128"](spark, sf_dir).limit(1).collect()  # starts the workers
    live = load(spark, sf_dir).where(~is_empty()).repartition(int(cpus)).persist()
    live.count()
    timed("signatures", with_signature(live).select("snapshot", "class_name", "class_sh", "method_sh", "field_sh", "code_sh"))
    signed = with_signature(live).select("snapshot", "class_name", "class_sh", "method_sh", "field_sh", "code_sh").persist()
    signed.count()
    side = lambda df, s: df.where(F.col("snapshot") == s)
    timed("near_dup_search", near_dup_join(side(signed, "a"), side(signed, "b")))
    pairs = near_dup_join(side(signed, "a"), side(signed, "b")).persist()
    pairs.count()
    a, b = (score_features(side(live, s)).persist() for s in "ab")
    a.count(), b.count()
    timed("scoring_best", score_contenders(pairs, a, b))
    spark.catalog.clearCache()
    for name in ("scan_classes", "fnv1a32", "best_match"):
        timed(name, QUERIES[name](spark, sf_dir))
        spark.catalog.clearCache()
    diff = Diff(load(spark, sf_dir))
    timed("diff_status", diff.status())
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
