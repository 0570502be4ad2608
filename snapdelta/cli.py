"""Command line: compares two snapshots, given as packages or as class rows."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from snapdelta.config import DiffConfig
from snapdelta.plans.diff import Diff
from snapdelta.sources.sinks import run_folder, write_html, write_phases, write_results
from snapdelta.sources.tables import exclusion_entries, read_exclusions, read_snapshots


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Compare two snapshots of classes.")
    p.add_argument("first")
    p.add_argument("second")
    p.add_argument("--excpkgs", help="excluded name parts, separated by semicolons")
    p.add_argument("-f", "--file", help="file with an excluded name part a line")
    p.add_argument("-o", "--obfuscated", action="store_true", help="names are obfuscated: leave out name statistics")
    p.add_argument("-k", "--distance", type=int, default=3, help="greatest Hamming distance of candidates")
    p.add_argument("-t", "--threshold", type=float, help="least score of a best match")
    p.add_argument("--format", help="dex, parquet, orc or json; without it, dex for .apk, .jar, .zip and .dex, else parquet")
    p.add_argument("--output", default="outputs")
    p.add_argument("--html", action="store_true", help="also write HTML pages (to a local folder)")
    return p


def main(argv: list[str] | None = None) -> str:
    options = parser().parse_args(argv)
    spark = SparkSession.builder.appName("snapdelta").getOrCreate()
    config = DiffConfig(exclusion_entries(options.excpkgs), options.distance, options.threshold, options.obfuscated)
    excluded = read_exclusions(spark, options.file) if options.file else None
    diff, folder = Diff(read_snapshots(spark, options.first, options.second, options.format), config, excluded), run_folder(options.output)
    took, began = diff.phases(), time.perf_counter()
    write_results(diff, folder)
    if options.html:
        write_html(diff, f"{folder}/html")
    took["results"] = (time.perf_counter() - began, diff.status().count())
    write_phases(spark, took, folder)
    diff.release()
    for name, (seconds, rows) in took.items():
        print(f"{name}: {seconds:.3f} s, {rows} rows")
    print(f"{folder}: done in {sum(s for s, _ in took.values()):.1f} s")
    return folder


if __name__ == "__main__":
    main()
