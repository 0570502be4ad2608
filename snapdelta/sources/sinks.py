"""Where results go: text files, tables and a self-contained HTML report."""

from __future__ import annotations

import html
from collections.abc import Iterable
from datetime import datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapdelta.plans.diff import Diff


def run_folder(root: str, now: datetime | None = None) -> str:
    """A folder for a run, named by its time."""
    return f"{root.rstrip('/')}/{(now or datetime.now()):%Y%m%d_%H%M%S}"


def best_match_line() -> Column:
    return F.concat("class_a", F.lit(" -> "), F.array_join("candidates", " "), F.lit(" | "), F.col("score").cast("string"))


def write_text(lines: DataFrame, path: str, column: str = "line") -> None:
    """Sorted lines; an existing path is an error."""
    lines.select(F.col(column).alias("value")).orderBy("value").write.mode("errorifexists").text(path)


def write_results(diff: Diff, folder: str) -> None:
    """The candidate report, best matches, each outcome's names, the summary and all statuses as a table."""
    write_text(diff.report(), f"{folder}/simhash_results")
    write_text(diff.best.select(best_match_line().alias("line")), f"{folder}/similar_classes")
    for name in ("deleted", "added", "empty"):
        write_text(getattr(diff, name), f"{folder}/{name}_classes", "class_name")
    diff.summary().write.mode("errorifexists").json(f"{folder}/summary")
    diff.status().write.mode("errorifexists").partitionBy("status").parquet(f"{folder}/status")


def write_phases(spark: SparkSession, took: dict[str, tuple[float, int]], folder: str) -> None:
    """Seconds and rows of each phase of a run."""
    spark.createDataFrame([(n, s, r) for n, (s, r) in took.items()], "phase string, seconds double, rows bigint").coalesce(1).write.mode("errorifexists").json(f"{folder}/phases")


_PAGE = """<!DOCTYPE html>
<html lang="en"><head><meta charset="utf-8"><title>{title}</title>
<style>body{{font:15px sans-serif;margin:2rem}}nav a{{margin-right:1rem}}table{{border-collapse:collapse}}td,th{{border:1px solid #bbb;padding:.2rem .6rem;text-align:left}}</style>
</head><body><nav>{links}</nav><h1>{title}</h1>
"""
PAGES = ("index", "similar", "added", "deleted", "empty")


def _page(path: Path, title: str, header: tuple[str, ...], rows: Iterable[tuple]) -> int:
    n = 0
    with path.open("w", encoding="utf-8") as f:
        links = " ".join(f'<a href="{p}.html">{p}</a>' for p in PAGES)
        f.write(_PAGE.format(title=html.escape(title), links=links))
        f.write("<table><tr>" + "".join(f"<th>{html.escape(h)}</th>" for h in header) + "</tr>\n")
        for row in rows:
            f.write("<tr>" + "".join(f"<td>{html.escape(str(x))}</td>" for x in row) + "</tr>\n")
            n += 1
        f.write("</table></body></html>\n")
    return n


def write_html(diff: Diff, folder: str) -> dict[str, int]:
    """Five escaped pages in a local folder; rows come to the driver one partition at a time."""
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=False)
    stream = lambda df: (tuple(r) for r in df.toLocalIterator())
    similar = diff.best.orderBy("class_a").select("class_a", F.array_join("candidates", " "), "score")
    counts = {"similar": _page(out / "similar.html", "Similar classes", ("class", "candidates", "score"), stream(similar))}
    for name in ("added", "deleted", "empty"):
        counts[name] = _page(out / f"{name}.html", f"Classes: {name}", ("class",), stream(getattr(diff, name).orderBy("class_name")))
    _page(out / "index.html", "Comparison", ("outcome", "classes"), counts.items())
    return counts
