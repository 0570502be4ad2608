"""Snapshots from packages, nested class files or flat tables, and exclusion lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapdelta.schema import CLASS, FIELDS, METHODS
from snapdelta.sources.dex import SUFFIXES, read_packages


def read_classes(spark: SparkSession, path: str, snapshot: str, fmt: str | None = None) -> DataFrame:
    """Class rows of one snapshot (dex, Parquet, ORC or JSON); a snapshot column in the files is overridden.

    Without a format, a path that ends like a package's is one, and others are Parquet.
    """
    fmt = fmt or ("dex" if path.lower().endswith(SUFFIXES) else "parquet")
    if fmt == "dex":
        return read_packages(spark, path, snapshot)
    return spark.read.schema(CLASS).format(fmt).load(path).withColumn("snapshot", F.lit(snapshot))


def read_snapshots(spark: SparkSession, a: str, b: str, fmt: str | None = None) -> DataFrame:
    return read_classes(spark, a, "a", fmt).unionByName(read_classes(spark, b, "b", fmt))


def fold(classes: DataFrame, methods: DataFrame, fields: DataFrame, class_xrefs: DataFrame, method_xrefs: DataFrame) -> DataFrame:
    """Class rows from flat tables, all keyed by (snapshot, class_name).

    ``methods`` and ``method_xrefs`` share ``idx``; xref tables have ``direction`` ('from' or 'to').
    Members are sorted by ``idx``. Each table is shuffled once by its class.
    """
    key = ["snapshot", "class_name"]

    def gathered(df: DataFrame, keys: list[str], columns: list[str], into: str, where=None) -> DataFrame:
        rows = df if where is None else df.where(where)
        return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(into))

    m = methods
    for d in ("from", "to"):
        m = m.join(gathered(method_xrefs, [*key, "idx"], ["peer_is_class", "peer_access"], f"xref_{d}", F.col("direction") == d), [*key, "idx"], "left").withColumn(f"xref_{d}", F.coalesce(f"xref_{d}", F.array()))
    out = classes
    out = out.join(gathered(m, key, ["idx", "declared", "analysed", "is_external", "descriptor", "access", "opcodes", "xref_from", "xref_to"], "methods"), key, "left")
    out = out.join(gathered(fields, key, ["idx", "declared", "analysed", "descriptor", "access", "n_read", "n_write", "init_value"], "fields"), key, "left")
    for d in ("from", "to"):
        out = out.join(gathered(class_xrefs, key, ["peer", "kind"], f"xref_{d}", F.col("direction") == d), key, "left")
    kinds = "array<struct<peer:string,kind:string>>"
    casts = {"methods": METHODS, "fields": FIELDS, "xref_from": kinds, "xref_to": kinds}
    return out.withColumns({c: F.coalesce(F.col(c), F.array()).cast(t) for c, t in casts.items()})


def exclusion_entries(literal: str | None) -> tuple[str, ...]:
    """Entries of a list separated by semicolons; blank ones are dropped."""
    return tuple(e.strip() for e in (literal or "").split(";") if e.strip())


def read_exclusions(spark: SparkSession, path: str) -> DataFrame:
    """One entry a line (column ``value``), without blank lines."""
    return spark.read.text(path).where(F.trim("value") != "")
