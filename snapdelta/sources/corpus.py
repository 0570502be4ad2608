"""Documents as classes: even ids are snapshot a, odd ones b. One narrow projection after the labels are joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapdelta.schema import FIELDS, METHODS, ROOT, XREF


def _words(line: Column) -> Column:
    return F.filter(F.split(line, " "), lambda w: w != "")


def _bind(value: Column, body) -> Column:
    """Computes ``value`` once for a lambda that looks into it again and again."""
    return F.transform(F.array(value), body)[0]


def _methods(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.size(_words(x)) >= 2)
    long = lambda x: F.filter(F.split(x, " "), lambda w: F.length(w) >= 7)
    refs = lambda x: F.transform(long(x), lambda w: F.struct((F.length(w) >= 9).alias("peer_is_class"), F.right(w, F.lit(3)).alias("peer_access")))
    codes = lambda x: F.transform(F.filter(F.split(x, ""), lambda c: c != ""), F.ascii)

    def one(x: Column, i: Column) -> Column:
        words = F.split(x, " ")
        return F.struct(
            i.alias("idx"), F.lit(True).alias("declared"), F.lit(True).alias("analysed"), F.lit(False).alias("is_external"),
            words[0].alias("descriptor"), words[1].alias("access"), codes(x).alias("opcodes"),
            F.array().cast(XREF).alias("xref_from"), refs(x).alias("xref_to"),
        )

    return F.transform(lines, one).cast(METHODS)


def _runs(words: Column) -> Column:
    """(word, n) of a sorted array, from where its runs begin."""
    def counted(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: ~F.coalesce(F.get(s, x["i"] - 1) == x["w"], F.lit(False)))
        return _bind(starts, lambda b: F.transform(b, lambda x, k: F.struct(x["w"].alias("w"), (F.coalesce(F.get(b, k + 1)["i"], F.size(s)) - x["i"]).alias("n"))))

    return _bind(F.sort_array(words), counted)


def _fields(tokens: Column) -> Column:
    def one(x: Column, i: Column) -> Column:
        token = x["w"]
        return F.struct(
            i.alias("idx"), F.lit(True).alias("declared"), (F.length(token) >= 10).alias("analysed"), token.alias("descriptor"), F.right(token, F.lit(3)).alias("access"),
            (x["n"] * F.length(token)).alias("n_read"), (F.ascii(token) % 7).alias("n_write"), F.when(token.rlike("[0-9]"), token).alias("init_value"),
        )

    return F.transform(_runs(F.filter(tokens, lambda t: F.length(t) >= 9)), one).cast(FIELDS)


def _refs(tokens: Column, wanted, peer) -> Column:
    return F.array_distinct(F.transform(F.filter(tokens, wanted), lambda t: F.struct(peer(t).alias("peer"), F.length(t).cast("string").alias("kind"))))


def classes(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Class rows of ``documents`` with a snapshot column."""
    marks = labels.select(F.col("doc_id").alias("__id"), "quality", "toxic")
    text = F.coalesce("text", F.lit(""))
    tokens = _words(F.replace(text, F.lit("\n"), F.lit(" ")))
    rows = documents.join(marks, F.col("doc_id") == F.col("__id"), "left").withColumn("__t", tokens)
    name = F.concat(F.lit("L"), "lang", F.lit("/D"), F.expr("doc_id div 2").cast("string"), F.lit(";"))
    t = F.col("__t")
    return rows.select(
        "doc_id", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b").alias("snapshot"), name.alias("class_name"), F.lit(True).alias("is_internal"), F.col("lang").alias("access_flags"),
        F.when(F.col("lang") == "en", ROOT).otherwise(F.concat(F.lit("L"), "lang", F.lit("/Base;"))).alias("extends"),
        F.array_compact(F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic"))).alias("implements"),
        _methods(text).alias("methods"), _fields(t).alias("fields"),
        _refs(t, lambda x: F.length(x) <= 2, lambda x: x).alias("xref_from"), _refs(t, lambda x: F.length(x) >= 7, lambda x: F.left(x, F.lit(1))).alias("xref_to"),
        "source",
    )


def load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in fewer partitions than there are cores (a small file) are dealt out first; larger inputs aren't shuffled."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    documents, cores = read("documents"), spark.sparkContext.defaultParallelism
    if documents.rdd.getNumPartitions() < cores:
        documents = documents.repartition(cores)
    return classes(documents, read("labels"))
