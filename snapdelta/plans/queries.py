"""A query for each operator, over documents seen as classes."""

from __future__ import annotations

from collections.abc import Callable
from copy import copy
from weakref import finalize

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapdelta.functions.families import family_name, family_value
from snapdelta.functions.hashing import fnv1a32
from snapdelta.functions.scores import avg_or_zero, code_sequence, code_values, count_penalty, jaccard, mean_penalty, method_code_sig, micro
from snapdelta.operators import matching
from snapdelta.operators.features import BAGS, members
from snapdelta.operators.filters import is_empty, is_excluded
from snapdelta.operators.near_dup import blocks, native_components, signature_hex, with_signature
from snapdelta.operators.scoring import PARTS, attach
from snapdelta.plans.diff import Diff
from snapdelta.plans.oracle import EXCLUDED
from snapdelta.schema import ROOT
from snapdelta.sources.assemble import build
from snapdelta.sources.corpus import load
from snapdelta.sources.dex import read_packages
from snapdelta.sources.scratch import shared_path

Query = Callable[[SparkSession, str], DataFrame]


def _kept_for(result: DataFrame, *diffs: Diff) -> DataFrame:
    """What the comparison keeps lives as long as the result that reads it, or any frame made from that.

    Those share the session object of the frame they come from, so the result has one of its own.
    """
    session = copy(result.sparkSession)
    for diff in diffs:
        finalize(session, diff.release).atexit = False
    return type(result)(result._jdf, session)


NAME = ["snapshot", "class_name"]


def _live(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d).where(~is_empty())


def _diff(spark: SparkSession, d: str) -> Diff:
    return Diff(load(spark, d))


def _keyed_diff(spark: SparkSession, d: str) -> Diff:
    """Of classes named by name and id, as a name can be null or that of two classes; ``_shown`` gives the names."""
    classes = load(spark, d)
    return Diff(classes.withColumn("class_name", F.concat(F.coalesce("class_name", F.lit("")), F.lit("\n"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))


def _shown(name: str) -> Column:
    return F.nullif(F.left(name, F.length(name) - F.length(F.substring_index(name, "\n", -1)) - 1), F.lit("")).alias(name)


def scan_classes(spark: SparkSession, d: str) -> DataFrame:
    size = lambda column, kind: F.size(members(column, kind)).cast("bigint")
    return load(spark, d).where("is_internal").select(
        *NAME, "access_flags", "extends", size("methods", "declared").alias("n_methods"), size("fields", "declared").alias("n_fields"),
        size("fields", "analysed").alias("n_analysed_fields"), F.size("implements").cast("bigint").alias("n_implements"))


def excluded_filter(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d).where(~is_excluded(EXCLUDED)).select(*NAME)


def empty_filter(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d).select(*NAME, is_empty().alias("is_empty"))


def opcode_family(spark: SparkSession, d: str) -> DataFrame:
    codes = load(spark, d).select(F.explode(F.flatten(F.transform(F.filter("methods", lambda m: m["opcodes"].isNotNull()), lambda m: m["opcodes"]))).alias("opcode"))
    return codes.groupBy("opcode").agg(F.count("*").alias("n")).select("opcode", "n", family_name(F.col("opcode")).alias("family"), family_value(F.col("opcode")).alias("value"))


def _features(component: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return load(spark, d).select(*NAME, F.explode(BAGS[component]()).alias("feature")).groupBy(*NAME, "feature").agg(F.count("*").alias("n"))

    return run


def fnv(spark: SparkSession, d: str) -> DataFrame:
    text = spark.read.parquet(f"{d}/documents.parquet").select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("feature"))
    return text.where("feature <> ''").distinct().select("feature", fnv1a32(F.col("feature")).alias("h"))


def simhash32(spark: SparkSession, d: str) -> DataFrame:
    return native_components(_live(spark, d))


def signature128(spark: SparkSession, d: str) -> DataFrame:
    return with_signature(_live(spark, d)).select(*NAME, signature_hex().alias("signature"))


def lsh_blocks(spark: SparkSession, d: str) -> DataFrame:
    return blocks(with_signature(_live(spark, d)).select(*NAME, *BAGS)).select(*NAME, "block", F.concat_ws(".", "p0", "p1", "p2", "p3").alias("block_key"))


def near_dup_join(spark: SparkSession, d: str) -> DataFrame:
    diff = _diff(spark, d)
    return _kept_for(diff.pairs.select("*"), diff)


def deleted_anti(spark: SparkSession, d: str) -> DataFrame:
    diff = _diff(spark, d)
    return _kept_for(diff.deleted, diff)


def added_anti(spark: SparkSession, d: str) -> DataFrame:
    diff = _diff(spark, d)
    return _kept_for(diff.added, diff)


def _pairs_with_origin(spark: SparkSession, d: str) -> tuple[Diff, DataFrame]:
    """Pairs with language and source of both sides, which stand for names here as those almost never coincide."""
    diff = _diff(spark, d)
    origin = load(spark, d).select("snapshot", "class_name", F.struct("access_flags", "source").alias("origin"))
    side = lambda s, c: origin.where(F.col("snapshot") == s).select(F.col("class_name").alias(f"class_{s}"), F.col("origin").alias(c))
    return diff, diff.pairs.join(side("a", "origin_a"), "class_a").join(side("b", "origin_b"), "class_b")


def name_absent_count(spark: SparkSession, d: str) -> DataFrame:
    diff, pairs = _pairs_with_origin(spark, d)
    return _kept_for(matching.name_absent(pairs, F.col("origin_a") == F.col("origin_b")).agg(F.count("*").alias("name_absent")), diff)


def candidate_report(spark: SparkSession, d: str) -> DataFrame:
    diff, pairs = _pairs_with_origin(spark, d)
    return _kept_for(matching.candidate_report(diff.side("a"), pairs, same=F.col("origin_a") == F.col("origin_b")), diff)


def summary_metrics(spark: SparkSession, d: str) -> DataFrame:
    diff = _diff(spark, d)
    return _kept_for(matching.summary(diff.side("a"), diff.side("b"), diff.pairs).withColumn("mean_candidates", micro(F.col("mean_candidates"))), diff)


def _attached(spark: SparkSession, d: str, *columns: Column) -> DataFrame:
    diff = _keyed_diff(spark, d)
    return _kept_for(attach(diff.pairs, diff.plain_features("a"), diff.plain_features("b")).select(_shown("class_a"), _shown("class_b"), *columns), diff)


def jaccard_query(spark: SparkSession, d: str) -> DataFrame:
    return _attached(spark, d, micro(jaccard(F.col("a.f_descriptors"), F.col("b.f_descriptors"))).alias("jaccard"))


def avg_query(spark: SparkSession, d: str) -> DataFrame:
    return _live(spark, d).select(*NAME, micro(avg_or_zero(F.transform(members("fields", "analysed"), lambda f: f["n_read"]))).alias("reads"))


def ratio_penalty(spark: SparkSession, d: str) -> DataFrame:
    count = count_penalty(0.08, F.col("a.n_methods"), F.col("b.n_methods"))
    mean = mean_penalty(0.03, F.col("a.reads"), F.col("b.reads"))
    return _attached(spark, d, micro(count).alias("count_penalty"), micro(mean).alias("mean_penalty"))


def method_sig_query(spark: SparkSession, d: str) -> DataFrame:
    coded = F.filter("methods", lambda m: m["declared"] & m["opcodes"].isNotNull())
    rows = _live(spark, d).select(*NAME, F.explode(coded).alias("m"))
    return rows.select(*NAME, "m.idx", code_values(F.col("m.opcodes")).alias("v")).select(*NAME, "idx", method_code_sig(F.col("v")).alias("sig"))


def sequence_query(spark: SparkSession, d: str) -> DataFrame:
    return _live(spark, d).select(*NAME, code_sequence(F.col("methods")).alias("code"))


def _scored(*parts: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        diff = _keyed_diff(spark, d)
        scored = diff.sub_scored if PARTS.keys() >= set(parts) else diff.scored
        return _kept_for(scored.select(_shown("class_a"), _shown("class_b"), *(micro(F.col(p)).alias(p) for p in parts)), diff)

    return run


def best_match(spark: SparkSession, d: str) -> DataFrame:
    diff = _keyed_diff(spark, d)
    best = matching.best_match(diff.contenders.withColumns({c: _shown(c) for c in ("class_a", "class_b")}), F.collect_list)
    return _kept_for(best.select("class_a", micro(F.col("score")).alias("score"), F.nullif(F.array_join("candidates", ","), F.lit("")).alias("candidates")), diff)


def best_above_threshold(spark: SparkSession, d: str) -> DataFrame:
    diff = _diff(spark, d)
    return _kept_for(diff.best_above(0.5).withColumn("score", micro(F.col("score"))), diff)


def diff_status(spark: SparkSession, d: str) -> DataFrame:
    diff = _diff(spark, d)
    return _kept_for(diff.status().withColumn("score", micro(F.col("score"))), diff)


def package_classes(spark: SparkSession, d: str) -> DataFrame:
    """A scan of a package that is assembled from two small tables: a class a region, and a class a nation that extends its region's."""
    rows = lambda name: sorted(map(tuple, spark.read.parquet(f"{d}/{name}.parquet").select(*TABLES[name]).collect()))
    region = lambda key: f"Lregion/R{key};"
    classes = [(region(key), 0x401, ROOT, (), [], [("name", "V", (), 0x1, [0x1070, ("m", ROOT, "<init>", "V", ()), 0, 0x0E])]) for (key,) in rows("region")]
    for key, name, parent in rows("nation"):
        code = [0x001A, ("s", name), 0x106E, ("m", region(parent), "name", "V", ()), 0, 0x0E]
        classes.append((f"Lnation/N{key};", 0x11, region(parent), (), [("key", "I", 0x18, bytes([0x04, key]))], [("go", "V", ("I",), 0x1, code)]))
    folder = shared_path(spark, "package")
    system, path = pafs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/tables.dex") as file:
        file.write(build(classes))
    found = read_packages(spark, folder, "a")
    size = lambda column: F.size(members(column, "declared")).cast("bigint")
    named = F.array_join(F.transform(F.flatten(F.transform(F.filter("methods", lambda m: m["opcodes"].isNotNull()), lambda m: m["opcodes"])), family_name), ",")
    return found.select(
        "class_name", "is_internal", F.coalesce("access_flags", F.lit("")).alias("access_flags"), F.coalesce("extends", F.lit("")).alias("extends"), size("methods").alias("n_methods"), size("fields").alias("n_fields"),
        F.get(F.transform("fields", lambda f: f["init_value"]), F.lit(0)).alias("init_value"), named.alias("families"), F.size("xref_to").cast("bigint").alias("n_used"), F.size("xref_from").cast("bigint").alias("n_users"))


TABLES = {"region": ["r_regionkey"], "nation": ["n_nationkey", "n_name", "n_regionkey"]}
QUERIES: dict[str, Query] = {
    "package_classes": package_classes, "scan_classes": scan_classes, "excluded_filter": excluded_filter, "empty_filter": empty_filter, "opcode_family": opcode_family,
    "class_features": _features("class_sh"), "method_features": _features("method_sh"), "field_features": _features("field_sh"), "code_features": _features("code_sh"),
    "fnv1a32": fnv, "simhash32": simhash32, "signature128": signature128, "lsh_blocks": lsh_blocks, "near_dup_join": near_dup_join,
    "deleted_anti": deleted_anti, "added_anti": added_anti, "name_absent_count": name_absent_count, "candidate_report": candidate_report, "summary_metrics": summary_metrics,
    "jaccard": jaccard_query, "avg_or_zero": avg_query, "ratio_penalty": ratio_penalty, "method_code_sig": method_sig_query, "code_sequence": sequence_query,
    "code_score": _scored("code_score"), "fields_score": _scored("fields_score"), "class_score": _scored("class_score"), "method_score": _scored("method_score"),
    "score_pairs": _scored("fields_score", "class_score", "method_score", "code_score", "score"), "similarity_score": _scored("score"),
    "best_match": best_match, "best_above_threshold": best_above_threshold, "diff_status": diff_status,
}
