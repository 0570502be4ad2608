"""Helpers that the operators of this subpackage share.

Texts reach Python in Arrow batches, which Spark itself bounds by bytes
(spark.sql.execution.arrow.maxBytesPerBatch, 64 MB unless the cluster sets another). The operators make
them smaller still: a setting of the session holds for the jobs that they run themselves, and for a
lazy result as long as that result is alive (``small_batches``); then the caller's own value is back.
``written`` also has shuffle files removed with its own job.
"""

from __future__ import annotations

import contextlib
import os
from collections.abc import Iterator
from weakref import finalize

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapdelta.sources.scratch import remove, shared_path

#: A word is a run of characters other than the six ASCII white-space characters.
SPACES = r"[\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "256"


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Holds a setting of the session for a job that is run inside, and puts the old one back."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


_holders: dict[SparkSession, list] = {}  # how many results are alive, and the value before the first of them


def _let_go(spark: SparkSession) -> None:
    _holders[spark][0] -= 1
    if not _holders[spark][0]:
        before = _holders.pop(spark)[1]
        with contextlib.suppress(Exception):  # a session that has ended
            spark.conf.set(BATCH, before)


def small_batches(result: DataFrame) -> DataFrame:
    """``result``, with small Arrow batches as long as it is alive; where it is let go before it runs, batches are bounded by bytes alone."""
    spark = result.sparkSession
    if spark not in _holders:
        _holders[spark] = [0, spark.conf.get(BATCH)]
        spark.conf.set(BATCH, BATCH_ROWS)
    _holders[spark][0] += 1
    finalize(result, _let_go, spark).atexit = False
    return result


@contextlib.contextmanager
def own_job(spark: SparkSession) -> Iterator[None]:
    """For a job that an operator runs itself: small batches, and shuffle files that go with it."""
    with setting(spark, CLEANUP, "true"), setting(spark, BATCH, BATCH_ROWS):
        yield


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Cuts the lineage: writes ``df`` into the shared folder and reads it back; its shuffle files go with the job."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    with own_job(spark):
        df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path  # for drop_written
    return out


def drop_written(*tables: DataFrame) -> None:
    """Deletes what ``written`` has written, once no later step reads it."""
    for df in tables:
        remove(df.sparkSession, df.written_path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name), F.lit(""))


def rows_of(df: DataFrame, **columns: Column) -> DataFrame:
    """(row, columns): each row of ``df`` as one struct beside columns made of it, so that no name can clash."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *(c.alias(n) for n, c in columns.items()))


def unpacked(df: DataFrame) -> DataFrame:
    """The rows that ``rows_of`` has packed."""
    return df.select("row.*")


def join_spread(rows: DataFrame, one: DataFrame, on: str, counts: DataFrame, how: str = "inner", most: int = 200_000, bound: int = 10_000) -> DataFrame:
    """``rows`` joined with ``one``, which has a row a key, by shuffles that split hot keys.

    ``counts`` has (key, n), the number of ``rows`` of each key. Keys of more than ``most`` rows are
    dealt to several tasks by a hash of the row, and their row of ``one`` is repeated for each. The hot
    keys are broadcast: at most ``bound`` of them, as ``most`` rises with the table where it must.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(most, total // bound)
    hot = counts.where(F.col("n") > least).select(F.col(on).alias("__hot"), F.ceil(F.col("n") / least).cast("int").alias("__parts"))
    found = hot.collect() if total > least else []
    if not found:
        return rows.join(one, on, how)
    hot = F.broadcast(rows.sparkSession.createDataFrame(found, hot.schema))
    salted = rows.join(hot, F.col(on) == F.col("__hot"), "left").withColumn("__salt", F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns)), F.coalesce("__parts", F.lit(1))).cast("int")).drop("__hot", "__parts")
    repeated = one.join(hot, F.col(on) == F.col("__hot"), "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__hot", "__parts")
    return salted.join(repeated, [on, "__salt"], how).drop("__salt")


def bounded_sample(df: DataFrame, key: str, limit: int) -> DataFrame:
    """The ``limit`` rows of ``df`` (distinct in ``key``) with the smallest hashes of ``key``; all if there are fewer.

    With many rows, hashes beyond three times the expected bound are left out before the sort, so
    that each task sends a few rows instead of ``limit`` of them.
    """
    n, order = df.count(), F.xxhash64(key)
    if n > 4 * limit:
        df = df.where(order < int(-(2**63) + 2**64 * (3 * limit / n)))
    return df.orderBy(order, key).limit(limit)


def let(value: Column, body) -> Column:
    """Binds ``value`` once, so that lambdas in ``body`` don't evaluate it again for every element."""
    return F.transform(F.array(value), body)[0]


def fixed_numbers(name: str, n: int) -> list[int]:
    """``n`` unsigned 64-bit numbers that depend on ``name`` alone, whatever the library's version."""
    import xxhash

    return [xxhash.xxh64_intdigest(f"{name} {k}".encode()) for k in range(n)]


def quiet_threads() -> None:
    """One thread a worker: the executor's cores are already taken by its tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
