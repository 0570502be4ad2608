import pyarrow as pa
from pyspark.sql import functions as F

from snapdelta.llm import common as C


def test_bounded_sample(spark):
    df = spark.range(20_000).selectExpr("id AS k", "id % 7 AS v")
    by_hash = [r.k for r in df.selectExpr("k", "xxhash64(k) AS h").orderBy("h", "k").limit(100).collect()]
    assert [r.k for r in C.bounded_sample(df, "k", 100).collect()] == by_hash
    assert C.bounded_sample(df.limit(50), "k", 100).count() == 50
    assert C.bounded_sample(df.limit(0), "k", 100).count() == 0


def test_batches_are_bounded_by_bytes(spark):
    """What the operators rely on for long texts: 400 texts of 1 MB don't come as one batch."""
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    def one(column):
        import pandas as pd

        return pd.Series([len(column)] * len(column))

    long = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("t"))
    assert max(r.n for r in long.mapInArrow(sizes, "n long").collect()) <= 80
    assert max(r[0] for r in long.select(F.pandas_udf(one, "long")("t")).collect()) <= 80


def test_settings_come_back(spark):
    before = spark.conf.get(C.CLEANUP)
    out = C.written(spark.range(10).groupBy((F.col("id") % 3).alias("k")).count(), "t")
    assert spark.conf.get(C.CLEANUP) == before and out.count() == 3
    C.drop_written(out)


def test_small_batches_end_with_their_results(spark):
    import gc

    before = spark.conf.get(C.BATCH)
    a, b = C.small_batches(spark.range(3)), C.small_batches(spark.range(4))
    assert spark.conf.get(C.BATCH) == C.BATCH_ROWS
    with C.own_job(spark):
        assert spark.conf.get(C.CLEANUP) == "true"
    del a
    gc.collect()
    assert spark.conf.get(C.BATCH) == C.BATCH_ROWS and b.count() == 4
    del b
    gc.collect()
    assert spark.conf.get(C.BATCH) == before


def test_spread_join_equals_join(spark):
    rows = spark.range(3000).selectExpr("if(id < 2000, 7, id % 5) AS k", "id AS v")
    one = spark.createDataFrame([(k, f"n{k}") for k in range(9)], "k long, name string")
    counts = rows.groupBy("k").count().withColumnRenamed("count", "n")
    for most in (10, 10**6):
        got = C.join_spread(rows, one, "k", counts, most=most).select("k", "v", "name")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(one, "k").select("k", "v", "name").collect()))
    assert C.join_spread(rows.limit(0), one, "k", counts.limit(0)).count() == 0
