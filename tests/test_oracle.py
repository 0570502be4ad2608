import os
import re

import pytest

import __spark_entry__ as entry
from tests.oracle import spark_rows, sql_rows

D = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if not re.match(r"op\d+_|pipeline$", n)])
def test_query_equals_sql(spark, name):
    got, want = spark_rows(entry.queries()[name](spark, D)), sql_rows(entry.oracle_sql()[name], D)
    assert got[0] == want[0]
    assert got[1] == want[1]
    assert got[1]


def test_entry(spark):
    assert entry.entry(spark).columns == ["class_name", "status", "score", "candidates"]
