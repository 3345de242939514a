"""The order of issues against a plain sort."""

import random

import pytest

from provloom.operators.order import SEVERITIES, issues_in_order

SCHEMA = "severity string, code string, file string, line_start int, line_end int, count int, message string, other int"


def test_equals_a_plain_sort(spark):
    r = random.Random(7)
    texts = ["", "a", "B", "￮", "\U0001f600", "a\U0001f600"]
    rows = [(r.choice(SEVERITIES), r.choice(texts), r.choice([*texts, None]), *[r.choice([None, 0, 1, 2]) for _ in range(3)], r.choice(texts), i) for i in range(300)]
    units = lambda t: (t or "").encode("utf-16-be")
    key = lambda x: (SEVERITIES.index(x[0]), units(x[1]), units(x[2]), x[3] or 0, x[4] or 0, x[5] or 0, units(x[6]))
    got = issues_in_order(spark.createDataFrame(rows, SCHEMA)).orderBy("place").collect()
    assert [x["place"] for x in got] == list(range(1, 301))
    assert [key(x) for x in got] == sorted(map(key, rows))
    assert sorted(x["other"] for x in got) == list(range(300))


def test_few_columns_no_rows_and_wrong_severities(spark):
    few = issues_in_order(spark.createDataFrame([("UNKNOWN", "a"), ("FATAL", "b"), ("FATAL", "b")], "severity string, code string"))
    assert [tuple(x) for x in few.orderBy("place").collect()] == [("FATAL", "b", 1), ("FATAL", "b", 2), ("UNKNOWN", "a", 3)]
    assert issues_in_order(spark.createDataFrame([], SCHEMA)).isEmpty()
    for wrong in ("WARNING", None):
        with pytest.raises(Exception, match="no severity"):
            issues_in_order(spark.createDataFrame([(wrong, "a")], "severity string, code string")).collect()
