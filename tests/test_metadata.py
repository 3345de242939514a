"""Canonical forms of JSON texts of any shape, against known values and the plain writer."""

import json
import random

import pytest
from pyspark.sql import functions as F

from provloom.functions.canonical import canonical_metadata, canonical_of_text, canonical_text, content_id_of, content_id_with, js_number


@pytest.mark.parametrize("x, text", [
    (0.0, "0"), (-0.0, "0"), (1.0, "1"), (-2.5, "-2.5"), (1e-6, "0.000001"), (1e-7, "1e-7"), (1.5e-7, "1.5e-7"), (0.1, "0.1"), (123456.0, "123456"),
    (1e20, "100000000000000000000"), (1e21, "1e+21"), (1.5e300, "1.5e+300"), (12345678901234567890.0, "12345678901234567000"), (5e-324, "5e-324"),
])
def test_numbers(x, text):
    assert js_number(x) == text


#: (text, canonical form); None is no JSON.
KNOWN = [
    ('{"b":1.50,"a":{"10":1,"9":2,"z":null,"B":[]}}', '{"a":{"9":2,"10":1,"B":[],"z":null},"b":1.5}'),
    ('{"\\uffee":1,"\\ud83d\\ude00":2}', '{"\U0001f600":2,"\uffee":1}'),  # by UTF-16 units
    ('{"a":1,"a":{"x":2}}', '{"a":{"x":2}}'), ('"\\u001B\\/\\ud800"', '"\\u001b/\\ud800"'), ("-0", "0"), ("[1e3, 1E400,100.0]", "[1000,null,100]"), (" null\n", "null"), ("9007199254740993", "9007199254740992"),
    ("", None), ("1 2", None), ("{} x", None), ("[1]]", None), ("1}", None), ("1], [2", None), ("1, 2", None), ('1,"b":2', None), ("1},{", None), ("[NaN]", None), ("{a:1}", None), ("[1,]", None), (None, None),
    ("[" * 900 + "]" * 900, "[" * 900 + "]" * 900), ('"' + "x\\n" * 100_000 + '"', '"' + "x\\n" * 100_000 + '"'),
]


def random_value(r: random.Random, depth: int = 0):
    kind = r.random()
    if depth < 4 and kind < 0.3:
        return {r.choice(["a", "B", "\u00e9", "10", "9", "01", "_", "\U0001f600", "\uffee", 'q"x', "\n", "1\":"]) + r.choice(["", "1"]): random_value(r, depth + 1) for _ in range(r.randint(0, 4))}
    if depth < 4 and kind < 0.5:
        return [random_value(r, depth + 1) for _ in range(r.randint(0, 4))]
    return r.choice([None, True, False, r.randint(-10**6, 10**6), r.randint(-10**20, 10**20), round(r.uniform(-1000, 1000), r.randint(0, 6)), r.uniform(-1, 1) * 10 ** r.randint(-25, 25), "".join(r.choice('ab",:[1.0e\\ \n\x01\x7f\u00e9\U0001f600') for _ in range(r.randint(0, 8)))])


def test_known_texts_and_random_ones_equal_the_plain_writer(spark):
    r = random.Random(5)
    texts = [t for t, _ in KNOWN] + [json.dumps(random_value(r), ensure_ascii=r.random() < 0.5, indent=r.choice([None, 1])) for _ in range(1500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", canonical_metadata(F.col("t")).alias("c")).orderBy("i").collect()
    got = [row["c"] for row in rows]
    assert got[:len(KNOWN)] == [c for _, c in KNOWN]
    assert got == [canonical_of_text(t) for t in texts]
    again = spark.createDataFrame([(c,) for c in got if c is not None], "c string")
    assert again.where(canonical_metadata(F.col("c")) != F.col("c")).isEmpty()


def test_ids_with_metadata(spark):
    rows = [("x", '{"b":[1,2.50], "a":{"k":"v"}}'), ("x", None), (None, "[]"), ("y", "no json")]
    df = spark.createDataFrame(rows, "t string, m string").select(content_id_with("rel", {"metadata": F.col("m")}, type=F.col("t"), basis=F.array(F.lit("p"))).alias("id"))
    wanted = [{"basis": ["p"], "type": "x", "metadata": {"a": {"k": "v"}, "b": [1, 2.5]}}, {"basis": ["p"], "type": "x"}, {"basis": ["p"], "metadata": []}, {"basis": ["p"], "type": "y"}]
    assert sorted(row["id"] for row in df.collect()) == sorted(content_id_of("rel", w) for w in wanted)
    assert canonical_text({"2": 1e-7, "10": 0.5, "1": "a"}) == '{"1":"a","2":1e-7,"10":0.5}'
