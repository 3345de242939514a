"""Ids, canonical bytes, globs, spans and versions against known values."""

import re

import pytest
from pyspark.sql import functions as F

from provloom.functions import ids, text
from provloom.functions.canonical import canonical_text, content_id, content_id_of


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_content_ids_agree_with_known_values(spark):
    payload = {"type": "EMITS", "subject_id": "a", "value": "Transfer(address,address,uint256)"}
    expected = content_id_of("fact", payload)
    assert one(spark, content_id("fact", **{k: F.lit(v) for k, v in payload.items()})) == expected
    assert re.fullmatch("fact:[0-9a-f]{16}", expected)


def test_canonical_text():
    assert canonical_text({"b": [1, 2.0, None], "a": {"z": None, "y": "é/"}, "c": []}) == '{"a":{"y":"é/"},"b":[1,2,null],"c":[]}'
    assert canonical_text({"\U0001f600": 1, "￮": 2}) == '{"\U0001f600":1,"￮":2}'  # by UTF-16 units


@pytest.mark.parametrize("glob, path, fits", [
    ("**/*.sol", "a.sol", True), ("**/*.sol", "x/y/a.sol", True), ("src/**", "src/a/b", True), ("src/*", "src/a/b", False),
    ("?.txt", "a.txt", True), ("?.txt", "ab.txt", False), ("a+b.sol", "a+b.sol", True), ("a.sol", "axsol", False), ("**", "any/thing", True),
])
def test_globs(glob, path, fits):
    assert bool(re.search(text.glob_pattern(glob), path)) is fits


def test_paths_and_contracts(spark):
    assert one(spark, ids.normal_path(F.lit("Src\\\\.//Vault Core.sol"))) == "src__vault_core_sol"
    assert one(spark, ids.contract_id(F.lit(" Vault "), F.lit("src/Vault.sol"))) == "contract:src__vault_sol:vault"
    address = "0x" + "Ab" * 20
    assert one(spark, ids.contract_id(F.lit("Vault"), chain=F.lit(" ETH "), address=F.lit(address))) == "contract:eth:" + address.lower()
    with pytest.raises(Exception, match="name must not be empty"):
        one(spark, ids.contract_id(F.lit("  ")))


def test_spans_and_lines(spark):
    assert one(spark, text.span_parts(F.lit("src/a:b.sol:3-14")))["file"] == "src/a:b.sol"
    assert one(spark, text.span_parts(F.lit("no span"))) is None
    assert one(spark, text.line_at(F.lit("é\nb\nc"), F.lit(3))) == 2


@pytest.mark.parametrize("version, ranges, fits", [
    ("0.8.19", "^0.8.0", True), ("0.9.0", "^0.8.0", False), ("1.9.9", "^1.2.3", True), ("0.0.4", "^0.0.3", False),
    ("0.8.3", ">=0.8.0 <0.8.4", True), ("0.8.4", ">=0.8.0 <0.8.4", False), ("0.7.6", "0.7.6 || ^0.8.0", True), ("x", "^0.8.0", False), ("0.8.0", "~0.8.0", False),
])
def test_version_ranges(spark, version, ranges, fits):
    assert one(spark, text.satisfies(F.lit(version), ranges)) is fits
