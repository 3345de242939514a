"""Saves of many tables: all or nothing, one of two savers, versions that stay."""

import pytest

from provloom.operators.commits import StateStore
from provloom.operators.store import StoreError


def contracts(spark, *ids, name="x"):
    return spark.createDataFrame([(i, name, "t") for i in ids], "id string, name string, created_at string")


def functions(spark, *pairs):
    return spark.createDataFrame(list(pairs), "id string, contract_id string")


def ids(frame):
    return sorted(r["id"] for r in frame.select("id").collect())


def store(spark, tmp_path):
    return StateStore(spark, f"file://{tmp_path}/state")


def test_versions_and_repeated_saves(spark, tmp_path):
    s = store(spark, tmp_path)
    assert s.manifest().version == 0 and s.load() == {} and s.read("contracts") is None
    first = s.save({"functions": functions(spark, ("f", "a")), "contracts": contracts(spark, "a", "b", "a")}, meta={"saved": "1"})
    assert first.version == 1 and list(s.load()) == ["contracts", "functions"] and ids(s.read("contracts")) == ["a", "b"]
    again = s.save({"contracts": contracts(spark, "b", "c")}, seen=1, meta={"saved": "2"})
    assert again.version == 2 and ids(s.read("contracts")) == ["a", "b", "c"] and ids(s.read("contracts", 1)) == ["a", "b"]
    assert (s.meta("saved"), s.meta("saved", 1), s.meta("schema_version")) == ("2", "1", "recon-state/v1")
    s.save({"contracts": contracts(spark, "a", "b", "c")})
    assert s.manifest().folders == again.folders and ids(s.read("functions")) == ["f"]
    assert len(s.compact("contracts").folders["contracts"]) == 1 and ids(s.read("contracts")) == ["a", "b", "c"]
    with pytest.raises(StoreError, match="EntityNotFound"):
        s.manifest(9)


def test_a_save_that_dies_between_two_tables_leaves_nothing_visible(spark, tmp_path):
    s = store(spark, tmp_path)
    s.save({"contracts": contracts(spark, "a")})
    broken = functions(spark, ("f", "a")).selectExpr("id", "if(id = 'f', raise_error('killed'), contract_id) as contract_id")
    with pytest.raises(Exception, match="killed"):
        s.save({"contracts": contracts(spark, "b"), "functions": broken})
    assert s.manifest().version == 1 and ids(s.read("contracts")) == ["a"] and s.read("functions") is None
    assert any(f.startswith("data/contracts/") for f in s.unreferenced())
    assert s.remove_unreferenced() and s.unreferenced() == []
    s.save({"contracts": contracts(spark, "b"), "functions": functions(spark, ("f", "a"))}, seen=1)
    assert ids(s.read("contracts")) == ["a", "b"] and ids(s.read("functions")) == ["f"]


def test_of_two_savers_one_is_refused(spark, tmp_path, monkeypatch):
    one, two = store(spark, tmp_path), store(spark, tmp_path)
    one.save({"contracts": contracts(spark, "a")})
    publish = one._publish

    def late(made):  # the other saver is done between this one's writing and its manifest
        two.save({"contracts": contracts(spark, "z")}, seen=1)
        publish(made)

    monkeypatch.setattr(one, "_publish", late)
    with pytest.raises(StoreError) as refused:
        one.save({"contracts": contracts(spark, "b")}, seen=1)
    assert refused.value.code == "VersionConflict" and ids(two.read("contracts")) == ["a", "z"]
    with pytest.raises(StoreError, match="VersionConflict"):
        two.save({"contracts": contracts(spark, "c")}, seen=1)
    assert one.manifest().version == 2


def test_content_and_references_are_checked(spark, tmp_path):
    s = store(spark, tmp_path)
    s.save({"contracts": contracts(spark, "a")})
    for tables, code in (({"contracts": contracts(spark, "a", name="other")}, "DuplicateCanonicalEntity"), ({"contracts": contracts(spark, "b"), "functions": functions(spark, ("f", "gone"))}, "InvalidSourceReference")):
        with pytest.raises(StoreError) as refused:
            s.save(tables)
        assert refused.value.code == code and s.manifest().version == 1 and ids(s.read("contracts")) == ["a"]
    s.save({"functions": functions(spark, ("f", "b"), ("g", None)), "contracts": contracts(spark, "b")})
    assert ids(s.read("functions")) == ["f", "g"]
