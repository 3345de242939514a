"""A whole state's checks on hand-made tables."""

import pytest

from provloom.operators import state_check as c

LISTS = "array<string>"


def state(spark, **changed):
    """A valid state of one record of each kind, some tables replaced."""
    made = {
        "contracts": (["c1", "c2"], "id string"), "functions": (["f1"], "id string"),
        "relationships": ([("r1", "c1", "f1", "more")], "id string, source_id string, target_id string, missing string"),
        "facts": ([("a1", "c1", None, "VERIFIED", ["p"])], f"id string, subject_id string, object_id string, level string, provenance {LISTS}"),
        "observations": ([("o1", ["a1"], "DERIVED", [])], f"id string, based_on {LISTS}, level string, provenance {LISTS}"),
        "assumptions": ([("s1", ["o1"], "INFERRED")], f"id string, based_on {LISTS}, level string"),
        "hypotheses": ([("h1", ["s1", "o1"], "SPECULATIVE", ["c2"])], f"id string, based_on {LISTS}, level string, affected_entities {LISTS}"),
        "evidence": ([("e1", ["h1"], ["a1"], ["p"])], f"id string, supports {LISTS}, contradicts {LISTS}, provenance {LISTS}"),
    }
    return {k: spark.createDataFrame([(r,) if isinstance(r, str) else r for r in changed.get(k, rows)], schema) for k, (rows, schema) in made.items()}


def found(tables):
    return sorted((r["code"], r["check"], r["source"], r["missing"] or "") for r in c.state_violations(tables).collect())


def test_a_valid_state_has_no_violations(spark):
    violations = c.state_violations(state(spark))
    assert violations.isEmpty() and c.deciding_code(violations) is None


LOST = "InvalidReconState"


@pytest.mark.parametrize("changed, wanted", [
    ({"relationships": [("r1", "c1", "a1", ""), ("r2", "x", "x", ""), ("r3", None, "f1", "")]}, [(LOST, "relationship-endpoints", "r1", "a1"), (LOST, "relationship-endpoints", "r2", "x"), (LOST, "relationship-endpoints", "r2", "x")]),
    ({"facts": [("a1", "o1", "z", "VERIFIED", ["p"])]}, [(LOST, "fact-object", "a1", "z"), (LOST, "fact-subject", "a1", "o1")]),
    ({"observations": [("o1", ["a1", "s1", None, "q"], "DERIVED", None)]}, [(LOST, "observation-basis", "o1", "q"), (LOST, "observation-basis", "o1", "s1")]),
    ({"assumptions": [("s1", ["a1"], "INFERRED")]}, [(LOST, "assumption-basis", "s1", "a1")]),
    ({"hypotheses": [("h1", ["a1", "s1"], "SPECULATIVE", ["h1"])]}, [(LOST, "hypothesis-basis", "h1", "a1"), (LOST, "hypothesis-entities", "h1", "h1")]),
    ({"evidence": [("e1", ["e1"], ["c1"], ["p"])]}, [(LOST, "evidence-contradicts", "e1", "c1"), (LOST, "evidence-supports", "e1", "e1")]),
    ({"functions": ["f1", "c1"]}, [("DuplicateCanonicalEntity", "unique", "c1", "")]),
    ({"observations": [("o1", [], "VERIFIED", ["p"])]}, [("InvalidConfidence", "observation", "o1", "")]),
])
def test_each_check(spark, changed, wanted):
    assert found(state(spark, **changed)) == wanted


def test_the_first_check_decides(spark):
    broken = {"evidence": [("e1", [], [], [])], "relationships": [("r1", "x", "y", "")]}
    assert c.deciding_code(c.state_violations(state(spark, **broken))) == "MissingProvenance"
    broken["hypotheses"] = [("h1", [], "SPECULATIVE", [])]
    assert c.deciding_code(c.state_violations(state(spark, **broken))) == "InvalidEpistemicDependency"
    broken["assumptions"] = [("s1", ["o1"], None)]
    assert c.deciding_code(c.state_violations(state(spark, **broken))) == "InvalidConfidence"
    broken["contracts"] = ["c1", "c1", "c2"]
    assert c.deciding_code(c.state_violations(state(spark, **broken))) == "DuplicateCanonicalEntity"


def test_tables_may_be_absent_or_empty(spark):
    whole = state(spark)
    assert found({"facts": whole["facts"].drop("object_id", "extra")}) == [(LOST, "fact-subject", "a1", "c1")]
    assert found({k: v.limit(0) for k, v in whole.items()}) == []
    with pytest.raises(ValueError, match="some of the tables"):
        c.state_violations({"others": whole["facts"]})
