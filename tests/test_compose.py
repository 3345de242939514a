"""Compositions against a plain recursive walk, on every kind of site and on random graphs."""

import hashlib
import json
import random

import pytest

from provloom.operators import compose
from provloom.operators.compose import Compositions
from provloom.operators.order import numbered
from provloom.storage import Scratch


def ident(**payload):
    return "seme:" + hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


class Walk:
    """What one root takes in, step by step."""

    def __init__(self, g, root, bound):
        self.g, self.bound, self.capable = g, bound, False
        self.entries, self.lineage, self.unknown = {}, {}, set()
        self.fallback = min((f for f, v in g["functions"].items() if v["visibility"] in ("public", "external")), default=None)
        self.take(root, [root])

    def note(self, owner, operator, edge, flags="", entry="", status=None):
        status = status or ("reentry-capable" if self.capable else "direct")
        self.lineage.setdefault((operator, edge, entry, owner, status, flags), len(self.lineage))

    def doubt(self, scope, reason, *basis):
        basis = sorted(basis)
        self.unknown.add((ident(scope=scope, reason=reason, basis=basis), scope, reason, tuple(basis)))

    def own(self, f, status=None):
        v = self.g["functions"][f]
        gates = [(m, i) for m in v["modifiers"] for i, k, fn, d in self.g["conditions"] if k == "modifier-gate" and fn == f and d == m]
        for m, i in gates:
            self.entries.setdefault(("condition", i, f, v["contract"]), len(self.entries))
            self.note(f, "modifier-wrap", m, status=status)
        rest = {("condition", i) for i, k, fn, d in self.g["conditions"] if fn == f and not (k == "modifier-gate" and d in v["modifiers"])} | {(k, r) for fn, k, r in self.g["owned"] if fn == f}
        for k, r in sorted(rest):
            self.entries.setdefault((k, r, f, v["contract"]), len(self.entries))

    def sites(self, f):
        g = self.g
        for i, s, t, kind in g["calls"]:
            if s == f:
                known = t in g["functions"]
                what = "no-kind" if not kind else ("delegate" if known else "shift") if kind == "delegatecall" else "call" if known else "unknown-target" if kind == "internal" else "callback"
                yield i, t if what in ("delegate", "call") else "", what, i
        for i, s, value in g["markers"]:
            if s == f:
                yield i, "", "shift" if value == "unresolved-delegatecall" else "callback", i
        for i, s, t in g["bases"]:
            if s == g["functions"][f]["contract"]:
                inside = [x for x, v in g["functions"].items() if v["contract"] == t]
                if t not in g["contracts"]:
                    yield i, "", "unknown-base", i
                elif not inside:
                    yield i, "", "empty-base", t
                for x in inside:
                    yield i, x, "inherit", t

    def take(self, f, chain):
        self.own(f)
        seen = set()
        for site, target, what, edge in sorted(self.sites(f)):
            operator = {"delegate": "delegate-shift", "shift": "delegate-shift", "callback": "callback-reentry", "unknown-base": "inherit-merge", "empty-base": "inherit-merge", "inherit": "inherit-merge"}.get(what, "call-inline")
            if len(chain) > self.bound:
                self.note(f, operator, site, "bound-hit")
                self.doubt("composition-bound", "bound-hit", site)
            elif target and (target in chain or target in seen):
                self.note(f, operator, site, "cyclic")
                self.doubt("composition-cycle", "cyclic", site)
            elif what == "callback" and self.fallback:
                self.own(self.fallback, status="direct")
                self.capable = True
                self.note(f, operator, site, "unknown-order", self.fallback)
                self.doubt("composition-reentry-order", "ordering-unobservable", site, self.fallback)
            else:
                if target:
                    seen.add(target)
                    self.take(target, chain + [target])
                flag = {"callback": "no-entry", "shift": "shift", "delegate": "shift"}.get(what, what if what in ("no-kind", "unknown-target", "unknown-base") else "")
                self.note(f, operator, edge, flag)
                scope = {"no-entry": ("composition-reentry", "no_evidence"), "shift": ("storage-subject", "context-shift"), "no-kind": ("composition-call-kind", "no_evidence"), "unknown-target": ("composition-unknown-target", "out_of_scope_target"), "unknown-base": ("composition-unknown-base", "out_of_scope_target")}.get(flag)
                if scope:
                    self.doubt(*scope, site)


def composed(spark, g, bound):
    scratch = Scratch(spark, "test-compose")
    functions = spark.createDataFrame([(f, v["contract"], v["visibility"], v["modifiers"]) for f, v in g["functions"].items()], "id string, contract_id string, visibility string, modifiers array<string>")
    conditions = spark.createDataFrame(g["conditions"], "id string, kind string, function string, descriptor string")
    steps = compose.sites(functions, spark.createDataFrame(g["calls"], "id string, source string, target string, call_kind string"), spark.createDataFrame(g["markers"], "id string, subject string, value string"),
                          spark.createDataFrame(g["bases"], "id string, source string, target string"), spark.createDataFrame([(c,) for c in g["contracts"]], "id string"), scratch)
    own = compose.own_records(functions, conditions, spark.createDataFrame(g["owned"], "function string, kind string, ref string"), scratch)
    return Compositions(functions.select("id"), functions, steps, own, bound=bound)


def check(spark, g, bound=8):
    made = composed(spark, g, bound)
    entries, lineage, unknowns = ({f: [] for f in g["functions"]} for _ in range(3))
    for r in sorted(made.entries().collect(), key=lambda r: (r["root"], r["place"])):
        entries[r["root"]].append((r["kind"], r["ref"], r["function"], r["contract"]))
    for r in sorted(made.lineage().collect(), key=lambda r: (r["root"], r["place"])):
        lineage[r["root"]].append((r["operator"], r["edge"], r["entry"], r["owner"], r["status"], r["flags"]))
    for r in made.unknowns().collect():
        unknowns[r["root"]].append((r["id"], r["scope"], r["reason"], tuple(r["basis"])))
    for f in g["functions"]:
        walk = Walk(g, f, bound)
        assert entries[f] == list(walk.entries), f
        assert lineage[f] == list(walk.lineage), f
        assert sorted(unknowns[f]) == sorted(walk.unknown), f
    return made


def small():
    f = lambda c, v="internal", m=(): {"contract": c, "visibility": v, "modifiers": list(m)}
    return {
        "functions": {"a": f("A", "public", ["only", "late", "none"]), "b": f("A"), "c": f("B", "internal", ["only"]), "d": f("B"), "e": f("C", "external"), "x": f("D")},
        "conditions": [("k1", "modifier-gate", "a", "only"), ("k2", "modifier-gate", "a", "late"), ("k3", "modifier-gate", "c", "only"), ("k4", "visibility-gate", "a", "public"), ("k5", "modifier-gate", "b", "stray")],
        "owned": [("a", "access", "s2"), ("a", "access", "s1"), ("b", "temporal", "t"), ("d", "access", "s1"), ("e", "path", "p"), ("d", "boundary", "q")],
        "calls": [("r1", "a", "b", "internal"), ("r2", "a", "b", "external"), ("r3", "b", "d", "delegatecall"), ("r4", "d", "gone", "external"), ("r5", "d", "lost", "internal"), ("r6", "b", "gone", "delegatecall"), ("r7", "d", "a", "internal"), ("r8", "b", "c", None), ("r9", "e", "a", "internal"), ("r0", "e", "d", "x")],
        "markers": [("m1", "c", "unresolved-delegatecall"), ("m2", "b", "unresolved-lowlevel-call")],
        "bases": [("i1", "A", "B"), ("i2", "B", "gone"), ("i3", "C", "E")],
        "contracts": ["A", "B", "C", "D", "E"],
    }


@pytest.mark.parametrize("bound", [8, 1])
def test_every_operator(spark, bound):
    made = check(spark, small(), bound)
    flags = {r["flags"] for r in made.lineage().select("flags").distinct().collect()}
    assert flags >= {"bound-hit"} if bound < 8 else flags == {"", "cyclic", "shift", "unknown-order", "no-kind", "unknown-target", "unknown-base"}


def test_no_open_function_and_contexts(spark):
    g = small()
    for v in g["functions"].values():
        v["visibility"] = "internal"
    made = check(spark, g)
    contexts = spark.createDataFrame([("c1", "x"), ("c2", "b"), ("c3", "e")], "id string, entry string")
    got = {(r["root"], r["id"]) for r in made.contexts(contexts).collect()}
    assert got == {(f, i) for f in g["functions"] for i, entry in (("c1", "x"), ("c2", "b"), ("c3", "e")) if entry == f or any(e[2] == entry for e in Walk(g, f, 8).entries)}


@pytest.mark.parametrize("seed", range(2))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    names = [f"f{k}" for k in range(7)]
    g = {"functions": {n: {"contract": f"C{rng.randint(0, 3)}", "visibility": rng.choice(["internal", "private", "public"]), "modifiers": rng.choice([[], ["m"], ["m", "n"]])} for n in names}}
    g["conditions"] = [(f"k{n}{m}", "modifier-gate", n, m) for n in names for m in "mn" if rng.random() < 0.6]
    g["owned"] = [(n, rng.choice(["access", "temporal", "path"]), f"o{rng.randint(0, 5)}") for n in names for _ in range(2)]
    g["calls"] = [(f"r{k:02d}", rng.choice(names), rng.choice(names + ["gone"]), rng.choice(["internal", "internal", "external", "delegatecall", None])) for k in range(11)]
    g["markers"] = [(f"m{k}", rng.choice(names), rng.choice(["unresolved-delegatecall", "unresolved-staticcall"])) for k in range(rng.randint(0, 2))]
    g["bases"] = [(f"i{k}", f"C{rng.randint(0, 3)}", f"C{rng.randint(0, 4)}") for k in range(2)]
    g["contracts"] = ["C0", "C1", "C2", "C3"]
    check(spark, g, 3 + seed)


def test_places_in_groups_of_any_size_by_code_units(spark):
    from pyspark.sql import functions as F

    from provloom.operators.order import code_units, sorted_by_units

    texts = ["ﬁ", "\U0001f642", "a", "", "é", "￿", "z", "ab"]
    rows = [("big", t) for t in texts] + [("one", "x"), (None, "y")]
    frame = spark.createDataFrame(rows, "g string, t string").repartition(3)
    got = numbered(frame, ["g"], [code_units(F.col("t"))], "place", Scratch(spark, "test-order"), "n").collect()
    expected = sorted(texts, key=lambda s: s.encode("utf-16-be"))
    assert [r["t"] for r in sorted((r for r in got if r["g"] == "big"), key=lambda r: r["place"])] == expected != sorted(texts)
    assert [(r["g"], r["place"]) for r in got if r["g"] != "big"] in ([("one", 1), (None, 1)], [(None, 1), ("one", 1)])
    assert frame.where("g = 'big'").agg(sorted_by_units(F.collect_list("t")).alias("t")).first()["t"] == expected


def test_one_part_alone_is_as_within_the_whole(spark):
    g = small()
    whole = composed(spark, g, 1)
    functions = spark.createDataFrame([(f, v["visibility"]) for f, v in g["functions"].items()], "id string, visibility string")
    one = Compositions(functions.select("id"), functions, whole.steps, whole.own, bound=1, parts=("lineage",))
    assert {r["what"].split("-")[0] for r in one.found.select("what").distinct().collect()} == {"lineage"}
    assert sorted(map(tuple, one.lineage().collect())) == sorted(map(tuple, whole.lineage().collect()))


def chain(spark, own, parts):
    """Six functions that call one another in a row, composed for ``parts``."""
    names = [f"f{k}" for k in range(6)]
    functions = spark.createDataFrame([(n, "C", "internal", ["only"]) for n in names], "id string, contract_id string, visibility string, modifiers array<string>")
    calls = spark.createDataFrame([(f"r{k}", f"f{k}", f"f{k + 1}", None if k == 4 else "internal") for k in range(5)], "id string, source string, target string, call_kind string")
    none = "id string, subject string, value string", "id string, source string, target string", "id string"
    steps = compose.sites(functions, calls, *[spark.createDataFrame([], s) for s in none], Scratch(spark, "test-chain"))
    return Compositions(functions.select("id"), functions, steps, own(functions), parts=parts)


def test_fragments_hold_a_row_a_visit_and_no_texts(spark):
    owned = spark.createDataFrame([(f"f{k}", "access", f"s{i:02d}") for k in range(6) for i in range(40)], "function string, kind string, ref string")
    conditions = spark.createDataFrame([(f"k{k}", "modifier-gate", f"f{k}", "only") for k in range(6)], "id string, kind string, function string, descriptor string")
    made = chain(spark, lambda f: compose.own_records(f, conditions, owned, Scratch(spark, "test-chain")), ("entry", "lineage"))
    visits = 15 + 1  # f5 takes nothing in, and f4's call, which has no kind, is not gone along
    assert made.found.where("what = 'entry'").count() == visits
    assert not {"c1", "c2", "c3", "c4", "c5"} & set(made.found.columns)
    first = sorted((r["place"], r["ref"]) for r in made.entries().where("root = 'f0'").collect())
    assert [p for p, _ in first] == list(range(1, 5 * 41 + 1)) and [r for _, r in first] == [x for k in range(5) for x in [f"k{k}", *[f"s{i:02d}" for i in range(40)]]]


def test_unknowns_do_without_what_functions_have(spark):
    from pyspark.sql import functions as F

    records = "function string, what string, c1 string, c2 string, c3 string, c4 string, c5 string, k int"
    never = lambda f: spark.createDataFrame([("f0", "unknown", "", "", "", "", "", 0)], records).withColumn("k", F.raise_error(F.lit("not to be made")).cast("int"))
    made = chain(spark, never, ("unknown",))
    assert sorted((r["root"], r["scope"], r["basis"]) for r in made.unknowns().collect()) == [(f"f{k}", "composition-call-kind", ["r4"]) for k in range(5)]
