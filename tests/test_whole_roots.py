"""Traces and source look-ups take every file, entity and hash as root, not those of the SQL only."""

import hashlib
from collections import defaultdict

from provloom.plans import checks, graphs


def rows_of(spark, tmp_path):
    rows = [(k, f"text {k // 3}", "en", f"src{k % 4}", 6) for k in range(65)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    return rows


def walks(edges, roots, depth):
    found = {}
    for root in roots:
        hops = {root: 0}
        for hop in range(depth):
            for node in [n for n, h in hops.items() if h == hop]:
                for other in edges[node]:
                    hops.setdefault(other, hop + 1)
        found |= {(root, node): hop for node, hop in hops.items()}
    return found


def test_every_root(spark, tmp_path):
    rows, out, back = rows_of(spark, tmp_path), defaultdict(set), defaultdict(set)
    path = {k: f"file:{source}/{lang}/{k}.txt" for k, _, lang, source, _ in rows}
    for k in path:
        steps = [(path[k], f"derivation:{k // 10}"), (f"derivation:{k // 10}", f"entity:{k}")] + [(f"entity:{k}", f"summary:{k % 13}")] * (k % 3 == 0)
        for a, b in steps:
            out[a].add(b)
            back[b].add(a)
    got = lambda make: {(r["root"], r["node"]): r["hop"] for r in make(spark, str(tmp_path)).collect()}
    assert got(graphs.forward_trace) == walks(out, path.values(), 3)
    assert got(graphs.backward_trace) == walks(back, [f"entity:{k}" for k in path], 2)
    runs = defaultdict(list)
    for k, text, *_ in rows:
        runs[hashlib.sha256(text.encode()).hexdigest()].append(f"run:{k}")
    assert {r["source_hash"]: r["runs"] for r in checks.runs_by_source_identity(spark, str(tmp_path)).collect()} == {h: ",".join(x) for h, x in runs.items()}
