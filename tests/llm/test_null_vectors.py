"""Vectors without a vec_id, with a shared one, or of extreme size; and the links found at default settings."""

import numpy as np

from provloom.llm.embeddings import near_vectors


def test_vectors_without_an_id_count_and_link(spark):
    rows = [(9, 1, [1.0, 0.0, 0.0]), (None, 1, [1.0, 0.2, 0.0]), (4, 1, [1.0, 0.5, 0.0]), (7, 1, [0.0, 0.0, 1.0]), (None, 2, [1.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = sorted((tuple(r) for r in near_vectors(frame, bits=2, tables=24).select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)
    # The one without an id is near both 9 and 4, which are not near each other.
    assert got == sorted([(9, 1, 4, False), (None, 2, None, False), (4, 1, 4, True), (7, 0, 7, True), (None, 0, None, False)], key=repr)


def test_rows_of_one_vec_id_are_vectors_of_their_own(spark):
    rows = [(5, 0, [1.0, 0.0, 0.0]), (5, 0, [0.0, 1.0, 0.0]), (6, 0, [1.0, 0.05, 0.0])]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).select("vec_id", "n_links").collect()
    assert sorted(map(tuple, got)) == [(5, 0), (5, 1), (6, 1)]


def test_very_large_and_very_small_components(spark):
    rows = [(1, 0, [1e-200, 1e-201]), (2, 0, [1e200, 1e199]), (3, 0, [1.7e308, -1.7e308]), (4, 0, [5e-324, -5e-324])]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).select("vec_id", "n_links", "component_id").collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1), (2, 1, 1), (3, 1, 3), (4, 1, 3)]


def test_links_found_at_default_settings(spark):
    """Pairs planted at cosines of 0.93 to 0.95, against all pairs compared one by one."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((3000, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal((500, 32))
    side -= (side * base[:500]).sum(1, keepdims=True) * base[:500]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.9301, 0.95, (500, 1))
    vectors = np.concatenate([base, cosine * base[:500] + np.sqrt(1 - cosine**2) * side])
    links = np.triu(vectors @ vectors.T >= 0.93, 1).sum()
    frame = spark.createDataFrame([(k, 1, v) for k, v in enumerate(vectors.tolist())], "vec_id long, label int, embedding array<double>")
    found = sum(r["n_links"] for r in near_vectors(frame).select("n_links").collect())
    assert links >= 500 and 2 * links * 0.985 <= found <= 2 * links
