"""Near-duplicate vectors: random-hyperplane signs in several tables, then exact cosines.

Equal vectors of one label are first made one class with a count, so that copies need no
comparing.  Each class gets ``tables`` bucket numbers of ``bits`` hyperplane signs; classes
that share a label and a bucket are compared exactly, in double precision.  Two classes
are counted in the first table alone where they meet.  A bucket of more than ``block``
classes is dealt to pairs of blocks, each small enough for one task.  Components follow
from a spanning set of the links found.

``bits`` follows from the classes of the largest label, so that about ``bucket`` of them
share a bucket by chance; ``tables`` from ``bits``, so that a pair at cosine ``least``
meets in one table with probability ``recall``, closer ones more surely.

Defined cases: vectors that are null, zero, or hold null or non-finite components link
with nothing, as do rows without a label; only vectors of one length are compared; each
of several rows with one vec_id is a vector of its own; components of any finite size
are scaled before they are multiplied; a null vec_id is a row with null
component_id that links and is counted like any other; an empty table gives no rows; other
columns of the input are neither read nor returned.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provloom.llm.components import connected_components
from provloom.storage import Scratch

SEED = 20
MIN_BITS, MAX_BITS = 6, 31


def hyperplanes(dim: int, tables: int, bits: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((tables * bits, dim))


def bucket_numbers(vectors: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """One number per vector and table."""
    planes, powers = hyperplanes(vectors.shape[1], tables, bits).T, 1 << np.arange(bits)
    parts = [((vectors[a : a + 1024] @ planes > 0).reshape(-1, tables, bits) @ powers).astype(np.int32) for a in range(0, len(vectors), 1024)]
    return np.concatenate(parts) if parts else np.zeros((0, tables), np.int32)


def settings(largest: int, least: float, recall: float, bucket: int) -> tuple[int, int]:
    """(tables, bits) for a largest label of so many classes."""
    bits = min(MAX_BITS, max(MIN_BITS, math.ceil(math.log2(max(1, largest) / bucket))))
    together = (1 - math.acos(least) / math.pi) ** bits
    return math.ceil(math.log(1 - recall) / math.log(1 - together)), bits


def _with_buckets(tables: int, bits: int):
    def run(batches):
        for batch in batches:
            vectors = np.array(batch.column("vector").to_pylist(), object)
            dims = np.array([len(v) for v in vectors])
            out: list = [None] * len(vectors)
            for dim in set(dims.tolist()):
                at = np.flatnonzero(dims == dim)
                found = bucket_numbers(_units([vectors[i] for i in at]), tables, bits)
                for i, row in zip(at, found.tolist()):
                    out[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], names=[*batch.schema.names, "buckets"])

    return run


def _find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


class _Rows:
    """Rows of whole keys, as arrays; ``pairs`` compares those that share a key."""

    def __init__(self, batch: pa.RecordBatch):
        def flat(name: str) -> np.ndarray:
            column = batch.column(name)
            values = column.flatten().to_numpy(zero_copy_only=False)
            return np.split(values, np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))[:-1])

        self.plain = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "table", "paired", "rep", "copies", "side")}
        self.vector, self.buckets = flat("vector"), flat("buckets")

    def pairs(self, least: float):
        """(x, y) of rows whose cosine reaches ``least``, each counted in its first table."""
        p, key = self.plain, self.plain["key"]
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        sizes = np.diff(cuts)
        small: list[np.ndarray] = []
        for start, size in zip(np.array(cuts[:-1])[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
            if size <= SMALL:
                i, j = PAIRS[size]
                small.append(np.stack([i + start, j + start]))
                continue
            unit = _units(self.vector[start : start + size])
            for a in range(0, size, 256):
                x, y = np.nonzero(unit[a : a + 256] @ unit.T >= least)
                x += a
                yield self._counted(x[x < y] + start, y[x < y] + start)
        for k in range(0, len(small), 4096):
            x, y = np.concatenate(small[k : k + 4096], 1)
            rows, at = np.unique(np.concatenate([x, y]), return_inverse=True)
            by_dim: dict[int, list[int]] = {}
            for n, r in enumerate(rows.tolist()):
                by_dim.setdefault(len(self.vector[r]), []).append(n)
            near = np.zeros(len(x), bool)
            for members in by_dim.values():  # a key's vectors have one length
                place = np.full(len(rows), -1)
                place[members] = np.arange(len(members))
                unit = _units([self.vector[rows[m]] for m in members])
                mine = np.flatnonzero(place[at[: len(x)]] >= 0)
                for c in range(0, len(mine), 100_000):
                    m = mine[c : c + 100_000]
                    near[m] = np.einsum("ij,ij->i", unit[place[at[m]]], unit[place[at[len(x) + m]]]) >= least
            yield self._counted(x[near], y[near])

    def _counted(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = self.plain
        # Of a pair of blocks only pairs across; those inside a block have a key of their own.
        keep = ~p["paired"][x] | (p["side"][x] != p["side"][y])
        x, y = x[keep], y[keep]
        if len(x):
            same = np.array([self.buckets[i] for i in x]) == np.array([self.buckets[j] for j in y])
            first = same.argmax(1) == p["table"][x]
            x, y = x[first], y[first]
        return x, y


SMALL = 32
PAIRS = {n: np.triu_indices(n, 1) for n in range(2, SMALL + 1)}


def _units(vectors: list) -> np.ndarray:
    v = np.array(vectors, np.float64)
    v /= np.abs(v).max(1, keepdims=True)  # squares of very large or small components stay finite
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _compare(least: float):
    """Streams rows sorted by key; a key's last rows wait for the batch that follows."""

    def whole_keys(batches):
        held = None
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            key = batch.column("key").to_numpy(zero_copy_only=False)
            last = len(key) - int((key[::-1] != key[-1]).argmax()) if (key != key[-1]).any() else 0
            if last:
                yield batch.slice(0, last)
            held = batch.slice(last)
        if held is not None and held.num_rows:
            yield held

    def run(batches):
        for batch in whole_keys(b for b in batches if b.num_rows):
            rows = _Rows(batch)
            rep, copies = rows.plain["rep"], rows.plain["copies"]
            met, parent, links = np.zeros(len(rep), np.int64), np.arange(len(rep)), []
            for x, y in rows.pairs(least):
                np.add.at(met, x, copies[y])
                np.add.at(met, y, copies[x])
                for i, j in zip(x.tolist(), y.tolist()):
                    p, q = _find(parent, i), _find(parent, j)
                    if p != q:
                        parent[max(p, q)] = min(p, q)
                        links.append((int(rep[i]), int(rep[j]), 0))
            found = links + [(int(rep[i]), None, int(met[i])) for i in np.flatnonzero(met)]
            if found:
                yield _rows(found)

    return run


def _rows(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["rep", "other", "met"])


def _kept_type(vectors: DataFrame):
    """float components stay float where rows are moved; cosines are taken in double."""
    return F.col("embedding").cast("array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>")


def near_vectors(vectors: DataFrame, *, least: float = 0.93, recall: float = 0.997, bucket: int = 16, tables: int | None = None, bits: int | None = None, block: int = 512) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector.

    ``tables`` and ``bits`` (31 at most), where given, take the place of those that follow
    from the data.
    """
    scratch = Scratch(vectors.sparkSession, "embeddings")
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), _kept_type(vectors).alias("vector"))
    kind = dict(own.dtypes)["vector"]
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.col("label").isNotNull() & F.coalesce(F.forall("vector", number) & F.exists("vector", lambda x: x != 0), F.lit(False))
    # 128 bits name a class: its label and components.
    own = own.withColumn("usable", usable).withColumn("c1", F.xxhash64("label", "vector")).withColumn("c2", F.xxhash64(F.lit(SEED), "vector", "label"))
    classes = own.where("usable").groupBy("c1", "c2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("vector").alias("vector"), F.first("label").alias("label"))
    # Numbered once they are written, so that classes without any vec_id are linked too.
    classes = scratch.keep(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    largest = classes.groupBy("label", F.size("vector")).count().agg(F.max("count")).first()[0] or 0
    own_tables, own_bits = settings(largest, least, recall, bucket)
    tables, bits = tables or own_tables, bits or own_bits
    bucketed = classes.select("rep", "copies", "label", "vector").mapInArrow(_with_buckets(tables, bits), f"rep long, copies long, label string, vector {kind}, buckets array<int>")
    bucketed = scratch.keep(bucketed, "bucketed")
    placed = bucketed.select("*", F.posexplode("buckets").alias("table", "bucket")).withColumn("at", F.xxhash64("label", F.size("vector"), "table", "bucket"))
    large = scratch.keep(placed.groupBy("at").count().where(F.col("count") > block), "large")
    # Large buckets: a class goes to the pairs of its own block with every block.
    blocks = placed.join(large, "at", "left").withColumn("n", F.ceil(F.coalesce("count", F.lit(1)) / block).cast("int")).withColumn("side", F.pmod(F.xxhash64("rep", F.lit(1)), "n").cast("int"))
    dealt = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("paired", F.col("side") != F.col("other"))
    dealt = dealt.withColumn("key", F.xxhash64("at", F.least("side", "other"), F.greatest("side", "other")))
    rows = dealt.select("key", "table", "paired", "rep", "copies", "vector", "buckets", "side").repartition("key").sortWithinPartitions("key")
    found = scratch.keep(rows.mapInArrow(_compare(least), "rep long, other long, met long"), "found")
    components = connected_components(found.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")), scratch)
    met = scratch.keep(found.where("other is null").groupBy("rep").agg(F.sum("met").alias("met")), "met")
    linked = classes.select("c1", "c2", "rep", "least", "copies").join(met, "rep", "left").join(components.withColumnRenamed("node", "rep"), "rep", "left")
    linked = scratch.keep(linked.select("c1", "c2", "least", (F.col("copies") - 1 + F.coalesce("met", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("root")).where("n_links > 0"), "linked")
    roots = scratch.keep(linked.groupBy("root").agg(F.min("least").alias("component_id")), "roots")
    named = scratch.keep(linked.join(roots, "root").select("c1", "c2", "n_links", "component_id"), "named")
    scratch.drop("linked", "roots")
    scratch.drop("bucketed", "large", "found", "met")
    ids = own.select("vec_id", F.when(F.col("usable"), F.col("c1")).alias("c1"), F.when(F.col("usable"), F.col("c2")).alias("c2"))
    out = ids.join(named, ["c1", "c2"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
