"""Hard negatives: integer inner products by Strassen's multiplication, then mergeable heaps.

Components become floor(256 x).  Rows are packed into blocks of consecutive rows in order
of label, and a tile is the product of a block of anchors and a block of candidates: an
int64 product by Strassen's recursion on quarters, padded with zeros to even sizes, so all
sums and differences are exact (they wrap as long as they must and come back).  Tiles of
one label give each anchor's positives, tiles of different labels its negatives, so that no
tile is multiplied twice unless a block holds several labels.

Candidates are dealt once, by block, to slices; anchors, a hundredth of the rows, go to
every slice.  A task walks one block of anchors over all candidates of its slice and keeps
for each anchor the first five positives, or for each positive the first ten within its
window: heaps of fixed size, which are merged between blocks and again between slices.

Defined cases: rows with a null vec_id, label or vector, with a vector that is empty or
holds a null or non-finite component, or one of 2**17 or more (whose products might leave a
long), take no part; only vectors of one length are multiplied; repeated rows and rows that
share a vec_id are rows of their own (an anchor's copies may be its positives), and give
the same output rows several times; ties of score go to the smaller vec_id, then to the
row that was numbered first; an anchor without another row of its label, and a positive
with no row in its window, give no rows; an empty table gives no rows; other columns are
neither read nor returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provloom.storage import Scratch, attach

SCALE, LARGEST = 256, float(1 << 17)
#: Products of this size or less are multiplied plainly.
LEAF = 16
NONE = np.iinfo(np.int64).min
BLOCK = "block long, dim int, labels array<string>, ids binary, numbers binary, codes binary, vectors binary"


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b of int64 matrices with seven products of quarters in place of eight."""
    m, k = a.shape
    n = b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    if m & 1 or k & 1 or n & 1:
        a, b = np.pad(a, ((0, m & 1), (0, k & 1))), np.pad(b, ((0, k & 1), (0, n & 1)))
        return strassen(a, b, leaf)[:m, :n]
    m, k, n = m // 2, k // 2, n // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    out = np.empty((2 * m, 2 * n), np.int64)
    p = strassen(a11 + a22, b11 + b22, leaf)
    q = strassen(a21 + a22, b11, leaf)
    r = strassen(a11, b12 - b22, leaf)
    s = strassen(a22, b21 - b11, leaf)
    t = strassen(a11 + a12, b22, leaf)
    out[:m, n:], out[m:, :n] = r + t, q + s
    out[:m, :n] = p + s - t + strassen(a12 - a22, b21 + b22, leaf)
    out[m:, n:] = p - q + r + strassen(a21 - a11, b11 + b12, leaf)
    return out


class Heaps:
    """The first ``size`` (score, id, number) of each of several owners."""

    def __init__(self, owners: int, size: int):
        self.size = size
        self.score, self.id, self.number = (np.full((owners, size), NONE, np.int64) for _ in range(3))

    def add(self, score: np.ndarray, ids: np.ndarray, numbers: np.ndarray) -> None:
        """Take in some candidates for every owner; a score of NONE is no candidate."""
        width = score.shape[1]
        if width > self.size:
            # Columns come in order of ties, so (score, column) names the first ones.
            low, high = int(np.where(score == NONE, np.iinfo(np.int64).max, score).min()), int(score.max())
            if high == NONE:
                return
            place = np.where(score == NONE, -1, (score - low) * width + (width - 1 - np.arange(width))) if high - low < (1 << 62) // width else None
            if place is None:
                at = np.lexsort((np.broadcast_to(np.arange(width), score.shape), -score), axis=1)[:, : self.size]
            else:
                at = np.argpartition(place, width - self.size, axis=1)[:, width - self.size :]
            score, ids, numbers = np.take_along_axis(score, at, 1), ids[at], numbers[at]
        else:
            ids, numbers = np.broadcast_to(ids, score.shape), np.broadcast_to(numbers, score.shape)
        score, ids, numbers = np.hstack([self.score, score]), np.hstack([self.id, ids]), np.hstack([self.number, numbers])
        at = np.lexsort((numbers, ids, ~score), axis=1)[:, : self.size]
        self.score, self.id, self.number = (np.take_along_axis(x, at, 1) for x in (score, ids, numbers))

    def rows(self) -> tuple[np.ndarray, ...]:
        """(owner, score, id, number) of all that are held."""
        owner, at = np.nonzero(self.score != NONE)
        return owner, self.score[owner, at], self.id[owner, at], self.number[owner, at]


class _Block:
    """A packed block: ids, row numbers, label codes, vectors."""

    def __init__(self, row: dict, side: str):
        self.dim, self.labels = row["dim"], np.array(row[f"{side}labels"], object)
        self.ids, self.numbers, self.codes = (np.frombuffer(row[f"{side}{c}"], t) for c, t in (("ids", "<i8"), ("numbers", "<i8"), ("codes", "<i4")))
        self.vectors = np.frombuffer(row[f"{side}vectors"], "<i4").reshape(-1, self.dim).astype(np.int64)


def _pack(rows: int):
    """Consecutive rows of one length, as blocks; within a block in order of ties."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        many = 0

        def cut(last: bool):
            nonlocal held, many
            table = pa.Table.from_batches(held).combine_chunks()
            held, many = [], 0
            dims = table.column("dim").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)]
            for a, b in zip(edges, edges[1:]):
                while b - a >= rows or (b > a and (last or b < len(dims))):
                    yield table.slice(a, min(rows, b - a))
                    a = min(a + rows, b)
            if a < b:
                held, many = table.slice(a).combine_chunks().to_batches(), b - a

        def pack(table: pa.Table) -> dict:
            ids, numbers = table.column("vec_id").to_numpy(), table.column("number").to_numpy()
            order = np.lexsort((numbers, ids))
            dim = int(table.column("dim")[0].as_py())
            coded = table.column("label").combine_chunks().dictionary_encode()
            coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
            flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            vectors = np.floor(SCALE * flat).astype("<i4").reshape(-1, dim)[order]
            codes = coded.indices.to_numpy(zero_copy_only=False).astype("<i4")[order]
            return {"block": int(numbers[0]), "dim": dim, "labels": coded.dictionary.to_pylist(), "ids": ids[order].astype("<i8").tobytes(), "numbers": numbers[order].astype("<i8").tobytes(), "codes": codes.tobytes(), "vectors": vectors.tobytes()}

        schema = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("labels", pa.list_(pa.string())), *[(c, pa.binary()) for c in ("ids", "numbers", "codes", "vectors")]])
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                many += batch.num_rows
                if many >= 2 * rows:
                    for part in cut(False):
                        yield pa.RecordBatch.from_pylist([pack(part)], schema)
        if many:
            for part in cut(True):
                yield pa.RecordBatch.from_pylist([pack(part)], schema)

    return run


def pack_blocks(rows: DataFrame, count: int, size: int) -> DataFrame:
    """``rows`` (number, vec_id, label, dim, vector) as blocks of ``size`` rows, labels together.

    Cut by label and then by row, so that a label of any share is in as many blocks as it needs.
    """
    parts = max(1, -(-count // (4 * size)))
    ordered = rows.repartitionByRange(parts, "dim", "label", "number").sortWithinPartitions("dim", "label", "number")
    return ordered.select("number", "vec_id", "label", "dim", "vector").mapInArrow(_pack(size), BLOCK)


def _by_anchor(batches, fresh, visit, report):
    """Tiles in the order they come; what is gathered for a block of anchors is reported when another comes."""
    current, block, state = None, None, None
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            if row["a_block"] != current:
                if state is not None:
                    yield report(block, state)
                current, block = row["a_block"], _Block(row, "a_")
                state = fresh(block, row)
            visit(block, _Block(row, "c_"), state)
    if state is not None:
        yield report(block, state)


def _apart(a: _Block, c: _Block) -> np.ndarray:
    """Whether anchor and candidate have different labels."""
    return (a.labels[:, None] != c.labels[None, :])[np.ix_(a.codes, c.codes)]


def _positives(keep: int):
    def visit(a: _Block, c: _Block, heaps: Heaps) -> None:
        score = strassen(a.vectors, c.vectors.T)
        score[_apart(a, c) | (a.numbers[:, None] == c.numbers[None, :])] = NONE
        heaps.add(score, c.ids, c.numbers)

    def report(a: _Block, heaps: Heaps) -> pa.RecordBatch:
        owner, score, ids, numbers = heaps.rows()
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (a.numbers[owner], a.ids[owner], score, ids, numbers)], names=["anchor", "anchor_id", "score", "id", "number"])

    def run(batches):
        yield from _by_anchor(batches, lambda a, row: Heaps(len(a.ids), keep), visit, report)

    return run


def _negatives(keep: int, low: tuple[int, int], high: tuple[int, int]):
    """The first candidates within each positive's window, by whole numbers alone."""

    def fresh(a: _Block, row: dict):
        owner, score, numbers = (np.frombuffer(row[c], "<i8") for c in ("p_owner", "p_score", "p_number"))
        at = np.searchsorted(a.numbers, owner, sorter=(by := np.argsort(a.numbers)))
        least = np.array([-(-low[0] * p // low[1]) for p in score.tolist()], np.int64)
        most = np.array([high[0] * p // high[1] for p in score.tolist()], np.int64)
        return by[at], score, numbers, least, most, Heaps(len(owner), keep)

    def visit(a: _Block, c: _Block, state) -> None:
        at, _, _, least, most, heaps = state
        score = strassen(a.vectors, c.vectors.T)
        score[~_apart(a, c)] = NONE
        for k in range(0, len(at), 512):  # a few owners at a time: memory follows a tile
            part = slice(k, k + 512)
            own = score[at[part]]
            own[(own < least[part, None]) | (own > most[part, None])] = NONE
            few = Heaps(len(own), keep)
            few.score, few.id, few.number = heaps.score[part], heaps.id[part], heaps.number[part]
            few.add(own, c.ids, c.numbers)
            heaps.score[part], heaps.id[part], heaps.number[part] = few.score, few.id, few.number

    def report(a: _Block, state) -> pa.RecordBatch:
        at, p_score, p_number, _, _, heaps = state
        owner, score, ids, numbers = heaps.rows()
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (a.numbers[at[owner]], p_number[owner], score, ids, numbers)], names=["anchor", "positive", "score", "id", "number"])

    def run(batches):
        yield from _by_anchor(batches, fresh, visit, report)

    return run


def _tiles(anchors: DataFrame, candidates: DataFrame, slices: int, same: bool) -> DataFrame:
    """Pairs of blocks, those of one block of anchors together within a slice."""
    a = anchors.select([F.col(c).alias(f"a_{c}") if c not in ("dim", "p_owner", "p_score", "p_number") else F.col(c) for c in anchors.columns])
    c = candidates.select(F.col("dim").alias("c_dim"), *[F.col(x).alias(f"c_{x}") for x in candidates.columns if x != "dim"])
    a = a.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    c = c.withColumn("slice", F.pmod(F.xxhash64("c_block"), F.lit(slices)).cast("int"))
    joined = a.hint("merge").join(c, "slice").where("dim = c_dim")
    if same:
        return joined.where(F.arrays_overlap("a_labels", "c_labels"))
    return joined.where("not (size(a_labels) = 1 and size(c_labels) = 1 and a_labels[0] = c_labels[0])")


def _first(rows: DataFrame, owner: list[str], keep: int) -> DataFrame:
    """The heaps of all slices, merged: the first ``keep`` of each owner, with their place."""
    order = Window.partitionBy(*owner).orderBy(F.desc("score"), "id", "number")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)


def mine_negatives(
    vectors: DataFrame, anchors: Column, *, positives: int = 5, negatives: int = 10, low: tuple[int, int] = (30, 100), high: tuple[int, int] = (90, 100), anchor_block: int = 512, candidate_block: int = 2048,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors``: a condition on vec_id.  A positive's window is from low to high of its score, as
    fractions, ends included.  Blocks bound a task's memory: a tile is anchor_block *
    candidate_block longs.
    """
    spark = attach(vectors.sparkSession)
    scratch = Scratch(spark, "negatives")
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce((F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST)), F.lit(False))
    own = scratch.keep(own.where(usable).withColumn("dim", F.size("vector")).withColumn("number", F.monotonically_increasing_id()), "rows")
    asked = own.where(anchors)
    many, n_asked = own.count(), asked.count()
    found_blocks = scratch.keep(pack_blocks(own, many, candidate_block), "candidates")
    asked_blocks = scratch.keep(pack_blocks(asked, n_asked, anchor_block), "anchors")
    slices = max(1, min(-(-many // candidate_block), 4 * spark.sparkContext.defaultParallelism))
    shared = _tiles(asked_blocks, found_blocks, slices, same=True)
    near = shared.mapInArrow(_positives(positives), "anchor long, anchor_id long, score long, id long, number long")
    chosen = scratch.keep(_first(near, ["anchor", "anchor_id"], positives).select("anchor", "anchor_id", F.col("number").alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    windows = _with_windows(asked_blocks, chosen)
    apart = _tiles(scratch.keep(windows, "windows"), found_blocks, slices, same=False)
    hard = apart.mapInArrow(_negatives(negatives, low, high), "anchor long, positive long, score long, id long, number long")
    ranked = _first(hard, ["anchor", "positive"], negatives)
    out = chosen.join(ranked, ["anchor", "positive"])
    return out.select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _with_windows(blocks: DataFrame, chosen: DataFrame) -> DataFrame:
    """Blocks of anchors beside their positives (a few for each anchor of the block)."""

    def numbers(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                own = np.frombuffer(batch.column("numbers")[i].as_py(), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), batch.column("block")[i].as_py())), pa.array(own)], names=["block", "anchor"])

    of_block = blocks.select("block", "numbers").mapInArrow(numbers, "block long, anchor long").join(chosen.select("anchor", "positive", "positive_score"), "anchor")

    def pack(batches):
        for batch in batches:
            rows = [np.array([[p["anchor"], p["positive_score"], p["positive"]] for p in x], "<i8") for x in batch.column("found").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("block"), *[pa.array([np.ascontiguousarray(r[:, k]).tobytes() for r in rows], pa.binary()) for k in range(3)]], names=["block", "p_owner", "p_score", "p_number"])

    packed = of_block.groupBy("block").agg(F.collect_list(F.struct("anchor", "positive_score", "positive")).alias("found")).mapInArrow(pack, "block long, p_owner binary, p_score binary, p_number binary")
    return blocks.join(packed, "block")
