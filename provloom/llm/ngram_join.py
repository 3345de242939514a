"""Exact Jaccard join of word n-gram sets with a token-group matrix.

Documents with equal sets are one set.  The matrix has a row per token and a column per
group of sets; a set can only link into a group whose token union holds enough of its own
tokens, so groups below that bound are never opened.

1.  Column sums, every set a group: a set needs ``percent`` of its tokens in other sets.
    The others (nearly all of a clean corpus) are done, with nothing but their tokens'
    hashes shuffled.
2.  Grouping: sets that share a min-hash key meet in chunks around a pivot, are compared
    exactly, and joined into groups of linked sets.
3.  Column sums again, now with these groups: only sets with enough tokens in *other*
    groups can still have a link that joins two groups.
4.  For those, a matrix of tokens by columns (a group's sets, or lone sets of one pivot)
    tells which columns a set must ask; their blocks are opened where the set's overlap
    with the block's stored token union reaches the bound, and compared exactly.

No link between two groups is lost: its sets share enough tokens across groups (3), hence
one of their first tokens in a fixed order (4), hence meet in a block.  That order puts
rare tokens first, and sets meet columns rather than sets, so rows grow with tokens and
columns, not with pairs of a group.  Tokens travel packed in binary rows; tokens that a block of documents holds in two groups are known to
be shared and travel once for the count, so a passage in a third of all documents does
not gather in one task.

Defined cases: null and empty texts have no tokens and link with nothing; texts with
fewer words than a shingle are one token; repeated doc_ids are one document's rows; a null
doc_id keeps a null component unless a copy of its text has an id; an empty table gives no
rows; other columns of the input are neither read nor returned.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provloom.llm.blocks import U64, coded_words, mix, offsets, pack_arrays, ragged, release_memory, segment_sums, text_blocks, texts_of, unpack_arrays, window_hashes, word_hashes
from provloom.llm.components import connected_components
from provloom.storage import Scratch

HEAD = struct.Struct("<QQ?")
CHUNK = 128  # sets compared around one copy of a pivot
BLOCK = 1024  # sets of a kin that are opened together, and queries that meet them in one task
BLOCK_TOKENS = 1 << 20  # tokens in either
PART_BYTES = 64 << 20  # tokens that one task counts
SKETCH_SHIFT = U64(44)
SKETCH = 1 << 20
RARE = 32


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct token hashes of each text, one text after another, and their numbers."""
    words, codes, sizes = coded_words(pc.ascii_lower(texts))
    hashes = word_hashes(words)[codes] if words else np.zeros(0, U64)
    first, windows = offsets(sizes), window_hashes(hashes, width)
    parts = []
    for i, size in enumerate(sizes.tolist()):
        at = first[i]
        if size >= width:
            parts.append(np.unique(windows[at : at + size - width + 1]))
        elif size:
            parts.append(mix(window_hashes(hashes[at : at + size], size) + U64(size)))
        else:
            parts.append(np.zeros(0, U64))
    return np.concatenate(parts) if parts else np.zeros(0, U64), np.fromiter(map(len, parts), np.int64, len(parts))


def set_names(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64 bits that name a set, whatever documents hold it."""
    return mix(segment_sums(mix(tokens ^ U64(0x5851F42D4C957F2D)), sizes) ^ mix(sizes.astype(U64)))


def need(n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap that a set of n tokens needs with any partner."""
    return (percent * n + 99) // 100


def linked(x: np.ndarray, n_x: int, y: np.ndarray, n_y: int, percent: int) -> bool:
    if 100 * min(n_x, n_y) < percent * max(n_x, n_y):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (n_x + n_y - common)


def _names(df: DataFrame, width: int) -> DataFrame:
    """The columns but text (all long), and size and name of each text's set."""

    def run(batches):
        for batch in text_blocks(batches):
            tokens, sizes = shingle_sets(texts_of(batch), width)
            kept = batch.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sizes), pa.array(set_names(tokens, sizes).view(np.int64))], names=[*kept.schema.names, "n_shingles", "name"])

    rest = ", ".join(f"{c} long" for c in df.columns if c != "text")
    return df.mapInArrow(run, f"{rest}, n_shingles long, name long")


# Packed rows: sets (name, group, size) with some of their tokens.


def pack(names: np.ndarray, groups: np.ndarray, n: np.ndarray, counts: np.ndarray, tokens: np.ndarray) -> bytes:
    same = bool((names == groups).all())
    return b"".join([HEAD.pack(len(names), len(tokens), same), names.tobytes(), b"" if same else groups.tobytes(), n.astype("<u4").tobytes(), counts.astype("<u4").tobytes(), tokens.tobytes()])


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    k, m, same = HEAD.unpack_from(raw)
    at, out = HEAD.size, []
    for kind, many in (("<u8", k), ("<u8", 0 if same else k), ("<u4", k), ("<u4", k), ("<u8", m)):
        out.append(np.frombuffer(raw, kind, many, at))
        at += out[-1].nbytes
    return out[0], out[0] if same else out[1], out[2].astype(np.int64), out[3].astype(np.int64), out[4]


def _gather(batches) -> tuple[np.ndarray, ...]:
    """All packed rows of a partition: name, group and n of each set, its count, and tokens."""
    parts = [unpack(raw) for batch in batches for raw in batch.column("packed").to_pylist()]
    if not parts:
        return np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    return tuple(np.concatenate(p) for p in zip(*parts))


def _place(tokens: np.ndarray, parts: int) -> np.ndarray:
    return ((tokens >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)


def _shared(order: np.ndarray, tokens: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Whether each token, in ``order``, is held by two groups at least."""
    t, g = tokens[order], groups[order]
    starts = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
    mixed = np.minimum.reduceat(g, starts) != np.maximum.reduceat(g, starts)
    return np.repeat(mixed, np.diff(np.append(starts, len(t))))


def _emit(target: np.ndarray, owner: np.ndarray, tokens: np.ndarray, names: np.ndarray, groups: np.ndarray, n: np.ndarray, kind: int):
    """Packed rows of the (owner, token) pairs, one per target partition."""
    order = np.lexsort((owner, target))
    target, owner, tokens = target[order], owner[order], tokens[order]
    cuts = np.flatnonzero(np.append(True, target[1:] != target[:-1]))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(target)]):
        own, counts = np.unique(owner[a:b], return_counts=True)
        yield int(target[a]), kind, pack(names[own], groups[own], n[own], counts, tokens[a:b])


def _rows(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["part", "kind", "packed"])


PACKED = "part int, kind int, packed binary"
#: Names of the probes that stand for a token known to be in two groups.
TWICE = (U64(0), U64(1))


def _scatter(names, groups, n, sizes, tokens, parts: int):
    """Rows that carry a block's tokens to the partitions that count them."""
    names, first = np.unique(names, return_index=True)  # copies within the block count once
    tokens = tokens[ragged(offsets(sizes)[:-1][first], sizes[first])]
    groups, n, sizes = groups[first], n[first], sizes[first]
    if not len(tokens):
        return
    owner = np.repeat(np.arange(len(names)), sizes)
    order = np.argsort(tokens, kind="stable")
    shared = np.zeros(len(tokens), bool)
    shared[order] = _shared(order, tokens, groups[owner])
    known = np.unique(tokens[shared])
    if len(known):
        two = np.array(TWICE, U64)
        probes = np.repeat(np.arange(2), len(known))
        yield from _emit(_place(np.tile(known, 2), parts), probes, np.tile(known, 2), two, two, np.zeros(2, np.int64), 0)
        at = np.flatnonzero(shared)
        yield from _emit((names[owner[at]] % U64(parts)).astype(np.int64), owner[at], tokens[at], names, groups, n, 1)
    at = np.flatnonzero(~shared)
    if len(at):
        yield from _emit(_place(tokens[at], parts), owner[at], tokens[at], names, groups, n, 0)


def _column_sums(parts: int):
    """Keeps the tokens that two groups hold and sends them back to their sets."""

    def run(batches):
        kinds: dict[int, list] = {0: [], 1: []}
        for batch in batches:
            for kind, raw in zip(batch.column("kind").to_pylist(), batch.column("packed").to_pylist()):
                if kind:  # known already: on to its set
                    yield _rows([(int(unpack(raw)[0][0] % U64(parts)), 1, raw)])
                else:
                    kinds[0].append(unpack(raw))
        if not kinds[0]:
            return
        names, groups, n, counts, tokens = (np.concatenate(p) for p in zip(*kinds[0]))
        owner = np.repeat(np.arange(len(names)), counts)
        order = np.argsort(tokens, kind="stable")
        at = order[_shared(order, tokens, groups[owner])]
        at = at[names[owner[at]] > TWICE[1]]
        out = list(_emit((names[owner[at]] % U64(parts)).astype(np.int64), owner[at], tokens[at], names, groups, n, 1)) if len(at) else []
        del names, groups, n, counts, tokens, owner, order, at
        kinds.clear()
        release_memory()
        for k in range(0, len(out), 16):
            yield _rows(out[k : k + 16])

    return run


SETS = "name long, grp long, n long, tokens binary"


def _sets(names, groups, n, tokens: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(groups.view(np.int64)), pa.array(n), pa.array(tokens, pa.binary())], names=["name", "grp", "n", "tokens"])


def _enough(percent: int):
    """Sets whose shared tokens reach their bound, with those tokens."""

    def run(batches):
        names, groups, n, counts, tokens = _gather(batches)
        if not len(tokens):
            return
        owner = np.repeat(np.arange(len(names)), counts)
        order = np.lexsort((tokens, names[owner]))
        name, tokens, owner = names[owner][order], tokens[order], owner[order]
        fresh = np.append(True, (name[1:] != name[:-1]) | (tokens[1:] != tokens[:-1]))
        name, tokens, owner = name[fresh], tokens[fresh], owner[fresh]
        cuts = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
        ends = np.append(cuts[1:], len(name))
        size = n[owner[cuts]]
        good = np.flatnonzero(ends - cuts >= need(size, percent))
        for k in range(0, len(good), 1000):
            g = good[k : k + 1000]
            yield _sets(name[cuts[g]], groups[owner[cuts[g]]], size[g], [tokens[a:b].tobytes() for a, b in zip(cuts[g].tolist(), ends[g].tolist())])
        del names, groups, n, counts, tokens, owner, order, name, fresh
        release_memory()

    return run


def _shared_sets(packed: DataFrame, parts: int, percent: int) -> DataFrame:
    """Sets of which enough tokens are held by groups other than their own."""
    counted = packed.repartitionById(parts, "part").mapInArrow(_column_sums(parts), PACKED)
    return counted.repartitionById(parts, "part").mapInArrow(_enough(percent), SETS)


def _scatter_texts(width: int, parts: int):
    def run(batches):
        for batch in text_blocks(batches):
            tokens, sizes = shingle_sets(texts_of(batch), width)
            names = set_names(tokens, sizes)
            rows = list(_scatter(names, names, sizes, sizes, tokens, parts))
            for k in range(0, len(rows), 16):
                yield _rows(rows[k : k + 16])

    return run


def _arrays(batch: pa.RecordBatch):
    tokens = [np.frombuffer(b, "<u8") for b in batch.column("tokens").to_pylist()]
    return [batch.column(c).to_numpy() for c in ("name", "grp", "n")], tokens


def _scatter_sets(parts: int):
    def run(batches):
        for batch in text_blocks(batches, column="tokens"):
            (names, groups, n), tokens = _arrays(batch)
            if tokens:
                rows = list(_scatter(names.view(U64), groups.view(U64), n, np.fromiter(map(len, tokens), np.int64, len(tokens)), np.concatenate(tokens), parts))
                for k in range(0, len(rows), 16):
                    yield _rows(rows[k : k + 16])

    return run


def _min_hashes(keys: int):
    """name, share of tokens that other sets hold, and ``keys`` min-hash keys of every set."""

    def run(batches):
        for batch in text_blocks(batches, column="tokens"):
            (names, _, n), tokens = _arrays(batch)
            if not tokens:
                continue
            sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
            flat, starts = np.concatenate(tokens), np.cumsum(sizes) - sizes
            found = np.zeros((len(names), keys), U64)
            for k in range(keys):
                found[:, k] = mix(np.minimum.reduceat(mix(flat ^ mix(np.array([k + 1], U64))), starts) + U64(k))
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(sizes / n), pa.array(found.view(np.int64).tolist(), pa.list_(pa.int64()))], names=["name", "share", "keys"])

    return run


def _chunks(batches, by: list[str]):
    """Rows of one key after another, from batches sorted by the key; yields (key, row)."""
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in by]
        rest = [batch.column(c).to_pylist() for c in ("role", "name", "n", "tokens")]
        for row in zip(zip(*cols), *rest):
            yield row


def _around_pivots(percent: int):
    """Links each set of a chunk to the first leader it fits; a set that fits none leads."""

    def run(batches):
        key, leaders, links = None, [], []
        for k, _, name, n, raw in _chunks(batches, ["pivot", "salt"]):
            tokens = np.frombuffer(raw, "<u8")
            if k != key:
                key, leaders = k, [(name, n, tokens)]
                continue
            for other, m, held in leaders:
                if linked(tokens, n, held, m, percent):
                    links.append((name, other))
                    break
            else:
                leaders.append((name, n, tokens))
            if len(links) >= 10_000:
                yield _links(links)
                links = []
        if links:
            yield _links(links)

    return run


def _links(links: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])


def _group_links(sets: DataFrame, scratch: Scratch, percent: int, keys: int) -> tuple[DataFrame, DataFrame]:
    """Exact links of sets that share a min-hash key, around pivots; and each set's best pivot."""
    hashed = scratch.keep(sets.mapInArrow(_min_hashes(keys), "name long, share double, keys array<long>").select("name", "share", F.explode("keys").alias("key")), "keys")
    many = hashed.count()
    # The pivot is the set with the fewest tokens of its own: what the others are copies of.
    pivots = hashed.groupBy("key").agg(F.max(F.struct("share", "name")).alias("best"), F.count("*").alias("many")).where("many > 1")
    pivots = scratch.keep(pivots.select("key", F.col("best.share").alias("pivot_share"), F.col("best.name").alias("pivot")), "pivots", rows=many)
    met = hashed.join(pivots, "key")
    homes = scratch.keep(met.groupBy("name").agg(F.max(F.struct("pivot_share", "pivot")).alias("best")).select("name", F.col("best.pivot").alias("home")), "homes", rows=many)
    pairs = scratch.keep(met.where("name <> pivot").groupBy("pivot", "name").agg(F.lit(1).alias("one")).select("pivot", "name"), "pairs", rows=many)
    salts = scratch.keep(pairs.groupBy("pivot").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("salts")), "salts", rows=many)
    members = pairs.join(salts, "pivot").select("pivot", "name", F.pmod(F.xxhash64("name"), "salts").cast("int").alias("salt"), F.lit(1).alias("role"))
    leads = salts.select("pivot", F.col("pivot").alias("name"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"))
    wanted = scratch.keep(members.unionByName(leads), "wanted", rows=many)
    rows = wanted.join(sets.select("name", "n", "tokens"), "name").select("pivot", "salt", "role", "name", "n", "tokens")
    links = scratch.keep(rows.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "role", "name").mapInArrow(_around_pivots(percent), "a long, b long"), "group-links")
    scratch.drop("keys", "pivots", "pairs", "salts", "wanted")
    return links, homes


def _sketch_sums(batches):
    """How many sets hold a token of each of ``SKETCH`` buckets."""
    sums = np.zeros(SKETCH, np.int64)
    for batch in batches:
        for raw in batch.column("tokens").to_pylist():
            sums += np.bincount(np.frombuffer(raw, "<u8") >> SKETCH_SHIFT, minlength=SKETCH)
    at = np.flatnonzero(sums)
    for k in range(0, len(at), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(at[k : k + 50_000]), pa.array(sums[at[k : k + 50_000]])], names=["bucket", "n"])


def _levels(sets: DataFrame) -> np.ndarray:
    """The order of tokens from rare to common: log2 of the sets that hold a token of its bucket.

    Its size is fixed (1 MB), and any one order keeps the join exact; rare tokens first
    keep common passages out of the tokens by which sets meet.
    """
    sums = sets.select("tokens").mapInArrow(_sketch_sums, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    levels = np.zeros(SKETCH, np.uint8)
    for row in sums.where(f"n >= {RARE}").select("bucket", F.log2("n").cast("int").alias("level")).toLocalIterator():
        levels[row["bucket"]] = row["level"]
    return levels


def _first_tokens(percent: int, shared):
    """The tokens of which any partner in another group must share one: first by rarity, then hash."""

    def run(batches):
        for batch in text_blocks(batches, column="tokens"):
            (names, _, n), tokens = _arrays(batch)
            if not tokens:
                continue
            sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
            flat, owner = np.concatenate(tokens), np.repeat(np.arange(len(tokens)), sizes)
            flat = flat[np.lexsort((flat, shared.value[flat >> SKETCH_SHIFT], owner))]
            first = np.maximum(0, sizes - need(n, percent) + 1)
            flat = flat[ragged(offsets(sizes)[:-1], first)]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, first)), pa.array(flat.view(np.int64))], names=["name", "token"])

    return run


def _pack_blocks(batches):
    """One row of the matrix per block: its token union, the sets that hold each, and the sets."""
    key, rows = None, []

    def packed():
        tokens = [np.frombuffer(raw, "<u8") for _, _, _, raw in rows]
        flat, owner = np.concatenate(tokens), np.repeat(np.arange(len(rows)), [len(t) for t in tokens])
        order = np.argsort(flat, kind="stable")
        union, first = np.unique(flat[order], return_index=True)
        ends = np.append(first[1:], len(flat))
        names, groups, n = (np.array([r[k] for r in rows], np.int64) for k in (1, 0, 2))
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([pack_arrays(union, ends.astype("<u4"), owner[order].astype("<u4"), names, groups, n)], pa.binary())], names=["block", "matrix"])

    for batch in batches:
        for block, *row in zip(*(batch.column(c).to_pylist() for c in ("block", "grp", "name", "n", "tokens"))):
            if block != key and rows:
                yield packed()
                rows = []
            key = block
            rows.append(row)
    if rows:
        yield packed()


def _open_blocks(percent: int):
    """Queries against a block: bound by its token union, then its sets' exact overlaps."""

    def run(batches):
        links: list = []
        union = ends = holders = names = groups = sizes = None
        for batch in batches:
            for role, grp, name, n, raw in zip(*(batch.column(c).to_pylist() for c in ("role", "grp", "name", "n", "tokens"))):
                if role == 0:
                    union, ends, holders, names, groups, sizes = unpack_arrays(raw)
                    ends = ends.astype(np.int64)
                    continue
                tokens = np.frombuffer(raw, "<u8")
                at = np.minimum(np.searchsorted(union, tokens), len(union) - 1)
                at = at[union[at] == tokens]
                if len(at) < need(n, percent):
                    continue
                starts = np.where(at > 0, ends[at - 1], 0)
                common = np.bincount(holders[ragged(starts, ends[at] - starts)], minlength=len(names))
                near = np.flatnonzero((100 * common >= percent * (n + sizes - common)) & (groups != grp))
                near = near[np.unique(groups[near], return_index=True)[1]]  # a link to one set of a group is enough
                links += [(name, other) for other in names[near].tolist()]
            if len(links) > 10_000:
                yield _links(links)
                links = []
        if links:
            yield _links(links)

    return run


def _cross_links(rest: DataFrame, homes: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Exact links between sets of different groups, one per query and group of a block at least.

    A column of the matrix is a kin: the sets of one group, or lone sets that share a pivot.
    Sets meet columns, never each other, through the tokens that come first; of two kins the
    smaller asks the larger, and a kin of several groups asks itself.  A column that is asked
    is opened in blocks of bounded size, each stored once with its token union.
    """
    spark = rest.sparkSession
    levels = spark.sparkContext.broadcast(_levels(rest))
    total = rest.count()
    groups = scratch.keep(rest.groupBy("grp").agg(F.count("*").alias("members")), "rest-groups", rows=total)
    placed = rest.select("name", "grp", "n", (F.length("tokens") / 8).cast("long").alias("held")).join(groups, "grp").join(homes, "name", "left")
    kin = F.when(F.col("members") == 1, F.xxhash64(F.coalesce("home", "name"), F.lit(1))).otherwise(F.xxhash64("grp", F.lit(2)))
    placed = scratch.keep(placed.select("name", "grp", "n", "held", kin.alias("kin")), "rest-placed", rows=total)
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("held") / BLOCK_TOKENS))
    kins = scratch.keep(placed.groupBy("kin").agg(F.count("*").alias("sets"), (F.min("grp") < F.max("grp")).alias("mixed"), blocks.alias("blocks")), "rest-kins", rows=total)
    named = scratch.keep(placed.join(kins, "kin").withColumn("at", F.pmod(F.xxhash64("name"), "blocks")), "rest-named", rows=total)
    asking = rest.mapInArrow(_first_tokens(percent, levels), "name long, token long").join(named.select("name", "n", "kin", "sets", "mixed"), "name")
    asking = scratch.keep(asking, "rest-first")
    columns = asking.groupBy("token", F.col("kin").alias("asked")).agg(F.first("sets").alias("asked_sets"), F.min("n").alias("least"), F.max("n").alias("most"))
    columns = scratch.keep(columns, "rest-columns")
    turn = "(struct(sets, kin) < struct(asked_sets, asked) or (mixed and kin = asked))"
    met = asking.join(columns, "token").where(f"{turn} and 100 * most >= {percent} * n and 100 * n >= {percent} * least")
    queries = scratch.keep(met.groupBy("name", "asked").agg(F.lit(1).alias("one")).select("name", F.col("asked").alias("kin")), "rest-queries")
    own = named.select("name", "at", "held", F.col("kin").alias("own"))
    opened = queries.join(kins.select("kin", "blocks"), "kin").join(own, "name")
    opened = opened.withColumn("at", F.explode(F.sequence(F.when(F.col("kin") == F.col("own"), F.col("at")).otherwise(F.lit(0)), F.col("blocks") - 1)))
    opened = scratch.keep(opened.select("name", "held", F.xxhash64("kin", "at").alias("block")), "rest-opened")
    salts = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("held") / BLOCK_TOKENS)).cast("int")
    salts = scratch.keep(opened.groupBy("block").agg(salts.alias("salts")), "rest-salts")
    members = named.select("name", F.xxhash64("kin", "at").alias("block")).join(salts.select("block"), "block").join(rest, "name")
    matrix = members.select("block", "grp", "name", "n", "tokens").repartition("block").sortWithinPartitions("block", "name").mapInArrow(_pack_blocks, "block long, matrix binary")
    matrix = scratch.keep(matrix, "rest-matrix")
    asked = opened.join(salts, "block").select("block", F.pmod(F.xxhash64("name"), "salts").cast("int").alias("salt"), "name").join(rest, "name")
    asked = asked.select("block", "salt", F.lit(1).alias("role"), "grp", "name", "n", "tokens")
    held = matrix.join(salts, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.lit(0).cast("long").alias("grp"), F.lit(0).cast("long").alias("name"), F.lit(0).cast("long").alias("n"), F.col("matrix").alias("tokens"))
    rows = asked.unionByName(held).repartition("block", "salt").sortWithinPartitions("block", "salt", "role", "name")
    links = scratch.keep(rows.mapInArrow(_open_blocks(percent), "a long, b long"), "cross-links")
    scratch.drop(*(f"rest-{x}" for x in ("groups", "placed", "kins", "named", "first", "columns", "queries", "opened", "salts", "matrix")))
    return links


def _linked_sets(named: DataFrame, texts: DataFrame, scratch: Scratch, width: int, percent: int, keys: int) -> DataFrame:
    """(name, root) of every set that links to another; root names its component."""
    total = named.agg(F.sum("n_shingles")).first()[0] or 0
    parts = max(int(named.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(8 * total / PART_BYTES))
    packed = texts.select("text").mapInArrow(_scatter_texts(width, parts), PACKED)
    sets = scratch.keep(_shared_sets(packed, parts, percent), "sets")
    near, homes = _group_links(sets, scratch, percent, keys)
    groups = connected_components(near, scratch)
    grouped = sets.join(groups.withColumnRenamed("node", "name"), "name", "left").select("name", F.coalesce("component", "grp").alias("grp"), "n", "tokens")
    grouped = scratch.keep(grouped, "grouped")
    rest = scratch.keep(_shared_sets(grouped.mapInArrow(_scatter_sets(parts), PACKED), parts, percent), "rest")
    across = _cross_links(rest, homes, scratch, percent)
    links = scratch.keep(near.unionByName(across), "links")
    roots = scratch.keep(connected_components(links, scratch).select(F.col("node").alias("name"), F.col("component").alias("root")), "roots")
    scratch.drop("sets", "homes", "grouped", "rest", "group-links", "cross-links", "links")
    return roots


def jaccard_components(docs: DataFrame, *, width: int = 5, percent: int = 75, keys: int = 6) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id that links reach) of every document."""
    scratch = Scratch(docs.sparkSession, "ngram-join")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = scratch.keep(_names(texts, width), "names")
    roots = _linked_sets(named, texts, scratch, width, percent, keys)
    # From sets back to documents: only sets with copies or links need a look-up.
    firsts = scratch.keep(named.where("n_shingles > 0").groupBy("name").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "firsts")
    joined = scratch.keep(firsts.join(roots, "name", "left").where("copies > 1 or root is not null").select("name", "first", F.coalesce("root", "name").alias("root")), "joined")
    least = scratch.keep(joined.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    found = scratch.keep(joined.join(least, "root").select("name", "component_id"), "found")
    scratch.drop("roots", "firsts", "joined", "least")
    keyed = named.withColumn("name", F.when(F.col("n_shingles") > 0, F.col("name")))
    return keyed.join(found, "name", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_firsts(docs: DataFrame, *, width: int = 5, percent: int = 75, keys: int = 6) -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each group of linked texts.

    The row with the least doc_id stays (null ids last, then by a hash of the row); of rows
    equal in every column one stays.  Rows are told apart by all their columns, never by
    doc_id alone, so another text under a copy's doc_id is kept.  Texts without words link
    with nothing and stay.
    """
    scratch = Scratch(docs.sparkSession, "first-copies")
    h1, h2, keep, many = (_fresh(docs, x) for x in ("row_1", "row_2", "keep", "many"))
    comparable = [F.to_json(F.struct(c)) if "map<" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes]
    keyed = docs.withColumns({h1: F.xxhash64(*comparable), h2: F.xxhash64(F.lit(1), *comparable)})
    texts = keyed.select(F.col(h1).alias("h1"), F.col(h2).alias("h2"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = scratch.keep(_names(texts, width), "names")
    roots = _linked_sets(named, texts, scratch, width, percent, keys)
    rows = named.where("n_shingles > 0").groupBy("name", "h1", "h2", "doc_id").agg(F.count("*").alias("many"))
    rows = scratch.keep(rows.join(roots, "name", "left").select("h1", "h2", "doc_id", "many", F.coalesce("root", "name").alias("root")), "rows")
    # The least row of each group, and how often it stands in the table.
    firsts = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2")).alias("first"), F.sum("many").alias("all")).where(F.col("all") > 1)
    firsts = scratch.keep(firsts.select("root", F.col("first.h1").alias("f1"), F.col("first.h2").alias("f2")), "firsts")
    marks = rows.join(firsts, "root").select(F.col("h1").alias(h1), F.col("h2").alias(h2), ((F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2"))).alias(keep), F.col("many").alias(many))
    marks = scratch.keep(marks, "marks")
    scratch.drop("names", "roots", "rows", "firsts")
    left = keyed.join(marks, [h1, h2], "left").where(F.coalesce(F.col(keep), F.lit(True)))
    once = left.where(F.coalesce(F.col(many), F.lit(1)) == 1).select(*(F.col(f"`{c}`") for c in docs.columns))
    repeated = left.where(F.col(many) > 1).dropDuplicates([h1, h2]).select(*(F.col(f"`{c}`") for c in docs.columns))
    return once.union(repeated)


def _fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
