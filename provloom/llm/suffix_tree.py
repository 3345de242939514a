"""Language-model scores from a probabilistic suffix tree over words.

A text is its words, lower-cased (A-Z), and one end; every word is a symbol.  The root
gives unseen words the mass of the words seen once (Good-Turing), which as many words share
as are estimated to be unseen (from those seen once and twice), and the others add-one
shares of what is left.  Contexts are the last 1 to ``depth`` symbols of
the text, its opening included.  A context is a candidate if training texts hold it
``min_count`` times, at every size of corpus, and becomes a state if its next-symbol
distribution diverges from that of the longest state that is its suffix: by ``min_gain``
nats of leave-one-out likelihood over its occurrences.  A context that is as frequent as
its suffix has the same distribution and is no state.  A state's distribution is smoothed
by that suffix state's (``weight`` occurrences of it), down to the root, and each symbol is
scored by the longest state that ends what precedes it.

The tree is never gathered: counts and states lie in partitions by hash.  Texts are kept in
packed blocks, dealt to partitions once.  Level by level a block asks for the totals of its
distinct words, then of its n-grams whose context is a candidate, and of its contexts'
gains; each ask is one sorted array per target partition, each answer an array in the same
order.  So a word, pair or passage that is in a third of all texts is asked for once a
block, tasks hold blocks and hash partitions of bounded size, and what is learned grows
with the corpus.  Words and n-grams are told apart by 64 bits of hash.

Defined cases: null and empty texts are the end alone; without training documents all
counts are 0 and every token has probability one half; null or repeated doc_ids are carried
row by row (a null is not held out and is not learned from); whole texts are read, a very
long one is a block of its own; an empty table gives no rows; other columns of the input
are neither read nor returned.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provloom.llm.blocks import U64, coded_words, crc_bucket, mix, offsets, ragged, release_memory, segment_sums, squeeze_arrays, text_blocks, texts_of, unsqueeze_arrays, window_hashes, word_hashes
from provloom.storage import Scratch, release_shuffles

OPEN, END = U64(0x4F50454E), U64(0x454E44)
BLOCK_BYTES = 8 << 20
ENTRIES_A_PART = 2_000_000
CHARS_A_PLACE = 16 << 20
GAIN_STEPS = 16  # gains are summed in whole steps, so that their sums do not depend on the order
ASKED = "block long, kind int, part int, packed binary"


@dataclass
class Root:
    """Word probabilities without context, and the base scores."""

    tokens: int = 0
    distinct: int = 0
    once: int = 0
    twice: int = 0

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + 1.0) / (self.tokens + self.distinct + 1))

    def unseen(self) -> float:
        return min(0.5, max(self.once, 1) / max(self.tokens, 2))

    def unseen_words(self) -> float:
        """How many words of the language training did not meet (Chao's estimate, one at least)."""
        return max(1.0, self.once * (self.once - 1) / (2 * (self.twice + 1)))

    def word(self, n: np.ndarray) -> np.ndarray:
        """Of a word seen n times; for n = 0, of one of the unseen words."""
        u = self.unseen()
        return np.where(n > 0, (1 - u) * (n + 1.0) / max(1, self.tokens + self.distinct), u / self.unseen_words())


@dataclass(frozen=True)
class TreeRules:
    depth: int = 4
    min_count: int = 4  # 2 at least
    min_gain: float = 8.0
    weight: float = 2.0


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and which of them each key is."""
    order = np.argsort(keys)
    ranked = keys[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(fresh) - 1
    return ranked[fresh], which


def _pack_texts(mod: int, held: int):
    """Blocks of texts: ids, whether held out and learned from, and words as codes into hashes."""

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        for batch in text_blocks(batches, BLOCK_BYTES):
            words, codes, sizes = coded_words(pc.ascii_lower(texts_of(batch)))
            ids = batch.column("doc_id")
            remainder = crc_bucket(ids, mod)
            flags = (remainder == held) + 2 * ((remainder != held) & (remainder >= 0)) + 4 * ids.is_null().to_numpy(zero_copy_only=False)
            rank = np.empty(len(words), np.int64)  # frequent words first: smaller codes
            order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
            rank[order] = np.arange(len(words))
            packed = squeeze_arrays(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), flags.astype("u1"), sizes.astype("<u4"), rank[codes].astype("<u4"), word_hashes(words)[order])
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([packed], pa.binary())], names=["block", "texts"])
            block += 1

    return run


class Block:
    """The symbols of a block's texts; ``advance`` applies answers and asks for what is next."""

    def __init__(self, raw: bytes):
        self.ids, flags, sizes, codes, hashes = unsqueeze_arrays(raw)
        self.held, self.learned, self.null = (flags & 1) > 0, (flags & 2) > 0, (flags & 4) > 0
        sizes = sizes.astype(np.int64)
        self.sizes = sizes + 2
        first = offsets(self.sizes)
        self.symbols = np.full(first[-1], len(hashes) + 1, np.int64)
        self.symbols[first[:-1]] = len(hashes)
        self.symbols[ragged(first[:-1] + 1, sizes)] = codes
        self.keys = np.append(hashes, [OPEN, END])
        self.salted = mix(self.keys)[self.symbols]
        self.since = np.arange(first[-1]) - np.repeat(first[:-1], self.sizes)
        self.taught = np.repeat(self.learned, self.sizes)

    def grams(self, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct n-grams that end at ``at``, and which of them each position has."""
        return distinct(window_hashes(self.salted, n)[at - n + 1])

    def advance(self, answers: dict[int, np.ndarray], root: Root | None, rules: TreeRules):
        """(asks by kind, p of each symbol, word counts); kinds: 2d counts of level d, 2d + 1 its states."""
        named = np.delete(np.arange(len(self.keys)), -2)  # all symbols but OPEN
        words, place = np.unique(self.keys[named], return_inverse=True)
        if 0 not in answers:
            own = np.bincount(self.symbols[self.taught], minlength=len(self.keys))
            return {0: (words, np.bincount(place, own[named], len(words)))}, None, None
        counts = np.zeros(len(self.keys))
        counts[named] = answers[0][place]
        p = root.word(counts)[self.symbols]
        counts[-2] = counts[-1]  # a text that is learned from opens and ends once
        # Counts of what ends at each position, and which context it is for the next symbol.
        before, asks = counts[self.symbols], {}
        keys, which, shorter = self.keys, self.symbols, None
        for d in range(1, rules.depth + 1):
            total = np.append(0.0, before[:-1])
            at = np.flatnonzero((self.since >= d) & (total >= rules.min_count))
            if not len(at):
                break
            # An n-gram is no more frequent than its end: where that stands once, here, it is known.
            # A context as frequent as its suffix is followed as that is, and is no state.
            taught, most = self.taught[at], before[at]
            own_way = np.ones(len(at), bool) if shorter is None else total[at] < shorter[at]
            shorter = total
            asked = np.flatnonzero(own_way & ((most > 1) | (most == 1) & ~taught))
            grams, own = self.grams(at[asked], d + 1)
            if 2 * d not in answers:
                asks[2 * d] = (grams, np.bincount(own, taught[asked], len(grams)))
                break
            n, total, lower, context = np.where(own_way, np.minimum(most, taught), most), total[at], p[at], which[at - 1]
            n[asked] = answers[2 * d][own]
            use = np.flatnonzero(taught & own_way)
            held = np.zeros(len(keys), bool)
            held[context[own_way]] = True
            held = np.flatnonzero(held)
            held = held[np.argsort(keys[held])]
            if 2 * d + 1 not in answers:
                gain = np.log((n[use] - 1 + rules.weight * lower[use]) / (total[use] - 1 + rules.weight) / lower[use])
                asks[2 * d + 1] = (keys[held], np.rint(np.bincount(context[use], gain, len(keys))[held] * GAIN_STEPS))
            else:
                is_state = np.zeros(len(keys), bool)
                is_state[held] = answers[2 * d + 1]
                state = is_state[context] & own_way
                p[at[state]] = ((n + rules.weight * lower) / (total + rules.weight))[state]
            before, which = np.zeros(len(before)), np.zeros(len(before), np.int64)
            before[at], which[at[asked]], keys = n, own, grams
        return asks, p, counts

    def scores(self, p: np.ndarray, counts: np.ndarray, root: Root) -> pa.RecordBatch:
        said = self.since > 0  # all but OPEN
        sums = lambda x: segment_sums(np.where(said, x, 0), self.sizes)
        n = counts[self.symbols]
        columns = [pa.array(self.ids, pa.int64(), mask=self.null), pa.array(self.held), pa.array(self.sizes - 1), pa.array(sums((n > 0).astype(np.int64))), pa.array(sums(root.base(n))), pa.array(sums(np.log10(p)))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])


def _place(keys: np.ndarray, parts: int) -> np.ndarray:
    """Target partition of each key; rises with the key."""
    high = keys >> U64(32)
    return (high * U64(parts) >> U64(32)).astype(np.int64)


def _rows(rows: list):
    for k in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[k : k + 64]], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["block", "kind", "part", "packed"])


def _asks(block: int, asks: dict, parts: int):
    for kind, (keys, values) in asks.items():
        part = _place(keys, parts)
        cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []
        kept = "<i4" if kind % 2 else "<u4"
        yield from _rows([(block, kind, int(part[a]), squeeze_arrays(np.diff(keys[a:b], prepend=U64(0)), values[a:b].astype(kept))) for a, b in zip(cuts, [*cuts[1:], len(keys)])])


def _totals(min_gain: float):
    """Answers every key of this partition, to each block in the order of its ask.

    Counts get their totals, contexts (odd kinds) whether they are states.  Also, as a row
    of block -1, the sum of the words' totals, and how many are over 0, exactly 1 and exactly 2.
    """

    def run(batches):
        kinds: dict[int, list] = {}
        for batch in batches:
            for block, kind, part, raw in zip(*(batch.column(c).to_pylist() for c in ("block", "kind", "part", "packed"))):
                steps, values = unsqueeze_arrays(raw)
                kinds.setdefault(kind, []).append((block, part, np.cumsum(steps, dtype=U64), values))
        for kind in sorted(kinds):
            asked = kinds.pop(kind)
            keys, which = distinct(np.concatenate([a[2] for a in asked]))
            total = np.bincount(which, np.concatenate([a[3] for a in asked]), len(keys))
            rows = [] if kind else [(-1, kind, asked[0][1], squeeze_arrays(np.array([total.sum(), (total > 0).sum(), (total == 1).sum(), (total == 2).sum()])))]
            total = (total >= min_gain * GAIN_STEPS).astype("u1") if kind % 2 else total.astype("<u8" if total.max() >= 2**32 else "<u4")
            at = 0
            for block, part, own, _ in asked:
                rows.append((block, kind, part, squeeze_arrays(total[which[at : at + len(own)]])))
                at += len(own)
            del asked, keys, which, total
            yield from _rows(rows)
        release_memory()

    return run


def _blocks_with_answers(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            answers: dict[int, list] = {}
            for a in sorted(batch.column("answers")[k].as_py() or [], key=lambda a: (a["kind"], a["part"])):
                answers.setdefault(a["kind"], []).append(unsqueeze_arrays(a["packed"])[0])
            yield batch.column("block")[k].as_py(), Block(batch.column("texts")[k].as_py()), {kind: np.concatenate(x).astype(float) for kind, x in answers.items()}
            release_memory()


def _ask_next(root: Root | None, rules: TreeRules, parts: int):
    def run(batches):
        for number, block, answers in _blocks_with_answers(batches):
            yield from _asks(number, block.advance(answers, root, rules)[0], parts)

    return run


def _score(root: Root, rules: TreeRules):
    def run(batches):
        for _, block, answers in _blocks_with_answers(batches):
            yield block.scores(*block.advance(answers, root, rules)[1:], root)

    return run


def score_texts(docs: DataFrame, *, mod: int = 7, held: int = 2, **tree) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    Learns from the rows whose crc32 of doc_id modulo ``mod`` is not ``held``; ``tree``: the
    fields of TreeRules.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix-tree")
    rules = TreeRules(**tree)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = texts.agg(F.count("*").alias("texts"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    at_least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tokens = size["texts"] + size["chars"] // 4  # nearly all words are longer
    parts, places = max(at_least, math.ceil(tokens / ENTRIES_A_PART)), max(at_least, math.ceil(size["chars"] / CHARS_A_PLACE))
    blocks = scratch.keep_bucketed(texts.mapInArrow(_pack_texts(mod, held), "block long, texts binary"), "blocks", places, "block")
    release_shuffles(spark)

    def with_answers(tables: list[DataFrame]) -> DataFrame:
        if not tables:
            return blocks.select("block", "texts", F.array().cast("array<struct<kind:int,part:int,packed:binary>>").alias("answers"))
        found = tables[0]
        for more in tables[1:]:
            found = found.unionByName(more)
        found = found.where("block >= 0").repartition(places, "block").groupBy("block").agg(F.collect_list(F.struct("kind", "part", "packed")).alias("answers"))
        return blocks.select("block", "texts").join(found, "block")  # every block asks for its END

    answers, root = [], None
    for step in range(rules.depth + 2):
        asks = with_answers(answers).mapInArrow(_ask_next(root, rules, parts), ASKED)
        answers.append(scratch.keep(asks.repartitionById(parts, "part").mapInArrow(_totals(rules.min_gain), ASKED), f"answers-{step}", codec="none"))
        del asks
        release_shuffles(spark)
        if root is None:  # four numbers a partition
            sums = [unsqueeze_arrays(r["packed"])[0] for r in answers[0].where("block < 0").select("packed").toLocalIterator()]
            root = Root(*(int(x) for x in np.sum(sums, 0))) if sums else Root()
    scores = with_answers(answers).mapInArrow(_score(root, rules), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    scores = scratch.keep(scores, "scores")
    scratch.drop("blocks", *(f"answers-{step}" for step in range(rules.depth + 2)))
    return scores.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(root.tokens).cast("long").alias("train_tokens"), "base_score", "score")
