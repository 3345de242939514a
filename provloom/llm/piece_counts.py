"""Exact token counts of every prefix, by dynamic programming over prefixes.

For a sentencepiece BPE model the encoding of a text is the one sequence of pieces in
which each neighbouring pair is itself an encoding.  So the last piece of each prefix
follows from the last pieces of shorter prefixes: among the pieces that end there, exactly
one may follow the last piece of what is before it.  Its count is one more than that
prefix's.  Whether two pieces may be neighbours is found by undoing their merges from the
latest to the first and looking for a merge across the border that would have come earlier.

Texts are cut where no piece reaches across (before spaces, and between characters that
no piece holds side by side), so counts of a text are running sums of the counts of its
words, and each worker remembers the words that it has met.  A text's counts are kept as
one signed byte a character (the change from the prefix before), from which truncation to
a budget and the size of any prefix are read without encoding again.

Defined cases: a null text counts as the empty text, of 0 tokens; null and repeated
doc_ids are carried row by row; an empty table gives no rows; texts of any length are
counted whole, long runs of spaces and words without any space included; no other column
of the input is read or returned.  Prefixes end between code points.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provloom.llm.blocks import offsets, ragged, segment_sums, text_blocks, texts_of
from provloom.storage import attach

SPACE = "▁"
#: Characters, by frequency in the pieces, whose trie steps are one table look-up.
DENSE = 128
FAR = np.int64(1) << 40  # later than any merge


def _merges(piece: str, rank: dict[str, int]) -> list[tuple[int, str, str]]:
    """(rank, left, right) of the merges that encode ``piece`` alone, in the order they happen."""
    parts, alive = list(piece), [True] * len(piece)
    after, before = list(range(1, len(piece) + 1)), list(range(-1, len(piece) - 1))
    heap: list[tuple[int, int, str]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < len(parts) and (r := rank.get(parts[i] + parts[j])) is not None:
            heapq.heappush(heap, (r, i, parts[i] + parts[j]))

    for i in range(len(piece) - 1):
        offer(i)
    done = []
    while heap:
        r, i, whole = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= len(parts) or parts[i] + parts[j] != whole:
            continue
        done.append((r, parts[i], parts[j]))
        parts[i], alive[j], after[i] = whole, False, after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return done


@dataclass
class PieceTables:
    """A model's pieces as arrays; small enough to be broadcast (it follows the vocabulary)."""

    chars: np.ndarray  # code points that pieces hold, most frequent first
    edges: np.ndarray  # trie: parent, character number, child
    token_of_node: np.ndarray
    rank: np.ndarray  # when a token is merged; -1 for single characters
    left: np.ndarray
    right: np.ndarray
    pairs: np.ndarray  # first token << 20 | second token of all that merge, sorted
    pair_rank: np.ndarray
    beside: np.ndarray  # character numbers side by side in a piece: a << 20 | b, sorted
    space_runs: np.ndarray  # tokens of 0, 1, 2 ... spaces in a row; one more for each further period


def piece_tables(path: str) -> PieceTables:
    """Read a BPE model with byte fallback, identity normalization and a leading space."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    if "".join(sp.encode("a  b ", out_type=str)) != f"{SPACE}a{SPACE}{SPACE}b{SPACE}" or sp.encode("ﬁé", out_type=str)[-1] == "é":
        raise ValueError("the model changes texts before it encodes them")
    score = {}
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)):
            score[sp.id_to_piece(i)] = sp.get_score(i)
    runs = [p for p in score if set(p) == {SPACE} and len(p) > 1]
    if any(SPACE in p[1:] for p in score if p not in runs) or len({score[p] for p in runs}) > 1 or any(score[runs[0]] >= v for p, v in score.items() if runs and set(p) != {SPACE}):
        raise ValueError("pieces with spaces inside, or runs of spaces that are not merged last and alike")
    # Runs of spaces are merged from the left; their counts repeat with the longest run's length.
    period, equal = max(map(len, runs), default=1), dict.fromkeys(runs, 0)
    space_runs = np.array([k - len(_merges(SPACE * k, equal)) for k in range(4 * period + 1)])
    if (space_runs[period:] != space_runs[:-period] + 1).any():
        raise ValueError("runs of spaces without a period")
    words = sorted((p for p in score if len(p) > 1 and set(p) != {SPACE}), key=lambda p: -score[p])
    if len({score[p] for p in words}) < len(words):
        raise ValueError("two pieces of one rank")
    rank = {p: k for k, p in enumerate(words)}
    singles = sorted({c for p in score for c in p})
    token = {c: k for k, c in enumerate(singles)}
    left, right, order = [-1] * len(singles), [-1] * len(singles), [-1] * len(singles)
    for p in words:
        done = _merges(p, rank)
        if not done or done[-1][1] + done[-1][2] != p:
            continue  # never made: other merges come first
        if any(a[0] > b[0] for a, b in zip(done, done[1:])):
            raise ValueError("a merge that comes after a later one")
        token[p] = len(token)
        order.append(rank[p])
        left.append(done[-1][1])
        right.append(done[-1][2])
    left = [token[x] if isinstance(x, str) else x for x in left]
    right = [token[x] if isinstance(x, str) else x for x in right]
    # Any two neighbours whose text is a piece merge, reachable alone or not.
    pairs = sorted((token[p[:k]] << 20 | token[p[k:]], rank[p]) for p in words for k in range(1, len(p)) if p[:k] in token and p[k:] in token)
    count: dict[str, int] = {}
    for p in words:
        for c in p:
            count[c] = count.get(c, 0) + 1
    chars = sorted(singles, key=lambda c: (-count.get(c, 0), c))
    number = {c: k + 1 for k, c in enumerate(chars)}  # 0: in no piece
    nodes: dict[str, int] = {"": 0}
    edges, of_node = [], [-1]
    for p in token:
        for k in range(1, len(p) + 1):
            if p[:k] not in nodes:
                nodes[p[:k]] = len(nodes)
                of_node.append(-1)
                edges.append((nodes[p[: k - 1]], number[p[k - 1]], nodes[p[:k]]))
        of_node[nodes[p]] = token[p]
    beside = sorted({number[a] << 20 | number[b] for p in words for a, b in zip(p, p[1:])})
    return PieceTables(
        np.array([ord(c) for c in chars]), np.array(edges, np.int64).reshape(-1, 3), np.array(of_node), np.array(order, np.int64), np.array(left, np.int64), np.array(right, np.int64),
        np.array([p for p, _ in pairs], np.int64), np.array([r for _, r in pairs], np.int64), np.array(beside, np.int64), space_runs[:period],
    )


def _found(keys: np.ndarray, sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stands in ``sorted_keys``, and whether it does."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


class PrefixCounter:
    """Counts of every prefix of words; ``limit`` bounds the words a worker remembers."""

    def __init__(self, tables: PieceTables, limit: int = 400_000):
        self.t, self.limit = tables, limit // 2
        self.number = np.zeros(0x110000, np.int32)
        self.number[tables.chars] = np.arange(1, len(tables.chars) + 1)
        self.space = int(self.number[ord(SPACE)])
        parent, char, child = tables.edges.T
        self.dense = np.zeros((len(tables.token_of_node), DENSE), np.int32)
        near = char < DENSE
        self.dense[parent[near], char[near]] = child[near]
        keys = parent[~near] << 20 | char[~near]
        order = np.argsort(keys)
        self.far_keys, self.far_child = keys[order], child[~near][order]
        self.known_pair = np.full(1 << 20, -1, np.int64)  # a cache by hash: pair, and whether it may stand
        self.known_fits = np.zeros(1 << 20, bool)
        # Two generations: what is met again moves to the younger; when that is full the older goes.
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def run_counts(self, k: np.ndarray) -> np.ndarray:
        """Tokens of k spaces in a row."""
        period = len(self.t.space_runs)
        return self.t.space_runs[k % period] + k // period

    def _undo(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether tokens x, y may be neighbours."""
        t, out = self.t, np.ones(len(x), bool)
        live = np.arange(len(x))
        x_until, y_until = np.full(len(x), FAR), np.full(len(x), FAR)
        while len(live):
            at, there = _found(x << 20 | y, t.pairs)
            merge = np.where(there, t.pair_rank[at] if len(t.pair_rank) else 0, FAR)
            # Of equal merges the left one is first: x's own is left of the border, y's right.
            bad = there & (merge < x_until) & (merge <= y_until)
            out[live[bad]] = False
            rx, ry = t.rank[x], t.rank[y]
            go = ~bad & ((rx >= 0) | (ry >= 0))
            undo_y = ry >= rx
            x, y, x_until, y_until = (np.where(undo_y, x, t.right[x])[go], np.where(undo_y, t.left[y], y)[go], np.where(undo_y, x_until, rx)[go], np.where(undo_y, ry, y_until)[go])
            live = live[go]
        return out

    def _fits(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        pair = x << 20 | y
        slot = ((pair * np.int64(0x9E3779B97F4A7C1)) >> np.int64(33)) & np.int64(len(self.known_pair) - 1)
        out = self.known_fits[slot]
        miss = np.flatnonzero(self.known_pair[slot] != pair)
        if len(miss):
            new, back = np.unique(pair[miss], return_inverse=True)
            fits = self._undo(new >> 20, new & ((1 << 20) - 1))
            out[miss] = fits[back]
            self.known_pair[slot[miss]], self.known_fits[slot[miss]] = pair[miss], fits[back]
        return out

    def _steps(self, words: list[str]) -> list[bytes]:
        """For words with their leading spaces: the change of the count at each character."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        bodies = [w.lstrip(" ") for w in words]
        spaces = sizes - np.fromiter(map(len, bodies), np.int64, len(words))
        lead = np.maximum(spaces, 1) - 1  # all but the space that may join the word
        points = np.frombuffer("".join(f"{SPACE}{b}" for b in bodies).encode("utf-32-le", "surrogatepass"), np.uint32)
        char = self.number[points].astype(np.int64)
        starts = offsets(sizes - lead)
        first = np.zeros(len(char) + 1, bool)
        first[starts] = True
        inner = ~first[1:-1]
        inner[inner] = _found((char[:-1] << 20 | char[1:])[inner], self.t.beside)[1]
        cut = np.concatenate([[True], ~inner])
        segment_start = np.maximum.accumulate(np.where(cut, np.arange(len(char)), 0))
        segment_end = np.append(np.flatnonzero(cut)[1:], len(char))[np.cumsum(cut) - 1]
        # Pieces from every position, along the trie.
        at = np.flatnonzero(char > 0)
        node, found, length = np.zeros(len(at), np.int64), [], 0
        while len(at):
            here = char[at + length]
            step = self.dense[node, np.minimum(here, DENSE - 1)].astype(np.int64)
            far = np.flatnonzero(here >= DENSE)
            if len(far):
                place, there = _found(node[far] << 20 | here[far], self.far_keys)
                step[far] = np.where(there, self.far_child[place] if len(self.far_child) else 0, 0)
            length += 1
            alive = step > 0
            at, node = at[alive], step[alive]
            token = self.t.token_of_node[node]
            ends = token >= 0
            found.append((at[ends], np.full(int(ends.sum()), length, np.int64), token[ends]))
            more = at + length < segment_end[at]
            at, node = at[more], node[more]
        start, size, token = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        end = start + size - 1
        depth = end - segment_start[end]
        order = np.argsort(depth, kind="stable")
        start, end, token, cuts = start[order], end[order], token[order], offsets(np.bincount(depth))
        last, count = np.full(len(char), -1, np.int64), np.zeros(len(char), np.int64)
        unknown = char == 0
        count[unknown] = 1 + (points[unknown] > 0x7F) + (points[unknown] > 0x7FF).astype(np.int64) + (points[unknown] > 0xFFFF)
        lone = np.zeros(len(char), bool)  # the prefix's first token is the space alone
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            s, e, t = start[a:b], end[a:b], token[a:b]
            opening = s == segment_start[e]
            fits = opening.copy()
            rest = np.flatnonzero(~opening)
            fits[rest] = self._fits(last[s[rest] - 1], t[rest])
            s, e, t, opening = s[fits], e[fits], t[fits], opening[fits]
            last[e] = t
            count[e] = np.where(opening, 0, count[s - 1]) + 1
            lone[e] = np.where(opening, (s == e) & (char[s] == self.space), lone[s - 1])
        # Runs of spaces: those that do not join the word are taken together.
        owner = np.cumsum(first[:-1]) - 1
        leading = np.flatnonzero(segment_start == starts[owner])
        k = lead[owner[leading]] + 1
        count[leading] += np.where(lone[leading], self.run_counts(k) - 1, self.run_counts(k - 1))
        before = np.where(cut, 0, np.roll(count, 1))
        before[starts[:-1]] = self.run_counts(lead)
        change = (count - before).astype(np.int8).tobytes()
        out = []
        for w, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
            head = np.diff(self.run_counts(np.arange(lead[w] + 1))).astype(np.int8).tobytes() if lead[w] else b""
            out.append(head + change[a:b])
        return out

    def _known(self, names: list[str]) -> list[bytes]:
        if len(self.words) > self.limit:
            self.words, self.older = {}, self.words
        words, older, missing = self.words, self.older, []
        for x in names:
            if x not in words:
                found = older.get(x)
                if found is None:
                    missing.append(x)
                else:
                    words[x] = found
        chunk: list[str] = []
        held = 0
        for x in [*missing, None]:
            if chunk and (x is None or held + len(x) > 300_000):
                words.update(zip(chunk, self._steps(chunk)))
                chunk, held = [], 0
            if x is not None:
                chunk.append(x)
                held += len(x)
        return [words[x] for x in names]

    def count(self, texts: pa.Array) -> PrefixCounts:
        """Counts of every prefix of every text (none of them null)."""
        texts = pc.replace_substring(texts, SPACE, " ")
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(texts, " ")
        flat = lists.flatten()
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = flat.dictionary_encode()
        names, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        blank = names.index("") if "" in names else -1
        spaces = np.ones(len(codes), np.int64)
        keep = np.ones(len(codes), bool)
        if (codes == blank).any():  # spaces in a row belong to the word after them, or to the text's end
            ends = np.cumsum(sizes)
            final = np.zeros(len(codes), bool)
            final[ends[sizes > 0] - 1] = True
            keep = (codes != blank) | final
            held = np.flatnonzero(keep)
            spaces = np.diff(np.concatenate([[-1], held]))
            sizes = segment_sums(keep.astype(np.int64), sizes)
            codes = codes[held]
            # The empty text has no word at all, not even the space that others begin with.
            gone = np.repeat(empty, sizes)
            codes, spaces, sizes = codes[~gone], spaces[~gone], np.where(empty, 0, sizes)
        keys, codes = np.unique(codes << 32 | spaces, return_inverse=True)
        words = [" " * (k & 0xFFFFFFFF) + names[k >> 32] for k in keys.tolist()]
        return PrefixCounts(sizes, codes.astype(np.int64), self._known(words))


@dataclass
class PrefixCounts:
    """Counts of the prefixes of several texts, as words and the changes within them."""

    sizes: np.ndarray  # words of each text
    codes: np.ndarray
    words: list[bytes]
    length: np.ndarray = field(init=False)
    total: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.pool = np.frombuffer(b"".join(self.words), np.int8)
        self.length = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.total = segment_sums(self.pool.astype(np.int64), self.length)
        self.first = offsets(self.sizes)

    def totals(self) -> np.ndarray:
        """Tokens of each whole text."""
        return segment_sums(self.total[self.codes], self.sizes)

    def steps(self, i: int) -> np.ndarray:
        """The change of text i's count at each of its characters, from the empty prefix on."""
        codes = self.codes[self.first[i] : self.first[i + 1]]
        start = offsets(self.length)[:-1]
        out = self.pool[ragged(start[codes], self.length[codes])]
        if len(out) > 1:  # the space before the text is no character of it
            out = out[1:].copy() if out[0] == 0 else np.concatenate([[out[0] + out[1]], out[2:]]).astype(np.int8)
        return out


def longest_prefix(steps: np.ndarray, limit: int) -> int:
    """Characters of the longest prefix whose own encoding has at most ``limit`` tokens (0 or more)."""
    fits = np.flatnonzero(np.cumsum(steps, dtype=np.int64) <= limit)
    return int(fits[-1]) + 1 if len(fits) else 0


_COUNTERS: dict[str, PrefixCounter] = {}


def _counter(path: str, shared) -> PrefixCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(shared.value)
    return _COUNTERS[path]


def _run(docs: DataFrame, path: str, schema: str, make) -> DataFrame:
    shared = attach(docs.sparkSession).sparkContext.broadcast(piece_tables(path))

    def run(batches):
        for batch in text_blocks(batches):
            texts = texts_of(batch)
            counts = _counter(path, shared).count(texts)
            n_bytes = pc.cast(pc.binary_length(texts), pa.int64())
            columns = [batch.column("doc_id"), n_bytes, pa.array(counts.totals()), *make(texts, counts)]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def token_counts(docs: DataFrame, path: str, *, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and fit_bytes: the bytes of the longest prefix within ``limit``."""

    def make(texts, counts):
        over = counts.totals() > limit
        fit = pc.cast(pc.binary_length(texts), pa.int64()).to_numpy(zero_copy_only=False).copy()
        for i in np.flatnonzero(over).tolist():
            fit[i] = len(texts[i].as_py()[: longest_prefix(counts.steps(i), limit)].encode())
        return pa.array(over), pa.array(fit)

    return _run(docs, path, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_bytes long", make)


def prefix_table(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, steps: to be written once and asked often (see ``prefix_tokens``, ``fitting_characters``)."""

    def make(texts, counts):
        return (pa.array([counts.steps(i).tobytes() for i in range(len(texts))], pa.binary()),)

    return _run(docs, path, "doc_id long, n_bytes long, n_tokens long, steps binary", make)


def _answer(table: DataFrame, ask: str, of) -> DataFrame:
    """One number a row from ``steps`` and the long column ``ask``; null where either is null."""
    schema = "doc_id long, asked long, answer long"

    def run(batches):
        for batch in batches:
            out = [None if s is None or a is None else of(np.frombuffer(s, np.int8), a) for s, a in zip(batch.column("steps").to_pylist(), batch.column("asked").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("asked"), pa.array(out, pa.int64())], names=["doc_id", "asked", "answer"])

    attach(table.sparkSession)
    return table.select("doc_id", F.col(ask).cast("long").alias("asked"), "steps").mapInArrow(run, schema)


def prefix_tokens(table: DataFrame, characters: str) -> DataFrame:
    """answer: tokens of the first so many characters of each text (all, if it has fewer)."""
    return _answer(table, characters, lambda steps, n: int(steps[: max(0, n)].sum(dtype=np.int64)))


def fitting_characters(table: DataFrame, budget: str) -> DataFrame:
    """answer: characters of the longest prefix within each row's budget of tokens."""
    return _answer(table, budget, longest_prefix)
