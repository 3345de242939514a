"""Token ids from the tokenizers library, with whole words and pieces remembered.

The library is called for every piece that a worker has not met; a piece is a run that
the tokenizer's own pre-tokenizer never joins with its neighbours, so encoding pieces
one by one gives the ids of the whole text.  Texts for which that cannot be promised
(runs of white space, added tokens) are encoded whole, as are unusual words.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from provloom.llm.blocks import offsets, ragged, segment_sums, split_words

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN = re.compile(rf"[!-~{LETTER}]+")
#: The pre-tokenizers' splits, for words of plain characters.
LOWER_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[0-9]|[^{LETTER}0-9]+")
BYTE_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[0-9]+| ?[^ {LETTER}0-9]+")
LETTERS = re.compile(rf"[{LETTER}]+")
SPACE_RUN = r"[\s\x0b\x1c-\x1f\x85\pZ][\s\x0b\x1c-\x1f\x85\pZ]"


class TextEncoder:
    """ids of texts under one tokenizer file; ``limit`` bounds the remembered words."""

    def __init__(self, path: str, limit: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.lower = bool(spec.get("normalizer"))
        self.single = rf"\A{'' if self.lower else ' '}[{LETTER}]+\z"
        self.added = [t["content"] for t in spec["added_tokens"]]
        # Words and pieces are remembered in two generations: what is met again moves to the
        # younger, and when that is full the older is forgotten, so frequent ones stay.
        self.limit = limit // 2
        self.words: dict[str, bytes] = {}
        self.older_words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.older_pieces: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.marks = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.marks[i] = token.endswith("</w>") if self.lower else token.startswith("Ġ")

    def _direct(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in got]

    def _runs(self, runs: list[str]) -> list[bytes]:
        """ids of letter runs, encoded together; every run ends (or begins) at a mark."""
        joined = " ".join(runs) if self.lower else "".join(runs)
        ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = np.flatnonzero(self.marks[ids])
        if len(cuts) != len(runs):
            return self._direct(runs)
        ends = cuts + 1 if self.lower else np.append(cuts[1:], len(ids))
        raw, ends = ids.tobytes(), (ends * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    @staticmethod
    def _unknown(wanted, young: dict[str, bytes], older: dict[str, bytes]) -> list[str]:
        """What neither generation knows; what only the older does is moved to the younger."""
        unknown = []
        for x in wanted:
            if x not in young:
                found = older.get(x)
                if found is None:
                    unknown.append(x)
                else:
                    young[x] = found
        return unknown

    def _learn(self, missing: list[str]) -> None:
        if len(self.pieces) > self.limit:
            self.pieces, self.older_pieces = {}, self.pieces
        # Words that are one run of letters are looked up together, without pieces.
        single = pc.match_substring_regex(pa.array(missing, pa.string()), self.single).to_numpy(zero_copy_only=False)
        runs = [missing[i] for i in np.flatnonzero(single).tolist()]
        for i in range(0, len(runs), 2000):
            chunk = runs[i : i + 2000]
            self.words.update(zip(chunk, self._runs(chunk)))
        missing = [missing[i] for i in np.flatnonzero(~single).tolist()]
        if not missing:
            return
        parts: dict[str, list[str]] = {}
        for word in missing:
            body = word[1:] if word[:1] == " " else word
            if not PLAIN.fullmatch(body):
                parts[word] = [word] if word else []
            elif self.lower:
                parts[word] = LOWER_SPLIT.findall(word.lower())
            else:
                parts[word] = BYTE_SPLIT.findall(word)
        unknown = self._unknown({p for ps in parts.values() for p in ps}, self.pieces, self.older_pieces)
        runs = [p for p in unknown if LETTERS.fullmatch(p[1:] if p[0] == " " else p) and (self.lower or p[0] == " ")]
        known = set(runs)
        others = [p for p in unknown if p not in known]
        for i in range(0, len(runs), 2000):
            chunk = runs[i : i + 2000]
            self.pieces.update(zip(chunk, self._runs(chunk)))
        self.pieces.update(zip(others, self._direct(others)))
        for word, ps in parts.items():
            self.words[word] = b"".join([self.pieces[p] for p in ps])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts in order, and how many each text has."""
        whole = np.zeros(len(texts), bool)
        for token in self.added:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if not self.lower:
            whole |= pc.match_substring_regex(texts, SPACE_RUN).to_numpy(zero_copy_only=False)
        if whole.any():
            at = np.flatnonzero(whole)
            direct = [np.frombuffer(b, "<u4") for b in self._direct([texts[int(i)].as_py() for i in at])]
            rest, counts = self._by_words(texts.filter(pa.array(~whole)))
            size = np.zeros(len(texts), np.int64)
            size[~whole], size[at] = counts, [len(d) for d in direct]
            out, first = np.zeros(size.sum(), np.uint32), offsets(size)
            out[ragged(first[:-1][~whole], counts)] = rest
            for i, d in zip(at, direct):
                out[first[i] : first[i + 1]] = d
            return out, size
        return self._by_words(texts)

    def _by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.lower:
            flat, sizes = split_words(texts)
        else:
            lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n "), " ")
            flat = lists.flatten()
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(flat):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        coded = flat.dictionary_encode()
        names, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if not self.lower:
            line = names.index("\n") if "\n" in names else -1
            spaced = np.ones(len(codes), bool)
            spaced[offsets(sizes)[:-1][sizes > 0]] = False
            spaced[codes == line] = False
            spaced[1:][codes[:-1] == line] = False
            keys, codes = np.unique(codes * 2 + spaced, return_inverse=True)
            names = [f" {names[k >> 1]}" if k & 1 else names[k >> 1] for k in keys.tolist()]
        if len(self.words) > self.limit:
            self.words, self.older_words = {}, self.words
        missing = self._unknown(names, self.words, self.older_words)
        if missing:
            self._learn(missing)
        found = [self.words[w] for w in names]
        length = np.fromiter(map(len, found), np.int64, len(found)) // 4
        pool, start = np.frombuffer(b"".join(found), "<u4"), np.cumsum(length) - length
        per_word = length[codes]
        return pool[ragged(start[codes], per_word)], segment_sums(per_word, sizes)


_ENCODERS: dict[tuple[str, int], TextEncoder] = {}


def encoder(path: str, limit: int = 400_000) -> TextEncoder:
    """The worker's own encoder of a tokenizer file."""
    if (path, limit) not in _ENCODERS:
        _ENCODERS[path, limit] = TextEncoder(path, limit)
    return _ENCODERS[path, limit]
