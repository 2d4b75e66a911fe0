"""SentencePiece encoding and decoding with a batched Viterbi pass in numpy.

New words of a batch are grouped by length, and the words of a group advance together: at
each place all substrings that end there are hashed from prefix hashes and probed in the
sorted hashes of the pieces; the maximum over lengths is kept with its length as the back
pointer. Words met before are looked up.

For a BPE model a piece may only follow one that it does not merge with (``piece_model``);
with that condition the pass gives the BPE encoding. Groups of few words take the same pass
word by word.

Defined results: a null or empty text has no ids; a space and the sign that stands for it
in the model are the same, so decoding gives a space for either; every other text decodes to
itself. Invalid bytes decode to U+FFFD.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subscope.llm.common import keyed, per_worker, sliced
from subscope.llm.piece_model import SPACE, UNKNOWN, Pieces, groups

#: words kept encoded before a group of new texts, and the longest of them
CACHE = 300_000
LONGEST = 64
#: groups of fewer words, and longer words, go one by one
FEW = 16
#: pairs of pieces remembered, and new ones before they are sorted in
PAIRS, NEW_PAIRS = 2_000_000, 20_000
#: bits of a hash by which substrings that are no pieces are told first
SOME_BITS = 20
_SOME = np.uint64(64 - SOME_BITS)
_DONE = UNKNOWN - 1
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(codes: np.ndarray) -> np.ndarray:
    h = codes.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def _prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes of the rows of ``codes``."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    mixed = _mixed(codes)
    for k in range(codes.shape[1]):
        out[:, k + 1] = out[:, k] * _BASE + mixed[:, k]
    return out


def _codes(same_length: list[str]) -> np.ndarray:
    return np.frombuffer("".join(same_length).encode("utf-32-le"), "<u4").reshape(len(same_length), -1)


def byte_table(pieces: Pieces) -> list[bytes]:
    """The bytes that each id stands for."""
    single = {i: bytes([b]) for b, i in pieces.byte.items()}
    return [single.get(i) or t.encode() for i, t in enumerate(pieces.text)]


def decoded(ids: list[int], table: list[bytes]) -> str:
    text = b"".join([table[i] for i in ids]).decode("utf-8", "replace").replace(SPACE, " ")
    return text[1:] if text.startswith(" ") else text


class Codec:
    def __init__(self, path: str, kind: str = "bpe"):
        self.pieces = Pieces(path, kind)
        ids = sorted(self.pieces.id.values(), key=lambda i: len(self.pieces.text[i]))
        hashes, order = [], []
        for _, same in groupby(ids, key=lambda i: len(self.pieces.text[i])):
            same = list(same)
            hashes.append(_prefix_hashes(_codes([self.pieces.text[i] for i in same]))[:, -1])
            order += same
        hashes = np.concatenate(hashes)
        at = np.argsort(hashes)
        self.keys, self.key_ids = hashes[at], np.array(order)[at]
        if len(np.unique(self.keys)) < len(self.keys):
            raise ValueError("two pieces have one hash")
        #: by the first bits of a hash: whether any piece has them. Most substrings are no pieces
        self.some = np.zeros(1 << SOME_BITS, bool)
        self.some[self.keys >> _SOME] = True
        self.powers = np.cumprod(np.full(self.pieces.longest + 1, _BASE))
        self.cache: dict[str, bytes] = {}
        self.bytes = byte_table(self.pieces)
        #: pairs known to follow or not: sorted keys, and new ones since they were sorted
        self.pairs, self.follow = np.zeros(0, np.int64), np.zeros(0, bool)
        self.new_pairs: dict[int, bool] = {}

    def _follow(self, last: np.ndarray, piece: np.ndarray) -> np.ndarray:
        keys = (last + 1) << 32 | piece
        out = np.zeros(len(keys), bool)
        at = np.searchsorted(self.pairs, keys).clip(max=max(len(self.pairs) - 1, 0))
        known = self.pairs[at] == keys if len(self.pairs) else out.copy()
        out[known] = self.follow[at[known]]
        rest = np.flatnonzero(~known)
        if len(rest):
            asked, back = np.unique(keys[rest], return_inverse=True)
            for k in asked.tolist():
                if k not in self.new_pairs:
                    self.new_pairs[k] = self.pieces.merges_to((k >> 32) - 1, k & 0xFFFFFFFF)
            out[rest] = np.fromiter(map(self.new_pairs.__getitem__, asked.tolist()), bool, len(asked))[back]
            if len(self.new_pairs) > NEW_PAIRS:
                keys = np.concatenate([self.pairs, np.fromiter(self.new_pairs, np.int64, len(self.new_pairs))])
                ok = np.concatenate([self.follow, np.fromiter(self.new_pairs.values(), bool, len(self.new_pairs))])
                order = np.argsort(keys)
                self.pairs, self.follow = (keys[order], ok[order]) if len(keys) <= PAIRS else (np.zeros(0, np.int64), np.zeros(0, bool))
                self.new_pairs = {}
        return out

    def viterbi(self, same_length: list[str]) -> list[list[int]]:
        """Ids of words of one length, which advance together."""
        return [np.frombuffer(ids, "<i4").tolist() for ids in self.packed(same_length)]

    def packed(self, same_length: list[str]) -> list[bytes]:
        """``viterbi`` as little-endian 32-bit integers."""
        p, n = self.pieces, len(same_length[0])
        hashes = _prefix_hashes(_codes(same_length))
        score = np.full((len(same_length), n + 1), -np.inf)
        score[:, 0] = 0
        last = np.full(score.shape, UNKNOWN, np.int64)
        length = np.ones(score.shape, np.int64)
        for end in range(1, n + 1):
            rest = np.arange(len(same_length))
            for size in range(min(end, p.longest), 0, -1):
                if p.bpe:  # where a piece may follow, no second one may
                    rest = rest[np.isneginf(score[rest, end])]
                h = hashes[rest, end] - hashes[rest, end - size] * self.powers[size - 1]
                some = np.flatnonzero(self.some[h >> _SOME])
                h = h[some]
                at = np.searchsorted(self.keys, h).clip(max=len(self.keys) - 1)
                hit = self.keys[at] == h
                rows, piece = rest[some[hit]], self.key_ids[at[hit]]
                total = score[rows, end - size] + p.score[piece]
                better = total > score[rows, end]
                if p.bpe:
                    better &= self._follow(last[rows, end - size], piece)
                rows, piece = rows[better], piece[better]
                score[rows, end], last[rows, end], length[rows, end] = total[better], piece, size
            lost = np.isneginf(score[:, end])
            score[lost, end] = score[lost, end - 1] + p.unknown_score
        return self._traces(same_length, last, length)

    def _traces(self, same_length: list[str], last: np.ndarray, length: np.ndarray) -> list[bytes]:
        """All words' paths along their back pointers, one step of every word at a time."""
        rows, ends, steps = np.arange(len(same_length)), np.full(len(same_length), len(same_length[0])), []
        while ends.any():
            steps.append(np.where(ends > 0, last[rows, ends], _DONE))
            ends = ends - np.where(ends > 0, length[rows, ends], 0)
        path = np.stack(steps[::-1], axis=1)
        used = path != _DONE
        flat, stops = path[used].astype("<i4").tobytes(), np.cumsum(used.sum(1)) * 4
        out = [flat[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]
        for row in np.flatnonzero((path == UNKNOWN).any(1)):  # characters without a piece
            out[row] = np.array(self.pieces.trace(same_length[row], last[row], length[row]), "<i4").tobytes()
        return out

    def learn(self, new: set[str]) -> None:
        """Encode words that are not kept yet."""
        for size, same in groupby(sorted(new, key=len), key=len):
            same = list(same)
            one_by_one = len(same) < FEW or size > LONGEST
            ids = (np.array(self.pieces.encode_word(w), "<i4").tobytes() for w in same) if one_by_one else self.packed(same)
            self.cache.update(zip(same, ids, strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out = []
        for group in groups(texts):
            needed = {w for text in group for w in text}
            if len(self.cache) > CACHE:  # the words of these texts, frequent ones among them, stay
                self.cache = {w: self.cache[w] for w in needed if w in self.cache}
            kept = self.cache
            self.learn({w for w in needed if w not in kept})
            out += [np.frombuffer(b"".join(map(kept.__getitem__, text)), "<i4") for text in group]
            for long in [w for w in needed if len(w) > LONGEST]:
                del kept[long]
        return out

    def decode(self, ids: list[int]) -> str:
        return decoded(ids, self.bytes)


def encode(df: DataFrame, model: str, kind: str = "bpe", id_col: str = "doc_id", text_col: str = "text",
           *more: Column) -> DataFrame:
    """(doc_id, ids, *more) for every row and its whole text."""
    docs = keyed(df, id_col, text_col, *more)
    extra = docs.columns[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = per_worker(f"codec {kind} {model}", lambda: Codec(model, kind))
        for batch in sliced(batches, 2048):
            found = codec.encode(batch.column(1).to_pylist())
            offsets = np.cumsum([0, *map(len, found)])
            flat = pa.array(np.concatenate([np.zeros(0, "<i4"), *found]))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, *batch.columns[2:]], ["doc_id", "ids", *extra])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = [f"doc_id {kinds['doc_id']}", "ids array<int>", *(f"`{c}` {kinds[c]}" for c in extra)]
    return docs.mapInArrow(run, ", ".join(schema))


def decode(df: DataFrame, model: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """``df`` with the ids' text in column ``to``; null ids give null."""
    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = per_worker(f"bytes {model}", lambda: byte_table(Pieces(model)))
        for ids in batches:
            yield ids.map(lambda row: None if row is None else decoded(row.tolist(), table))

    return df.withColumn(to, text(ids_col))
