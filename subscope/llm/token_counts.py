"""Token counts by dynamic programming over a trie of distinct pre-tokens.

The distinct new pre-tokens of a batch, in sorted order, are a trie walked in depth: each
shares the prefix it has in common with the one before, whose forward scores stand already,
and only the places below are computed, once per node. The count at a pre-token's terminal
node is kept; a text's count is the sum over its pre-tokens.

Counts are those of the model's own encoder (``piece_model``); characters without a piece
count their UTF-8 bytes. Defined results: a null or empty text has 0 tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from subscope.llm.common import keyed, per_worker, sliced
from subscope.llm.piece_model import UNKNOWN, Pieces, groups

#: counts kept before a group of new texts, and the longest pre-token among them
CACHE = 400_000
LONGEST = 64


def trie_counts(pieces: Pieces, distinct: set[str]) -> dict[str, int]:
    """Tokens of each of ``distinct``."""
    found, before = {}, ""
    score, last, count = [0.0], [UNKNOWN], [0]
    for word in sorted(distinct):
        shared = 0
        for a, b in zip(before, word, strict=False):
            if a != b:
                break
            shared += 1
        del score[shared + 1:], last[shared + 1:], count[shared + 1:]
        if pieces.bpe:
            pieces.extend(word, shared, last, count)
        else:
            for end in range(shared + 1, len(word) + 1):
                length = pieces.step(word, end, score, last)
                cost = len(word[end - 1].encode()) if last[end] == UNKNOWN else 1
                count.append(count[end - length] + cost)
        found[word], before = count[-1], word
    return found


def token_counts(df: DataFrame, model: str, kind: str = "bpe", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens) for every row and its whole text."""
    docs = keyed(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, kept = per_worker(f"counts {kind} {model}", lambda: (Pieces(model, kind), {}))
        for batch in sliced(batches, 2048):
            n_words, n_tokens = [], []
            for group in groups(batch.column(1).to_pylist()):
                needed = {w for text in group for w in text}
                if len(kept) > CACHE:  # the words of these texts, frequent ones among them, stay
                    stay = {w: kept[w] for w in needed if w in kept}
                    kept.clear()
                    kept.update(stay)
                kept.update(trie_counts(pieces, {w for w in needed if w not in kept}))
                n_words += map(len, group)
                n_tokens += [sum(map(kept.__getitem__, text)) for text in group]
                for long in [w for w in needed if len(w) > LONGEST]:
                    del kept[long]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())],
                                             ["doc_id", "n_words", "n_tokens"])

    kind_of_id = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind_of_id}, n_words long, n_tokens long")
