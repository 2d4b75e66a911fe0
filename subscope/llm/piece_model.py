"""Pieces of a SentencePiece model file and the paths through a word that its encoder may take.

The best path through a word ends, at each place, in a piece whose score adds to the best one
before it. In a unigram model any pieces may follow each other. In a BPE model two pieces may
do so only if merging their joined characters gives back just these two; a word's encoding is
the one path all of whose neighbours may follow each other, and its prefixes' encodings are
the prefixes of the dynamic programme. So the same forward pass serves both kinds, with the
pairs of a BPE model checked (and remembered) as they occur.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

SPACE = "▁"
#: a character without a piece: its UTF-8 bytes are the tokens
UNKNOWN = -1
#: pairs remembered at once
PAIRS = 2_000_000
#: words of a text: no piece holds a space after another character, or a line break
WORD = re.compile("▁*[^▁\n]+|▁+|\n")


def words(text: str) -> list[str]:
    """The pre-tokens of ``text``; joined, they are the text with its dummy prefix."""
    return WORD.findall(SPACE + text.replace(" ", SPACE)) if text else []


def groups(texts: list[str], together: int = 500_000) -> Iterator[list[list[str]]]:
    """The texts' words, about ``together`` at a time, so that their new words are met as one set."""
    group, held = [], 0
    for text in texts:
        group.append(words(text))
        held += len(group[-1])
        if held > together:
            yield group
            group, held = [], 0
    yield group


class Pieces:
    """``kind``: "bpe" or "unigram", the model's type."""

    def __init__(self, path: str, kind: str = "bpe"):
        from sentencepiece import SentencePieceProcessor

        self.bpe = kind == "bpe"
        model = SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        self.text = [model.id_to_piece(i) for i in every]
        self.byte = {int(self.text[i][3:5], 16): i for i in every if model.is_byte(i)}
        usual = [i for i in every if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.score = np.array([model.get_score(i) for i in every])
        self.id = {self.text[i]: i for i in usual}
        self.longest = max(map(len, self.id))
        self.unknown_score = min(self.score[i] for i in usual) - 10
        for piece in usual:
            if "\n" in self.text[piece] or SPACE in self.text[piece].lstrip(SPACE):
                raise ValueError(f"words cannot be cut around the piece {self.text[piece]!r}")
        self.scores = {self.text[i]: float(self.score[i]) for i in usual}
        # lengths of the pieces that end in two given characters, longest first
        ends: dict[str, set[int]] = {}
        for piece in usual:
            if len(self.text[piece]) > 1:
                ends.setdefault(self.text[piece][-2:], set()).add(len(self.text[piece]))
        self.lengths = {two: sorted(found, reverse=True) for two, found in ends.items()}
        self._pairs: dict[tuple[int, int], bool] = {}

    def _merged(self, symbols: list[str]) -> list[str]:
        """Byte-pair merges: the best-scored neighbours join first, the leftmost of equals."""
        scores, none = self.scores.get, -np.inf
        joined = [scores(a + b, none) for a, b in zip(symbols, symbols[1:], strict=False)]
        while joined:
            best = max(joined)
            if best == none:
                break
            at = joined.index(best)
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
            del joined[at]
            if at < len(joined):
                joined[at] = scores(symbols[at] + symbols[at + 1], none)
            if at:
                joined[at - 1] = scores(symbols[at - 1] + symbols[at], none)
        return symbols

    def merges_to(self, last: int, piece: int) -> bool:
        """Whether merging the characters of both gives the two back."""
        pair = [self.text[piece]] if last == UNKNOWN else [self.text[last], self.text[piece]]
        return self._merged(list("".join(pair))) == pair

    def follows(self, last: int, piece: int) -> bool:
        """Whether ``piece`` may come after ``last`` (UNKNOWN: after a word's start or an unknown character)."""
        if not self.bpe:
            return True
        known = self._pairs.get((last, piece))
        if known is None:
            known = self.merges_to(last, piece)
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            self._pairs[last, piece] = known
        return known

    def step(self, word: str, end: int, score: list[float], last: list[int]) -> int:
        """Extend the forward pass to the prefix that ends at ``end``; returns the last piece's length."""
        best, piece, length = -np.inf, UNKNOWN, 1
        for n in [*self.lengths.get(word[end - 2:end], ()), 1] if end > 1 else [1]:
            if n > end:
                continue
            part = word[end - n:end]
            found = self.id.get(part)
            if found is None:
                continue
            total = score[end - n] + self.scores[part]
            if total > best and self.follows(last[end - n], found):
                best, piece, length = total, found, n
                if self.bpe:  # no second one may follow
                    break
        score.append(best if piece != UNKNOWN else score[end - 1] + self.unknown_score)
        last.append(piece)
        return length

    def extend(self, word: str, done: int, last: list[int], count: list[int]) -> None:
        """``step`` of a BPE model for all places after ``done``, with the tokens so far: one piece at most
        may follow, so no scores are compared."""
        lengths, ids, pairs = self.lengths.get, self.id.get, self._pairs.get
        for end in range(done + 1, len(word) + 1):
            for n in lengths(word[end - 2:end], ()) if end > 1 else ():
                if n <= end:
                    piece = ids(word[end - n:end])
                    if piece is not None:
                        ok = pairs((last[end - n], piece))
                        if ok or ok is None and self.follows(last[end - n], piece):
                            last.append(piece)
                            count.append(count[end - n] + 1)
                            break
            else:
                piece = ids(word[end - 1])
                if piece is not None and self.follows(last[end - 1], piece):
                    last.append(piece)
                    count.append(count[end - 1] + 1)
                else:
                    last.append(UNKNOWN)
                    count.append(count[end - 1] + len(word[end - 1].encode()))

    def encode_word(self, word: str) -> list[int]:
        score, last, lengths = [0.0], [UNKNOWN], [0]
        for end in range(1, len(word) + 1):
            lengths.append(self.step(word, end, score, last))
        return self.trace(word, last, lengths)

    def trace(self, word: str, last, lengths) -> list[int]:
        """Ids along the back pointers; an unknown character gives the ids of its bytes."""
        out, end = [], len(word)
        while end > 0:
            if last[end] == UNKNOWN:
                out += [self.byte[b] for b in reversed(word[end - 1].encode())]
            else:
                out.append(int(last[end]))
            end -= int(lengths[end])
        return out[::-1]
