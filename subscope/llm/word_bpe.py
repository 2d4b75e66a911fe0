"""Token ids of a lower-casing word-level BPE tokenizer file, with repeated words looked up.

White space never reaches the model, so each space- or newline-separated chunk of a text has
its ids on its own. Stretches of plain characters are cut into the tokenizer's own pre-tokens
here, all at once, and only new words go to its model; any other chunk goes to the whole
tokenizer.
"""

from __future__ import annotations

import os
import re
import struct

#: chunks and words kept at once; the memory bound of a task (about 200 bytes each)
CACHE = {"chunks": 50_000, "words": 400_000}
#: longer chunks are not kept
LONGEST = 64
#: visible ASCII and Latin letters without compositions: no normalisation beyond lower case
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-įı-ɏ]*")
_PLAIN_TEXT = re.compile(r"[ \n!-~À-ÖØ-öø-įı-ɏ]*")
#: the pre-tokens of the tokenizer file, for plain characters in lower case; none holds white space
_PRE_TOKEN = re.compile(r"[a-zß-öø-įı-ɏ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[!-/:-@\[-`{-~]+")


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: visible Latin-1 bytes stand for themselves, the others for 256 and up."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Kept(dict):
    """A dictionary of the last words asked for: when half of ``most`` are new, those that were not asked
    for since the half before go, and frequent ones stay."""

    def __init__(self, most: int):
        self.most, self.before = most, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            ids = self.made(word)
        if len(word) <= LONGEST:
            if len(self) >= self.most // 2:
                self.before = dict(self)
                self.clear()
            self[word] = ids
        return ids


class _Words(_Kept):
    def __init__(self, model):
        super().__init__(CACHE["words"])
        self.model, self.letters = model, _byte_letters()

    def made(self, word: str) -> bytes:
        shown = word if word.isascii() else "".join(self.letters[b] for b in word.encode())
        return _packed([t.id for t in self.model.tokenize(shown)])


class _Chunks(_Kept):
    def __init__(self, tokenizer):
        super().__init__(CACHE["chunks"])
        self.tokenizer, self.words = tokenizer, _Words(tokenizer.model)

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, _PRE_TOKEN.findall(text.lower())))

    def made(self, chunk: str) -> bytes:
        if _PLAIN.fullmatch(chunk) and "<|" not in chunk:
            return self.plain(chunk)
        return _packed(self.tokenizer.encode(chunk, add_special_tokens=False).ids)


class Encoder:
    """``encode(text)``: the ids as little-endian unsigned 32-bit integers in bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.chunks = _Chunks(Tokenizer.from_file(path))

    def encode(self, text: str, block: int = 1 << 20) -> bytes:
        out, start = [], 0
        while start < len(text):
            end = text.find(" ", start + block) if start + block < len(text) else -1
            end = len(text) if end < 0 else end
            part = text[start:end]
            if "<|" not in part and _PLAIN_TEXT.fullmatch(part):
                out.append(self.chunks.plain(part))
            else:
                out.extend(map(self.chunks.__getitem__, part.replace("\n", " ").split(" ")))
            start = end
        return b"".join(out)
