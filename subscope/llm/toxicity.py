"""Toxicity by compression distance to two zstandard dictionaries.

The ordinary dictionary is trained on windows of clean texts. The toxic one is trained on
the parts of toxic texts that are more frequent there than in clean ones: phrases of one to
PHRASE words whose smoothed rate is RATIO times the clean one and differs by more than chance
(likelihood ratio, over all phrases tried). An occurrence in clean texts lowers the ratio and
rules nothing out. Occurrences after the same word count once (a copied passage repeats its
neighbours, a slur does not). Where no phrase stands out it is trained on all toxic windows.
Each is a raw prefix for the compressor; the toxic prefix goes on top of the ordinary one, so
a window of ordinary text has nearly the same length under both, and the bytes saved by the
toxic dictionary are the window's distance; what an ordinary prefix of the same length saves
as well does not count.

A text is cut into windows of WINDOW words over the whole of it. How many windows save at
least 2, 3, ... bytes, and the largest saving, are the features of a logistic model
(Newton's method in numpy) that is calibrated on sampled documents whose dictionaries did not
see them, weighted to the labels' shares in all rows; its probability is the score.

The model is fitted on a bounded sample of labelled rows, in order of a hash of the id: at
most DOCS rows and BYTES bytes of text per class, whole texts only.

Defined results: a null text counts as empty; an empty text has no window and gets the
model's probability for that; without a sampled row of one class every score is 0 (no toxic
row) or the share of toxic rows. Unlabelled rows and labels that are null are not learned.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subscope.llm.common import blocks, give_back, keep_rows, keyed, sliced

#: bounds of the learning sample, by label
DOCS = {0: 12_000, 1: 4_000}
BYTES = {0: 32 << 20, 1: 16 << 20}
#: clean texts of the sample on which the model is calibrated
CALIBRATED = 4_000
#: words of a window
WINDOW = 6
#: words of the longest phrase that is evidence, and the ratio of its rates in toxic and clean texts
PHRASE = 3
RATIO = 4
#: phrases held before repeated ones are left out
HELD = 250_000
ORDINARY_SIZE, TOXIC_SIZE = 112 << 10, 4 << 10
LEVEL = 3
THRESHOLD = 0.7
#: savings in bytes that are counted
SAVINGS = range(2, 9)

_GOLDEN, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_GAP = re.compile(rb"[\x00-\x20!-@\[-`{-\x7f]+")


def _words(block: bytes) -> list[bytes]:
    """Runs of ASCII letters (lower-cased) and non-ASCII bytes."""
    return [w for w in _GAP.split(block.lower()) if w]


def _windows(text: bytes) -> Iterator[bytes]:
    for block in blocks(text):
        words = _words(block)
        for k in range(0, len(words), WINDOW):
            yield b" " + b" ".join(words[k:k + WINDOW]) + b" "


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray | None  # None: ``constant`` for every text
    constant: float = 0.0

    def compressors(self):
        def one(prefix: bytes):
            held = zstandard.ZstdCompressionDict(prefix, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False,
                                            write_checksum=False, write_dict_id=False).compress
        return one(self.ordinary), one(self.ordinary + self.ordinary[-len(self.toxic):]), one(self.ordinary + self.toxic)

    def features(self, text: bytes, compressors) -> np.ndarray:
        plain, longer, toxic = compressors
        saved = [len(plain(w)) - len(toxic(w)) for w in _windows(text)]
        for k, w in enumerate(_windows(text)) if max(saved, default=0) >= SAVINGS.start else ():
            if saved[k] >= SAVINGS.start:  # more than the prefix's length alone saves
                saved[k] = min(saved[k], len(longer(w)) - len(toxic(w)))
        n, saved = max(1, len(saved)), np.array(saved or [0])
        counts = np.array([(saved >= k).sum() for k in SAVINGS], float)
        return np.concatenate([[1.0, np.log(n), max(saved.max(), 0) / 4], np.log1p(counts), counts / np.sqrt(n)])

    def score(self, texts: list[bytes], compressors) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.constant)
        x = np.array([self.features(t, compressors) for t in texts]).reshape(-1, len(self.weights))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.3, steps: int = 25) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(hessian, x.T @ (weight * (y - p)) - ridge * w)
    return w


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary's bytes; the samples themselves where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def _encode(text: bytes) -> np.ndarray:
    """Checksums of the text's words."""
    return np.fromiter((zlib.crc32(w) for b in blocks(text) for w in _words(b)), np.uint32)


def _phrases(words: np.ndarray, size: int) -> np.ndarray:
    """Hash, 32 bits, of the ``size`` words from every place."""
    n = max(0, len(words) - size + 1)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = (h ^ words[k:k + n]) * _GOLDEN
        h ^= h >> np.uint64(29)
    return (h * _MIX) >> np.uint64(32)


def _in(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Whether each value is one of ``among``, sorted and not empty."""
    return among[np.searchsorted(among, values).clip(max=len(among) - 1)] == values


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    values = np.concatenate(parts)
    values.sort()
    return values[np.append(True, values[1:] != values[:-1])[:len(values)]]


def _contexts(texts: list[np.ndarray], size: int, among: np.ndarray | None, start: int) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, number of different words before it), of phrases whose first ``start`` words are ``among``."""
    parts, held = [np.zeros(0, np.uint64)], 0
    for words in texts:
        phrase = _phrases(words, size)
        last = np.concatenate([np.zeros(1, np.uint32), words])[:len(phrase)]
        if among is not None:
            ok = _in(_phrases(words, start)[:len(phrase)], among)
            phrase, last = phrase[ok], last[ok]
        parts.append(phrase << np.uint64(32) | last)
        held += len(phrase)
        if held > HELD:
            parts, held = [_distinct(parts)], 0
    return np.unique(_distinct(parts) >> np.uint64(32), return_counts=True)


def _evidence(clean: list[np.ndarray], toxic: list[np.ndarray]) -> list[np.ndarray]:
    """By size, sorted hashes of the phrases whose rate in toxic texts is RATIO times that in clean
    ones, by smoothed counts of contexts, and whose difference is more than chance."""
    words, others = sum(map(len, toxic)), sum(map(len, clean))
    if not words or not others:
        return []
    share, chance = words / (words + others), np.log(PHRASE * words)
    found, able = [], None
    for size in range(1, PHRASE + 1):
        # fewer contexts could not stand out if no clean text had the phrase; a longer one has no more
        phrases, t = _contexts(toxic, size, able, size - 1)
        enough = -t * np.log(share) >= chance
        able, t = phrases[enough], t[enough]
        if not len(able):
            break
        seen, n = _contexts(clean, size, able, size)
        c = np.zeros(len(able))
        c[np.searchsorted(able, seen)] = n
        ratio = (t + 0.5) / share / ((c + 0.5) / (1 - share))
        gain = t * np.log(t / ((t + c) * share)) + c * np.log(np.maximum(c, 1) / ((t + c) * (1 - share)))
        found.append(able[(ratio >= RATIO) & (gain >= chance)])
    return found


def _runs(text: bytes, words: np.ndarray, evidence: list[np.ndarray]) -> bytes:
    """The words of ``text`` that are evidence or lie in a phrase of it that has no such word, in order."""
    marked = np.zeros(len(words), bool)
    before = np.zeros(len(words) + 1, np.int64)
    for size, among in enumerate(evidence, 1):
        if len(among) and len(words) >= size:
            at = np.flatnonzero(_in(_phrases(words, size), among) & (before[size:] == before[:-size]))
            for k in range(size):
                marked[at + k] = True
        if size == 1:
            before[1:] = np.cumsum(marked)
    return b" ".join(w for w, m in zip((w for b in blocks(text) for w in _words(b)), marked, strict=True) if m)


def _dictionaries(clean: list[bytes], toxic: list[bytes], clean_words: list[np.ndarray],
                  toxic_words: list[np.ndarray]) -> Model:
    """``clean_words``: of the clean texts that phrases are compared with; ``toxic_words``: of ``toxic``."""
    evidence = _evidence(clean_words, toxic_words)
    runs = (_runs(t, w, evidence) for t, w in zip(toxic, toxic_words, strict=True))
    samples = [b" " + run + b" " for run in runs if run]
    if not samples:  # no phrase stands out: the toxic windows as they are
        samples = [w for t in toxic for w in _windows(t)]
        samples = samples[::max(1, len(samples) // 40_000)]
    windows = [w for t in clean for k, w in enumerate(_windows(t)) if k % 4 == 0]
    windows = windows[::max(1, len(windows) // 40_000)]
    return Model(_dictionary(windows, ORDINARY_SIZE), _dictionary(samples, TOXIC_SIZE), None)


def fit(clean: list[bytes], toxic: list[bytes], totals: tuple[int, int] | None = None) -> Model:
    """Dictionaries from all given texts; calibration on features of each half under the
    dictionaries of the other half, weighted to ``totals``, the numbers of clean and toxic rows
    that the texts stand for."""
    if not clean or not toxic:
        return Model(b"", b"", None, 1.0 if toxic else 0.0)
    toxic_words, clean_words = [[_encode(t) for t in texts] for texts in (toxic, clean)]
    measured = clean[:CALIBRATED]
    x, y = [], []
    for half in (0, 1):
        other = [t[1 - half::2] or t for t in (measured, toxic, clean_words[:CALIBRATED], toxic_words)]
        other[2] = other[2] + clean_words[CALIBRATED:]
        part = _dictionaries(*other)
        compressors = part.compressors()
        for label, texts in enumerate((measured, toxic)):
            x += [part.features(t, compressors) for t in texts[half::2]]
            y += [label] * len(texts[half::2])
    y = np.array(y, float)
    model = _dictionaries(clean, toxic, clean_words, toxic_words)
    total = totals or (len(clean), len(toxic))
    weight = np.where(y == 1, total[1] / len(toxic), total[0] / len(measured))
    model.weights = _logistic(np.array(x), y, weight / weight.mean())
    return model


def learn(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_id: str = "doc_id", label_col: str = "toxic") -> Model:
    """Fit on the bounded sample of rows of ``df`` that ``labels`` marks 0 or 1."""
    marks = labels.select(F.col(label_id).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    sizes = df.select(F.col(id_col).alias("doc_id"), F.octet_length(text_col).alias("size")).where("size IS NOT NULL")
    totals = dict(sizes.join(marks, "doc_id").groupBy("label").count().collect())
    texts: dict[int, list[bytes]] = {}
    for label in (0, 1):
        rows = (sizes.join(marks.where(F.col("label") == label), "doc_id")
                .orderBy(F.xxhash64("doc_id"), "doc_id").limit(DOCS[label]).collect())
        chosen, room = [], BYTES[label]
        for row in rows:
            if row["size"] <= room:
                chosen.append((row["doc_id"],))
                room -= row["size"]
        kind = df.schema[id_col].dataType.simpleString()
        ids = df.sparkSession.createDataFrame(sorted(set(chosen)), f"doc_id {kind}")
        found = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
        picked = found.join(F.broadcast(ids), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").toArrow()
        texts[label] = [t.as_py() for t in picked.column("text").cast(pa.large_binary())]
        del picked
    model = fit(texts.pop(0), texts.pop(1), (totals.get(0, 0), totals.get(1, 0)))
    give_back()  # the driver's Python outlives the fit
    return model


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """(doc_id, score, *more) for every row and its whole text."""
    docs = keyed(df, id_col, text_col, *more)
    extra = docs.columns[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors() if model.weights is not None else None
        for batch in sliced(batches):
            texts = [t.as_py() for t in batch.column(1).cast(pa.large_binary())]
            scores = pa.array(model.score(texts, compressors), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores, *batch.columns[2:]], ["doc_id", "score", *extra])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return docs.mapInArrow(run, ", ".join([f"doc_id {kinds['doc_id']}, score double", *(f"`{c}` {kinds[c]}" for c in extra)]))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without the rows whose score reaches THRESHOLD."""

    def decider():
        compressors = model.compressors() if model.weights is not None else None
        return lambda texts: model.score([(t or "").encode() for t in texts], compressors) < THRESHOLD

    return keep_rows(docs, text_col, decider)
