"""Language identification with bit-sliced Bloom filters of n-grams.

Each language has a Bloom filter of the n-grams of its learning texts. The filters are
stored bit-sliced: a slot holds one bit per language (a byte for every eight), so the AND of
an n-gram's HASHES slots is the set of languages that may contain it. All n-grams of a block
of texts are looked up together; the popcount of each language and text, less the false
positives that the filter's fill lets expect, decides.

Learning counts the n-grams of every text outside the held-out fold that has a language, per
language, over all data; each task counts its own texts first, so a language or source with
most rows is no hot key. A language's filter takes the TOP most frequent n-grams whose rate
in it is at least SHARE of their highest rate; that bounds the model to about TOP keys each.

Defined results: ``und`` with score 0 for a null text or one without a letter; a text whose
n-grams no filter knows, and ties, go to the language with most learning text; with no
language learned everything is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from subscope.llm.common import bounded_batches, cut, keep_rows, keyed, sliced

NONE = "und"
#: characters of an n-gram; a word's ends count as a space
SIZES = (3, 4)
#: slots of the bit-sliced filter, a power of two, and hash functions
SLOTS = 1 << 20
HASHES = 3
#: n-grams in a language's filter, and those that tie with the last of them
TOP = 40_000
#: a language's filter leaves out n-grams of other languages' passages in its texts: those whose
#: rate in it is below this share of the highest rate in any language
SHARE = 0.2
#: a filter keeps texts of which a language covers at least this share of the n-grams
COVER = 0.25
#: characters looked up at once; n-grams that a task keeps counted before it hands them on
BLOCK = 1 << 18
HELD = 500_000

_GOLDEN = 0x9E3779B97F4A7C15
_MIX = 0xBF58476D1CE4E5B9


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngrams(texts: list[str], letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, number of its text) of every n-gram, and whether each text has a letter.

    Every run of other characters is one space; n-grams hold spaces at their ends only.
    """
    codes = np.frombuffer(("\0" + "\0".join(t.lower().replace("\0", " ") for t in texts) + "\0").encode("utf-32-le"), "<u4")
    is_letter = letter[codes]
    border = codes == 0
    keep = is_letter | border
    keep[1:] |= is_letter[:-1]
    codes, inside, border = np.where(is_letter, codes, 32)[keep], is_letter[keep], border[keep]
    text = np.cumsum(border) - 1
    seen = np.zeros(len(texts) + 1, bool)
    seen[text[inside]] = True
    found, owners = [], []
    codes = codes.astype(np.uint64)
    for size in SIZES:
        n = len(codes) - size + 1
        if n <= 0:
            continue
        ok = inside[1:n + 1].copy()
        for k in range(2, size - 1):
            ok &= inside[k:n + k]
        at = np.flatnonzero(ok)
        h = np.full(len(at), size, np.uint64)
        for k in range(size):
            h = (h ^ codes[at + k]) * np.uint64(_GOLDEN)
            h ^= h >> np.uint64(29)
        h *= np.uint64(_MIX)
        found.append(h ^ (h >> np.uint64(32)))
        owners.append(text[at + 1])
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), seen[:-1]
    return np.concatenate(found), np.concatenate(owners), seen[:-1]


def _slots(h: np.ndarray) -> Iterator[np.ndarray]:
    for k in range(HASHES):
        yield ((h >> np.uint64(20 * k)) & np.uint64(SLOTS - 1)).astype(np.int64)


def _parts(texts: list[str]) -> Iterator[tuple[list[str], list[int]]]:
    """Whole texts together up to BLOCK characters; a longer one in parts that end at a space."""
    group, numbers, total = [], [], 0
    for number, text in enumerate(texts):
        start = 0
        while start < len(text) or not start:
            end = len(text)
            if end - start > BLOCK:
                end = text.rfind(" ", start + 1, start + BLOCK)
                end = start + BLOCK if end < 0 else end
            if group and total + end - start > BLOCK:
                yield group, numbers
                group, numbers, total = [], [], 0
            group.append(text[start:end])
            numbers.append(number)
            total += end - start
            if end >= len(text):
                break
            start = end
    if group:
        yield group, numbers


@dataclass
class Model:
    languages: list[str]  # by falling learning text, so that ties go to the first
    slices: list[np.ndarray]  # a byte per slot for every eight languages
    false_positive: np.ndarray

    @classmethod
    def build(cls, keys: dict[str, np.ndarray], languages: list[str]) -> Model:
        slices = [np.zeros(SLOTS, np.uint8) for _ in range(-(-len(languages) // 8))]
        fill = []
        for k, language in enumerate(languages):
            part, bit = slices[k // 8], np.uint8(1 << k % 8)
            for at in _slots(keys[language]):
                part[at] |= bit
            fill.append(np.count_nonzero(part & bit) / SLOTS)
        return cls(languages, slices, np.array(fill) ** HASHES)

    def counts(self, texts: list[str], letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hits by text and language, n-grams, whether a letter occurs)."""
        hits = np.zeros((len(texts), 8 * len(self.slices)), np.int64)
        total, lettered = np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
        bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
        for group, numbers in _parts(texts):
            h, owner, seen = ngrams(group, letter)
            numbers = np.array(numbers)
            np.add.at(total, numbers, np.bincount(owner, minlength=len(group)))
            np.logical_or.at(lettered, numbers, seen)
            for k, part in enumerate(self.slices):
                mask = np.bitwise_and.reduce([part[at] for at in _slots(h)])
                popcounts = np.bincount(owner * 256 + mask, minlength=256 * len(group)).reshape(-1, 256) @ bits
                np.add.at(hits[:, 8 * k:8 * k + 8], numbers, popcounts)
        return hits[:, :len(self.languages)], total, lettered

    def predict(self, texts: list[str], letter: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, share of the corrected counts, share of the n-grams it covers)."""
        hits, total, lettered = self.counts(texts, letter)
        if not self.languages:
            zero = np.zeros(len(texts))
            return [NONE] * len(texts), zero, zero
        true = np.maximum((hits - total[:, None] * self.false_positive) / (1 - self.false_positive), 0)
        best = true.argmax(1)
        most = true[np.arange(len(texts)), best]
        score = np.where(lettered, most / np.maximum(true.sum(1), 1e-12), 0.0)
        cover = np.clip(most / np.maximum(total, 1), 0, 1)
        names = [self.languages[b] if ok else NONE for b, ok in zip(best, lettered, strict=True)]
        return names, np.clip(score, 0, 1), np.where(lettered, cover, 0.0)


def ngram_counts(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, gram, n): counts over all rows of ``df`` that have a text and a language."""
    df = bounded_batches(df).where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter = letters()
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, (grams, n) in held.items():
                names = pa.array([lang]).take(pa.array(np.zeros(len(grams), np.int32)))
                yield pa.RecordBatch.from_arrays([names, pa.array(grams.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])
            held.clear()

        for batch in sliced(batches):
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                for group, _ in _parts(texts):
                    grams, n = np.unique(ngrams(group, letter)[0], return_counts=True)
                    if lang in held:
                        both = np.concatenate([held[lang][0], grams])
                        grams, at = np.unique(both, return_inverse=True)
                        n = np.bincount(at, np.concatenate([held[lang][1], n]), len(grams)).astype(np.int64)
                    held[lang] = grams, n.astype(np.int64)
                    if sum(len(g) for g, _ in held.values()) > HELD:
                        yield from rows()
        yield from rows()

    return df.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, top: int) -> DataFrame:
    """Rows (lang, gram, n) of the ``top`` highest counts of each language, by histograms: no task orders
    a language. Counts are ordered by levels, 32 to a doubling, the last level's n-grams by the upper 16
    bits of their hashes; those equal to the last one are kept too."""
    level, bucket = F.floor(F.log2("n") * 32), F.shiftrightunsigned("gram", 48)

    def cuts(rows: DataFrame, key: Column, room: dict[str, int] | None, falling: bool) -> dict[str, tuple[int, int]]:
        """Language -> the value of ``key`` at which its room is used up, and the room before it."""
        found: dict[str, tuple[int, int]] = {}
        left = {} if room is None else dict(room)
        hist = rows.groupBy("lang", key.alias("key")).count().collect()
        for r in sorted(hist, key=lambda r: -r["key"] if falling else r["key"]):
            before = left.get(r["lang"], top)
            left[r["lang"]] = before - r["count"]
            if before - r["count"] < 0 and r["lang"] not in found:
                found[r["lang"]] = r["key"], before
        return found

    spark = counts.sparkSession
    full = cuts(counts, level, None, True)
    if not full:
        return counts
    at = spark.createDataFrame([(k, v[0]) for k, v in full.items()], "lang string, last long")
    known = counts.join(F.broadcast(at), "lang", "left")
    edge = cuts(known.where(level == F.col("last")), bucket, {k: v[1] for k, v in full.items()}, False)
    to = spark.createDataFrame([(k, v[0] if full[k][1] else -1) for k, v in edge.items()], "lang string, edge long")
    kept = F.col("last").isNull() | (level > F.col("last")) | ((level == F.col("last")) & (bucket <= F.col("edge")))
    return known.join(F.broadcast(to), "lang", "left").where(kept).select("lang", "gram", "n")


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP) -> Model:
    """Fit on every row of ``df`` with a text and a language."""
    counts = cut(ngram_counts(df, text_col, lang_col))
    counts = counts.join(counts.groupBy("lang").agg(F.sum("n").alias("all")), "lang").withColumn("rate", F.col("n") / F.col("all"))
    own = counts.withColumn("peak", F.max("rate").over(Window.partitionBy("gram"))).where(F.col("rate") >= SHARE * F.col("peak"))
    rows = most_frequent(cut(own.select("lang", "gram", "n")), top).groupBy("lang").agg(F.sum("n").alias("n"), F.collect_list("gram").alias("grams")).collect()
    keys = {r["lang"]: np.array(r["grams"], np.int64).view(np.uint64) for r in rows}
    weight = {r["lang"]: r["n"] for r in rows}
    return Model.build(keys, sorted(keys, key=lambda x: (-weight[x], x)))


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """(doc_id, lang_pred, score, cover, *more) for every row."""
    docs = keyed(df, id_col, text_col, *more)
    extra = docs.columns[2:]
    shared = df.sparkSession.sparkContext.broadcast((model.languages, model.slices, model.false_positive))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter, model = letters(), Model(*shared.value)
        for batch in sliced(batches):
            names, score, cover = model.predict(batch.column(1).to_pylist(), letter)
            arrays = [batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(cover)]
            yield pa.RecordBatch.from_arrays([*arrays, *batch.columns[2:]], ["doc_id", "lang_pred", "score", "cover", *extra])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = f"doc_id {kinds['doc_id']}, lang_pred string, score double, cover double"
    return docs.mapInArrow(run, ", ".join([schema, *(f"`{c}` {kinds[c]}" for c in extra)]))


def keep_language(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without texts that are in no learned language: those without a letter
    and those of whose n-grams the best language covers less than COVER."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.slices, model.false_positive))

    def decider():
        letter, model = letters(), Model(*shared.value)

        def decide(texts):
            names, _, cover = model.predict([t or "" for t in texts], letter)
            return np.array([n != NONE for n in names], bool) & (cover >= COVER)

        return decide

    return keep_rows(docs, text_col, decider)
