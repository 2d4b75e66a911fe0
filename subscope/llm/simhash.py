"""SimHash near-duplicates by multi-index hashing.

Fingerprints: XXH64 (seed 42) of every WORDS-word shingle, repeats included; a bit is set
if more than half of the hashes set it. Candidates: the 64 bits are cut in two segments of
32. Two fingerprints within ``distance`` (at most 3) bits differ by at most one bit in one
of them, so each distinct fingerprint probes its segment value and the 32 values one flip
away in a table of exact segment values, and the whole distance is verified.

A segment value that more than HEAVY fingerprints share would pair them all. Their
fingerprints are linked without pairs instead: every fingerprint within one bit of a centre
is within three of every one within two bits of it, so all of them are linked to the least
fingerprint within one bit; over all centres that finds exactly the links of distance three
or less, in rows proportional to the fingerprints.

Defined results: a null text is empty; a text without words has fingerprint zero and links
like any other. Repeated rows come out once each. A null id is returned and counts as larger
than any other when the smallest id of a component is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subscope.llm.common import blocks, cut, keyed, salted_lookup, without
from subscope.llm.components import components

WORDS = 3
DISTANCE = 3
#: fingerprints that may share one segment value before they are linked by centres
HEAVY = 256
_SEED = 42


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Unsigned 64-bit SimHash of UTF-8 ``text``; words are taken block by block."""
    digest = xxhash.xxh64_intdigest
    total, ones, rest = 0, np.zeros(64, np.int64), []
    for block in blocks(text):
        rest = rest + block.lower().split()  # both treat ASCII only
        if len(rest) < words:
            continue
        shingles = map(b" ".join, zip(*(rest[i:] for i in range(words)), strict=False))
        n = len(rest) - words + 1
        hashes = np.fromiter((digest(s, _SEED) for s in shingles), "<u8", n)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        total += n
        rest = rest[n:]
    if not total:
        return digest(b" ".join(rest), _SEED) if rest else 0
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""
    docs = keyed(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in texts), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, fp long")


def _ball(center: Column, bits: int, radius: int) -> Column:
    """All values within ``radius`` flips of the lowest ``bits`` bits, as an array."""
    masks = [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(bits), r)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    return F.transform(F.lit(signed).cast("array<bigint>"), lambda m: m.bitwiseXOR(center))


def links(prints: DataFrame, distance: int = DISTANCE, heavy: int = HEAVY) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect exactly those that a
    chain of links of ``distance`` or fewer bits connects."""
    if not 0 <= distance <= 3:
        raise ValueError("two segments with one flip each find distances up to 3")
    low, high = F.col("fp").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("fp", 32)
    halves = prints.select("fp", F.posexplode(F.array(low, high)).alias("segment", "value"))
    shared = halves.groupBy("segment", "value").count().where(F.col("count") > heavy).drop("count")
    probes = prints.select("fp", F.posexplode(F.array(_ball(low, 32, 1), _ball(high, 32, 1))).alias("segment", "near"))
    probes = probes.select(F.col("fp").alias("a"), "segment", F.explode("near").alias("value"))
    table = halves.join(shared, ["segment", "value"], "left_anti").withColumnRenamed("fp", "b")
    pairs = probes.join(table, ["segment", "value"]).where(
        (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)).select("a", "b")
    # everything within a flip of a crowded value probes it, and goes by centres
    around = shared.select("segment", F.explode(_ball(F.col("value"), 32, 1)).alias("value")).distinct()
    crowd = cut(halves.join(around, ["segment", "value"], "left_semi").select("fp").distinct())
    return pairs.unionByName(_by_centres(crowd, distance))


def _by_centres(crowd: DataFrame, distance: int) -> DataFrame:
    """Star edges through centres: all within ceil(distance / 2) of a centre to the least within floor."""
    inner, outer = distance // 2, distance - distance // 2
    near = crowd.select("fp", F.explode(_ball(F.col("fp"), 64, inner)).alias("centre"))
    least = near.groupBy("centre").agg(F.min("fp").alias("a"))
    far = crowd.select(F.col("fp").alias("b"), F.explode(_ball(F.col("fp"), 64, outer)).alias("centre"))
    return far.join(least, "centre").where("a <> b").select("a", "b").distinct()


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   words: int = WORDS, distance: int = DISTANCE, heavy: int = HEAVY) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest reachable doc_id)."""
    rows = cut(fingerprints(df, id_col, text_col, words))
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    roots = components(links(prints.select("fp"), distance, heavy))
    prints = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    prints = prints.select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    ids = prints.groupBy("root").agg(F.min("least_id").alias("component_id"))
    found = salted_lookup(prints.select("fp", "root"), ["root"], F.col("fp"), ids).select("fp", "component_id")
    return salted_lookup(rows, ["fp"], F.col("doc_id"), found).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with the smallest id of each component. Rows of one id are one
    document: they stay if any of them has its component's smallest id."""
    groups = simhash_groups(docs, id_col, text_col)
    first = F.max(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return without(docs, groups.groupBy("doc_id").agg(first.alias("first")).where("NOT first").select("doc_id"), id_col)
