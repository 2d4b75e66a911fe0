"""Exact deduplication by progressive refinement, in DataFrame functions only.

Three levels, each over the rows that the one before left open: equal length, equal
hash of the first PREFIX characters, equal SHA-256 of the whole text. The first two run
on a slim frame of (length, prefix hash) taken in one scan; which rows survive travels to
the second scan as fixed-size bitmaps, so the whole text is hashed only for survivors and
never shuffled.

Defined results: a null text is the empty text; texts are compared unchanged. Of equal
texts the row with the largest id stays; a null id is smaller than any other. Rows that
repeat both id and text count one by one in ``group_size`` and exactly one of them is
kept. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subscope.llm.common import SLOTS, cut, free, id_slot, keyed, salted_lookup, slot_bitmap, with_membership, without

#: characters whose hash makes the second level
PREFIX = 256


def _length_slot() -> Column:
    return F.pmod(F.col("length").cast("long"), F.lit(SLOTS))


def _prefix_slot() -> Column:
    return F.pmod(F.xxhash64("length", "prefix_hash"), F.lit(SLOTS))


def _repeated(df: DataFrame, slot: Column) -> DataFrame:
    """Bitmap of the slots that hold two rows or more."""
    return slot_bitmap(df.groupBy(slot.alias("slot")).count().where("count > 1"))


def survivors(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, open): false where length or prefix hash already rules out any equal text."""
    docs = keyed(df, id_col, text_col).withColumns({
        "length": F.octet_length("text"),
        "prefix_hash": F.xxhash64(F.substring("text", 1, PREFIX)),
    })
    slim = cut(docs.select("length", "prefix_hash"))
    by_length = _repeated(slim, _length_slot())
    open_1 = with_membership(slim, _length_slot(), by_length, "open").where("open").drop("open")
    by_prefix = _repeated(open_1, _prefix_slot())
    return with_membership(docs, _prefix_slot(), by_prefix, "open").select("doc_id", "text", "open")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept.

    ``extra``: further columns computed from ``text`` in the scan that hashes it.
    """
    extra = extra or {}
    rows = cut(survivors(df, id_col, text_col).select(
        "doc_id", F.when(F.col("open"), F.unhex(F.sha2("text", 256))).alias("full_hash"),
        *[c.alias(n) for n, c in extra.items()]))
    single = rows.where("full_hash IS NULL").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), *extra)
    # repeats of one (text, id) become one row with a count, so each comes out again and one is kept
    opened = rows.where("full_hash IS NOT NULL").groupBy("full_hash", "doc_id").agg(
        F.count("*").alias("times"), *[F.first(n).alias(n) for n in extra])
    groups = (opened.groupBy("full_hash")
              .agg(F.max("doc_id").alias("keep_id"), F.sum("times").alias("group_size")))
    copies = salted_lookup(opened, ["full_hash"], F.col("doc_id"), groups).select(
        "doc_id", "keep_id", "group_size", *extra, F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("nth"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)
    return single.unionByName(copies.withColumn("kept", kept).drop("nth"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with one row of each group of equal texts."""
    full_hash = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    found = cut(exact_dedup(docs, id_col, text_col, {"text_hash": F.sha2("text", 256)}).where("NOT kept"))
    gone = found.select("doc_id", "text_hash")
    # rows that repeat the kept row's id too: all of them leave above, and one comes back
    key, value, maybe = (free(docs, c) for c in ("_id", "_hash", "_llm_maybe"))
    twice = found.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id", "text_hash").distinct().toDF(key, value)
    same = F.col(id_col).eqNullSafe(F.col(key)) & (full_hash == F.col(value))
    again = with_membership(docs, id_slot(id_col), slot_bitmap(twice.select(id_slot(key).alias("slot"))), maybe)
    again = again.where(maybe).join(twice, same, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
    return without(docs, gone, id_col, full_hash).unionByName(again.dropDuplicates([id_col, text_col]))
