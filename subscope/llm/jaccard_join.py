"""Documents linked by the Jaccard similarity of their word shingles, with adaptive multi-match prefixes.

Documents of equal shingle sets are one class. Every class orders its shingles from rare to frequent, by
counts of a sketch of all classes. Two sets that reach the similarity share at least m shingles of the first
n - ceil(similarity * n) + m of either, for any m. So each class lengthens its prefix as long as that lowers
its estimated cost (postings to send, and candidates to verify: their bound falls with m), and a pair is
verified only if it shares the smaller of the two m, and more where the sizes ask for more (``_matches``). Only prefixes are sent, as (shingle, class) postings,
and of those only shingles that two classes or more have.

Only components are asked for, so no group of near copies is paired with itself: each list first links to
its smallest member; lists of at most LIGHT classes then pair what is still in different components. In a
longer list, what lies outside the list's main component is compared with pivots from it, and what then
still lies outside with all that its counts of matches allow. At the end no pair that could reach the similarity is left untested but
within one component.

Defined results: lower-casing is of A-Z only, words are runs of anything but ASCII white space. A text with
fewer words than a shingle has is one shingle; without words it has none, and its component is its own id. A
null text is empty. Repeated rows come out once each. A null id counts as larger than any other when a
component's smallest id is taken. An empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from subscope.llm.common import (SALTS, blocks, cut, give_back, id_slot, keyed, lookup, narrowed, sliced, slot_bitmap,
                                 with_membership, without)
from subscope.llm.components import components
from subscope.llm.prefix_trie import ROWS, repeated_slots

WORDS, PERCENT = 5, 80
#: longest list of classes whose pairs are taken directly
LIGHT = 64
#: most matches that a prefix may be lengthened for
MATCHES = 8
#: shingles a slot of the frequency sketch holds on average, and its least and most slots as powers of two (8 MB)
PER_SLOT, MIN_BITS, MAX_BITS = 8, 16, 22
#: slots for each posting in a row of the sketch that screens them, and its most slots as a power of two (64 MB in all)
SCREEN_SLOTS, SCREEN_BITS = 4, 28
#: partners of one class whose sets meet in one task
PARTNERS = 256
#: whole sets, or pairs of them, that a task takes where they are few
SETS = 2000
#: slots that a task holds before it sends their counts
HELD = 1 << 22
#: members of a long list's main component that all outside it meet first
PIVOTS = 16
_CHUNK = 16
_MULTIPLIERS = [xxhash.xxh64_intdigest(str(i)) | 1 for i in range(256)]


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    found = [np.fromiter(map(xxhash.xxh64_intdigest, block.lower().split()), np.uint64) for block in blocks(text)]
    hashes = np.concatenate([np.zeros(0, np.uint64), *found])
    size = min(words, len(hashes))
    if not size:
        return hashes
    total = np.full(len(hashes) - size + 1, size, np.uint64)
    for i in range(size):
        total += hashes[i:len(hashes) - size + 1 + i] * np.uint64(_MULTIPLIERS[i])
    total ^= total >> np.uint64(33)
    total *= np.uint64(_MULTIPLIERS[-1])
    total ^= total >> np.uint64(29)
    return np.unique(total)


def _class(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).view(np.int64))


def _each_set(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in sliced(batches):
        yield batch, [shingles(t.as_py(), words) for t in batch.column(1).cast(pa.large_binary())]


def classes(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, c): size and class of each document's set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _each_set(batches, words):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                                              pa.array([_class(s) for s in sets], pa.int64())], ["doc_id", "n", "c"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, c long")


def frequencies(docs: DataFrame, words: int, bits: int) -> np.ndarray:
    """Counts of all shingles by the low ``bits`` bits of their hashes, capped at 65535: 2 ** (bits + 1) bytes."""
    mask = np.uint64((1 << bits) - 1)

    def line(chunk: int, slot: np.ndarray, times: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
        """Slots met once are listed, or where they are many, marked in a bitmap; the others have their counts."""
        once, more = slot[times == 1].astype("<u2"), times > 1
        if len(once) > 1 << (_CHUNK - 4):
            marks = np.zeros(1 << _CHUNK, np.uint8)
            marks[once] = 1
            once = np.packbits(marks)
        return chunk, once.tobytes(), slot[more].astype("<u2").tobytes(), times[more].tobytes()

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def sent() -> pa.RecordBatch:
            slot, times = np.unique(np.concatenate(held), return_counts=True)
            times = np.minimum(times, 65535).astype("<u2")
            cuts = np.flatnonzero(np.diff(slot >> _CHUNK)) + 1
            lines = [line(int(s[0] >> _CHUNK), s & 0xFFFF, t) for s, t in zip(np.split(slot, cuts), np.split(times, cuts), strict=True)]
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*lines, strict=True), kinds, strict=True)],
                                              ["chunk", "once", "more", "times"])

        for _, sets in _each_set(batches, words):
            held += [(s & mask).astype(np.uint32) for s in sets]
            size += sum(map(len, sets))
            if size >= HELD:
                yield sent()
                held, size = [], 0
        if size:
            yield sent()

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << _CHUNK, np.int64)
        for once, more, times in zip(part.once, part.more, part.times, strict=True):
            if len(once) == 1 << (_CHUNK - 3):  # a bitmap; a list is shorter or has one slot more
                total += np.unpackbits(np.frombuffer(once, np.uint8))
            else:
                total[np.frombuffer(once, "<u2")] += 1
            total[np.frombuffer(more, "<u2")] += np.frombuffer(times, "<u2")
        return pd.DataFrame({"chunk": part.chunk[:1], "counts": [np.minimum(total, 65535).astype("<u2").tobytes()]})

    out = np.zeros(1 << bits, "<u2")
    merged = docs.mapInArrow(slots, "chunk int, once binary, more binary, times binary").groupBy("chunk")
    for r in merged.applyInPandas(merge, "chunk int, counts binary").collect():  # at most 2 ** (bits - 16) rows
        out[r["chunk"] << _CHUNK:(r["chunk"] + 1) << _CHUNK] = np.frombuffer(r["counts"], "<u2")
    give_back()
    return out


def prefix(hashes: np.ndarray, counts: np.ndarray, noise: float, percent: int) -> tuple[int, np.ndarray]:
    """(m, shingles of the prefix): the number of matches asked for and the prefix that warrants it."""
    n = len(hashes)
    seen = counts[(hashes & np.uint64(len(counts) - 1)).astype(np.int64)].astype(np.float64)
    order = np.argsort(seen, kind="stable")  # equal counts: by hash
    others = np.maximum(seen[order] - 1 - noise, 0)
    needed = -(-percent * n // 100)
    m = np.arange(1, min(MATCHES, needed) + 1)
    read = np.cumsum(others)[n - needed + m - 1]
    cost = (n - needed + m) + read + (4 + n / 64) * read / m  # postings sent and met, candidates verified
    best = int(m[cost.argmin()])
    return best, hashes[order[:n - needed + best]]


def prefixes(docs: DataFrame, words: int, percent: int, counts: np.ndarray, noise: float) -> DataFrame:
    """(id, c, n, m, tokens) of every document with words."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # bounded by MAX_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _each_set(batches, words):
            some = [i for i, s in enumerate(sets) if len(s)]
            found = [prefix(sets[i], shared.value, noise, percent) for i in some]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(some, pa.int64())), pa.array([_class(sets[i]) for i in some], pa.int64()),
                pa.array([len(sets[i]) for i in some], pa.int64()), pa.array([m for m, _ in found], pa.int64()),
                pa.array([t.view(np.int64) for _, t in found], pa.list_(pa.int64()))], ["id", "c", "n", "m", "tokens"])

    out = cut(docs.mapInArrow(run, f"id {docs.schema['doc_id'].dataType.simpleString()}, c long, n long, m long, tokens array<long>"))
    shared.destroy()
    return out


def _screened(found: DataFrame) -> DataFrame:
    """``found`` with the tokens that a count-min sketch of all prefixes does not prove to be the only ones
    of their kind; rows without any are left out."""
    total = found.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0]
    bits = min(SCREEN_BITS, max(MIN_BITS, (SCREEN_SLOTS * total).bit_length()))
    chunks = repeated_slots(found.select(F.explode("tokens")), bits).collect()  # at most 2 ** (bits - 16) rows a hash row
    more = np.zeros((ROWS << bits) // 8, np.uint8)
    for r in chunks:
        more[r["chunk"] << 13:(r["chunk"] + 1) << 13] = np.frombuffer(r["bits"], np.uint8)
    del chunks
    shared = found.sparkSession.sparkContext.broadcast(more)  # bounded by SCREEN_BITS
    del more
    give_back()
    mask = np.uint64((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            tokens = batch.column(4)
            h = tokens.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(batch.num_rows), tokens.value_lengths().to_numpy(zero_copy_only=False))
            maybe = np.ones(len(h), bool)
            for r in range(ROWS):
                slot = ((h.view(np.uint64) >> np.uint64(32 * r)) & mask).astype(np.int64) + (r << bits)
                maybe &= (shared.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
            left = np.bincount(owner[maybe], minlength=batch.num_rows)
            kept = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *left]), pa.int32()), pa.array(h[maybe]))
            out = pa.RecordBatch.from_arrays([*batch.columns[:4], kept], ["id", "c", "n", "m", "tokens"])
            yield out.filter(pa.array(left > 0))

    out = cut(found.mapInArrow(run, f"id {found.schema['id'].dataType.simpleString()}, c long, n long, m long, tokens array<long>"))
    shared.destroy()
    return out


def postings(found: DataFrame, light: int) -> DataFrame:
    """(c, id, n, m, tokens, times, posted, heavy), one row per class: the prefix tokens that several classes have,
    with the lengths of their lists; ``posted``: their number, ``heavy``: those in lists longer than ``light``."""
    rows = _screened(found)
    if rows.groupBy("c").count().where("count > 1").take(1):  # repeated rows: one posting
        rows = cut(rows.groupBy("c", "n", "m").agg(F.min("id").alias("id"), F.first("tokens").alias("tokens")))
    flat = rows.select("c", F.explode("tokens").alias("token"))
    lists = cut(flat.groupBy("token").agg(F.count("*").alias("times")).where("times > 1"))
    total = lists.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    shared = lookup(flat, ["token"], lists, "times", total).where("times IS NOT NULL")
    shared = shared.groupBy("c").agg(F.collect_list(F.struct("token", "times")).alias("list"))  # a class's own prefix
    return cut(rows.drop("tokens").join(shared, "c").select(
        "c", "id", "n", "m", F.col("list.token").alias("tokens"), F.col("list.times").alias("times"), F.size("list").alias("posted"),
        F.size(F.filter("list", lambda x: x["times"] > light)).alias("heavy")))


def _each(rows: DataFrame, *more: str) -> DataFrame:
    """The classes' postings: (token, times, c, id, n, m, posted, heavy, *more)."""
    return rows.select(F.explode(F.arrays_zip("tokens", "times")).alias("x"), "c", "id", "n", "m", "posted", "heavy", *more).select(
        F.col("x.tokens").alias("token"), F.col("x.times").alias("times"), "c", "id", "n", "m", "posted", "heavy", *more)


def _matches(percent: int) -> Column:
    """Prefix tokens that a and b must share. The set whose prefix ends first in the common order shares no
    prefix token but those, so its overlap is at most their number and the rest of the set."""
    overlap = F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent))
    rest = [F.ceil(percent * F.col(f"n{x}") / 100) - F.col(f"m{x}") for x in "ab"]
    return F.greatest(overlap - F.greatest(*rest), F.least("ma", "mb"))


def _fits(percent: int, lists: str) -> Column:
    """Sizes, and numbers of ``lists`` that a and b are in, with which they can reach the similarity."""
    return (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (F.least(f"{lists}a", f"{lists}b") >= _matches(percent))


class _Sets:
    """Whole sets of the classes in candidate pairs, and the pairs that reach the similarity."""

    def __init__(self, docs: DataFrame, words: int, percent: int):
        self.docs, self.words, self.percent = docs, words, percent

    def of(self, wanted: DataFrame) -> DataFrame:
        """(c, hashes) of the classes in ``wanted`` (id, c): their documents are read again."""
        words = self.words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, sets in _each_set(batches, words):
                yield pa.RecordBatch.from_arrays([pa.array([_class(s) for s in sets], pa.int64()),
                                                  pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["c", "hashes"])

        ids = slot_bitmap(wanted.select(id_slot("id").alias("slot")))
        docs = with_membership(self.docs, id_slot("doc_id"), ids, "maybe").where("maybe").select("doc_id", "text")
        sets = docs.mapInArrow(run, "c long, hashes array<long>")
        return sets.join(wanted.select("c").distinct(), "c", "left_semi").dropDuplicates(["c"])

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a, ida, b, idb; a may be in very many) that reach the similarity, as (a, b)."""
        pairs = cut(pairs)
        total = pairs.count()
        pairs = narrowed(pairs, total)
        if not total:
            return pairs.select("a", "b")
        # a class with very many partners has its set in several tasks
        partners = cut(narrowed(pairs.groupBy("a").agg(F.count("*").alias("n")), total).where(F.col("n") > PARTNERS))
        if partners.take(1):
            pairs = lookup(pairs, ["a"], partners, "n", total)
        else:
            pairs = pairs.withColumn("n", F.lit(0))
        pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.coalesce("n", F.lit(0)) / PARTNERS) + 1)).drop("n")
        ends = [pairs.select(F.col(f"id{x}").alias("id"), F.col(x).alias("c")) for x in "ab"]
        sets = cut(narrowed(self.of(ends[0].unionByName(ends[1])), 2 * total, SETS))
        left = narrowed(pairs.select("a", "salt").distinct().join(sets.toDF("a", "ha"), "a"), total, SETS)
        both = narrowed(pairs.select("a", "b", "salt").join(sets.toDF("b", "hb"), "b"), total, SETS).join(left, ["a", "salt"])
        same = F.size(F.array_intersect("ha", "hb"))
        same = both.where(100 * same >= self.percent * (F.size("ha") + F.size("hb") - same)).select("a", "b")
        return cut(narrowed(same, total, SETS))


def _pairs(a: DataFrame, b: DataFrame, percent: int, lists: str, light: int) -> DataFrame:
    """Pairs from lists: rows of ``a`` (few in a list) with those of ``b`` in another component that fit, and
    the number of lists they share. A list of ``b`` is dealt to a task for each ``light`` of its rows, SALTS at most."""
    salts = F.least(F.ceil(F.col("times") / light), F.lit(SALTS)).cast("int")
    a = a.select("token", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), *[F.col(x).alias(f"{x}a") for x in _MEMBER])
    b = b.select("token", F.pmod(F.xxhash64("c"), salts).cast("int").alias("salt"), *[F.col(x).alias(f"{x}b") for x in _MEMBER])
    met = a.join(b, ["token", "salt"]).where((F.col("rootb") != F.col("roota")) & _fits(percent, lists))
    return _counted(met, percent)


_MEMBER = ["c", "id", "n", "m", "posted", "heavy", "root"]


def _counted(met: DataFrame, percent: int) -> DataFrame:
    return met.groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(
        F.count("*").alias("shared"), F.first("ida").alias("ida"), F.first("idb").alias("idb"),
        F.first(_matches(percent)).alias("matches"), F.first(F.least("heavya", "heavyb")).alias("heavy"))


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows``, one per class, with ``root``, the component of their class by ``roots`` (node, root)."""
    return rows.join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))


def _joined(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """Components of those in ``roots`` (node, root) and new ``edges``: each is a star already, so few rounds join them."""
    if not edges.take(1):
        return roots
    return components(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(edges))


def links(found: DataFrame, sets: _Sets, percent: int = PERCENT, light: int = LIGHT, pivots: int = PIVOTS) -> DataFrame:
    """(node, root): one row per class that is not the smallest of its component by all links, with that smallest class."""
    rows = postings(found, light)
    # every list's smallest id, with the rest of the list
    each = _each(rows).withColumn("root", F.col("c"))
    first = each.groupBy("token", "times").agg(F.min(F.struct(F.coalesce("id", F.lit((1 << 63) - 1)), *_MEMBER)).alias("first"))
    star = _pairs(first.select("token", "times", "first.*"), each, percent, "posted", light)
    roots = components(sets.links(star.where("shared >= matches")))

    # short lists: pairs still in different components; long lists may hold some of their matches
    short = _each(_rooted(rows, roots), "root").where(F.col("times") <= light).groupBy("token").agg(F.sort_array(F.collect_list(F.struct(*_MEMBER))).alias("list"))
    short = short.where(F.array_max("list.root") != F.array_min("list.root"))
    short = short.select("token", "list", F.explode("list").alias("x")).select("token", "x", F.explode("list").alias("y"))
    short = short.where("x.c < y.c AND x.root <> y.root").select(
        *[F.col(f"x.{k}").alias(f"{k}a") for k in _MEMBER], *[F.col(f"y.{k}").alias(f"{k}b") for k in _MEMBER])
    short = _counted(short.where(_fits(percent, "posted")), percent)
    roots = _joined(roots, sets.links(short.where("shared >= greatest(1, matches - heavy)")))

    # long lists: what lies outside a list's main component with some of it, then with all of the list. A pair
    # that shares a short list too has been tested, so the long ones hold all matches of those that are left
    long = rows.where("heavy > 0")
    for last in (False, True) if long.take(1) else ():
        now = cut(_each(_rooted(long, roots), "root").where(F.col("times") > light))
        main = now.groupBy("token", "root").count().groupBy("token").agg(
            F.max(F.struct("count", "root")).alias("main"), F.sum("count").alias("all"))
        main = main.where("main.count < all").select("token", F.col("main.root").alias("main"))  # not settled yet
        outside = now.join(main, "token").where("root <> main")
        if last:
            pairs = _pairs(outside, now.join(main, "token", "left_semi"), percent, "heavy", light)
        else:
            order = Window.partitionBy("token").orderBy(F.xxhash64("c"), "c")
            chosen = now.join(main, "token").where("root = main").withColumn("nth", F.row_number().over(order))
            pairs = _pairs(chosen.where(F.col("nth") <= pivots), outside, percent, "heavy", light)
        roots = _joined(roots, sets.links(pairs.where("shared >= matches")))
    return roots


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                       percent: int = PERCENT, light: int = LIGHT, pivots: int = PIVOTS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id reachable by links)."""
    docs = keyed(df, id_col, text_col)
    rows = cut(classes(docs, words))
    least = cut(rows.where("n > 0").groupBy("c", "n").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")))
    total = rows.count()
    # documents read again: of each class the smallest id
    stays = lookup(rows.where("n > 0"), ["c"], least.select("c", "least", "rows"), "rows", total)
    stays = stays.groupBy("doc_id").agg(F.max(F.col("doc_id").eqNullSafe(F.col("least"))).alias("stays"))
    docs = without(docs, stays.where("NOT stays").select("doc_id"), "doc_id")
    size = least.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = min(MAX_BITS, max(MIN_BITS, (size // PER_SLOT).bit_length()))
    found = prefixes(docs, words, percent, frequencies(docs, words, bits), size / (1 << bits))
    roots = links(found, _Sets(docs, words, percent), percent, light, pivots).withColumnRenamed("node", "c")
    tree = least.join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    ids = tree.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    tree = cut(lookup(tree, ["root"], ids, "members", total).select("c", "rows", "component_id"))
    linked = lookup(rows.where("n > 0"), ["c"], tree, "rows", total)
    alone = rows.where("n = 0").withColumn("component_id", F.col("doc_id"))
    out = [F.col("doc_id"), F.col("n").alias("n_shingles"), F.col("component_id")]
    return linked.select(*out).unionByName(alone.select(*out))
