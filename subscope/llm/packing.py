"""Packing of document pieces into sequences of at most CAPACITY tokens, by linear grouping.

Only histograms reach the driver: at most CAPACITY numbers each, whatever the data.
1. Pieces longer than SMALL_SHARE of the capacity, in order of falling length, form GROUPS groups of equal size,
   each rounded up to its longest length. Configurations of these few sizes come from the
   cutting-stock linear program (column generation with a knapsack), rounded down, and
   best-fit decreasing for what rounding leaves.
2. Real pieces take the places of their group's size: a piece's rank among the large ones
   decides its sequence.
3. The room that is really left in each sequence, as a histogram, is filled with the small
   pieces by best fit in falling length; new sequences open only where nothing fits.
Ranks come from counts per (length, bucket) and a row number inside each bucket, so a length
that a third of all pieces share is still dealt to BUCKETS tasks.

Defined results: a null text is empty and has the end id alone; a null or repeated doc_id is
packed like any other row; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from subscope.llm.common import cut, keyed, per_worker, sliced
from subscope.llm.word_bpe import Encoder

CAPACITY = 2048
#: id after the last token of every document
END = 0
#: share of the capacity up to which a piece is small: just under half, so that pairs of large
#: pieces are still configured while most of the mass fits by its real length
SMALL_SHARE = 15 / 32
#: equal-cardinality groups of large pieces
GROUPS = 64
#: buckets over which the pieces of one length are ranked
BUCKETS = 256


def pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
           capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids themselves."""
    docs = keyed(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker(f"word_bpe {tokenizer}", lambda: Encoder(tokenizer))
        end = np.array([END], "<u4").tobytes()
        for batch in sliced(batches):
            rows, cols = [], ([], [], [], [], [])
            for row, text in enumerate(batch.column(1)):
                ids = encoder.encode(text.as_py()) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    rows.append(row)
                    values = (piece, at // 4, len(part) // 4, zlib.crc32(part))
                    for col, value in zip(cols, values, strict=False):
                        col.append(value)
                    if with_ids:
                        cols[4].append(np.frombuffer(part, "<i4"))
            arrays = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(cols[0], pa.int32()),
                      *[pa.array(c, pa.int64()) for c in cols[1:4]]]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(cols[4], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    return docs.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


def _histogram(df: DataFrame, col: str) -> dict[int, int]:
    return {r[0]: r[1] for r in df.groupBy(col).count().collect()}


def _ranked(df: DataFrame, size: str, *order: str) -> DataFrame:
    """``df`` with ``rank``: 0, 1, ... within each value of ``size``."""
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(BUCKETS)))
    counts = df.groupBy(size, "_bucket").count()
    before = Window.partitionBy(size).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(size, "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(size, "_bucket").orderBy(*order))
    return (df.withColumn("_inside", inside).join(counts, [size, "_bucket"])
            .withColumn("rank", F.col("_before") + F.col("_inside") - 1).drop("_bucket", "_before", "_inside"))


# ---- plans on histograms (driver) ------------------------------------------------------

def _best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the multiset of sizes of greatest worth."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(int(sizes.min()), capacity + 1):
        fits = sizes <= room
        gain = np.where(fits, best[room - np.where(fits, sizes, 0)] + worth, -1.0)
        k = int(gain.argmax())
        if gain[k] > best[room - 1] + 1e-12:
            best[room], last[room] = gain[k], k
        else:
            best[room], last[room] = best[room - 1], -2
    config, room = np.zeros(len(sizes), int), capacity
    while room > 0 and last[room] != -1:
        if last[room] == -2:
            room -= 1
        else:
            config[last[room]] += 1
            room -= sizes[last[room]]
    return float(best[capacity]), config


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """(copies of each size, times): configurations that hold exactly ``demand``."""
    size, need = np.array(sizes), np.array(demand)
    basis = np.diag(capacity // size).astype(float)  # columns are configurations
    times = need / np.diag(basis)
    for _ in range(40 * len(sizes)):
        worth = np.linalg.solve(basis.T, np.ones(len(sizes)))
        value, config = _best_configuration(size, np.maximum(worth, 0), capacity)
        if value <= 1 + 1e-6:
            break
        direction = np.linalg.solve(basis, config)
        ratio = np.where(direction > 1e-9, times / np.where(direction > 1e-9, direction, 1), np.inf)
        leave = int(ratio.argmin())
        basis[:, leave] = config
        times = np.maximum(np.linalg.solve(basis, need), 0)
    found, left = [], need.copy()
    for column, x in zip(basis.T, np.floor(times + 1e-9).astype(int), strict=True):
        config = column.round().astype(int)
        x = min([int(x), *(int(n // c) for n, c in zip(left, config, strict=True) if c)])
        if x > 0:
            found.append((config, x))
            left -= x * config
    while left.any():  # best fit decreasing of what is left: few, as each size is used up or fits no more
        config, room = np.zeros(len(size), int), capacity
        for k in np.argsort(-size):
            config[k] = min(left[k], room // size[k])
            room -= config[k] * size[k]
        x = min(int(n // c) for n, c in zip(left, config, strict=True) if c)
        found.append((config, x))
        left -= x * config
    return found


def plan_large(lengths: dict[int, int], capacity: int, groups: int) -> dict:
    """From a histogram of large lengths: rank of the first piece of each length (falling lengths)
    and, over ranks in sequence, (first rank, first sequence, times) of runs of equal places."""
    first, total = {}, 0
    for length in sorted(lengths, reverse=True):
        first[length] = total
        total += lengths[length]
    if not total:
        return {"first": {}, "runs": np.zeros((0, 3), np.int64), "sequences": 0}
    width = -(-total // groups)
    tops = sorted(first.items(), key=lambda x: x[1])
    starts = [s for _, s in tops]
    demand: dict[int, int] = {}
    for at in range(0, total, width):
        top = tops[bisect_left(starts, at + 1) - 1][0]  # the longest of the group is its first
        demand[top] = demand.get(top, 0) + min(width, total - at)
    sizes = sorted(demand, reverse=True)
    found = configurations(sizes, [demand[s] for s in sizes], capacity)
    base = np.cumsum([0] + [x for _, x in found])
    runs, rank = [], 0
    for k in range(len(sizes)):
        for (config, x), sequence in zip(found, base, strict=False):
            for _ in range(config[k]):
                runs.append((rank, sequence, x))
                rank += x
    return {"first": first, "runs": np.array(runs, np.int64), "sequences": int(base[-1])}


def plan_small(lengths: dict[int, int], rooms: dict[int, int], capacity: int) -> list[tuple[int, ...]]:
    """Best fit of small pieces on histograms: (length, first rank, room, first sequence rank,
    copies for each sequence). New sequences have room ``capacity`` and ranks from 0."""
    by_room: dict[int, list[tuple[int, int, int]]] = {r: [(r, 0, n)] for r, n in rooms.items() if r > 0 and n}
    opened, steps = 0, []
    for length in sorted(lengths, reverse=True):
        left, rank = lengths[length], 0
        while left:
            room = min((r for r in by_room if r >= length), default=0)
            if not room:
                room, new = capacity, -(-left // (capacity // length))
                by_room[capacity] = [(capacity, opened, new)]
                opened += new
            kind, at, n = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
            each = room // length
            whole = min(n, left // each)
            rest = left - whole * each if whole < n else 0
            for count, copies, start in ((whole, each, at), (1 if rest else 0, rest, at + whole)):
                if count:
                    steps.append((length, rank, kind, start, copies))
                    rank += count * copies
                    left -= count * copies
                    by_room.setdefault(room - copies * length, []).append((kind, start, count))
            used = whole + (1 if rest else 0)
            if used < n:
                by_room.setdefault(room, []).append((kind, at + used, n - used))
            by_room.pop(0, None)
    return steps


# ---- ranks to places (tasks) -----------------------------------------------------------

def _place_large(ranked: DataFrame, plan: dict) -> DataFrame:
    first = np.zeros(max(plan["first"], default=0) + 1, np.int64)
    for length, rank in plan["first"].items():
        first[length] = rank
    runs = plan["runs"]

    @F.pandas_udf("long")
    def sequence(length, rank):
        at = first[length.to_numpy()] + rank.to_numpy()
        run = runs[np.searchsorted(runs[:, 0], at, "right") - 1]
        return type(length)(run[:, 1] + (at - run[:, 0]) % run[:, 2])

    return ranked.withColumn("sequence_id", sequence("length", "rank")).drop("rank")


def _seat_small(ranked: DataFrame, steps: list[tuple[int, ...]]) -> DataFrame:
    """Adds (room, seat): the kind of sequence and its rank among those of that room."""
    table = np.array(sorted(steps), np.int64).reshape(-1, 5)
    key = table[:, 0] << 48 | table[:, 1]

    @F.pandas_udf("room long, seat long")
    def seat(length, rank):
        import pandas as pd

        length, rank = length.to_numpy(), rank.to_numpy()
        step = table[np.searchsorted(key, length << 48 | rank, "right") - 1]
        return pd.DataFrame({"room": step[:, 2], "seat": step[:, 3] + (rank - step[:, 1]) // step[:, 4]})

    return ranked.withColumn("_to", seat("length", "rank")).select(
        *[c for c in ranked.columns if c != "rank"], "_to.room", "_to.seat")


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, small: int | None = None) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length and any more) with sequence_id and offset."""
    small = int(capacity * SMALL_SHARE) if small is None else small
    pieces = cut(pieces)
    lengths = _histogram(pieces, "length")
    large_plan = plan_large({n: c for n, c in lengths.items() if n > small}, capacity, groups)
    order = ["doc_id", "piece", "start"]
    large = cut(_place_large(_ranked(pieces.where(F.col("length") > small), "length", *order), large_plan))
    rooms = large.groupBy("sequence_id").agg((F.lit(capacity) - F.sum("length")).alias("room"))
    steps = plan_small({n: c for n, c in lengths.items() if n <= small}, _histogram(rooms, "room"), capacity)
    seated = _seat_small(_ranked(pieces.where(F.col("length") <= small), "length", *order), steps)
    fresh = seated.where(F.col("room") == capacity).withColumn(
        "sequence_id", F.col("seat") + large_plan["sequences"]).drop("room", "seat")
    seats = _ranked(rooms, "room", "sequence_id").withColumnRenamed("rank", "seat")
    filled = seated.where(F.col("room") < capacity).join(seats, ["room", "seat"]).drop("room", "seat")
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), *order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    placed = large.unionByName(fresh).unionByName(filled)
    offset: Column = F.sum("length").over(inside) - F.col("length")
    return placed.withColumn("offset", offset)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): whole sequences of pieces that carry their ids; at most CAPACITY ids each."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
