"""Helpers shared by the operators: inputs, lineage cuts, salted lookups, slot bitmaps."""

from __future__ import annotations

import ctypes
import re
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subscope.session import checkpoint_dir

#: tasks over which the rows of one hot key are spread in ``salted_lookup``
SALTS = 16
#: keys that ``lookup`` may broadcast
HEAVY = 4096
#: rows that a task takes of a small table, however many partitions it came in
TASK_ROWS = 100_000
#: slots of a membership bitmap: 2**24 bits are 2 MB, whatever the data
SLOTS = 1 << 24

#: bytes of an Arrow batch of whole texts; a single longer text is a batch of its own
BATCH_BYTES = 4 << 20

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder; its lineage ends there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def narrowed(df: DataFrame, total: int, rows: int = TASK_ROWS) -> DataFrame:
    """``df``, of about ``total`` rows, in no more tasks than have ``rows`` each, without a shuffle."""
    return df.coalesce(max(1, -(-total // rows)))


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on hands rows to Python in batches of at most BATCH_BYTES: 10,000 whole
    texts at once, Spark's default, have no bound. A smaller bound of the session's own stays."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = (conf.get(name) or "").rstrip("bB")
    if now.isdigit() and int(now) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def keyed(df: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """(doc_id, text, *more) with a null text as the empty one; other columns are left out."""
    return bounded_batches(df).select(F.col(id_col).alias("doc_id"),
                     F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id is the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % parts


def salted_lookup(rows: DataFrame, keys: list[str], spread: Column, values: DataFrame) -> DataFrame:
    """``rows`` left-joined with ``values`` (one row per ``keys``), a hot key dealt to SALTS tasks.

    The distinct (key, salt) pairs, at most SALTS per key, fetch the values first, so
    neither join ever brings all rows of one key together.
    """
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    pairs = rows.select(*keys, "_salt").distinct().join(values, keys)
    return rows.join(pairs, [*keys, "_salt"], "left").drop("_salt")


def lookup(rows: DataFrame, keys: list[str], values: DataFrame, weight: str, total: int) -> DataFrame:
    """``rows`` left-joined with ``values``, one row per ``keys`` whose ``weight`` is the number of rows that have it.

    Keys that hold more than ``total`` / HEAVY of the ``total`` rows, fewer than HEAVY of them, are broadcast;
    of any other key no task gets more rows than that.
    """
    least = total / HEAVY
    heavy = values.where(F.col(weight) > least).withColumn("_heavy", F.lit(True))
    marked = rows.join(F.broadcast(heavy), keys, "left")
    rest = marked.where("_heavy IS NULL").select(*rows.columns).join(values.where(F.col(weight) <= least), keys, "left")
    return marked.where("_heavy").drop("_heavy").unionByName(rest)


def slot_bitmap(slots: DataFrame, slot: str = "slot") -> DataFrame:
    """The set of ``slot`` values (0 to SLOTS - 1) as at most SLOTS / 32768 rows of 4 KB."""
    return (slots.groupBy(F.expr(f"bitmap_bucket_number({slot})").alias("_bucket"))
            .agg(F.expr(f"bitmap_construct_agg(bitmap_bit_position({slot}))").alias("_bits")))


def free(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as no column of ``df`` has (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_membership(df: DataFrame, slot: Column, bitmap: DataFrame, name: str) -> DataFrame:
    """``df`` with boolean ``name``: whether the slot is set. The bitmap is broadcast; its size is
    fixed by SLOTS. A false positive is possible for hashed slots, a false negative is not."""
    at, bucket, bits = (free(df, c) for c in ("_llm_slot", "_bucket", "_bits"))
    place = f"bitmap_bit_position({at})"
    byte = f"conv(hex(substring({bits}, cast({place} div 8 + 1 as int), 1)), 16, 10)"
    hit = F.expr(f"getbit(cast({byte} as int), cast({place} % 8 as int)) = 1")
    return (df.withColumn(at, slot)
            .join(F.broadcast(bitmap.toDF(bucket, bits)), F.expr(f"bitmap_bucket_number({at})") == F.col(bucket), "left")
            .withColumn(name, F.coalesce(hit, F.lit(False)))
            .drop(at, bucket, bits))


def id_slot(col: str) -> Column:
    return F.pmod(F.xxhash64(F.col(col)), F.lit(SLOTS))


def without(df: DataFrame, gone: DataFrame, id_col: str, also: Column | None = None) -> DataFrame:
    """Rows of ``df`` that are not in ``gone``: its first column holds ids, its second, if there is
    one, the value of ``also``. Nulls match nulls.

    Rows whose id misses the bitmap of gone ids stay without a shuffle; only the others, the
    gone rows and a few false positives, meet ``gone`` in an exact anti join. Without ``also`` the ids
    alone meet it first; a second bitmap, of the false positives, then leaves few whole rows to be joined.
    """
    key, value, maybe, spared = (free(df, c) for c in ("_gone", "_also", "_llm_maybe", "_llm_spared"))
    gone = cut(gone.toDF(key, value) if also is not None else gone.toDF(key)).distinct()
    slots = slot_bitmap(gone.select(id_slot(key).alias("slot")))
    marked = with_membership(df, id_slot(id_col), slots, maybe)
    same = F.col(id_col).eqNullSafe(F.col(key))
    if also is not None:
        same = same & also.eqNullSafe(F.col(value))
    open_ = marked.where(maybe)
    if also is None:
        at = F.pmod(F.xxhash64(F.lit(1), F.col(id_col)), F.lit(SLOTS))
        false = cut(open_.select(id_col).distinct().join(gone, same, "left_anti"))
        open_ = with_membership(open_, at, slot_bitmap(false.select(at.alias("slot"))), spared).where(spared)
    tested = open_.join(gone, same, "left_anti").select(*[F.col(f"`{c}`") for c in marked.columns])
    return marked.where(f"NOT {maybe}").unionByName(tested).select(*[F.col(f"`{c}`") for c in df.columns])


def blocks(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """``data`` in pieces of about ``size`` bytes that end before white space, so no word is split."""
    start = 0
    while start < len(data):
        end = start + size
        if end >= len(data):
            end = len(data)
        else:
            found = _SPACE.search(data, end)
            end = found.start() if found else len(data)
        yield data[start:end]
        start = end


def give_back() -> None:
    """Freed memory back to the system: Python workers outlive their tasks, and executors count them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps what it keeps
        pass


def per_worker(key: str, make: Callable[[], object]) -> object:
    """``make()``, kept in this Python process for the tasks that come after. Functions travel by value,
    so a module of theirs would be new in every task. The next task that reads texts without asking for it lets it go."""
    kept = sys.modules.setdefault("_subscope_kept", types.ModuleType("_subscope_kept")).__dict__
    if key not in kept:
        kept[key] = make()
    kept["_asked"] = True
    return kept[key]


def let_go() -> None:
    """What ``per_worker`` keeps, unless this task has asked for it: a tokenizer and its words are up to 100 MB
    that a later stage's tasks would hold besides their own."""
    kept = getattr(sys.modules.get("_subscope_kept"), "__dict__", {})
    if not kept.pop("_asked", False):
        kept.clear()


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices, without a copy: what a task makes of a slice's texts is small and goes
    before the next slice."""
    let_go()
    give_back()  # what the worker's last task has left
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
        give_back()


def keep_rows(df: DataFrame, text_col: str, decider: Callable[[], Callable[[list], object]]) -> DataFrame:
    """Rows of ``df``, all columns, whose text passes. ``decider()`` makes, once a task, the function
    from a list of texts (None for null) to booleans."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = decider()
        for batch in sliced(batches):
            yield batch.filter(pa.array(decide(batch.column(at).to_pylist()), pa.bool_()))

    return bounded_batches(df).mapInArrow(run, df.schema)
