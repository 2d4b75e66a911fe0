"""Trie of conversation prefixes, screened by a count-min sketch of prefix digests.

1. Turns are sorted over range partitions by (conversation, turn), so a conversation of any length
   is spread over tasks. Prefix digests are sums of turn digests times powers of a base modulo
   2**31 - 1, in four lanes: they add up over partitions, and only the state at each partition's
   end (one row a partition) passes through the driver.
2. A rebuilt conversation's digests follow from its own and its donor's by arithmetic on longs.
3. All prefix digests are counted in a count-min sketch: tasks send the slots they filled, merged
   chunk by chunk to one bit a slot, "more than once". A prefix with an estimate of one is a
   singleton; if its parent's is one too, its node is complete and is emitted where it stands.
4. Only the others shuffle, to be grouped exactly by (depth, digest). Sums over subtrees need no walk
   over levels: each conversation carries what it adds to all its ancestors.

The sketch follows the number of prefixes up to 2**MAX_BITS slots a row (64 MB in all, the broadcast
bound); beyond it more prefixes shuffle and the results stay exact.

Defined results: rows with a null conversation id take no part; a null role or text is empty. Turns of one
number (or none) are ordered by the MD5 of role and text, so repeated turns stay. A conversation
without turns is a member of the root only. An empty table gives an empty result. Other columns are
never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subscope.llm.common import cut, fold, lookup, narrowed

MOD = (1 << 31) - 1
#: any four bases of the digest's lanes
BASES = (1103515245, 1664525000, 214013123, 1597334677)
#: hash rows of the sketch, slots for each prefix, least and most slots a row as powers of two
ROWS, PER_PREFIX, MIN_BITS, MAX_BITS = 2, 8, 16, 28
#: slots that a task holds before it sends them on
HELD = 1 << 20
_CHUNK = 16
#: chunks of the sketch, 8 KB each, that a task merges
CHUNKS = 64
_WORD = r"[^\x20\x09-\x0D]+"
_KEY = ["depth", "k1", "k2"]


# ---- prefix digests over sorted partitions

class _State:
    """The conversation at which a partition ends: turns, digest lanes and words so far."""

    def __init__(self, conv: int, pos: int = 0, lanes: tuple = (0, 0, 0, 0), words: int = 0):
        self.conv, self.pos, self.lanes, self.words = conv, pos, lanes, words

    def then(self, other: _State) -> _State:
        """This prefix with the turns of ``other`` after it."""
        lanes = tuple((a + b * pow(base, self.pos, MOD)) % MOD for a, b, base in zip(self.lanes, other.lanes, BASES, strict=True))
        return _State(self.conv, self.pos + other.pos, lanes, self.words + other.words)


def _scan(batch: pa.RecordBatch, state: _State | None) -> tuple[dict[str, np.ndarray], _State]:
    """Place, digest lanes before and after, and words so far of every turn; the state after the last."""
    n = batch.num_rows
    conv = batch.column(0).to_numpy(zero_copy_only=False)
    digest = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(n, 4).astype(np.int64) % (MOD - 1) + 1
    words = batch.column(2).to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
    run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    first = np.zeros(len(starts), np.int64)
    if state is not None and state.conv == conv[0]:
        first[0] = state.pos
    else:
        state = None
    local = np.arange(n) - starts[run] + 1
    after = np.empty((n, 4), np.int64)
    terms = np.empty((n, 4), np.int64)
    for lane, base in enumerate(BASES):
        powers = np.ones(int(local.max()) + 1, np.int64)
        for at in range(1, len(powers)):
            powers[at] = powers[at - 1] * base % MOD
        power = powers[local]
        if state is not None:
            power = np.where(run == 0, power * pow(base, state.pos, MOD) % MOD, power)
        terms[:, lane] = digest[:, lane] * power % MOD
        total = np.cumsum(terms[:, lane])
        total -= (total[starts] - terms[starts, lane])[run]
        if state is not None:
            total[run == 0] += state.lanes[lane]
        after[:, lane] = total % MOD
    so_far = np.cumsum(words)
    so_far -= (so_far[starts] - words[starts])[run]
    if state is not None:
        so_far[run == 0] += state.words
    place = local + first[run]
    out = {"conv": conv, "pos": place, "words": words, "cum": so_far}
    for name, lanes in (("k", after), ("p", (after - terms) % MOD)):
        out[f"{name}1"] = lanes[:, 0] << 31 | lanes[:, 1]
        out[f"{name}2"] = lanes[:, 2] << 31 | lanes[:, 3]
    return out, _State(int(conv[-1]), int(place[-1]), tuple(int(v) for v in after[-1]), int(so_far[-1]))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: partition, first conversation, and the state of the last one since the partition's start."""
    state, first = None, None
    for batch in batches:
        if batch.num_rows:
            first = batch.column(0)[0].as_py() if first is None else first
            state = _scan(batch, state)[1]
    if state is not None:
        line = [TaskContext.get().partitionId(), first, state.conv, state.pos, *state.lanes, state.words]
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in line], ["part", "first", "conv", "pos", "l0", "l1", "l2", "l3", "words"])


def prefixes(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, pos, words, cum, k1, k2, p1, p2) of every turn: its place, its words, the words so far, the
    digest of the prefix that ends with it and of the one before."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    framed = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = df.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.unhex(F.md5(framed)).alias("digest"),
        F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words"), F.col(turn_col).alias("turn"),
        F.monotonically_increasing_id().alias("line"))  # splits a turn that is repeated without end
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("digest")]
    turns = cut(turns.repartitionByRange(*order, F.col("line")).sortWithinPartitions(*order).select("conv", "digest", "words"))
    states, carry, carries = turns.mapInArrow(_ends, "part long, first long, conv long, pos long, l0 long, l1 long, l2 long, l3 long, words long"), None, {}
    for r in sorted(states.collect(), key=lambda r: r["part"]):  # one row a partition
        state = _State(r["conv"], r["pos"], (r["l0"], r["l1"], r["l2"], r["l3"]), r["words"])
        if carry is not None and carry.conv == r["first"]:
            carries[r["part"]] = carry
            state = carry.then(state) if r["first"] == r["conv"] else state
        carry = state

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = carries.get(TaskContext.get().partitionId())
        for batch in batches:
            if batch.num_rows:
                out, state = _scan(batch, state)
                yield pa.RecordBatch.from_arrays([pa.array(out[c], pa.int64()) for c in names], names)

    names = ["conv", "pos", "words", "cum", "k1", "k2", "p1", "p2"]
    return cut(turns.mapInArrow(run, ", ".join(f"{c} long" for c in names)))


# ---- rebuilt conversations

def _shifted(k: str, own: str, lead: str, back: Column, lanes: tuple[int, int]) -> Column:
    """Both lanes of lead + (k - own) * base ** -back, packed in a long."""
    low = lambda c: F.col(c).bitwiseAND(MOD)
    high = lambda c: F.shiftright(c, 31)
    out = []
    for part, base in zip((high, low), lanes, strict=True):
        factor = F.element_at(F.array(*[F.lit(pow(base, -i, MOD)).cast("long") for i in range(4)]), (back + 1).cast("int"))
        out.append((part(lead) + (part(k) - part(own) + MOD) % MOD * factor % MOD) % MOD)
    return F.shiftleft(out[0], 31).bitwiseOR(out[1])


def rebuilt(turns: DataFrame, every: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Per conversation (conv, n, length, total words), and per prefix of the rebuilt conversations
    (conv, depth, k1, k2, p1, p2, words, cum, last).

    The first h turns come from conversation conv - conv % every, h being crc32 of conv modulo ``most`` + 1.
    """
    total = turns.count()
    turns = narrowed(turns, total)
    at = range(1, most + 1)
    first = [F.max(F.when(F.col("pos") == i, F.col(c))).alias(f"{c}_{i}") for i in at for c in ("k1", "k2", "words")]
    heads = cut(narrowed(turns.groupBy("conv").agg(F.max("pos").alias("n"), F.max("cum").alias("cum"), *first), total))
    donors = heads.select([F.col(c).alias(f"d_{c}") for c in heads.columns])
    both = heads.join(donors, F.col("d_conv") == F.col("conv") - F.col("conv") % every, "left")
    h = fold("conv", most + 1)
    both = both.withColumn("h", h).withColumn("hd", F.least("h", F.coalesce("d_n", F.lit(0)))).withColumn("ho", F.least("h", "n"))

    def pick(prefix: str, c: str, count: str) -> Column:
        return F.coalesce(*[F.when(F.col(count) == i, F.col(f"{prefix}{c}_{i}")) for i in at], F.lit(0)).cast("long")

    def words(prefix: str, count: str) -> Column:
        return sum((F.when(F.col(count) >= i, F.col(f"{prefix}words_{i}")).otherwise(0) for i in at), F.lit(0)).cast("long")

    lead = [F.struct(F.lit(i).cast("long").alias("depth"), *[F.col(f"d_{c}_{i}").alias(c) for c in ("k1", "k2")],
                     *[(F.col(f"d_k{j}_{i - 1}") if i > 1 else F.lit(0).cast("long")).alias(f"p{j}") for j in (1, 2)],
                     F.col(f"d_words_{i}").alias("words"),
                     sum((F.col(f"d_words_{j}") for j in range(1, i + 1)), F.lit(0)).cast("long").alias("cum")) for i in at]
    params = cut(narrowed(both, total).select(
        "conv", "n", "h", "hd", *[pick("", f"k{i}", "ho").alias(f"o{i}") for i in (1, 2)],
        *[pick("d_", f"k{i}", "hd").alias(f"l{i}") for i in (1, 2)],
        words("", "ho").alias("own_words"), words("d_", "hd").alias("lead_words"), "cum",
        F.slice(F.array(*lead), F.lit(1), F.col("hd").cast("int")).alias("lead"))
        .withColumn("length", F.col("hd") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
        .withColumn("total", F.col("cum") - F.col("own_words") + F.col("lead_words")).drop("cum"))
    leading = params.select("conv", "length", F.explode("lead").alias("t")).select("conv", "t.*", (F.col("t.depth") == F.col("length")).alias("last"))
    own = lookup(turns, ["conv"], params.drop("lead"), "n", total).where("pos > h")
    back = F.col("h") - F.col("hd")
    own = own.select(
        "conv", (F.col("pos") - back).alias("depth"),
        *[_shifted(f"{c}{i}", f"o{i}", f"l{i}", back, BASES[2 * i - 2:2 * i]).alias(f"{c}{i}") for c in "kp" for i in (1, 2)],
        "words", (F.col("cum") - F.col("own_words") + F.col("lead_words")).alias("cum"),
        (F.col("pos") - back == F.col("length")).alias("last"))
    return params.select("conv", "length", "total"), cut(narrowed(leading.unionByName(own), (most + 1) * total))


# ---- the sketch

def repeated_slots(hashes: DataFrame, bits: int) -> DataFrame:
    """(chunk, bits): the slots of both hash rows that hold more than one of ``hashes`` (one long column)."""
    mask = np.uint64((1 << bits) - 1)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def sent() -> pa.RecordBatch:
            slot, times = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.flatnonzero(np.diff(slot >> _CHUNK)) + 1
            lines = [(int(s[0] >> _CHUNK), (s & 0xFFFF)[t == 1].astype("<u2").tobytes(), (s & 0xFFFF)[t > 1].astype("<u2").tobytes())
                     for s, t in zip(np.split(slot, cuts), np.split(times, cuts), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*lines, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)],
                                              ["chunk", "once", "more"])

        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            held += [((h >> np.uint64(32 * r)) & mask).astype(np.int64) + (r << bits) for r in range(ROWS)]
            size += ROWS * len(h)
            if size >= HELD:
                yield sent()
                held, size = [], 0
        if size:
            yield sent()

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        seen = np.zeros(1 << _CHUNK, np.uint8)
        for once, more in zip(part.once, part.more, strict=True):
            seen[np.frombuffer(more, "<u2")] = 2
            slot = np.frombuffer(once, "<u2")
            seen[slot] = np.minimum(seen[slot] + 1, 2)
        return pd.DataFrame({"chunk": part.chunk[:1], "bits": [np.packbits(seen > 1, bitorder="little").tobytes()]})

    sent = hashes.mapInArrow(slots, "chunk int, once binary, more binary")
    merged = sent.groupBy("chunk").applyInPandas(merge, "chunk int, bits binary")
    return cut(narrowed(merged, (ROWS << bits) >> _CHUNK, CHUNKS))


def _estimated(df: DataFrame, key: list[str], sketch: DataFrame, bits: int, name: str) -> DataFrame:
    """``df`` with boolean ``name``: the sketch's estimate for the digest is more than one. The sketch
    is broadcast; MAX_BITS bounds it."""
    found = []
    for r in range(ROWS):
        slot = F.shiftrightunsigned(F.xxhash64(*key), 32 * r).bitwiseAND((1 << bits) - 1) + (r << bits)
        byte = f"conv(hex(substring(s{r}, cast(shiftright(t{r} & 65535, 3) as int) + 1, 1)), 16, 10)"
        df = df.withColumn(f"t{r}", slot).join(
            F.broadcast(sketch.select(F.col("chunk").alias(f"c{r}"), F.col("bits").alias(f"s{r}"))),
            F.shiftright(f"t{r}", _CHUNK) == F.col(f"c{r}"), "left")
        found.append(F.coalesce(F.expr(f"getbit(cast({byte} as int), cast(t{r} & 7 as int)) = 1"), F.lit(False)))
        df = df.withColumn(f"e{r}", found[-1]).drop(f"t{r}", f"c{r}", f"s{r}")
    return df.withColumn(name, F.expr(" AND ".join(f"e{r}" for r in range(ROWS)))).drop(*[f"e{r}" for r in range(ROWS)])


# ---- ids of the conversations that end at a node

def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, conv) rows to (node, first conv, comma-joined decimals) runs."""
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(np.stack(cols[:3])) != 0).any(0)]))
        text = batch.column(3).cast(pa.string()).to_pylist()
        runs = [",".join(text[a:b]) for a, b in zip(starts, np.append(starts[1:], batch.num_rows), strict=True)]
        yield pa.RecordBatch.from_arrays([*[pa.array(c[starts]) for c in cols], pa.array(runs, pa.string())], [*_KEY, "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs in order to one SHA-256 a node, held as a hash state only."""
    node, state, done = None, None, []
    for batch in batches:
        for *key, _, ids in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
            if key == node:
                state.update(b",")
            else:
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, state = key, hashlib.sha256()
            state.update(ids.encode())
        if done:
            yield _digests(done)
            done = []
    if node is not None:
        yield _digests([(*node, state.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [*_KEY, "ends_sha256"])


def id_digests(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, conv) to (depth, k1, k2, ends_sha256): ids in numeric order, comma-joined. A node's ids
    are joined where range partitions hold them; the last step reads whole runs, one after the other."""
    by_id = ends.repartitionByRange(*_KEY, "conv").sortWithinPartitions(*_KEY, "conv").select(*_KEY, "conv")
    runs = by_id.mapInArrow(_joined_ids, "depth long, k1 long, k2 long, first long, ids string")
    return runs.repartition(*_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(_hashed, "depth long, k1 long, k2 long, ends_sha256 string")


# ---- nodes

def prefix_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                every: int = 20, most: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    convs, path = rebuilt(prefixes(df, conv_col, turn_col, role_col, text_col), every, most)
    places = path.count()
    bits = min(max_bits, max(MIN_BITS, (PER_PREFIX * places - 1).bit_length()))
    sketch = repeated_slots(path.select(F.xxhash64(*_KEY)), bits)
    path = _estimated(path, _KEY, sketch, bits, "maybe")
    path = path.withColumn("parent", F.col("depth") - 1)
    path = _estimated(path, ["parent", "p1", "p2"], sketch, bits, "below").withColumn("below", F.col("below") | (F.col("depth") == 1))
    nothing = F.sha2(F.lit(""), 256)
    one = F.when(F.col("last"), F.sha2(F.col("conv").cast("string"), 256)).otherwise(nothing)
    long = lambda v: F.lit(v).cast("long")

    def alone(rows: DataFrame, parent: Column) -> DataFrame:
        return rows.select(F.col("conv").alias("conv_id"), "depth", parent.alias("parent_conv_id"), long(1).alias("n_convs"),
                           F.when(F.col("last"), long(0)).otherwise(long(1)).alias("n_children"), long(1).alias("n_leaves"),
                           long(0).alias("saved_tokens"), one.alias("ends_sha256"))

    path = cut(path)
    tails = alone(path.where("NOT maybe AND NOT below"), F.col("conv"))
    opened = path.where("maybe OR below").withColumn("pre", F.col("cum") - F.col("words"))
    total = opened.count()
    nodes = opened.where("maybe").groupBy(*_KEY).agg(
        F.count("*").alias("n"), F.min("conv").alias("rep"), F.count(F.when(F.col("last"), 1)).alias("ends"),
        F.min(F.when(F.col("last"), F.col("conv"))).alias("first_end"), F.first("p1").alias("p1"), F.first("p2").alias("p2"),
        F.first("pre").alias("pre")).where("n > 1")
    nodes = cut(narrowed(nodes, total))
    found = lookup(opened.select("conv", *_KEY, "p1", "p2", "pre", "last"), _KEY, nodes.select(*_KEY, "n", "rep", "ends"), "n", total)
    found = cut(narrowed(found, total))

    # what each conversation adds to all its ancestors
    least = convs.agg(F.min("conv")).first()[0]
    shared, own = F.col("n").isNotNull(), F.col("rep") == F.col("conv")
    told = found.groupBy("conv").agg(
        F.count("*").alias("rows"), F.max(F.when(shared, F.col("depth"))).alias("deep"), F.max("rep").alias("deep_rep"),
        F.min(F.when(~shared | own, F.col("pre"))).alias("before"),
        F.max(F.when(shared & own & F.col("last") & (F.col("ends") == F.col("n")), 1)).alias("leaf"))
    told = convs.join(told, "conv", "left").select(
        "conv", "length", "total", F.coalesce("rows", long(0)).alias("rows"), F.coalesce("deep", long(0)).alias("deep"),
        F.coalesce("deep_rep", F.lit(least)).alias("deep_rep"),
        F.when(F.col("conv") == F.lit(least), F.col("total")).otherwise(F.col("total") - F.coalesce("before", "total")).alias("first_words"),
        F.when(F.col("length") > F.coalesce("deep", long(0)), 1).otherwise(F.coalesce("leaf", F.lit(0))).cast("long").alias("leaf"))
    told = cut(narrowed(told, places))
    found = cut(narrowed(lookup(found, ["conv"], told, "rows", total), total))
    single = found.where("n IS NULL")
    parent = F.when(F.col("depth") == F.col("deep") + 1, F.col("deep_rep")).otherwise(F.col("conv"))
    of_rep = lambda c: F.max(F.when(own, F.col(c)))
    sums = found.where(shared).groupBy(*_KEY).agg(
        F.sum("total").alias("words"), F.sum("first_words").alias("first_words"), F.sum("leaf").alias("n_leaves"),
        of_rep("total").alias("rep_words"), of_rep("first_words").alias("rep_first"))
    up = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    children = (nodes.select(up).unionByName(single.where(F.col("depth") == F.col("deep") + 1).select(up))
                   .groupBy(*_KEY).agg(F.count("*").alias("n_children")))
    children = cut(narrowed(children, total))
    parents = nodes.select(*_KEY, F.col("rep").alias("parent_conv_id")).join(children, _KEY).select(
        F.col("depth").alias("parent"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), "parent_conv_id", "n_children")
    ends = found.where(shared & F.col("last") & (F.col("ends") > 1)).select(*_KEY, "conv")
    at_root = told.where("length = 0").select(long(0).alias("depth"), long(0).alias("k1"), long(0).alias("k2"), "conv")
    digests = id_digests(ends.unionByName(at_root))

    tree = lookup(nodes.withColumn("parent", F.col("depth") - 1), ["parent", "p1", "p2"], parents, "n_children", max(nodes.count(), 1))
    tree = tree.drop("n_children").join(sums, _KEY).join(children, _KEY, "left").join(digests, _KEY, "left").select(
        F.col("rep").alias("conv_id"), "depth", F.coalesce("parent_conv_id", F.lit(least)).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.coalesce("n_children", long(0)).alias("n_children"), "n_leaves",
        (F.col("words") - F.col("n") * F.col("pre") - F.col("first_words") + F.col("rep_first") - F.col("rep_words") + F.col("pre")).alias("saved_tokens"),
        F.when(F.col("ends") == 0, nothing).when(F.col("ends") == 1, F.sha2(F.col("first_end").cast("string"), 256))
        .otherwise(F.col("ends_sha256")).alias("ends_sha256"))
    root = told.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.sum("leaf").alias("leaves"),
                    F.sum(F.col("total") - F.col("first_words")).alias("saved_tokens")).where("n_convs > 0")
    root = (root.withColumns({"depth": long(0), "k1": long(0), "k2": long(0)}).join(children, _KEY, "left").join(digests, _KEY, "left")
            .select("conv_id", "depth", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs",
                    F.coalesce("n_children", long(0)).alias("n_children"), F.greatest("leaves", long(1)).alias("n_leaves"),
                    "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256")))
    return tails.unionByName(alone(single, parent)).unionByName(narrowed(tree, total)).unionByName(root)
