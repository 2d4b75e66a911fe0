"""Language-model scores: a smoothed unigram base and a log-bilinear neural model.

Counts. Every token of every learning text is counted, in tasks first and then by Spark. The
KNOWN most frequent tokens travel to the tasks (a bound of KNOWN * LONGEST bytes); all others
meet their counts in a join, as (document, token, times) rows.

Model. The SHORT most frequent tokens and one class for all others are predicted from the
two tokens before: the context's vectors, each through its position's matrix, add up to the
predicted vector, whose products with the output vectors plus biases are the scores. A token
outside the short list has the class's probability times its share of the base's mass there,
so the distribution over all tokens, an unseen one included, sums to one.

Training is noise-contrastive estimation in numpy, with noise from the class frequencies. Every
learning document trains the model: each task trains on its own, PASS tokens or a text at a
time, from the same parameters, and the parameters are averaged by examples (ROUNDS times).
Scoring normalises exactly: one matrix product gives the
scores of all classes for the distinct contexts of a block.

Defined results: a null text is empty and is one end token. Repeated rows and ids are scored
one by one. Without any learning text every token is unseen, and the model is its base.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subscope.llm.common import blocks, cut, keyed, sliced

#: tokens whose counts travel to the tasks, at most, and the longest of them in bytes
KNOWN = 1 << 18
LONGEST = 64
#: predicted tokens; all others are one class
SHORT = 512
DIMENSIONS = 24
ROUNDS = 1
#: tokens that a task holds and trains on at once, but for the rest of a text
PASS = 1 << 20
BATCH, NOISE, RATE = 1024, 64, 0.1
#: tasks that add up the trained parameters
AVERAGERS = 16
#: tokens scored by one matrix product; tokens a task counts before it hands them on
SLICE = 1 << 18
HELD = 400_000
#: the token after the last word of a text; no word holds a line break
END = b"\n"
SMOOTHING = 0.1


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """The text's words, block by block, and the end token."""
    for block in blocks(text):
        yield block.lower().split()
    yield [END]


def token_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(token, n) over every row of ``df``."""
    docs = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["token", "n"])
            held.clear()
            return out

        for batch in batches:
            for text in batch.column(0).cast(pa.large_binary()):
                for words in tokens(text.as_py()):
                    held.update(words)
                if len(held) > HELD:
                    yield rows()
        yield rows()

    return docs.mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _level():
    return F.floor(F.log2("n") * 32)


def most_frequent(counts: DataFrame, most: int) -> tuple[list[tuple[bytes, int]], int]:
    """Tokens (at most ``most``) whose frequency level is above the returned one, by falling count.

    Levels are 32 to a doubling, so their histogram is small however many tokens there are.
    """
    short = counts.where(F.length("token") <= LONGEST)
    taken, floor = 0, 1 << 30
    for level, n in sorted(short.groupBy(_level().alias("level")).count().collect(), reverse=True):
        if taken + n > most:
            break
        taken, floor = taken + n, level
    rows = short.where(_level() >= floor).collect()
    return sorted(((bytes(r["token"]), r["n"]) for r in rows), key=lambda r: (-r[1], r[0])), floor


# ---- the log-bilinear model ------------------------------------------------------------

def initial(frequencies: np.ndarray, dimensions: int = DIMENSIONS, seed: int = 7) -> dict[str, np.ndarray]:
    """Biases at the class frequencies, small vectors: the model starts as the unigram one.

    Classes are the short list and, last, all other tokens; contexts also have a text's start.
    """
    rng = np.random.default_rng(seed)
    n = len(frequencies)
    return {"context": rng.normal(0, 0.1, (n + 1, dimensions)).astype(np.float32),
            "near": np.eye(dimensions, dtype=np.float32), "far": np.eye(dimensions, dtype=np.float32),
            "output": rng.normal(0, 0.1, (n, dimensions)).astype(np.float32),
            "bias": np.log(frequencies).astype(np.float32)}


def contexts(classes: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes one and two places back; ``n`` (a text's start) before the first. ``starts``: the
    places where a text begins, in one array of many texts."""
    one, two = np.full(len(classes), n), np.full(len(classes), n)
    one[1:], two[2:] = classes[:-1], classes[:-2]
    one[starts] = n
    two[starts] = n
    second = starts + 1
    two[second[second < len(classes)]] = n
    return one, two


def _sums(rows: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``rows`` by their number ``of``, below ``n``."""
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    order = np.argsort(of, kind="stable")
    of = of[order]
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    out[of[first]] = np.add.reduceat(rows[order], first)
    return out


def train(p: dict[str, np.ndarray], classes: np.ndarray, starts: np.ndarray, frequencies: np.ndarray,
          seed: int, past: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """One pass of noise-contrastive estimation (AdaGrad) over the examples; ``past``, the sums of
    squared steps, is empty before the first call of a task and carried on by the next."""
    p = {k: v.copy() for k, v in p.items()}
    past = {} if past is None else past
    for k, v in p.items():
        past.setdefault(k, np.full_like(v, 1e-3))
    rng = np.random.default_rng(seed)
    one, two = contexts(classes, starts, len(frequencies))
    log_noise = np.log(NOISE * frequencies).astype(np.float32)
    cumulated = np.cumsum(frequencies)
    order = rng.permutation(len(classes))
    for at in range(0, len(order), BATCH):
        pick = order[at:at + BATCH]
        a, b, t = one[pick], two[pick], classes[pick]
        noise = np.searchsorted(cumulated, rng.random(NOISE) * cumulated[-1]).clip(0, len(frequencies) - 1)
        ra, rb, qt, qn = p["context"][a], p["context"][b], p["output"][t], p["output"][noise]
        h = ra @ p["near"] + rb @ p["far"]
        true = (h * qt).sum(1) + p["bias"][t] - log_noise[t]
        false = h @ qn.T + p["bias"][noise] - log_noise[noise]
        up = 1 / (1 + np.exp(np.clip(true, -30, 30)))
        down = -1 / (1 + np.exp(-np.clip(false, -30, 30)))
        dh = up[:, None] * qt + down @ qn
        n = len(frequencies)
        g = {"output": _sums(up[:, None] * h, t, n) + _sums(down.T @ h, noise, n),
             "bias": (np.bincount(t, up, n) + np.bincount(noise, down.sum(0), n)).astype(np.float32),
             "context": _sums(dh, a, n + 1) @ p["near"].T + _sums(dh, b, n + 1) @ p["far"].T,
             "near": ra.T @ dh, "far": rb.T @ dh}
        for k in p:
            step = g[k] / len(pick)
            past[k] += step * step
            p[k] += RATE * step / np.sqrt(past[k])
    return p


def class_log10(p: dict[str, np.ndarray], classes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """log10 of the normalised probability of every class given the two before it."""
    n = len(p["bias"])
    one, two = contexts(classes, starts, n)
    near, far = p["context"] @ p["near"], p["context"] @ p["far"]
    out = np.empty(len(classes))
    for at in range(0, len(classes), SLICE):
        t = classes[at:at + SLICE]
        key, back = np.unique(one[at:at + SLICE] * (n + 1) + two[at:at + SLICE], return_inverse=True)
        h = near[key // (n + 1)] + far[key % (n + 1)]
        norm = np.empty(len(key), np.float32)
        for k in range(0, len(key), 1 << 13):
            scores = h[k:k + (1 << 13)] @ p["output"].T + p["bias"]
            top = scores.max(1, keepdims=True)
            norm[k:k + (1 << 13)] = np.log(np.exp(scores - top).sum(1)) + top[:, 0]
        out[at:at + SLICE] = (h[back] * p["output"][t]).sum(1) + p["bias"][t] - norm[back]
    return out / np.log(10)


# ---- over the corpus -------------------------------------------------------------------

def _class_rows(df: DataFrame, ids: dict[bytes, int], others: int):
    """Per partition of ``df`` (text): classes of about PASS tokens, whole texts, in one array, and the
    places where texts start."""
    shared = df.sparkSession.sparkContext.broadcast(ids)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        short, parts, starts, at = shared.value, [], [], 0
        for batch in batches:
            for text in batch.column(0).cast(pa.large_binary()):
                starts.append(at)
                for words in tokens(text.as_py()):
                    parts.append(np.fromiter((short.get(w, others) for w in words), np.int32, len(words)))
                    at += len(words)
                if at >= PASS:
                    yield np.concatenate(parts), np.array(starts, np.int64)
                    parts, starts, at = [], [], 0
        if at:
            yield np.concatenate(parts), np.array(starts, np.int64)

    return gather


def fit(df: DataFrame, ids: dict[bytes, int], frequencies: np.ndarray, text_col: str = "text") -> dict[str, np.ndarray]:
    """Train on all rows of ``df``: tasks train apart, their parameters are averaged by examples."""
    docs = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    gather = _class_rows(docs, ids, len(frequencies) - 1)
    p = initial(frequencies)
    names = list(p)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, added = 0, None
        for batch in batches:
            for n, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values = np.frombuffer(packed, np.float64)
                weight, added = weight + n, values if added is None else added + values
        if weight:
            yield pa.RecordBatch.from_arrays([pa.array([weight]), pa.array([added.tobytes()], pa.binary())], ["n", "packed"])

    for turn in range(ROUNDS):
        now = p

        def learn(batches: Iterator[pa.RecordBatch], now=now, turn=turn) -> Iterator[pa.RecordBatch]:
            new, past, n = now, {}, 0
            for classes, starts in gather(batches):
                n += len(classes)
                new = train(new, classes, starts, frequencies, n + turn, past)
            if n:
                packed = np.concatenate([new[k].ravel() for k in names]).astype(np.float64) * n
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([packed.tobytes()], pa.binary())], ["n", "packed"])

        trained = docs.mapInArrow(learn, "n long, packed binary")
        sums = trained.repartition(AVERAGERS).mapInArrow(total, "n long, packed binary").collect()
        if not sums:
            break
        flat = sum(np.frombuffer(r["packed"], np.float64) for r in sums) / sum(r["n"] for r in sums)
        p, at = {}, 0
        for k in names:
            p[k] = flat[at:at + now[k].size].reshape(now[k].shape).astype(np.float32)
            at += now[k].size
    return p


def score(df: DataFrame, learning: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``df``: doc_id, n_tokens, n_known, train_tokens, base_score, score (log10), learned
    from ``learning`` (same columns)."""
    counts = cut(token_counts(learning, text_col))
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    train_tokens, vocabulary = total["n"] or 0, total["v"]
    every = train_tokens + SMOOTHING * (vocabulary + 1)
    known, floor = most_frequent(counts, KNOWN)
    base = np.log10((np.array([n for _, n in known], float) + SMOOTHING) / every)
    short = min(SHORT, len(known))
    rest = max(1 - float((10 ** base[:short]).sum()), SMOOTHING / every)
    frequencies = np.append(10 ** base[:short], rest)
    frequencies /= frequencies.sum()
    ids = {token: k for k, (token, _) in enumerate(known)}
    p = fit(learning, {t: k for t, k in ids.items() if k < short}, frequencies, text_col)
    shared = df.sparkSession.sparkContext.broadcast((ids, base, p))
    log_rest = float(np.log10(rest))
    docs = keyed(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, base, p = shared.value
        of = ids.get
        for batch in sliced(batches):
            parts, lengths, rare_of, rare_tokens, rare_times = [], [], [0], [], []
            for text in batch.column(1).cast(pa.large_binary()):
                rare, length = Counter(), 0
                for words in tokens(text.as_py()):
                    found = np.fromiter((of(w, -1) for w in words), np.int64, len(words))
                    rare.update([words[k] for k in np.flatnonzero(found < 0)])
                    parts.append(found)
                    length += len(words)
                rare_tokens += rare.keys()
                rare_times += rare.values()
                rare_of.append(len(rare_tokens))
                lengths.append(length)
            place = np.concatenate([np.zeros(0, np.int64), *parts])
            lengths = np.array(lengths, np.int64)
            starts = np.cumsum(lengths) - lengths
            listed = place >= 0
            unigram = np.where(listed, base[np.where(listed, place, 0)] if len(base) else 0.0, 0.0)
            classes = np.where(listed & (place < short), place, short)
            model = class_log10(p, classes, starts) + np.where(classes == short, unigram - log_rest, 0.0)
            add = (lambda x: np.add.reduceat(x, starts)) if len(starts) else (lambda x: x)
            rows = pa.ListArray.from_arrays(pa.array(rare_of, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(rare_tokens, pa.binary()), pa.array(rare_times, pa.int64())], ["token", "times"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths), pa.array(add(listed.astype(np.int64))),
                 pa.array(add(unigram)), pa.array(add(model)), rows],
                ["doc_id", "n_tokens", "n_known", "base_score", "score", "rare"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double, "
              "rare array<struct<token: binary, times: long>>")
    scored = cut(docs.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))
    # the rest of the tokens: at most one row per document and token; a hot partition of this plain
    # equi-join is one that adaptive execution may split, as nothing above it needs the key together
    rare = scored.select("row", F.explode("rare").alias("_r")).select("row", "_r.token", "_r.times")
    below = counts.where((F.length("token") > LONGEST) | (_level() < floor))
    of_row = (rare.join(below, "token", "left")
              .withColumn("log", F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + SMOOTHING) / every))
              .groupBy("row").agg(F.sum("log").alias("log"), F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("seen")))
    log, seen = F.coalesce("log", F.lit(0.0)), F.coalesce("seen", F.lit(0))
    return scored.drop("rare").join(of_row, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + seen).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + log).alias("base_score"), (F.col("score") + log).alias("score"))
