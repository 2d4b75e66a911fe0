"""Hard negatives by anchor-clustered shared lists.

Anchors are clustered by direction; the centroids are fitted on at most SAMPLE anchors. Rows are
dealt to blocks of about BLOCK, clusters to groups of about GROUP anchors (a cluster of more is
split). Within a cluster, members of nearly one direction share a list (``tight``). For a block and
such a group the rows are sorted once by the angular upper bound that holds for every member: |row| * cos(max(0, angle(row, centroid) - radius)), radius being the largest
angle of a member to the centroid. Every member walks that list, scoring steps of rows as matrix
products, until the bound of the next row times its own length is below what could still enter
its answer: the k-th score found or the lower limit. What it has not walked is thereby certified.
The first walk finds the positives, the second, whose limits follow from the positives' scores,
the negatives; the blocks' answers are ranked at the end.

Defined results: rows with a null id, label or vector, or a null or non-finite component, take no
part; a missing last component counts as zero. Rows equal in id, label and vector are one row;
rows of one id that differ are rows of their own, and every anchor row answers for itself. Ties go
to the smaller id. Scores are exact integers. No positive, or no row within the limits: no output.
An empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from subscope.llm.common import cut

BLOCK, GROUP = 8192, 2048
#: anchors that the centroids are fitted on, and anchors of that sample for each centroid
SAMPLE, PER_CENTROID = 4096, 16
#: rows of the first step of a walk; each next step is twice as long
STEP = 64
#: members of one list lie within this angle (in degrees) of its first: wider lists bound nothing
WIDTH = 20


def take_part(df: DataFrame, id_col: str, label: Column, vector_col: str, scale: int) -> DataFrame:
    """(id, label, vec, key) of the rows that take part, one for equal ones; vec = floor(scale * x)."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(finite).select(
        F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"),
        F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale)).alias("vec"))
    return rows.where("label IS NOT NULL").distinct().withColumn("key", F.xxhash64("id", "label", "vec"))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[:len(v)] = v
    return out


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norms = np.sqrt((x.astype(np.float64) ** 2).sum(1))
    return x / np.where(norms > 0, norms, 1)[:, None], norms


def centroids(sample: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Spherical k-means of the sample's directions, one centroid for PER_CENTROID of them."""
    unit = _unit(sample)[0]
    found = unit[:: PER_CENTROID] if len(unit) else np.zeros((1, sample.shape[1]))
    for _ in range(rounds):
        nearest = (unit @ found.T).argmax(1)
        sums = np.zeros_like(found)
        np.add.at(sums, nearest, unit)
        moved, norms = _unit(sums)
        found = np.where(norms[:, None] > 0, moved, found)
    return found


def tight(members: np.ndarray, width: float = WIDTH) -> list[np.ndarray]:
    """The cluster's members in groups of one direction each: everyone joins the first member within
    ``width`` degrees of it, or else starts a group. A member far from all others has a list of its own."""
    unit, left, groups = _unit(members)[0], np.arange(len(members)), []
    while len(left):
        near = unit[left] @ unit[left[0]] >= np.cos(np.radians(width))
        near[0] = True
        groups.append(left[near])
        left = left[~near]
    return groups


def shared_list(members: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``x`` by falling upper bound for any member of length one, and those bounds."""
    unit, norms = _unit(members)
    centre = _unit(unit.sum(0)[None])[0][0]
    rows, lengths = _unit(x)
    radius = np.arccos(np.clip(unit[norms > 0] @ centre, -1, 1)).max(initial=0)
    away = np.arccos(np.clip(rows @ centre, -1, 1))
    bound = lengths * np.cos(np.maximum(away - radius, 0)) + 1e-6 * (1 + lengths)  # above rounding
    order = np.argsort(-bound, kind="stable")
    return order, bound[order]


class Request:
    """What one member asks of the list: the first ``k`` rows of its label, or of the others, whose
    scores lie between ``low`` and ``high``."""

    def __init__(self, tag: object, member: int, label: int, same: bool, k: int, low: float = -np.inf, high: float = np.inf):
        self.tag, self.member, self.label, self.same, self.k, self.low, self.high = tag, member, label, same, k, low, high
        self.scores, self.rows = np.zeros(0), np.zeros(0, np.int64)

    def bar(self) -> float:
        """The least score that may still enter."""
        return max(self.low, self.scores[-1]) if len(self.scores) == self.k else self.low

    def offer(self, scores: np.ndarray, rows: np.ndarray, labels: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> None:
        fits = np.flatnonzero((scores >= self.bar()) & (scores <= self.high) & ((labels[rows] == self.label) == self.same))
        if len(fits):
            self.scores = np.concatenate([self.scores, scores[fits]])
            self.rows = np.concatenate([self.rows, rows[fits]])
            best = np.lexsort((keys[self.rows], ids[self.rows], -self.scores))[:self.k]
            self.scores, self.rows = self.scores[best], self.rows[best]


def walk(members: np.ndarray, own: np.ndarray, requests: list[Request], x: np.ndarray, ids: np.ndarray,
         labels: np.ndarray, keys: np.ndarray) -> int:
    """Answer ``requests`` of one cluster's ``members`` (row keys ``own``); rows scored on the way, summed over members."""
    order, bound = shared_list(members, x)
    lengths = _unit(members)[1]
    most = float(np.abs(members).max(initial=0)) * float(np.abs(x).max(initial=0)) * x.shape[1]
    kind = np.float64 if most < 2 ** 53 else object  # sums are exact integers either way
    q, listed = members.astype(kind), x[order].astype(kind)
    at, step, scored = 0, STEP, 0
    while requests and at < len(order):
        requests = [r for r in requests if bound[at] * lengths[r.member] >= r.bar()]
        active = sorted({r.member for r in requests})
        rows = order[at:at + step]
        scores = dict(zip(active, q[active] @ listed[at:at + step].T, strict=True)) if active else {}
        for r in requests:
            line, others = scores[r.member], keys[rows] != own[r.member]
            r.offer(line[others], rows[others], labels, ids, keys)
        scored += len(active) * len(rows)
        at, step = at + step, step * 2
    return scored


def _grid(rows: DataFrame, anchors: DataFrame, n: int, m: int, run, schema: str) -> DataFrame:
    """``run`` for every block of rows with every group of anchors."""
    blocks, groups = max(1, -(-n // BLOCK)), max(1, -(-m // GROUP))
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = rows.withColumn("b", F.pmod("key", F.lit(blocks)).cast("int")).withColumn("g", every(groups))
    right = (anchors.withColumn("g", F.pmod(F.xxhash64("cluster", "part"), F.lit(groups)).cast("int"))
             .withColumn("b", every(blocks)))
    return left.groupBy("b", "g").cogroup(right.groupBy("b", "g")).applyInPandas(run, schema)


def _answers(x: pd.DataFrame, a: pd.DataFrame, asked) -> pd.DataFrame:
    """Rows (tag, id, label-free key, score) of every request that ``asked(anchor row, member)`` makes."""
    out: dict[str, list] = {"key": [], "slot": [], "row_id": [], "row_key": [], "score": []}
    if len(x) and len(a):
        width = max(x.vec.map(len).max(), a.vec.map(len).max())
        rows, ids, labels, keys = _matrix(x.vec, width), x.id.to_numpy(), x.label.to_numpy(), x.key.to_numpy()
        for _, cluster in a.groupby(["cluster", "part"], sort=False):
            members, own, lines = _matrix(cluster.vec, width), cluster.key.to_numpy(), list(cluster.itertuples())
            requests = []
            for group in tight(members):
                each = [r for member, at in enumerate(group) for r in asked(lines[at], member)]
                walk(members[group], own[group], list(each), rows, ids, labels, keys)
                requests += each
            for r in requests:
                out["key"] += [r.tag[0]] * len(r.rows)
                out["slot"] += [r.tag[1]] * len(r.rows)
                out["row_id"] += ids[r.rows].tolist()
                out["row_key"] += keys[r.rows].tolist()
                out["score"] += [min(max(int(s), -(1 << 63)), (1 << 63) - 1) for s in r.scores]
    return pd.DataFrame({c: np.array(v, np.int64) for c, v in out.items()})


_FOUND = "key long, slot long, row_id long, row_key long, score long"


def hard_negatives(df: DataFrame, is_anchor: Column, label: Column | str = "label", id_col: str = "vec_id",
                   vector_col: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 10,
                   low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are its ``positives`` best other rows of its label. For each, the best
    ``negatives`` rows of other labels with low * positive <= 100 * negative <= high * positive.
    ``is_anchor`` is a condition on the column ``id``.
    """
    rows = cut(take_part(df, id_col, F.col(label) if isinstance(label, str) else label, vector_col, scale))
    anchors = rows.where(is_anchor)
    n, m = rows.count(), anchors.count()
    sample = anchors.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("vec").toPandas().vec  # bounded
    width = int(sample.map(len).max()) if len(sample) else 1
    centres = centroids(_matrix(sample, width))

    def nearest(batches):
        for batch in batches:
            unit = _unit(_matrix(batch.vec.map(lambda v: v[:width]), width))[0]
            yield batch.assign(cluster=(unit @ centres.T).argmax(1).astype(np.int32) if len(batch) else np.zeros(0, np.int32))

    kind = "id long, label long, vec array<long>, key long, cluster int"
    anchors = cut(anchors.mapInPandas(nearest, kind))
    sizes = anchors.groupBy("cluster").count().select("cluster", F.ceil(F.col("count") / GROUP).cast("long").alias("parts"))
    # at most one row a centroid
    anchors = anchors.join(F.broadcast(sizes), "cluster").withColumn("part", F.pmod("key", F.col("parts"))).drop("parts")

    def ask_positives(line, member):
        return [Request((line.key, 0), member, line.label, True, positives)]

    best = lambda k, *by: Window.partitionBy(*by).orderBy(F.desc("score"), "row_id", "row_key")  # noqa: E731, ARG005
    found = _grid(rows, anchors, n, m, lambda x, a: _answers(x, a, ask_positives), _FOUND)
    found = found.withColumn("rank", F.row_number().over(best(positives, "key"))).where(F.col("rank") <= positives)
    chosen = cut(found.select("key", F.col("rank").cast("long").alias("slot"), F.col("row_id").alias("positive_id"),
                              F.col("score").alias("positive_score")))
    wanted = chosen.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("slot", "positive_score"))).alias("wanted"))
    asking = anchors.join(wanted, "key").select(
        "*", F.col("wanted.slot").alias("slots"), F.col("wanted.positive_score").alias("scores")).drop("wanted")

    def ask_negatives(line, member):
        return [Request((line.key, slot), member, line.label, False, negatives, -(-low * int(p) // 100), high * int(p) // 100)
                for slot, p in zip(line.slots, line.scores, strict=True) if low * int(p) <= high * int(p)]

    found = _grid(rows, asking, n, m, lambda x, a: _answers(x, a, ask_negatives), _FOUND)
    found = found.withColumn("rank", F.row_number().over(best(negatives, "key", "slot"))).where(F.col("rank") <= negatives)
    return (found.join(chosen, ["key", "slot"]).join(anchors.select("key", F.col("id").alias("anchor_id")), "key")
            .select("anchor_id", "positive_id", "rank", F.col("row_id").alias("negative_id"), "positive_score",
                    F.col("score").alias("negative_score")))
