"""Conversation trie, n-gram Jaccard components and hard negatives against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from subscope.llm import hard_negatives as hn
from subscope.llm import jaccard_join as jj
from subscope.llm import prefix_trie as pt
from subscope.llm.common import HEAVY, lookup


# ---- lookups of skewed keys

def test_lookup_matches_every_row_of_hot_and_rare_keys(spark):
    rows = spark.range(9000).select(F.when(F.col("id") < 3000, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
    values = rows.where("k % 2 = 0").groupBy("k").agg(F.count("*").alias("w")).withColumn("v", F.col("k") * 10)
    got = {tuple(r) for r in lookup(rows, ["k"], values, "w", 9000).select("k", "x", "v").collect()}
    assert HEAVY < 9000 and got == {(k, x, k * 10 if k % 2 == 0 else None) for k, x in ((0 if i < 3000 else i, i) for i in range(9000))}


# ---- 11 conversation prefix trie

def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * words(p)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(built[c]) == len(p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


_CONV = "conv_id long, turn long, role string, text string, depth long, conv string, k1 string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", None) for r in rows], _CONV)  # with clashing extra columns


def nodes(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(3)
    rows = []
    for c in [*range(120), -5, -20, -41]:
        for turn in range(rng.choice([1, 1, 2, 4, 6])):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["yes", "no way", "a  b\tc", ""])))
    rows += [(300, t, "user", f"turn {t % 3}") for t in range(900)]  # a conversation of most rows, and its copies
    rows += [(c, t, "user", f"turn {t % 3}") for c in (301, 302) for t in range(450)]
    rows += [(303, None, None, None), (303, None, "user", "x"), (303, 0, "user", None), (303, 0, "user", ""), (303, 0, "user", "")]
    rows += [(None, 0, "user", "yes"), (20, 0, "user", "yes"), (20, 0, "user", "yes"), (401, 0, "user", "long " * 50_000)]
    return rows


@pytest.mark.parametrize("bits", [28, 4])  # a sketch of 16 slots proves almost nothing: all goes to exact grouping
def test_trie_equals_brute_force(spark, talks, bits, monkeypatch):
    monkeypatch.setattr(pt, "MIN_BITS", min(bits, pt.MIN_BITS))
    df = conversations(spark, talks).repartition(5)
    assert nodes(pt.prefix_trie(df, max_bits=bits)) == brute_trie(talks)


def test_trie_of_turnless_conversations_and_none(spark, talks):
    lost = [(c, t, "user", "x") for c in range(1, 20) for t in range(2)]  # their first turns come from an absent conversation
    got = nodes(pt.prefix_trie(conversations(spark, lost)))
    assert got == brute_trie(lost)
    assert any(zlib.crc32(str(c).encode()) % 4 > 1 for c in range(1, 20))
    assert pt.prefix_trie(conversations(spark, talks).limit(0)).count() == 0
    only_null = conversations(spark, [(None, 1, "user", "x")])
    assert pt.prefix_trie(only_null).count() == 0


def test_states_add_up_over_partitions(spark, talks):
    """The same prefixes whether a conversation lies in one partition or in many."""
    df = conversations(spark, talks)
    spark.conf.set("spark.sql.shuffle.partitions", "31")
    try:
        many = sorted(map(tuple, pt.prefixes(df, "conv_id", "turn", "role", "text").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    one = sorted(map(tuple, pt.prefixes(df.coalesce(1), "conv_id", "turn", "role", "text").collect()))
    assert many == one


def test_sketch_never_underestimates_and_proves_most_singletons(spark):
    hashes = spark.range(4000).select(F.xxhash64(F.col("id") % 3000).alias("h"))
    bits = 16
    chunks = {r["chunk"]: np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little") for r in pt.repeated_slots(hashes, bits).collect()}

    def more(h):
        slots = [((h >> 32 * r) & ((1 << bits) - 1)) + (r << bits) for r in range(pt.ROWS)]
        return all(s >> 16 in chunks and chunks[s >> 16][s & 65535] for s in slots)

    counts = Counter(r["h"] & (1 << 64) - 1 for r in hashes.collect())
    assert all(more(h) for h, n in counts.items() if n > 1)
    assert sum(more(h) for h, n in counts.items() if n == 1) < 0.02 * len(counts)


# ---- 12 n-gram Jaccard components

def brute_components(rows, percent=80):
    ids = defaultdict(list)
    for i, text in rows:
        w = (text or "").encode().lower().split()
        ids[frozenset(tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()].append(i)
    sets = [s for s in ids if s]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, s in enumerate(sets):
        for b in range(a):
            both = len(s & sets[b])
            if 100 * both >= percent * (len(s) + len(sets[b]) - both):
                root[find(a)] = find(b)
    inf = float("inf")
    least = defaultdict(lambda: inf)
    for a, s in enumerate(sets):
        least[find(a)] = min([least[find(a)], *(inf if i is None else i for i in ids[s])])
    out = [(i, len(s), None if least[find(a)] == inf else least[find(a)]) for a, s in enumerate(sets) for i in ids[s]]
    return sorted(out + [(i, 0, i) for i in ids.get(frozenset(), [])], key=repr)


def near_copies(rng, count):
    """Texts around a few originals, with chains of growing distance, and a passage that most share."""
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = rng.sample(vocabulary, 60)
    rows = []
    for family in range(6):
        base = rng.sample(vocabulary, rng.choice([30, 90, 150]))
        for k in range(count):
            text = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            if k % 3 == 0:
                text += passage
            if k % 7 == 0:
                text = text[:rng.randrange(5, len(text))]
            rows.append((1000 * family + k, " ".join(text)))
    rows += [(9000 + k, " ".join(passage[:55] + rng.sample(vocabulary, rng.randrange(3, 9)))) for k in range(40)]
    return rows + [(9500, " ".join(passage)), (9501, "one"), (9502, "ONE"), (9503, "one two three four"), (9504, "")]


@pytest.mark.parametrize("light,pivots", [(64, 16), (4, 2), (2, 1)])  # long lists of their own, or almost only those
def test_components_equal_brute_force(spark, light, pivots):
    rows = near_copies(random.Random(light), 25)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((tuple(r) for r in jj.jaccard_components(df, light=light, pivots=pivots).collect()), key=repr)
    assert got == brute_components(rows)


def test_component_edges(spark, edges, empty):
    clash = edges.withColumns({c: F.lit(1) for c in ("c", "n", "root", "token", "least", "rows", "salt", "a", "b")})
    got = sorted((tuple(r) for r in jj.jaccard_components(clash).collect()), key=repr)
    assert got == brute_components([(r["doc_id"], r["text"]) for r in edges.collect()])
    assert jj.jaccard_components(empty).count() == 0


def test_prefixes_share_what_similar_sets_must_share():
    rng = np.random.default_rng(2)
    counts = rng.integers(1, 400, 1 << 16).astype("<u2")
    matched = Counter()
    for _ in range(400):
        n = int(rng.integers(5, 200))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        out = rng.random(len(a)) < 0.08
        b = np.unique(np.concatenate([a[~out], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 12))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both < 80 * (len(a) + len(b) - both):
            continue
        (m1, p1), (m2, p2) = jj.prefix(a, counts, 100, 80), jj.prefix(b, counts, 100, 80)
        shared = len(np.intersect1d(p1, p2))
        overlap = -(-80 * (len(a) + len(b)) // 180)
        rest = max(-(-80 * len(s) // 100) - m for s, m in ((a, m1), (b, m2)))
        assert shared >= max(overlap - rest, min(m1, m2))
        matched[m1] += 1
    assert len(matched) > 2  # prefixes are lengthened where frequent shingles make it pay


def test_shingles_of_blocks_are_those_of_the_text():
    text = b"One two\tTHREE four five\x0bsix " * 60_000
    assert len(jj.shingles(text)) == 6 and len(jj.shingles(b"a b")) == 1 and len(jj.shingles(b" \n")) == 0
    assert jj.shingles(b"a b c d") != jj.shingles(b"d c b a")


# ---- 13 hard negatives

def brute_negatives(rows, scale=256):
    valid = sorted({(i, int(label), tuple(math.floor(scale * x) for x in v)) for i, label, v in rows
                    if None not in (i, label, v) and all(x is not None and math.isfinite(x) for x in v)})
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for anchor in valid:
        if anchor[0] % 100:
            continue
        scored = [(-dot(anchor[2], r[2]), r[0], r) for r in valid if r != anchor]
        for p, pid, _ in sorted(s for s in scored if s[2][1] == anchor[1])[:5]:
            fit = sorted(s for s in scored if s[2][1] != anchor[1] and 30 * -p <= 100 * -s[0] <= 90 * -p)[:10]
            out += [(anchor[0], pid, rank, nid, -p, -n) for rank, (n, nid, _) in enumerate(fit, 1)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label int, embedding array<float>, key long, cluster string")


def mined(df, **more):
    return sorted(tuple(r) for r in hn.hard_negatives(df, F.col("id") % 100 == 0, **more).collect())


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(1200):
        v = (centres[i % 12] + rng.normal(size=16) * rng.choice([0.05, 0.6])).astype(np.float32)
        rows.append((i, int(rng.integers(0, 4)), [float(x) for x in v / np.linalg.norm(v)]))
    return rows


def test_negatives_equal_brute_force(spark, clustered, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK", 300)
    monkeypatch.setattr(hn, "GROUP", 5)
    assert mined(vectors(spark, clustered).repartition(3)) == brute_negatives(clustered)


def test_negatives_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5]), (0, 1, [1.0, 0.5]), (0, 1, [0.5, 1.0]), (0, 2, [1.0, 0.25]), (1, 1, [0.9, 0.5]), (2, 1, None),
            (3, 2, [0.5, 0.25]), (4, 2, [0.5, 0.25]), (5, 3, [0.4]), (6, None, [0.5, 0.5]), (7, 2, [nan, 0.1]), (8, 2, [inf, 0.1]),
            (9, 2, [None, 0.1]), (None, 2, [0.3, 0.3]), (10, 2, [0.0, 0.0]), (100, 5, [0.0, 0.0]), (200, 6, [-1.0, -1.0]), (11, 6, [0.5, 0.5])]
    got = mined(vectors(spark, rows))
    assert got == brute_negatives(rows) and len({r[1] for r in got}) > 1
    assert mined(vectors(spark, rows).limit(0)) == []
    assert mined(vectors(spark, [r for r in rows if r[0] in (1, 3)])) == []  # no anchor


def test_walks_stop_early_and_stay_exact():
    """Tight clusters: a member's list is certified long before its end."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 32))
    x = np.floor(256 * (lambda v: v / np.linalg.norm(v, axis=1, keepdims=True))(
        np.repeat(centres, 200, 0) + rng.normal(size=(8000, 32)) * 0.05)).astype(np.int64)
    ids, labels, keys = np.arange(8000), np.arange(8000) % 2, np.arange(8000)
    members = np.arange(0, 200, 20)  # of one cluster
    requests = [hn.Request((m, 0), k, int(labels[m]), True, 5) for k, m in enumerate(members)]
    scored = hn.walk(x[members], keys[members], list(requests), x, ids, labels, keys)
    assert scored <= 0.15 * len(members) * len(x)
    for r, m in zip(requests, members, strict=True):
        s = x @ x[m]
        want = sorted((-s[i], i) for i in range(8000) if labels[i] == labels[m] and i != m)[:5]
        assert [(-int(a), int(b)) for a, b in zip(r.scores, r.rows, strict=True)] == want


def test_walks_of_random_directions_stop_early_too():
    """Members that share no direction have lists of their own, whose bounds are tight."""
    rng = np.random.default_rng(9)
    x = np.floor(256 * (lambda v: v / np.linalg.norm(v, axis=1, keepdims=True))(rng.normal(size=(4000, 64)))).astype(np.int64)
    x[1::40] = x[0::40] + rng.integers(-2, 3, (100, 64))  # some near copies
    ids, labels, keys = np.arange(4000), np.arange(4000) % 5, np.arange(4000)
    anchors = np.concatenate([np.arange(0, 4000, 200), np.arange(1, 4000, 200)])
    groups = hn.tight(x[anchors])
    assert sorted(len(g) for g in groups) == [2] * 20  # an anchor and its near copy
    scored = 0
    for group in groups:
        m = anchors[group]
        requests = [hn.Request((i, 0), k, int(labels[i]), False, 10, 0, 9000) for k, i in enumerate(m)]
        scored += hn.walk(x[m], keys[m], list(requests), x, ids, labels, keys)
        for r, i in zip(requests, m, strict=True):
            s = x @ x[i]
            want = sorted((-s[j], j) for j in range(4000) if labels[j] != labels[i] and 0 <= s[j] <= 9000)[:10]
            assert [(-int(a), int(b)) for a, b in zip(r.scores, r.rows, strict=True)] == want
    assert scored < 0.5 * len(anchors) * len(x)


def test_bound_holds_for_every_member():
    rng = np.random.default_rng(6)
    members, x = rng.integers(-256, 256, (30, 8)), rng.integers(-256, 256, (500, 8))
    x[0] = 0
    order, bound = hn.shared_list(members, x)
    assert (np.diff(bound) <= 0).all()
    lengths = np.linalg.norm(members, axis=1)
    assert (members @ x[order].T <= bound * lengths[:, None]).all()


def test_components_are_found_again_only_for_new_links(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(jj, "components", lambda edges, f=jj.components: calls.append(1) or f(edges))
    words = [f"w{i}" for i in range(120)]
    rows = [(k, " ".join([*words[:k], "other", *words[k + 1:]])) for k in range(8)] + [(9, "far from all the others here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in jj.jaccard_components(df, light=2, pivots=1).collect())
    assert got == brute_components(rows)
    assert len(calls) == 1  # all links are with the smallest
