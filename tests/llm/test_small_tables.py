"""Small tables that come in very many partitions: few tasks take them, and no step repeats what stands."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from subscope.llm import common
from subscope.llm import components as cp
from subscope.llm import jaccard_join as jj
from subscope.llm import prefix_trie as pt
from subscope.llm import token_counts as tc
from subscope.llm.common import narrowed
from subscope.llm.queries import tokenizer_file
from subscope.llm.sentencepiece_codec import Codec


@pytest.fixture
def many_partitions(spark):
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_narrowed_keeps_rows_and_bounds_tasks(spark):
    df = spark.range(1000, numPartitions=20)
    assert narrowed(df, 1000, 300).rdd.getNumPartitions() == 4
    assert narrowed(df, 0).rdd.getNumPartitions() == 1
    assert narrowed(df, 10 ** 9, 100).rdd.getNumPartitions() == 20
    assert narrowed(df, 1000).agg(F.sum("id")).first()[0] == 499500


def test_trie_tables_follow_their_rows(many_partitions):
    rows = [(c, t, "user", f"turn {t} of {c % 7}") for c in range(60) for t in range(5)]
    df = many_partitions.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    _, path = pt.rebuilt(pt.prefixes(df, "conv_id", "turn", "role", "text"), 20, 3)
    assert path.rdd.getNumPartitions() == 1  # 300 turns; 40 shuffle partitions
    assert pt.prefix_trie(df).where("depth = 0").first()["n_convs"] == 60


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return sorted((x, find(x)) for x in root if find(x) != x)


def test_components_in_few_tasks(many_partitions, monkeypatch):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(7, k) for k in range(1000, 1200)] + [(k, k + 1) for k in range(2000, 2040)]
    found = cp.components(many_partitions.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, found.collect())) == brute(edges)
    assert found.rdd.getNumPartitions() == 1
    cuts = []
    monkeypatch.setattr(cp, "cut", lambda df, f=cp.cut: cuts.append(1) or f(df))
    stars = [(10, k) for k in range(11, 40)] + [(50, 60), (50, 50)]
    found = cp.components(many_partitions.createDataFrame(stars, "a long, b long"))
    assert sorted(map(tuple, found.collect())) == brute(stars)
    assert len(cuts) == 1  # stars already: no step changes them
    assert cp.components(many_partitions.createDataFrame([(3, 3)], "a long, b long")).count() == 0


def test_postings_are_one_row_a_class(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join([*words[:k], "other", *words[k + 1:]]) for k in range(6)] + ["far from all the others here"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(0, texts[0])], "doc_id long, text string")
    counts = jj.frequencies(docs, 5, 16)
    found = jj.prefixes(docs, 5, 80, counts, 0.0)
    rows = jj.postings(found, 3).collect()
    assert len(rows) == len({r["c"] for r in rows}) == 6
    for r in rows:
        assert r["posted"] == len(r["tokens"]) == len(r["times"]) and r["heavy"] == sum(t > 3 for t in r["times"])


def test_pairs_send_a_short_list_once(spark):
    member = {"c": 1, "id": 1, "n": 10, "m": 1, "posted": 5, "heavy": 0, "root": 1}
    rows = [{"token": 5, "times": 2, **member, "c": c, "root": c} for c in (1, 2)] + [{"token": 6, "times": 900, **member, "c": c, "root": c} for c in (1, 2, 3)]
    df = spark.createDataFrame(rows, "token long, times long, c long, id long, n long, m long, posted long, heavy long, root long")
    pairs = jj._pairs(df.where("c = 1"), df, 80, "posted", 64)
    assert sorted((r["a"], r["b"], r["shared"]) for r in pairs.collect()) == [(1, 2, 2), (1, 3, 1)]
    sent = [x for x in pairs._jdf.queryExecution().optimizedPlan().toString().split("\n") if "explode" in x]
    assert sent and all("times" in x for x in sent)  # as many copies as the list's length asks for


def test_slot_counts_of_dense_chunks(spark):
    rng = random.Random(5)
    texts = [" ".join(str(rng.randrange(10 ** 6)) for _ in range(4000)) for _ in range(8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)  # over 4096 slots met once
    slots = np.concatenate([jj.shingles(t.encode()) for t in texts]) & np.uint64(65535)
    assert (jj.frequencies(docs, 5, 16) == np.bincount(slots.astype(np.int64), minlength=65536)).all()


def test_token_counts_equal_the_codec():
    rng = random.Random(8)
    codec = Codec(tokenizer_file("piece_bpe_32k.model"))
    letters = "abcdefghijklmnopqrstuvwxyzéß日☃ 0123456789.,'"
    made = {"▁" + "".join(rng.choice(letters) for _ in range(rng.randrange(1, 30))).replace(" ", "") for _ in range(2000)} | {"\n", "▁▁▁", "▁" + "ab" * 400}
    assert tc.trie_counts(codec.pieces, made) == {w: len(codec.pieces.encode_word(w)) for w in made}
    same = {}
    for w in made:
        same.setdefault(len(w), []).append(w)
    for words in same.values():
        assert codec.viterbi(words) == [codec.pieces.encode_word(w) for w in words]


def test_without_joins_few_whole_rows(spark, monkeypatch):
    monkeypatch.setattr(common, "SLOTS", 64)  # most rows are false positives of the first bitmap
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"), F.lit(0).alias("slot"))
    df = df.unionByName(spark.createDataFrame([(None, "a", 0), (7, "b", 0)], "doc_id long, text string, slot int"))
    gone = df.where("doc_id % 9 = 0 OR doc_id IS NULL").select("doc_id")
    left = common.without(df, gone, "doc_id")
    assert left.columns == df.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted([*(i for i in range(400) if i % 9), 7])
    few = common.without(df, gone.where("doc_id = 9"), "doc_id")
    assert few.count() == 401


def test_merges_equal_the_library(monkeypatch):
    from sentencepiece import SentencePieceProcessor

    path = tokenizer_file("piece_bpe_32k.model")
    codec, model, rng = Codec(path), SentencePieceProcessor(model_file=path), random.Random(9)
    made = ["".join(rng.choice("aeinrst") for _ in range(rng.randrange(1, 14))) for _ in range(300)]
    assert [codec.pieces.encode_word("▁" + w) for w in made] == [model.encode(w) for w in made]
    assert [codec.pieces._merged(list("▁" + w)) for w in made] == [model.encode(w, out_type=str) for w in made]
    asked = []
    monkeypatch.setattr(np, "searchsorted", lambda a, v, f=np.searchsorted: asked.append((len(a), len(v))) or f(a, v))
    codec.viterbi(["▁" + "q" * 12] * 40)
    probes = 40 * sum(min(end, codec.pieces.longest) for end in range(1, 14))
    assert sum(n for size, n in asked if size == len(codec.keys)) < probes / 2  # most substrings are told without a search
