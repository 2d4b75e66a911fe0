"""Each operator against a brute-force version, an exact round trip or held-out accuracy."""

import hashlib
import math
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from subscope.llm import langid, license_scan, lm, packing, sentencepiece_codec, toxicity
from subscope.llm.common import SLOTS, blocks, fold, slot_bitmap, with_membership
from subscope.llm.components import components
from subscope.llm.exact_dedup import drop_copies, exact_dedup
from subscope.llm.piece_model import Pieces, words
from subscope.llm.queries import tokenizer_file
from subscope.llm.simhash import drop_near_copies, fingerprint, links, simhash_groups
from subscope.llm.token_counts import token_counts, trie_counts
from subscope.llm.topk import search, top_k
from subscope.llm.word_bpe import Encoder

PIECES = tokenizer_file("piece_bpe_32k.model")
WORDS = tokenizer_file("word_bpe_49k.json")


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


# ---- helpers

def test_blocks_join_to_the_text_and_split_no_word():
    text = b"one two\nthree " * 1000
    parts = list(blocks(text, 100))
    assert b"".join(parts) == text and len(parts) > 10
    assert [w for p in parts for w in p.split()] == text.split()
    assert list(blocks(b"")) == [] and list(blocks(b"x" * 500, 100)) == [b"x" * 500]


def test_bitmap_holds_exactly_its_slots(spark):
    slots = {0, 1, 7, 8, 32767, 32768, 65535, 70000, SLOTS - 1}
    bitmap = slot_bitmap(spark.createDataFrame([(s,) for s in slots], "slot long"))
    asked = spark.createDataFrame([(s,) for s in slots | {2, 6, 9, 32766, 32769, 65536, SLOTS - 2}], "s long")
    found = with_membership(asked, F.col("s"), bitmap, "hit").collect()
    assert {r["s"] for r in found if r["hit"]} == slots and len(found) == 16


# ---- 1 licence scans

MIT = """/*
 * Copyright (c) 2020 Somebody
 *
 * Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal
 * in the Software without restriction.
 *
 * The above copyright notice and this permission notice shall be included in all
 * copies or substantial portions of the Software.
 *
 * THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
 * IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
 * FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
 */"""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""
GPL = """// This program is free software: you can redistribute it and/or modify
// it under the terms of the GNU General Public License as published by
// the Free Software Foundation, either version 3 of the License, or
// (at your option) any later version.
"""


@pytest.mark.parametrize(("text", "licences", "unmatched"), [
    (MIT, ["MIT"], 0), (APACHE, ["Apache-2.0"], 0), (GPL, ["GPL-3.0-or-later"], 0), (MIT + "\n\n" + APACHE, ["MIT", "Apache-2.0"], 0),
    ("words before.\nReleased under the MIT License.\nwords after", ["MIT"], 0),
    ("a heading\nReleased under the MIT License.", ["MIT"], 0),
    ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0-only"], 0),
    ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"], 0), ("// SPDX-License-Identifier: ISC\nint x;", ["spdx:isc"], 0),
    ("No licence for old men.", [], 1), ("The above copyright notice and this permission notice shall be included in all copies "
                                         "or substantial portions of the Software.", [], 1), ("", [], 0), (None, [], 0),
])
def test_licence_rules(spark, text, licences, unmatched):
    row = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [m["license"] for m in row["matches"]] == licences and row["n_unmatched"] == unmatched
    assert all(0 <= m["start"] < m["end"] <= len(text) for m in row["matches"])


KNOWN_SENTENCES = {
    "spdx": "SPDX-License-Identifier: MIT", "ccby": "Available under CC BY 4.0", "cc0": "Released under CC0", "copyright": "Copyright 2020 Foo",
    "mit.short": "Released under the MIT License", "bsd.short": "Licensed under the BSD 2-clause license", "apache.under": "Licensed under the Apache License, Version 2.0",
    "gpl.short": "Licensed under the GNU General Public License v2", "gpl.terms": "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or at your option any later version",
    "mpl.terms": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mpl.copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "bsd.names": "Neither the name of Foo nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd.asis": "This software is provided by the authors as is and any express or implied warranties are disclaimed",
    "bsd.liability": "In no event shall the authors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages",
    "gpl.version": "Either version 2 of the License, or at your option any later version", "gpl.hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl.details": "See the GNU General Public License for more details", "gpl.received": "You should have received a copy of the GNU General Public License along with this program",
    "isc.grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "bsd.source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd.binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "apache.copy": "You may obtain a copy of the License at", "address": None,
}


def test_every_known_sentence_and_rule_end_to_end(spark):
    said = {name: KNOWN_SENTENCES.get(name, pattern.replace(".*", "").replace("?or", "or")) for name, pattern in license_scan.SENTENCES}
    know = license_scan.Sentences()
    for name, text in said.items():
        if text:
            spans = [text[a:b] for a, b in license_scan.licence_sentences(text)]
            assert spans == [text] and [part[2] for part in know(text)] == [name]
    texts = [(k, ".\n".join(said[part.rstrip("?")] for part in parts) + ".") for k, (_, parts) in enumerate(license_scan.RULES)]
    found = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for k, (licence, _) in enumerate(license_scan.RULES):
        name = [m["license"] for m in found[k]["matches"]]
        assert len(name) == 1 and found[k]["n_unmatched"] == 0 and name[0].startswith(licence.split("{")[0])
    more = ["Available under CC\n# BY 4.0.", "Dedicated to Creative\n// Commons Zero."]
    found = license_scan.scan(spark.createDataFrame(list(enumerate(more)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [[m["license"] for m in r["matches"]] for r in found] == [["CC-BY-4.0"], ["CC0-1.0"]]


@pytest.mark.parametrize(("text", "licences", "unmatched"), [
    ("# Copyright 2020 Foo\n# SPDX-License-Identifier: MIT", ["spdx:mit"], 0),
    ("Copyright (c) 2020 Foo\nReleased under the MIT License.", ["MIT"], 0),
    ("Copyright 2020 Foo\nCopyright 2021 Bar\nsome licence of ours", [], 1),
    ("// SPDX-License-Identifier: ISC\n// SPDX-License-Identifier: MIT\n", ["spdx:isc", "spdx:mit"], 0),
    ("Released under the MIT License\nand more\nLicensed under CC BY 4.0\nby a licence of ours", ["MIT", "CC-BY-4.0"], 1),
    ("Dedicated to CC0 by licence\nSPDX-License-Identifier: MIT", ["CC0-1.0", "spdx:mit"], 0),
    ("a heading\n" + "\n".join("This work is licensed under the GNU General Public License, version 3 or at your option any later version".split()),
     ["GPL-3.0-or-later"], 0),
])
def test_every_licence_of_a_span(spark, text, licences, unmatched):
    row = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [m["license"] for m in row["matches"]] == licences and row["n_unmatched"] == unmatched


def test_licence_lines_of_the_table(documents):
    phrases = {"MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
               "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0."}
    found = {r["doc_id"]: {m["license"] for m in r["matches"]} for r in license_scan.scan(documents).collect()}
    for r in documents.collect():
        for name, phrase in phrases.items():
            assert (phrase in r["text"]) == (name in found[r["doc_id"]])


def test_long_licence_texts_take_time_in_proportion():
    """20,000 lines of licence language without a stop, and the same behind a sentence with an open end."""
    lines = [f"this license applies to file {i} of the program" for i in range(20_000)]
    for head in ([], ["Dedicated to the CC0 license"]):
        text = "\n".join(head + lines + ["released under the MIT license", *lines[:50]])
        began = time.process_time()
        sentences = license_scan.Sentences()
        found = [name for a, b in license_scan.licence_sentences(text) for *_, name, _ in sentences(text[a:b])]
        assert time.process_time() - began < 20
        assert "mit.short" in found


# ---- 2 exact dedup

def brute_copies(data):
    groups = defaultdict(list)
    for i, t in data:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        left = 1
        for i in ids:
            kept = i == keep and left > 0
            left -= kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_dedup(edges, documents, empty):
    for df in (edges, documents, empty):
        got = exact_dedup(df, extra={"text_sha256": F.sha2("text", 256)})
        assert rows(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == brute_copies(
            [(r["doc_id"], r["text"]) for r in df.collect()])


def test_exact_dedup_needs_more_than_length_and_prefix(spark):
    base = "x" * 300
    df = spark.createDataFrame([(k, base + t) for k, t in enumerate(["aa", "ab", "aa", "b"])], "doc_id long, text string")
    assert {r["doc_id"]: r["keep_id"] for r in exact_dedup(df).collect()} == {0: 2, 1: 1, 2: 2, 3: 3}


def test_drop_copies_keeps_one_row_of_each_text(edges):
    left = drop_copies(edges)
    assert left.columns == edges.columns
    kept = [(r["doc_id"], r["text"] or "") for r in left.collect()]
    expected = [(i, t) for i, t in {((r["doc_id"]), r["text"] or "") for r in edges.collect()}
                if i == max(x["doc_id"] or -99 for x in edges.collect() if (x["text"] or "") == t)]
    assert sorted(kept) == sorted(expected)


def test_dedup_main_path_is_native(documents):
    plan = exact_dedup(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapIn" not in plan


# ---- 3 language model

def test_scores_match_brute_force(spark, edges, documents, monkeypatch):
    monkeypatch.setattr(lm, "KNOWN", 600)
    both = documents.select("doc_id", "text").unionByName(edges.select("doc_id", "text"))
    learning = both.where(fold("doc_id", 10) != 0)
    got = lm.score(both, learning).collect()
    tokens = lambda t: (t or "").encode().lower().split() + [b"\n"]
    c = Counter(w for r in learning.collect() for w in tokens(r["text"]))
    n, every = sum(c.values()), sum(c.values()) + 0.1 * (len(c) + 1)
    want = sorted((str(r["doc_id"]), len(w), sum(c[x] > 0 for x in w), round(sum(math.log10((c[x] + .1) / every) for x in w), 5))
                  for r in both.collect() for w in [tokens(r["text"])])
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 5)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n} and all(r["score"] < 0 for r in got)


def test_model_probabilities_sum_to_one_and_learn():
    rng = np.random.default_rng(0)
    chain = np.array([[.8, .1, .05, .05], [.05, .8, .1, .05], [.05, .05, .8, .1], [.1, .05, .05, .8]])
    classes = [0]
    for _ in range(60_000):
        classes.append(int(rng.choice(4, p=chain[classes[-1]])))
    classes = np.array(classes)
    starts = np.arange(0, len(classes), 500)
    p = lm.initial(np.full(4, .25))
    total = sum(10 ** lm.class_log10(p, np.array([1, 2, k]), np.array([0]))[2] for k in range(4))
    assert abs(total - 1) < 1e-5
    before = lm.class_log10(p, classes[:5000], starts[starts < 5000]).mean()
    for turn in range(3):
        p = lm.train(p, classes, starts, np.full(4, .25), turn)
    after = lm.class_log10(p, classes[:5000], starts[starts < 5000]).mean()
    assert after > before + 0.1
    total = sum(10 ** lm.class_log10(p, np.array([1, 2, k]), np.array([0]))[2] for k in range(4))
    assert abs(total - 1) < 1e-5


def test_every_learning_document_trains_the_model(spark, monkeypatch):
    texts = [(k, "one two " * (k + 1)) for k in range(40)]
    learning = spark.createDataFrame(texts + [(0, "one two")] * 3, "doc_id long, text string")
    examples = []
    monkeypatch.setattr(lm, "PASS", 100, raising=False)
    seen = lm.fit

    def fit(df, *more):
        examples.append(df.count())
        return seen(df, *more)

    monkeypatch.setattr(lm, "fit", fit)
    assert lm.score(learning, learning).count() == 43 and examples == [43]
    # one document, whatever its id, moves the model from its start
    for doc_id in range(3):
        one = spark.createDataFrame([(doc_id, "one two " * 3000)], "doc_id long, text string")
        row = lm.score(one, one).first()
        assert row["score"] > row["base_score"] + 1


def test_scores_without_learning_text(edges, empty):
    got = lm.score(edges, empty).collect()
    assert len(got) == edges.count() and all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in got)
    assert all(abs(r["base_score"] - r["score"]) < 1e-4 * r["n_tokens"] for r in got)
    assert lm.score(empty, edges).count() == 0


# ---- 4 packing

def test_encoder_gives_the_tokenizers_ids(documents, edges):
    from tokenizers import Tokenizer

    whole, cached = Tokenizer.from_file(WORDS), Encoder(WORDS)
    texts = [r["text"] for r in documents.limit(60).collect()] + [r["text"] or "" for r in edges.collect()]
    texts += ["İ ΣΑΣ <|endoftext|>x", "á ́c d\x1ce \x85 f", "It's I'LL don't _x_ 12½ ²µ ×÷", "  a  ", "ﬁ ǅ ŉ ß ẞ"]
    for text in texts:
        assert np.frombuffer(cached.encode(text, 1000), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def check_packing(found, capacity):
    place = defaultdict(list)
    for r in found:
        place[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in place.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(place)


def test_pieces_and_sequences(spark, edges, empty):
    cut = packing.pieces(edges, WORDS, capacity=50)
    found = packing.pack(cut, capacity=50, groups=4).collect()
    check_packing(found, 50)
    whole = Encoder(WORDS)
    want = []
    for r in edges.collect():
        ids = np.append(np.frombuffer(whole.encode(r["text"] or ""), "<u4"), 0).astype("<u4")
        want += [(str(r["doc_id"]), k // 50, k, len(ids[k:k + 50]), zlib.crc32(ids[k:k + 50].tobytes())) for k in range(0, len(ids), 50)]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == sorted(want)
    assert packing.pack(packing.pieces(empty, WORDS)).count() == 0
    lengths = {r["sequence_id"]: len(r["ids"]) for r in packing.sequences(spark.createDataFrame(found[:200], packing.pack(cut, 50).schema)).collect()}
    assert all(0 < n <= 50 for n in lengths.values())


@pytest.mark.parametrize("kind", ["uniform", "one length", "large", "small"])
def test_packing_is_near_the_bound(spark, kind):
    rng = random.Random(3)
    draw = {"uniform": lambda: rng.randrange(1, 101), "one length": lambda: 40 if rng.random() < .6 else rng.randrange(1, 101),
            "large": lambda: rng.randrange(48, 101), "small": lambda: rng.randrange(1, 30)}[kind]
    data = [(k, 0, 0, draw()) for k in range(3000)]
    found = packing.pack(spark.createDataFrame(data, "doc_id long, piece int, start long, length long"), capacity=100).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(3000))
    rooms, best = [], 0
    for length in sorted((d[3] for d in data), reverse=True):  # best fit decreasing, one by one
        fit = min((r for r in rooms if r >= length), default=None)
        if fit is None:
            best += 1
            rooms.append(100 - length)
        else:
            rooms[rooms.index(fit)] -= length
    assert check_packing(found, 100) <= 1.03 * best + 2


def test_configurations_hold_exactly_the_demand():
    sizes, demand = [90, 61, 50, 41, 33, 20], [5, 17, 40, 33, 101, 64]
    found = packing.configurations(sizes, demand, 100)
    assert (sum(c * x for c, x in found) == demand).all()
    assert all((c * sizes).sum() <= 100 and x > 0 for c, x in found)


# ---- 5 SimHash

def plain_fingerprint(text):
    w = text.lower().split() if text.isascii() else text.encode().lower().split()
    w = [x.encode() if isinstance(x, str) else x for x in w]
    if not w:
        return 0
    shingles = [b" ".join(w[k:k + 3]) for k in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    ids = list(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[:x]:
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_fingerprints_and_groups(documents):
    got = {r["doc_id"]: r for r in simhash_groups(documents).collect()}
    want = {r["doc_id"]: plain_fingerprint(r["text"]) for r in documents.collect()}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == want
    assert {i: r["component_id"] for i, r in got.items()} == brute_groups(want)


def test_spark_hash_is_the_same(spark):
    assert spark.sql("select xxhash64('a b c')").first()[0] % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", seed=42)
    assert fingerprint(b"a b c") == xxhash.xxh64_intdigest(b"a b c", seed=42) and fingerprint(b" \n") == 0


@pytest.mark.parametrize("heavy", [256, 8, 0])
def test_links_connect_what_brute_force_connects(spark, heavy):
    rng = random.Random(heavy)
    prints = set()
    for _ in range(12):  # dense balls, chains and strangers
        centre = rng.getrandbits(64)
        prints |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for _ in range(25)}
    prints |= {rng.getrandbits(64) for _ in range(50)}
    signed = {p - (1 << 64) if p >> 63 else p: p for p in prints}
    found = components(links(spark.createDataFrame([(s,) for s in signed], "fp long"), heavy=heavy)).collect()
    groups = defaultdict(set)
    roots = {r["node"]: r["root"] for r in found}
    for s, p in signed.items():
        groups[roots.get(s, s)].add(p)
    want = defaultdict(set)
    for p, r in brute_groups(dict(zip(sorted(prints), sorted(prints), strict=True))).items():
        want[r].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components_of_chain_star_and_loop(spark):
    edges_ = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 199), (199, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges_, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {k: 100 for k in range(101, 160)} | {200: 199}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_edges(edges, empty):
    got = simhash_groups(edges).collect()
    zero = [r for r in got if r["fingerprint"] == "0" * 16]
    assert len(got) == edges.count() and {r["component_id"] for r in zero} == {3} and len(zero) == 3
    same = {r["component_id"] for r in got if r["doc_id"] in (1, 2, 6, None)}
    assert same == {1}  # one case-folded text; the null id is larger than any other
    assert simhash_groups(empty).count() == 0
    left = drop_near_copies(edges)
    # the two long texts differ in ten bits
    assert left.columns == edges.columns and {r["doc_id"] for r in left.collect()} == {1, 3, 7, 8, 9, -20}


# ---- 6 toxicity

def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(5)
    syllables, slurs = "ta mo ri ne ka lu so vi".split(), ["grobnik", "quaxo", "zhurd"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5)))
    data = []
    for k in range(900):
        text = [word() for _ in range(rng.randrange(30, 120))]
        toxic = k % 6 == 0
        for _ in range(4 * toxic):
            text.insert(rng.randrange(len(text)), rng.choice(slurs))
        data.append((k, " ".join(text), int(toxic)))
    df = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    model = toxicity.learn(df.where("doc_id % 3 <> 1"), df.select("doc_id", "toxic"))
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    held = [(scored[i] >= toxicity.THRESHOLD, t) for i, _, t in data if i % 3 == 1]
    hits = sum(p and t for p, t in held)
    assert hits >= 0.9 * sum(t for _, t in held) and hits >= 0.9 * sum(p for p, _ in held)
    left = {r["doc_id"] for r in toxicity.drop_toxic(df, model).collect()}
    assert left == {i for i, s in scored.items() if s < toxicity.THRESHOLD}


def test_toxicity_keeps_words_of_clean_rows_and_phrases_of_ordinary_words():
    rng = random.Random(6)
    syllables, slurs = "ta mo ri ne ka lu so vi".split(), ["grobnik", "quaxo", "zhurd"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5)))
    text = lambda *more: " ".join([word() for _ in range(30)] + [w for m in more for w in (m, word(), word())]).encode()
    phrase = "luso tamo kane"
    clean = [text(*"luso tamo kane".split()) for _ in range(600)] + [text(*slurs)]  # the last one is mislabelled
    model = toxicity.fit(clean, [text(rng.choice(slurs), rng.choice(slurs)) for _ in range(60)]
                         + [text(phrase, phrase) for _ in range(60)])
    assert all(s.encode() in model.toxic for s in slurs) and phrase.encode() in model.toxic
    score = lambda *more: model.score([text(*more) for _ in range(20)], model.compressors()).mean()
    assert score(*slurs) > 0.7 and score(phrase, phrase) > 0.5 > 0.2 > score("tamo", "luso", "kane")
    assert toxicity.fit([b"one two three"], [b"one two three"]).toxic  # never empty


def test_toxicity_edges(spark, edges, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    for learn_from in (edges, empty):
        model = toxicity.learn(learn_from, labels)
        got = toxicity.score(edges, model).collect()
        assert len(got) == edges.count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.drop_toxic(edges, model).columns == edges.columns


# ---- 7 language

def test_language_on_held_out_rows(documents):
    model = langid.learn(documents.where(fold("doc_id", 3) != 1))
    got = {r["doc_id"]: r for r in langid.predict(documents, model).collect()}
    held = [(got[r["doc_id"]]["lang_pred"], r["lang"]) for r in documents.where(fold("doc_id", 3) == 1).collect()]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.keep_language(documents, model).count() >= 0.99 * documents.count()


def test_language_edges(edges, empty, documents):
    model = langid.learn(documents)
    got = [r["lang_pred"] for r in langid.predict(edges.where("doc_id IN (3, 4, 5, -20)"), model).collect()]
    assert got == ["und"] * 4
    assert langid.predict(empty, model).count() == 0
    assert {r["lang_pred"] for r in langid.predict(edges, langid.learn(empty)).collect()} == {"und"}
    left = langid.keep_language(edges, model)
    assert left.columns == edges.columns and left.where("text IS NULL OR text = ''").count() == 0


def test_no_task_ranks_a_languages_ngrams(spark):
    rng = np.random.default_rng(3)
    data = [(lang, int(g), int(n)) for lang, size in (("aa", 3000), ("bb", 40), ("cc", 500))
            for g, n in zip(rng.integers(-(1 << 63), (1 << 63) - 1, size), rng.integers(1, 30, size), strict=True)]
    got = langid.most_frequent(spark.createDataFrame(data, "lang string, gram long, n long"), 500)
    assert "row_number" not in got._jdf.queryExecution().toString()
    for lang, size in (("aa", 500), ("bb", 40), ("cc", 500)):
        every = sorted((n for x, _, n in data if x == lang), reverse=True)
        mine = sorted((r["n"] for r in got.where(F.col("lang") == lang).collect()), reverse=True)
        assert mine[:size] == every[:size] and size <= len(mine) <= size + 2


def test_language_more_than_eight_and_blocks(monkeypatch):
    letter = langid.letters()
    names = [f"l{k:02}" for k in range(19)]
    text = {n: " ".join(f"{chr(97 + k)}{chr(97 + (k + j) % 26)}q{chr(97 + k)}" for j in range(20)) for k, n in enumerate(names)}
    keys = {n: np.unique(langid.ngrams([t], letter)[0]) for n, t in text.items()}
    model = langid.Model.build(keys, names)
    assert model.predict(list(text.values()), letter)[0] == names
    whole = model.counts([text["l03"] * 50, "", text["l11"]], letter)
    monkeypatch.setattr(langid, "BLOCK", 200)
    parts = model.counts([text["l03"] * 50, "", text["l11"]], letter)
    assert (whole[2] == parts[2]).all() and abs(whole[1] - parts[1]).max() <= 0.02 * whole[1].max()


# ---- 8 pieces, 10 counts

def test_codec_matches_the_library(documents, edges):
    from sentencepiece import SentencePieceProcessor

    model, codec = SentencePieceProcessor(model_file=PIECES), sentencepiece_codec.Codec(PIECES)
    rng = random.Random(1)
    texts = [r["text"] for r in documents.limit(60).collect()] + [(r["text"] or "")[:5000] for r in edges.collect()]
    texts += ["", " ", "a  b", "\n", " " * 40 + "x" + " " * 17, "x" * 500, "▁a", "<s>", "日本語", "Ａ é"]
    texts += ["".join(rng.choice("abcdefgiklmnoprstuw  \n.,é☃") for _ in range(rng.randrange(80))) for _ in range(500)]
    ids = codec.encode(texts)
    assert [i.tolist() for i in ids] == model.encode(texts)
    assert [codec.decode(i.tolist()) for i in ids] == [t.replace("▁", " ") for t in texts]
    counts = trie_counts(Pieces(PIECES), {w for t in texts for w in words(t)})
    assert [sum(counts[w] for w in words(t)) for t in texts] == list(map(len, ids))


def test_unigram_viterbi_is_the_best_path():
    codec = sentencepiece_codec.Codec(PIECES, "unigram")
    p = codec.pieces
    for word in ["▁banana", "▁inthe", "▁zzqé", "▁over"]:
        best = {0: (0.0, [])}
        for end in range(1, len(word) + 1):
            options = [(best[s][0] + p.scores[word[s:end]], best[s][1] + [word[s:end]]) for s in range(end) if word[s:end] in p.scores]
            best[end] = max(options)
        assert [p.text[i] for i in codec.viterbi([word] * 3)[1]] == best[len(word)][1]


def test_codec_and_counts_on_tables(edges, empty):
    encoded = sentencepiece_codec.encode(edges, PIECES)
    decoded = {(r["doc_id"], r["decoded"]) for r in sentencepiece_codec.decode(encoded, PIECES).collect()}
    assert decoded == {(r["doc_id"], r["text"] or "") for r in edges.collect()}
    sizes = sorted(r["n"] for r in encoded.select(F.size("ids").alias("n")).collect())
    assert sizes == sorted(r["n_tokens"] for r in token_counts(edges, PIECES).collect())
    assert token_counts(empty, PIECES).count() == 0 and sentencepiece_codec.encode(empty, PIECES).count() == 0


# ---- 9 top-k

def brute_top(ids, vectors, queries, k):
    out = []
    for q, v in queries:
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in zip(ids, vectors) if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("size", [(8192, 1024), (13, 3)])
def test_top_k(spark, size):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 6))
    x[30:60] = x[0]  # one common vector: ties
    data = [(k, v.tolist()) for k, v in enumerate(x)] + [(500, None), (520, [1.0, None]), (540, [float("nan")] * 6), (560, [float("inf")] * 6), (None, [1.0] * 6)]
    got = top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 7, block=size[0], group=size[1])
    z = np.floor(64 * x).astype(int).tolist()
    want = brute_top(range(120), z, [(k, z[k]) for k in range(0, 120, 20)], 7)
    assert sorted(map(tuple, got.collect())) == want


def test_top_k_few_rows_and_none(spark):
    few = spark.createDataFrame([(0, [1.0]), (3, [2.0, 5.0])], "vec_id long, embedding array<double>")
    assert rows(top_k(few, F.col("vec_id") % 20 == 0, 20), "query_id", "rank", "vec_id", "score") == [(0, 1, 3, 64 * 128)]
    assert top_k(few.limit(0), F.col("vec_id") % 20 == 0, 20).count() == 0


def test_top_k_of_repeated_query_ids(spark):
    few = [(k, [float(k), 1.0]) for k in range(1, 9)]
    df = spark.createDataFrame([(0, [1.0, 0.0])] * 2 + [(0, [-1.0, 0.0])] + few, "vec_id long, embedding array<double>")
    got = rows(top_k(df, F.col("vec_id") % 20 == 0, 4), "query_id", "rank", "vec_id")
    assert got == sorted([(0, r + 1, 8 - r) for r in range(4)] + [(0, r + 1, r + 1) for r in range(4)], key=repr)


def test_search_stops_early_and_stays_exact():
    rng = np.random.default_rng(0)
    x = rng.integers(-40, 40, (4000, 3))
    x[:50] *= 20
    got = search(np.array([1]), x[1:2], np.arange(4000), x, 5)
    assert got[0][2].tolist() == sorted((x @ x[1])[np.arange(4000) != 1].tolist(), reverse=True)[:5]
    huge = np.full((3, 2), 1 << 62, np.int64)
    assert search(np.array([0]), huge[:1], np.arange(3), huge, 5)[0][2].tolist() == [(1 << 63) - 1] * 2
