"""The pipeline's stages against their operators, and the queries against DuckDB."""

from collections import Counter

import duckdb
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from subscope.llm.common import fold
from subscope.llm.exact_dedup import exact_dedup
from subscope.llm.oracle_sql import SQL
from subscope.llm.queries import QUERIES
from subscope.llm.simhash import simhash_groups
from subscope.llm import toxicity

SF = "/root/testdata/sf0.001"


def test_every_query_is_registered():
    found = __spark_entry__.queries()
    assert set(QUERIES) | {"pipeline"} <= set(found)
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert set(SQL) <= set(__spark_entry__.oracle_sql())


def test_queries_match_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "embeddings", "conversations"):
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    for name, sql in SQL.items():
        want = con.sql(sql)
        got = QUERIES[name](spark, SF)
        assert sorted(got.columns) == sorted(want.columns)
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_stages_follow_their_operators(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.learn(documents.where(fold("doc_id", 3) != 1), labels)
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
    clean = stages["toxicity"](spark, documents, SF)
    assert clean.columns == documents.columns
    assert ids(clean) == ids(toxicity.score(documents, model).where(f"score < {toxicity.THRESHOLD}"))
    once = stages["exact_dedup"](spark, documents, SF)
    assert ids(once) == ids(exact_dedup(documents).where("kept"))
    near = stages["simhash"](spark, documents, SF)
    assert ids(near) == ids(simhash_groups(documents).where("doc_id = component_id"))
    assert once.columns == near.columns == documents.columns


def test_stages_keep_columns_of_empty_and_edge_tables(spark, edges, empty):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (empty, edges):
            got = stage(spark, docs, SF)
            rows = got.collect()
            if name != "best_fit_packing":
                assert got.columns == docs.columns
                assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in docs.collect()}
            elif docs is edges:
                assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(r["doc_id"] for r in docs.collect())
            assert docs is edges or not rows


def test_stages_with_clashing_columns(spark, documents):
    clash = documents.limit(80).withColumns({c: F.lit("x") for c in ("_bits", "_bucket", "_llm_slot", "_gone", "_also", "_llm_maybe", "_id", "_hash")})
    stages = dict(corpus_pipeline.STAGES)
    for name in ("exact_dedup", "simhash"):
        want = {r["doc_id"] for r in stages[name](spark, documents.limit(80), SF).collect()}
        got = stages[name](spark, clash, SF)
        assert got.columns == clash.columns and {r["doc_id"] for r in got.collect()} == want


def test_pipeline_packs_what_is_left(spark):
    packed = corpus_pipeline.run(spark, SF)
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
    assert 100 < packed.select("doc_id").distinct().count() < 200
    assert corpus_pipeline.ORACLE_SQL is None
