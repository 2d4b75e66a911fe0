"""The registered queries of this subpackage: thin, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subscope.llm import langid, license_scan, lm, sentencepiece_codec, toxicity
from subscope.llm.common import fold, table
from subscope.llm.exact_dedup import exact_dedup
from subscope.llm.hard_negatives import hard_negatives
from subscope.llm.jaccard_join import jaccard_components
from subscope.llm.packing import pack, pieces
from subscope.llm.prefix_trie import prefix_trie
from subscope.llm.simhash import simhash_groups
from subscope.llm.token_counts import token_counts
from subscope.llm.topk import top_k


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document; the licences found, in the order of their places."""
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    names = F.array_distinct(F.transform("matches", lambda m: m["license"]))
    return found.select("doc_id", F.array_join(names, ";").alias("licenses"), F.size("matches").cast("long").alias("n_matches"),
                        F.try_element_at("matches", F.lit(1))["start"].alias("first_start"), "n_sentences", "n_unmatched")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = {"text_sha256": F.sha2("text", 256)}
    return exact_dedup(table(spark, sf_dir, "documents"), extra=digest)


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = lm.score(docs, docs.where(fold("doc_id", 10) != 0))
    return scored.withColumn("held_out", fold("doc_id", 10) == 0)


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer file; the files are installed beside the libraries, never copied here."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), with_ids=False))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs.where(fold("doc_id", 3) != 1), table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score",
                         (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs.where(fold("doc_id", 3) != 1))
    found = langid.predict(docs, model)
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "cover")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every text, decode the ids again and compare digests."""
    model = tokenizer_file("piece_bpe_32k.model")
    encoded = sentencepiece_codec.encode(table(spark, sf_dir, "documents"), model, "bpe", "doc_id", "text",
                                         F.sha2(F.translate(F.coalesce("text", F.lit("")), "▁", " "), 256).alias("text_sha256"))
    digests = encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                             F.xxhash64("ids").alias("ids_xxhash64"), "text_sha256", "ids")
    return (sentencepiece_codec.decode(digests, model).withColumn("decoded_sha256", F.sha2("decoded", 256))
            .withColumn("round_trip", F.col("decoded_sha256") == F.col("text_sha256")).drop("ids", "decoded", "text_sha256"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, moved)


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_lm_scores": op3_lm_scores,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_simhash": op5_simhash,
    "op6_toxicity": op6_toxicity,
    "op7_language_id": op7_language_id,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_exact_top_k": op9_exact_top_k,
    "op10_token_counts": op10_token_counts,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_jaccard_join": op12_jaccard_join,
    "op13_hard_negatives": op13_hard_negatives,
}
