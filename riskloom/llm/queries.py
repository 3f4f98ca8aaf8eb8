"""One query for each operator of this subpackage, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import (
    attention, language, minhash, negatives, packing, page_wrappers, pieces, quality, rules, secret_scan, topk,
    url_filter, vector_codes,
)
from riskloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

# The rules the url query applies.
URL_RULES = {
    "org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block",
}


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixture_packing(spark, sf):
    pieces_ = packing.pack(table(spark, sf, "documents"), tokenizer("byte_bpe_50k.json"))
    return pieces_.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "queue")


def op2_pairwise_quality(spark, sf):
    return quality.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op3_secret_novelty(spark, sf):
    return secret_scan.find_secrets(table(spark, sf, "documents")).drop("masked")


def op4_weak_rules(spark, sf):
    return rules.judge(table(spark, sf, "documents"))


def op5_url_digests(spark, sf):
    return url_filter.filter_urls(table(spark, sf, "pages"), URL_RULES)


def op6_minhash_dedup(spark, sf):
    return minhash.near_duplicates(table(spark, sf, "documents"))


def op7_sentencepiece(spark, sf):
    coded = pieces.encode(table(spark, sf, "documents"), tokenizer("piece_bpe_32k.model"), decoded=True)
    return coded.select(
        "doc_id", (F.length("ids") / 4).cast("bigint").alias("n_ids"), F.crc32("ids").alias("ids_crc32"),
        (F.col("decoded") == F.translate("text", pieces.SPACE, " ")).alias("round_trip"))


def op8_language_kernel(spark, sf):
    return language.identify(table(spark, sf, "documents"))


def op9_attention_scores(spark, sf):
    return attention.score_texts(table(spark, sf, "documents"), tokenizer("byte_bpe_50k.tiktoken"))


def op10_exact_topk(spark, sf):
    return topk.top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_packed_negatives(spark, sf):
    vec_id, label = F.col("vec_id"), F.col("label")
    return negatives.hard_negatives(
        table(spark, sf, "embeddings"), vec_id % 50 == 0, F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label))


def op12_dual_tree_codes(spark, sf):
    return vector_codes.compress(table(spark, sf, "embeddings"))


def op13_page_wrappers(spark, sf):
    return page_wrappers.extract(table(spark, sf, "pages"))


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (
        op1_mixture_packing, op2_pairwise_quality, op3_secret_novelty, op4_weak_rules, op5_url_digests,
        op6_minhash_dedup, op7_sentencepiece, op8_language_kernel, op9_attention_scores, op10_exact_topk,
        op11_packed_negatives, op12_dual_tree_codes, op13_page_wrappers,
    )
}
