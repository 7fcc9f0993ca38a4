"""The corpus operators as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import decontaminate, hard_negatives, host_rules, html_main, line_spread, mixing, pii, prefix_trie, quality, sharding, spotsigs, token_index
from .common import Stage, table
from .ngram_join import ngram_links


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_links(table(spark, sf_dir, "documents")).drop("text_hash", "group")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "linked")


def op5_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


END_ID, VOCABULARY = 2, 49_408


def op7_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Stage(spark, "op7").path("shards")
    token_index.write(table(spark, sf_dir, "documents"), path, vocabulary(), END_ID, VOCABULARY)
    return token_index.read_documents(spark, path)


def op8_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages"))


def op9_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_spread.remove_spread_lines(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge(table(spark, sf_dir, "documents"))


def catalogue() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
        "op2_decontamination": op2_decontamination,
        "op3_mixing": op3_mixing,
        "op4_sharding": op4_sharding,
        "op5_spotsigs": op5_spotsigs,
        "op6_quality": op6_quality,
        "op7_token_index": op7_token_index,
        "op8_html_main_text": op8_html_main_text,
        "op9_line_spread": op9_line_spread,
        "op10_pii": op10_pii,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_host_rules": op13_host_rules,
    }


def oracles() -> dict[str, str]:
    return {
        "op3_mixing": mixing.sql(),
        "op9_line_spread": line_spread.sql(),
        "op11_hard_negatives": hard_negatives.sql(),
        "op12_prefix_trie": prefix_trie.sql(),
        "op13_host_rules": host_rules.sql(),
    }
