"""The registered queries of the corpus operators: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import decontamination, language_id, licenses, packing, sharding, simhash, substrings, topk, toxicity, url_filter
from pageloom.llm.shared import held_out, table


def tokeniser_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    found = language_id.language_id(docs, ~held_out(F.col("doc_id")), docs.select("doc_id", "text"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def op5_url_filter(spark: SparkSession, root: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, root, "pages")).select("page_id", "host", "path", "rule", "verdict", "own_rule")


def op6_best_fit_packing(spark: SparkSession, root: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, root, "documents"), tokeniser_path())


def op7_sharding(spark: SparkSession, root: str) -> DataFrame:
    placed = sharding.histogram_sort(table(spark, root, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_toxicity(spark: SparkSession, root: str) -> DataFrame:
    found = toxicity.toxicity(table(spark, root, "documents"), table(spark, root, "labels"), ~held_out(F.col("doc_id")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_license_scan(spark: SparkSession, root: str) -> DataFrame:
    found = licenses.license_scan(table(spark, root, "documents").select("doc_id", "text"))
    n = F.size("places")
    return found.select(
        "doc_id",
        "n_words",
        n.cast("long").alias("n_base"),
        F.when(n > 0, F.array_min("places")).cast("long").alias("first_word"),
        F.when(n > 0, F.array_max("places")).cast("long").alias("last_word"),
        "base_labels",
        "labels",
        "score",
    )


def op10_decontamination(spark: SparkSession, root: str) -> DataFrame:
    found = decontamination.contamination(table(spark, root, "documents"), table(spark, root, "benchmark"), carry=["doc_id"])
    n_hit = F.size("covered").cast("long")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op2_topk(spark: SparkSession, root: str) -> DataFrame:
    rows = topk.quantised(table(spark, root, "embeddings").select("vec_id", "embedding"))
    return topk.top_k(rows, F.col("vec_id") % 50 == 0, k=5)


def op8_simhash(spark: SparkSession, root: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, root, "documents"))


def op3_substring_dedup(spark: SparkSession, root: str) -> DataFrame:
    return substrings.repeated_words(table(spark, root, "documents"))
