"""From raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's result as Parquet in the
shared folder and rereads it as the next one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import decontamination, language_id, packing, simhash, substrings
from pageloom.llm.queries import tokeniser_path
from pageloom.llm.shared import delete, held_out, shared_folder, table, temporary


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


# In every stage: each row is judged on its own text, also rows with a null or repeated doc_id; columns beside doc_id
# and text are handed on as they are, whatever their names (n_chars follows the text, where there is one); an empty
# table gives an empty one.


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, null and empty ones among them, and those whose two nearest languages are about equally near."""
    found = language_id.language_id(docs.select("doc_id", "text", "lang"), ~held_out(F.col("doc_id")), docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text"))
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & ~F.col("ambiguous")).select(*[F.col(f"doc.`{c}`") for c in docs.columns])


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents whose fingerprints are linked, the one with the smallest id; null ids come last, ties go by the text."""
    return simhash.one_each(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes words under 13-word windows that a document with a smaller id has as well; a null id is larger than any.
    A document that loses every word goes; one without words stays."""
    return _counted(substrings.without_repeats(docs)).select(*[f"`{c}`" for c in docs.columns])


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the words of benchmark items; a document whose words were all theirs goes, one without words stays."""
    return _counted(decontamination.without_hits(docs, table(spark, sf_dir, "benchmark"))).select(*[f"`{c}`" for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as pieces of packed sequences, with their token ids; null and empty texts are the end id alone."""
    return packing.best_fit_packing(docs, tokeniser_path(), with_ids=True)


STAGES = [
    ("language_id", keep_known_languages),
    ("simhash_near_dedup", keep_one_of_each_group),
    ("substring_dedup", cut_repeated_passages),
    ("benchmark_decontamination", cut_benchmark_passages),
    ("best_fit_packing", pack_sequences),
]

#: SQL cannot tokenise or train; tests/llm holds the pipeline against plain Python versions of the stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other. What a stage has written for itself, and its input, go when its result is written."""
    docs, run_id, last = table(spark, sf_dir, "documents"), uuid.uuid4().hex, None
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{run_id}-{name}"
        with temporary(spark):
            result = stage(spark, docs, sf_dir)
            result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
        if last:
            delete(spark, last)
        last = path
    return docs
