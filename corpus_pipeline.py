"""From raw documents to packed training sequences, in five stages.

quality rules -> line dedup -> n-gram Jaccard join (one document of each group stays) -> mixing sources to target
weights -> best-fit packing. Each stage takes what the one before kept, whole, and all but the last return the
columns of documents. Between stages the rows are materialised in the shared folder; a stage's intermediates and its
input go when its output is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import jaccard, lines, mixing, packing, quality
from marlstone.llm.scratch import drop, drop_since, mark, stash
from marlstone.llm.text import SPACES


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars as the text now is."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed rules or their own language's and source's fences reject go."""
    return quality.quality_filter(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go from all documents but their first; documents of which nothing is left go."""
    out = lines.without_boilerplate(docs)
    empty = (F.col("_n_removed") > 0) & (F.btrim("text", F.lit(SPACES)) == "")
    return _measured(out.where(~empty).select(*docs.columns))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the least id."""
    return jaccard.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source up to its share of words; what is taken twice comes twice."""
    return _measured(mixing.mixed_documents(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of 4096 tokens."""
    import public_tokenizers

    return packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: Packing has no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        at, before = mark(), docs
        docs = stash(stage(spark, before, sf_dir), name)
        drop_since(spark, at, keep=docs)  # what the stage needed, and what it read: both have had their last reader
        drop(before)
    return docs
