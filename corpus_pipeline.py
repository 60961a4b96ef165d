"""From raw documents to token ids: five stages, each written before the next one reads it.

Stages take (spark, docs, sf_dir); all but the last return the columns of documents. Rules, line chunks, scan and
encoder judge every row by itself, with or without a doc_id, however many share it. Among near copies, rows that share
a doc_id stay or go together, and rows without one are in no group. A null or empty text fails the rules; a text that
line dedup empties stays, and gives no tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import bpe, chunks, decontaminate, ngram_join, outliers
from brindle.llm.common import written


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id, null or not, is among ids (one column). Both sides grow with the corpus, so they are merged."""
    ids = ids.toDF("_only_id").distinct().hint("merge")
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_only_id"]), "left_semi")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the base rules or the robust outlier test reject, each row by its own verdict."""
    return outliers.quality_rules(docs, carry=["text", "lang", "source", "n_chars"]).filter("kept").select("doc_id", "text", "lang", "source", "n_chars")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts line chunks that stood earlier out of the texts; n_chars follows."""
    out = chunks.dedup_chunks(docs, carry=["lang", "source", "n_chars"])
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.select("doc_id", "text", "lang", "source", changed.alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 or more on five-word n-grams, the smallest doc_id stays."""
    groups = ngram_join.ngram_groups(docs, 5, 80, 100)
    return _only(docs, groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with any passage of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = decontaminate.decontaminate(docs, benchmark, carry=["text", "lang", "source", "n_chars"])
    return out.filter("n_hit = 0").select("doc_id", "text", "lang", "source", "n_chars")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), and digests of the ids and of what they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = bpe.round_trip(docs, path)
    return out.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("bpe", encoding),
]

#: The outlier estimates and the encoder can't be written in SQL; the pipeline is tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
