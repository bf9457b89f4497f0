"""From raw documents to packed training sequences: quality rules, exact and near duplicates, pseudonyms, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from locusflow.llm.chunks import vocabulary
from locusflow.llm.common import documents, passing, written
from locusflow.llm.exact_dedup import kept_documents
from locusflow.llm.jaccard_join import one_of_each
from locusflow.llm.packing import pack
from locusflow.llm.pii import SAMPLE_KEY, key_of, pseudonymise
from locusflow.llm.quality import quality_filter

STAGES = [
    ("quality rules", lambda spark, docs, sf_dir: quality_filter(docs)),
    ("exact dedup", lambda spark, docs, sf_dir: kept_documents(docs)),
    ("near duplicates", lambda spark, docs, sf_dir: one_of_each(docs)),
    ("pseudonyms", lambda spark, docs, sf_dir: pseudonymise(docs, key_of(spark, SAMPLE_KEY))),
    ("packing", lambda spark, docs, sf_dir: pack(docs, vocabulary("word_bpe_49k.json"))),
]

#: Near duplicates, pseudonyms and packing are not for SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage. A stage's own tables and its input are deleted once its output is written. An empty table gives none."""
    docs, before = documents(spark, sf_dir), []
    for name, stage in STAGES:
        with passing(spark) as made:
            docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            made.remove(docs.written_at)
            made += before
        before = [docs.written_at]
    return docs
