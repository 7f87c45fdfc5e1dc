"""The corpus pipeline: documents to token archives, by five of the corpus operators.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns the next
stage's documents (the last: what the archives hold). ``run`` applies them to ``documents``, each
written as Parquet and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmenta.llm import decontam, jaccard, mixing, quality, tokenfile
from fragmenta.llm._shared import removed, scratch, table, written
from fragmenta.llm.queries import tokenizer_path

#: Documents below this score go.
LEAST_SCORE = 0.3


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    scored = quality.score_documents(docs, table(spark, sf_dir, "labels"))
    return scored.where(F.col("score") >= LEAST_SCORE).select(*docs.columns)


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that with the smallest id."""
    return jaccard.without_copies(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontam.without_overlaps(docs, table(spark, sf_dir, "benchmark"))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says; documents with a null id stay once. Rows that share an id have the greatest copies of their texts."""
    with scratch() as made:
        mixed = mixing.mix(docs, mixing.label_domains(table(spark, sf_dir, "labels")), mixing.SHARES)
        copies = mixed.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("of")).agg(F.max("copies").alias("copies"))
        copies = made.keep(written(copies.where("copies <> 1"), "copies"))
    met = docs.join(copies, docs["doc_id"] == copies["of"], "left")
    times = F.coalesce(copies["copies"], F.lit(1))
    met = met.where(times > 0)
    again = F.explode(F.sequence(F.lit(1), times))
    return met.select(*(docs[c] for c in docs.columns), again.alias(uuid.uuid4().hex)).select(*(F.col(f"`{c}`") for c in docs.columns))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) as the token archives of all documents give them."""
    return tokenfile.read_archives(tokenfile.write_archives(docs, tokenizer_path()))


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_first),
    ("benchmark decontamination", keep_uncontaminated),
    ("mixing to target weights", mix_domains),
    ("token output", write_tokens),
]

#: The classifier, the rates and the tokens can't be said in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
            removed(before)
    return docs
