"""A training-data pipeline over ``documents``: five stages, each one operator of ``riskloom.llm``.

Stages that decide by id (near duplicates, mix) give all rows of one id the same decision, null ids
among them. Ties are the operators': of equal texts the largest id stays, of near duplicates the smallest, equal finish times of
the mix go by source, hash, id and size. Null and empty texts are texts like any other; very long ones are worked on whole, one or one slice in
a task. Extra columns pass through unchanged, whatever their names, but for the last stage's own:
``ids``, ``decoded`` and ``n_tokens`` of the input are replaced. Empty tables pass through as such.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import bpe, exact, mixing, quality, simhash
from riskloom.llm.common import aside, free, table, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier, fitted on this input and the labels, predicts to be bad."""
    model = quality.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    rows, back = aside(docs, "score", "predicted")
    return quality.score(rows, model).where("predicted = 1").select(*back)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row of the largest id stays."""
    return exact.kept_rows(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every SimHash component, the document of the smallest id stays."""
    found = simhash.near_duplicates(docs)
    stays = found.groupBy("doc_id").agg(F.bool_or(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays"))
    own = free("gone", docs.columns)
    gone = written(stays.where(~F.col("stays")).select(F.col("doc_id").alias(own)), "near-copies")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone[own]), "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for every time it takes a document."""
    own, copies, copy = (free(c, docs.columns) for c in ("taken_id", "copies", "copy"))
    found = mixing.mix(docs).groupBy(F.col("doc_id").alias(own)).agg(F.max("copies").alias(copies))
    taken = written(found.where(F.col(copies) > 0), "taken")
    rows = docs.join(taken, docs["doc_id"].eqNullSafe(taken[own]))
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the token ids of every document of the mix, the text decoded from them, and how many there are."""
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("quality classifier", good_quality), ("exact dedup", without_copies), ("SimHash near-dedup", without_near_copies),
          ("mixing sources to target weights", mixed), ("BPE encoding and decoding", encoded)]

#: SQL has neither the classifier nor the encoder; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
