"""From raw documents to a mixture for training, in five stages.

Each stage takes the documents that its predecessor kept, from a Parquet table, and returns the
documents it keeps with the columns they came with; the last adds the order of the mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagescout.llm import decontaminate, line_dedup, mixing, ngram_join, quality_gam
from pagescout.llm.texts import text_key
from pagescout.storage import Scratch, materialize, scratch


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_gam.train(docs, labels)
    return quality_gam.score_quality(docs, model, keep=True).where("predicted = 1").select(*docs.columns)


def new_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stood, exactly or nearly, in an earlier place; one that loses all its lines goes."""
    out = line_dedup.dedup_lines(docs).where("n_removed = 0 or n_lines > n_removed")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    found = ngram_join.near_duplicates(docs)
    stays = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.struct("doc_id", "key").alias("one")).distinct()
    rows = docs.select(F.struct("doc_id", text_key(F.col("text")).alias("key")).alias("one"), F.struct(*docs.columns).alias("row"))
    kept = rows.join(stays, F.md5(F.to_json(rows["one"])) == F.md5(F.to_json(stays["one"])), "left_semi")
    # Of rows with one id and text, copies among them, the one that is least as text stays.
    as_text = F.to_json(F.col("row"), {"ignoreNullFields": "false"})
    return kept.groupBy("one").agg(F.min_by("row", F.sha2(as_text, 256)).alias("row")).select("row.*")


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contamination(docs, benchmark, keep=True).where(~F.col("contaminated")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their place in the mixture."""
    return mixing.interleave(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", new_lines),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", without_benchmarks),
    ("mixing sources to target weights", mixture),
]

#: The classifier cannot be written in SQL; tests/llm looks at its stages one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what the stages write on the way is removed as soon as the next table is there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    earlier = Scratch(spark)
    for name, stage in STAGES:
        with scratch(spark) as own:
            kept = stage(spark, docs, sf_dir)
        with scratch(spark) as result:
            docs = materialize(kept, name.replace(" ", "-"))
        own.release()
        earlier.release()
        earlier = result
    return docs
