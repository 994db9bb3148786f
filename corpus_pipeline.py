"""A training corpus from raw documents: filter, deduplicate, decontaminate and encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read back before the
next one. Rows without doc_id pass the stages that compare documents. All columns of the input come out of every
stage but the last as they went in, whatever their names and types; empty tables give empty ones.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, jaccard_join, queries, substring_dedup, toxicity
from gridloom.llm.byte_bpe import byte_bpe
from gridloom.session import cut, scratch

#: Column of the node of a row in the stage of near duplicates.
_NODE = "near_duplicate_node"


def _apart(docs: DataFrame, *used: str) -> DataFrame:
    """``docs`` with all columns but the used ones under names that no operator adds or reads."""
    return docs.toDF(*[c if c in used else f"other_{k}" for k, c in enumerate(docs.columns)])


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from all labels, takes for toxic go.

    Rows are judged one by one, by text alone, so repeated rows go or stay together; null and empty texts are texts
    without words.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(toxicity.labelled(docs, labels))
    apart = _apart(docs, "text")
    return toxicity.toxicity(apart, model).where("predicted = 0").select(apart.columns).toDF(*docs.columns)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows one stays: that of least doc_id, and among rows with this doc_id one of them.

    Rows are compared, not doc_ids: a row's node is a 64-bit hash of doc_id and text. Of rows that repeat with one
    doc_id and text one stays (that whose other columns come first as JSON, if they differ); another text with the same doc_id stays or
    goes by its own links. Texts without words are linked with nothing, so each such row stays, as each without doc_id.
    """
    names, docs = docs.columns, _apart(docs, "doc_id", "text")
    placed = docs.withColumn(_NODE, F.xxhash64("doc_id", "text"))
    known = placed.where("doc_id is not null")
    groups = jaccard_join.jaccard_groups(known.select(F.col(_NODE).alias("doc_id"), "text")).where("n_shingles > 0")
    nodes = cut(groups.groupBy(F.col("doc_id").alias(_NODE), "component_id").agg(F.count("*").alias("rows")), "nodes")
    least = nodes.join(known.select(_NODE, "doc_id").distinct(), _NODE).groupBy("component_id").agg(F.min(F.struct("doc_id", _NODE)).alias("least"))
    stays = cut(least.select(F.col(f"least.{_NODE}").alias(_NODE)), "stays")
    # nodes of several rows leave with those that go, and come back as one row
    several = cut(nodes.where("rows > 1").join(stays, _NODE, "left_semi").select(_NODE), "several")
    gone = nodes.join(stays, _NODE, "left_anti").select(_NODE).unionByName(several).withColumnRenamed(_NODE, "gone")
    rest = placed.join(gone, F.col("doc_id").isNotNull() & (F.col(_NODE) == F.col("gone")), "left_anti").select(docs.columns)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    first = F.to_json(F.struct(*others)) if others else F.lit("")
    one = known.join(several, _NODE, "left_semi").groupBy(_NODE).agg(F.min_by(F.struct(*docs.columns), first).alias("row"))
    return rest.unionByName(one.select("row.*")).toDF(*names)


def _substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go; texts without one stay as they are, null and empty ones too.

    Of copies of a passage that of the smallest doc_id stays; rows of one doc_id are not earlier than each other.
    """
    names, docs = docs.columns, _apart(docs, "doc_id", "text", "n_chars")
    done = substring_dedup.substring_dedup(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return done.withColumn("text", text).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns).toDF(*names)


def _benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, by text alone; null and empty texts hold none and repeated rows go or stay together."""
    apart = _apart(docs, "doc_id", "text")
    return decontaminate.decontaminated(apart, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).toDF(*docs.columns)


def _encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each row, of null texts as of empty ones; repeated rows keep their own, other columns are not read."""
    return queries.bpe_digest(byte_bpe(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("toxicity", _toxicity),
    ("near_duplicates", _near_duplicates),
    ("substring_dedup", _substrings),
    ("decontamination", _benchmark),
    ("bpe", _encode),
]

#: No stage but the third can be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
