"""A corpus pipeline: quality, near duplicates, personal data, mixing, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basinflow.llm import bpe, jaccard_join, mixing, pii, quality
from basinflow.llm.catalog import tokenizer
from basinflow.llm.common import WORD, blank_if_null, read, stage_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier takes for quality 1; rows that share an id stay if one of
    them does. Empty texts are scored as any other; an empty table stays empty."""
    scored = quality.score(docs, read(spark, sf_dir, "labels"))
    bad = scored.groupBy("doc_id").agg(F.max("predicted").alias("_best")).filter("_best = 0").select(F.col("doc_id").alias("_id"))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]), "left_anti")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that five-word shingles link at 0.8 the smallest doc_id stays, once.

    Documents without words link with nothing and stay. Rows without an id can't be named by a
    group and stay too. Of rows that repeat an id the one of the least text stays; an empty table
    stays empty.
    """
    groups = jaccard_join.join(docs, k=5, percent=80)
    dropped = groups.filter("component_id < doc_id").select(F.col("doc_id").alias("_id")).distinct()
    kept = docs.filter("doc_id is not null").join(dropped, docs["doc_id"] == dropped["_id"], "left_anti")
    # Rows that repeat a doc_id are one document.
    nth = F.row_number().over(W.partitionBy("doc_id").orderBy("text"))
    return kept.withColumn("_nth", nth).filter("_nth = 1").drop("_nth").unionByName(docs.filter("doc_id is null"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; every document stays, repeated rows, null and empty texts too."""
    return pii.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document is repeated 0 to 2 times, so that each source emits the words the mix takes of it.

    Rows of one id, source and size are alike for the mix: their copies are dealt among them, least
    hash of the text first. Documents without words add nothing to a mix of words and are left out;
    an empty table stays empty.
    """
    key = {
        "_id": mixing.identity(),
        "_source": F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1")),
        "size": F.regexp_count(blank_if_null("text"), F.lit(WORD)).cast("long"),
    }
    copies = mixing.copies(docs).filter("copies > 0").withColumns({"_id": F.col("key"), "_source": key["_source"]})
    copies = copies.groupBy(*key).agg(F.array_sort(F.collect_list("copies")).alias("_copies"))
    chosen = docs.withColumns(key).join(copies, list(key))
    nth = F.row_number().over(W.partitionBy(*key).orderBy(F.xxhash64("text")))
    chosen = chosen.withColumn("_times", F.get("_copies", nth - 1)).filter("_times > 0")
    return chosen.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_times"))).select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with their digests and that of the decoded text."""
    return bpe.encode(docs, *tokenizer())


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("PII", pii_stage),
    ("mixing sources to target weights", mixing_stage),
    ("byte-level BPE", bpe_stage),
]

#: SQL can't express the classifier's fit and byte-level BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage_table(docs, "pipeline-" + "".join(c if c.isalnum() else "-" for c in name))
    return docs
