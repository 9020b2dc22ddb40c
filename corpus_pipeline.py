"""The corpus pipeline: toxicity, exact dedup, near-duplicate dedup, mixing and packing, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swipeline.llm.common import discard, scratch
from swipeline.llm.exact_dedup import exact_dedup
from swipeline.llm.mixing import mix_documents
from swipeline.llm.packing import pack
from swipeline.llm.simhash import keep_one
from swipeline.llm.toxicity import toxicity

#: SQL cannot express classifiers, fingerprints of XXH64 or token ids; tests/llm compares with brute force instead.
ORACLE_SQL = None


def aside(docs: DataFrame, *used: str) -> DataFrame:
    """The columns ``used`` as they are and all others, by their places, in one, so that no name of theirs meets a name of an operator."""
    names = [c if c in used else f"_{k}" for k, c in enumerate(docs.columns)]
    others = [c for c in names if c not in used]
    return docs.toDF(*names).select(*(c for c in names if c in used), F.struct(F.lit(0).alias("none"), *others).alias("_aside"))


def restored(found: DataFrame, docs: DataFrame, *used: str) -> DataFrame:
    return found.select(*(F.col(c) if c in used else F.col("_aside").getField(f"_{k}") for k, c in enumerate(docs.columns))).toDF(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity model rejects, columns as given.

    Each row is judged by its own whole text, so rows that share a doc_id, have none or are repeated go or stay one by one; null and empty
    texts have the score of a text without features. Columns named like the model's are left alone. No documents or no labels give the rows given.
    """
    used = ("doc_id", "text")
    scored = toxicity(aside(docs, *used), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return restored(scored.filter("predicted = 0"), docs, *used)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for the case of A-Z, the largest doc_id's, columns as given.

    Null texts are empty ones, so one row without words of them stays; of repeated rows one stays; a null doc_id is below all. Texts may
    be of any length. An empty table gives no rows.
    """
    names = [c if c in ("doc_id", "text") else f"_{k}" for k, c in enumerate(docs.columns)]
    found = exact_dedup(docs.toDF(*names), *(F.col(c).alias(f"_c{k}") for k, c in enumerate(names))).filter("kept")
    return found.select(*(f"_c{k}" for k in range(len(names)))).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates, the smallest doc_id's (a null one for want of another), columns as given.

    Rows of one doc_id are judged by their own texts, of any length and read whole. Texts without words are copies of each other. Other columns may have any names. An
    empty table gives no rows.
    """
    return keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as their source's budget takes them, the last one of a source cut, columns as given.

    Documents without words, null texts too, are not in it; a null source is a source; a null doc_id is a value like others. Repeated rows are taken
    row by row. Texts of any length are counted whole, and only a source's last one is cut. Other columns may have any names. An empty table gives no rows.
    """
    used = ("doc_id", "text", "source", "n_chars")
    return restored(mix_documents(aside(docs, *used)), docs, *used)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens; a null text is an empty one. Rows of one doc_id are packed row by row.

    Long texts are cut into whole sequences and a rest, no id is lost. Other columns play no part, whatever their names. An empty table gives no rows.
    """
    return pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("simhash dedup", drop_near_copies), ("mixing", mix_sources), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces. Each stage's rows are a table in the shared folder until the next one's are written; the last one's stays, as the result reads it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
