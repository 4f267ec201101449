"""The corpus pipeline: toxicity, exact copies, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, or what it made
of them, with the columns of documents; the last returns the packed pieces. Between stages the
rows are written as Parquet to the shared folder, so a lost executor costs one stage's tasks;
these tables go when the application ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobloom.llm.common import scratch, table
from jobloom.llm.exact_dedup import exact_dedup
from jobloom.llm.jaccard_join import jaccard_components
from jobloom.llm.packing import pack_documents
from jobloom.llm.pii import pii_pseudonyms
from jobloom.llm.toxicity import fit_toxicity, score_toxicity, training_rows

#: Near copies: shingles of so many words, alike by so many per cent.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labelled ones among them, doesn't hold for toxic.

    Null and empty texts get the score of the bias alone, as in any stage repeated rows each count,
    and an empty table stays empty.
    """
    model = fit_toxicity(training_rows(docs, table(spark, sf_dir, "labels")))
    return score_toxicity(docs, model).filter("predicted = 0").select(docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the largest id; null ids are smallest.

    Null and empty texts are one group; of rows alike in id and text one stays.
    """
    return exact_dedup(docs).filter("kept").select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: that with the smallest id, nulls last.

    It is decided row by row: of rows that share an id, or have none, and are near copies, one
    stays, and of rows alike in id and text one does. Texts without words are no copies of
    anything, and all stay.
    """
    key = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.coalesce("text", F.lit(""))), 256)
    keyed = docs.withColumn("row_key", F.unhex(key))
    found = jaccard_components(keyed, percent=NEAR_PERCENT, words=NEAR_WORDS, key_col="row_key")
    first = found.filter("n_shingles > 0").groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "key")).alias("least")).select(F.col("least.key").alias("row_key"))
    has_words = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    one = keyed.filter(has_words).join(first, "row_key", "left_semi").withColumn("rn", F.row_number().over(Window.partitionBy("row_key").orderBy("doc_id"))).filter("rn = 1")
    return docs.filter(~has_words).union(one.select(docs.columns))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms in place of personal numbers, dates and addresses; null texts stay null."""
    return pii_pseudonyms(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of token windows; a null or empty text is the end id alone."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("pii", personal_data), ("packing", packing)]

#: The stages learn a model and tokenise; tests hold them against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after another, over documents."""
    docs = table(spark, sf_dir, "documents")
    folder = scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
