"""From raw documents to packed training sequences, in five stages that each apply one text operator.

Every stage gets the documents that the stage before has kept, and all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import langid
from weftgraph.llm.common import bounded_batches, documents, order_id, told_apart, written
from weftgraph.llm.lines import drop_lines
from weftgraph.llm.minhash import near_duplicates
from weftgraph.llm.packing import pack_documents
from weftgraph.llm.queries import tokenizer_path
from weftgraph.llm.substring import remove_duplicate_spans

#: Least score of a language. 0.1 is a text beyond the margin (-1.1) of even its best family; every row of sf0.01 and
#: check_s is above it (the least scores there are 0.71 and 0.50).
LEAST_SCORE = 0.1
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_words(docs: DataFrame) -> DataFrame:
    """Documents that still have a word, with the length of the text that they have now."""
    left = docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that get a language with a score of at least LEAST_SCORE; those without a letter (und) go.

    Where no label can be learnt from there is no model, and all documents with a letter stay. lang stays as labelled.
    """
    bounded_batches(spark)
    model = langid.train(docs, "doc_id", "text", "lang")
    if model is None:
        return langid.with_letters(docs.select(*COLUMNS), "text")
    out = langid.predict_language(docs, "doc_id", "text", model, COLUMNS)
    return out.where(F.col("lang_pred") != "und").where(F.col("score") >= LEAST_SCORE).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that a smaller document holds, and documents of which no word is left."""
    bounded_batches(spark)
    return _with_words(drop_lines(docs, "doc_id", "text", COLUMNS))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest document of each group of near duplicates (five-word shingles, similarity 0.8).

    Documents without an id, or with one id, are told apart by their texts; of exact repetitions one row stays.
    """
    bounded_batches(spark)
    docs, key, _ = told_apart(docs, "doc_id", "text")
    groups = near_duplicates(docs, key, "text", words=5, percent=80)
    gone = groups.where("NOT kept").select("doc_key").distinct()
    left = docs.join(gone, order_id(docs[key]) == gone["doc_key"], "left_anti")
    again = groups.where("n_shingles > 0").groupBy("doc_key").count().where("count > 1").select("doc_key")
    if again.isEmpty():
        return left.select(*COLUMNS)
    once = left.join(again, order_id(left[key]) == again["doc_key"], "left_anti")
    many = left.join(again, order_id(left[key]) == again["doc_key"], "left_semi").dropDuplicates([key])
    return once.unionByName(many).select(*COLUMNS)


def dedup_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts windows of 20 words that stand earlier, and drops documents of which no word is left."""
    bounded_batches(spark)
    return _with_words(remove_duplicate_spans(docs, "doc_id", "text", COLUMNS, window=20, join_words=False))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 1024 tokens, one row per piece."""
    bounded_batches(spark)
    return pack_documents(docs, "doc_id", "text", tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("substring_dedup", dedup_substrings),
    ("packing", pack_sequences),
]

#: The language model and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again."""
    docs = documents(spark, sf_dir).select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
