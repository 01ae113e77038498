"""The corpus pipeline: five stages over the documents table, each written as Parquet and read as the next one's input.

Language ID drops documents without a language (null or letterless text) and names the language of those that say none;
of every group of SimHash
near-duplicates one stays; documents that hold a benchmark item go; sources are mixed to their target weights,
so documents repeat or drop out; the rest is written as token ids and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, language_id, mixing, queries, simhash, token_files
from ledgerloom.session import reliable_checkpoint


def keep_languages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with a language; a null ``lang`` becomes the predicted one, learned from documents that state theirs."""
    model = language_id.learn(docs, ~language_id.held_out())
    found = language_id.identify(docs, model, *docs.columns)
    found = found.where(F.col("lang_pred") != language_id.UNKNOWN).withColumn("lang", F.coalesce("lang", "lang_pred"))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each component of linked fingerprints: the smallest id, null ids last."""
    return simhash.one_of_each(docs, queries.SIMHASH_WORDS, queries.SIMHASH_BITS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none."""
    return decontaminate.clean(docs, queries.table(spark, folder, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents as often as the mix takes them; null is a source of its own."""
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The documents' rows as read back from the token files; null and empty texts have the end id alone."""
    return token_files.token_output(docs, queries.byte_bpe, queries.END_ID)


STAGES = [
    ("language ID", keep_languages),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("token-ID output", write_tokens),
]

#: SQL can express neither the first two stages nor the last.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """The stages' result for the documents of a folder of tables."""
    docs = queries.table(spark, folder, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else reliable_checkpoint(docs), folder)
    return docs
