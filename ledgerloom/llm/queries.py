"""The registered query of every operator, with production parameters, and SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, fill_middle, kneser_ney, language_id, mixing, paragraphs, quality, secrets, separator_scan, simhash, sql, token_files, word_bpe
from .common import id_remainder, table
from .tokenize import Encoder, hub_encoder, rank_encoder


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file, found on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_bpe() -> Encoder:
    return hub_encoder(vocabulary("byte_bpe_50k.json"))


def byte_bpe_multi() -> Encoder:
    import public_tokenizers

    return rank_encoder(vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


#: No text has this id of the rank vocabulary: it closes documents in flat files.
CLOSING_ID = 50256
#: Appended to every document of the binary output.
END_ID = 2


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return separator_scan.count_tokens(table(spark, folder, "documents"), byte_bpe_multi, CLOSING_ID)


def op2_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secret_report(table(spark, folder, "documents"))


def op3_token_output(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.token_output(table(spark, folder, "documents"), byte_bpe, END_ID)


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language_id.learn(docs, ~language_id.held_out())
    found = language_id.identify(docs, model, "doc_id")
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    found = quality.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.drop("n_lines")


def op6_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op7_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return paragraphs.repeated_substrings(table(spark, folder, "documents"))


def op7_passages(spark: SparkSession, folder: str) -> DataFrame:
    return paragraphs.repeated_passages(table(spark, folder, "documents"))


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.plan_mix(table(spark, folder, "documents"))


#: Words in a shingle and bits that may differ.
SIMHASH_WORDS, SIMHASH_BITS = 4, 4


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"), SIMHASH_WORDS, SIMHASH_BITS)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_language_model(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = id_remainder() == 1
    model = kneser_ney.train(docs.where(~held_out))
    scored = kneser_ney.score_texts(docs, model, "doc_id")
    return scored.withColumn("held_out", held_out).withColumn("perplexity", kneser_ney.perplexity(F.col("score"), F.col("n_tokens")))


def _sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op11_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    found = fill_middle.fill_in_middle(table(spark, folder, "documents"))
    restored = fill_middle.restored(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", _sha256(F.col("output")).alias("output_sha256"), _sha256(restored).alias("restored_sha256"))


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


def word_bpe_49k() -> word_bpe.WordBpe:
    return word_bpe.word_bpe(vocabulary("word_bpe_49k.json"))


def op13_word_bpe(spark: SparkSession, folder: str) -> DataFrame:
    found = word_bpe.decode_ids(word_bpe.encode_texts(table(spark, folder, "documents"), word_bpe_49k), word_bpe_49k)
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), _sha256(listed).alias("ids_sha256"), _sha256(F.col("decoded")).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_secrets": op2_secrets,
    "op3_token_output": op3_token_output,
    "op4_language": op4_language,
    "op5_quality": op5_quality,
    "op6_decontaminate": op6_decontaminate,
    "op7_paragraphs": op7_paragraphs,
    "op7_passages": op7_passages,
    "op8_mixing": op8_mixing,
    "op9_simhash": op9_simhash,
    "op10_language_model": op10_language_model,
    "op11_fill_middle": op11_fill_middle,
    "op12_collocations": op12_collocations,
    "op13_word_bpe": op13_word_bpe,
}
ORACLE: dict[str, str] = {
    "op6_decontaminate": sql.DECONTAMINATE,
    "op8_mixing": sql.MIXING,
    "op11_fill_middle": sql.FILL_MIDDLE,
    "op12_collocations": sql.COLLOCATIONS,
}
