"""Readers: strict and lenient JSON lines, manifests, sentence and link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import trim
from ..functions.schemas import DUMP, ENTRY, MANIFEST, SENTENCES_JSON


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, line_no) of every line; numbers rise with the names of the files and with the place in a file, however Spark deals the files to tasks."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    return spark.read.text(path).select("value", place.alias("line_no"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, line_no) of lines that are not blank."""
    return _lines(spark, path).where(trim(F.col("value")) != "")


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Authored entries; any line that does not parse or lacks a required field fails the read."""
    rows = numbered_lines(spark, path).select("line_no", F.from_json("value", ENTRY, {"mode": "FAILFAST"}).alias("e")).select("line_no", "e.*")
    wrong = F.col("id").isNull() | F.col("language").isNull() | F.col("lemma").isNull()
    return rows.withColumn("id", F.when(wrong, F.raise_error(F.concat(F.lit("entry lacks a required field at line "), F.to_json("line_no")))).otherwise(F.col("id")))


def parse_dump(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value, good, fields of a record): the lines of a raw dictionary dump, each parsed once; those that do not parse or have no word are not good."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = F.explode(F.array(F.from_json("value", DUMP, options)))  # filters on a generator's rows stay above it; below it each would parse the line again
    rows = numbered_lines(spark, path).select("line_no", "value", parsed.alias("d"))
    word = F.coalesce(F.schema_of_variant(F.col("d.word")) == "STRING", F.lit(False))
    good = F.col("d").isNotNull() & F.col("d._corrupt_record").isNull() & word
    said = F.when(word, F.variant_get(F.col("d.word"), "$", "string"))
    rest = (c for c in rows.schema["d"].dataType.names if c not in ("word", "_corrupt_record"))
    return rows.select("line_no", "value", good.alias("good"), said.alias("word"), *(F.col(f"d.{c}").alias(c) for c in rest))


def read_dump(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, bad lines) of a raw dictionary dump."""
    rows = parse_dump(spark, path)
    return rows.where("good").drop("good", "value"), rows.where("NOT good").select("line_no", "value")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(path, multiLine=True)


def _tsv(spark: SparkSession, path: str, n: int) -> DataFrame:
    lines = _lines(spark, path).select("line_no", F.split("value", "\t").alias("f"))
    return lines.where(F.size("f") >= n)


def _id(c) -> object:
    return F.when(c.rlike(r"^\+?[0-9]+$"), c.try_cast("long"))


def read_sentences(spark: SparkSession, path: str, lang: str) -> DataFrame:
    rows = _tsv(spark, path, 3).select("line_no", _id(F.col("f")[0]).alias("id"), F.col("f")[1].alias("lang"), F.col("f")[2].alias("text"))
    return rows.where((F.col("lang") == lang) & F.col("id").isNotNull())


def read_links(spark: SparkSession, path: str) -> DataFrame:
    rows = _tsv(spark, path, 2).select("line_no", _id(F.col("f")[0]).alias("a"), _id(F.col("f")[1]).alias("b"))
    return rows.where("a IS NOT NULL AND b IS NOT NULL")


def read_sentence_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SENTENCES_JSON).json(path, multiLine=True)


def sentence_pairs(records: DataFrame) -> DataFrame:
    """One row for each translation of each sentence; a translation without a licence has the sentence's."""
    flat = records.select("id", "text", "lang", "license", F.explode(F.flatten("translations")).alias("t"))
    return flat.select(F.col("id").alias("source_id"), F.col("text").alias("source_text"), F.col("lang").alias("source_lang"), F.col("t.id").alias("target_id"), F.col("t.text").alias("target_text"), F.col("t.lang").alias("target_lang"), F.coalesce("t.license", "license", F.lit(SENTENCE_LICENSE)).alias("license"), F.concat(F.lit("Tatoeba.org #"), F.col("id").cast("string"), F.lit(" -> #"), F.col("t.id").cast("string")).alias("attribution"))


def sentence_examples(records: DataFrame, target_lang: str | None = None) -> DataFrame:
    """(text, translation, roman, source_id) of each sentence, with its first translation into a language, or its first."""
    told = F.flatten("translations")
    if target_lang is not None:
        told = F.filter(told, lambda t: t["lang"] == target_lang)
    return records.select("text", F.get(told, F.lit(0))["text"].alias("translation"), F.lit(None).cast("string").alias("roman"), F.concat(F.lit("tatoeba:"), F.col("id").cast("string")).alias("source_id"))


#: The licence of sentences that name none.
SENTENCE_LICENSE = "CC BY 2.0 FR"
#: Language codes of sentence corpora; others are used as they are.
SENTENCE_LANGS = {"en": "eng", "ca": "cat", "es": "spa", "fr": "fra", "de": "deu", "zh": "cmn", "cmn": "cmn", "ary": "ary"}
