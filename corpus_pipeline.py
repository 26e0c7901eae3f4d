"""The corpus pipeline: five operators of quillspark.llm in a row, from documents to token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return
the columns of ``documents``; rows are told apart by a hash of id and text, so that equal ids do no harm.

Defined results, in all stages: an empty table gives an empty one with the same columns; texts are taken whole,
however long; a null id is an id of its own and never joined with another; columns beside those of ``documents``,
of any name, pass unchanged up to the last stage.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, language, mixing, secrets, simhash

RANKS = {"ranks": public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}
#: A language is accepted from this share on.
SURE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those whose best language is no surer than the others together. The stated language stays as it is.

    Null and empty texts have no letter and go. Rows without an id or a language are judged, but not learned from;
    without anything to learn from, every document goes. Repeated rows are judged alike.
    """
    columns = docs.columns
    model = language.train(docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0))
    return language.accepted(docs, model, SURE).select(*columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the lowest id of each group of exact and near copies.

    A null id comes after all others; of equal ids the least hash of the text decides, and rows of equal id and
    text stay once. Texts without a word are one group, a null among them.
    """
    return simhash.representatives(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in texts; n_chars follows.

    Every row stays, repeated ones too. A null text stays null, and so is its n_chars. Where labels are not of
    both classes a rule decides (see ``secrets.scan``).
    """
    clean = secrets.redact(docs, secrets.scan(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that sources have tempered shares, in shuffled order.

    A null source is a source like any other. Draws go by id and text, so repeated rows share a count and rows
    without an id do not.
    """
    return mixing.mix(docs).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether they decode to its text. A null text is empty: no ids, and a round trip. Rows are neither dropped nor added."""
    decoded = bpe.decode(bpe.encode(docs.select("doc_id", "source", "lang", "text"), RANKS), RANKS)
    return decoded.select("doc_id", "source", "lang", "ids", F.size("ids").alias("n_tokens"), F.decode("decoded", "UTF-8").eqNullSafe(F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [("language ID", language_id), ("SimHash near-dedup", near_dedup), ("secret scan", secret_scan), ("source mix", source_mix), ("byte-level BPE", tokenize)]
#: Neither the language model nor the forest can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over all of ``documents``: doc_id, source, lang, ids, n_tokens and round_trip of each copy that was drawn."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
