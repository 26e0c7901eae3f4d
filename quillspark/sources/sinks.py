"""Rows to files."""

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files


def _aside(path: str, kind: str) -> str:
    """A hidden folder beside the path; readers of the parent folder pass over it."""
    folder, _, name = path.rstrip("/").rpartition("/")
    return f"{folder}/.{name}.{kind}" if folder else f".{name}.{kind}"


def _restore(spark: SparkSession, path: str) -> None:
    """Brings back what a writer that died between its two renames had put aside."""
    kept = _aside(path, "previous")
    if not files.exists(spark, path) and files.exists(spark, kept):
        files.move(spark, kept, path)


def write_table(df: DataFrame, path: str, overwrite: bool = False, format: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Writes a table aside, then renames it into its place. What is there is not replaced unless asked.

    The rows are computed and written before anything that exists is touched: a write that fails leaves the old table as it
    was, and a table may be overwritten from a query that reads it. The swap is two renames, the old table out and the new
    one in; if the second fails the first is taken back, and if the writer dies between them, the next ``write_table`` or
    ``read_table`` of the path does so. A reader that is at work while a table is replaced fails; it never reads both.
    """
    spark = df.sparkSession
    _restore(spark, path)
    if not overwrite and files.exists(spark, path):
        raise FileExistsError(f"[PATH_ALREADY_EXISTS] {path} already exists")
    staged, kept = _aside(path, f"staged-{uuid.uuid4().hex}"), _aside(path, "previous")
    try:
        df.write.format(format).partitionBy(*partition_by).save(staged)
        if overwrite and files.exists(spark, path):
            files.delete(spark, kept)  # the table is there, so this is what an earlier writer had no time to delete
            files.move(spark, path, kept)
            try:
                files.move(spark, staged, path)
            except BaseException:
                _restore(spark, path)
                raise
            files.delete(spark, kept)
        else:
            files.move(spark, staged, path)
    finally:
        files.delete(spark, staged)


def read_table(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """What ``write_table`` wrote last."""
    _restore(spark, path)
    return spark.read.format(format).load(path)


def pack_files(files: DataFrame, path: str) -> None:
    """Adds packs of small files: path and text (or content) of each, in Parquet tables with the columns of the binaryFile source.

    A store pays for each file when it is made, renamed, listed and opened, whatever its size; a pack is one of them for
    thousands. Row groups of 32 MB are what a reader holds or takes apart. The readers take files and packs together.
    """
    content = F.col("content") if "content" in files.columns else F.encode("text", "UTF-8")
    modified = F.col("modificationTime") if "modificationTime" in files.columns else F.current_timestamp()
    rows = files.select("path", modified.alias("modificationTime"), F.length(content).cast("long").alias("length"), content.alias("content"))
    rows.write.mode("append").option("parquet.block.size", 32 << 20).parquet(path)


def write_transcripts(transcripts: DataFrame, path: str, overwrite: bool = False) -> None:
    """file_id, markdown and text, a folder for each kind, by ``write_table``."""
    kinds = F.array(F.struct(F.lit("md").alias("kind"), F.col("markdown").alias("document")), F.struct(F.lit("txt").alias("kind"), F.col("text").alias("document")))
    rows = transcripts.select("file_id", F.explode(kinds).alias("x")).select("file_id", "x.kind", "x.document")
    write_table(rows, path, overwrite, partition_by=["kind"])


def to_json_docs(df: DataFrame, key: str, error: str | None = None) -> DataFrame:
    """key and document: the row as JSON with its fields in the order of their names, nulls included; rows with an error are {"message", "status": "error"}."""
    fields = sorted(c for c in df.columns if c not in (key, error))
    good = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    if error is None:
        return df.select(key, good.alias("document"))
    bad = F.to_json(F.struct(F.col(error).alias("message"), F.lit("error").alias("status")))
    return df.select(key, F.when(F.col(error).isNotNull(), bad).otherwise(good).alias("document"))
