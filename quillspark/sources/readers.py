"""Files to rows."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import html_unescape

PAGE_RESULT = T.StructType([T.StructField(n, T.StringType()) for n in ("status", "model", "page_prompt_sha256", "source_pdf_sha256", "source_pdf_path", "render_media_type", "ocr_mode", "render_sha256", "rendered_image_path", "ocr_markdown", "finish_reason", "processed_at")] + [T.StructField("bundle_id", T.LongType()), T.StructField("page_number", T.IntegerType()), T.StructField("dpi", T.StringType()), T.StructField("render_dimensions", T.ArrayType(T.IntegerType())), T.StructField("review_notes", T.ArrayType(T.StringType()))])


#: What the binaryFile source gives, and what packs hold.
FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def read_files(spark: SparkSession, path: str, packed: str | None = None) -> DataFrame:
    """Rows of the binaryFile source: each file under the path, and each in the packs under ``packed``, if that is given (see ``sinks.pack_files``)."""
    loose = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return loose if packed is None else loose.unionByName(spark.read.schema(FILES).parquet(packed))


def _text() -> F.Column:
    """UTF-8 without a byte order mark; bad bytes are replaced."""
    return F.regexp_replace(F.expr("make_valid_utf8(cast(content as string))"), "^\ufeff", "")


def caption_rows(files: DataFrame, format: str | None = None) -> DataFrame:
    """file_id, path, format, text, modified and error of rows of the binaryFile source; the format is the path's suffix unless it is given."""
    own = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)) if format is None else F.lit(format)
    known = own.isin("vtt", "srt", "json3")
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file_id"), "path", own.alias("format"), F.when(known, _text()).alias("text"), F.col("modificationTime").alias("modified"), F.when(~known, F.concat(F.lit("unsupported caption format: "), own)).alias("error"))


def read_captions(spark: SparkSession, path: str, format: str | None = None, packed: str | None = None) -> DataFrame:
    """file_id, path, format, text, modified and error of each file under the path and in the packs; formats that are no captions are errors."""
    return caption_rows(read_files(spark, path, packed), format)


def read_statements(spark: SparkSession, path: str, packed: str | None = None) -> DataFrame:
    """statement_id (a hash of the path), path, xml and error, of files and packs; what does not begin as XML is an error."""
    files = read_files(spark, path, packed)
    xml = _text()
    good = xml.rlike(r"^\s*<")
    return files.select(F.xxhash64("path").alias("statement_id"), "path", F.when(good, xml).alias("xml"), F.when(~good, F.lit("not XML")).alias("error"))


def read_section(spark: SparkSession, path: str, tag: str, attributes: Sequence[str], packed: str | None = None) -> DataFrame:
    """path and the named attributes of every element with the tag, in reports of any size, and in packs of small ones.

    Files are cut at the tag as text is cut at line ends, so a large report is many tasks' work; Spark's XML source reads
    each file in one task. An element without an attribute has null there, and so has an empty one. Reports are not checked as a
    whole: of one that breaks off, the elements before the break are rows, and so is what stands in a comment.
    """
    pieces = spark.read.option("lineSep", f"<{tag}").option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    if packed is not None:
        pieces = pieces.unionByName(spark.read.schema(FILES).parquet(packed).select("path", F.explode(F.split(_text(), f"<{tag}")).alias("value")))
    # What is before a file's first element begins otherwise, and so does an element with a longer name.
    own = pieces.where(F.col("value").rlike(r"^(\s|/|>)") & ~F.col("value").rlike(r"^\s*<"))
    start = r"""^((?:[^"'>]|"[^"]*"|'[^']*')*)>"""

    def value(attribute: str) -> F.Column:
        raw = F.regexp_extract("head", rf"""(?:^|\s){attribute}\s*=\s*("[^"]*"|'[^']*')""", 1)
        return F.nullif(html_unescape(F.translate(F.substring(raw, F.lit(2), F.length(raw) - 2), "\n\r\t", "   ")), F.lit(""))

    whole = own.where(F.col("value").rlike(start)).select("path", F.regexp_extract("value", start, 1).alias("head"))
    return whole.select("path", *(value(a).alias(a) for a in attributes))


def read_page_results(spark: SparkSession, path: str) -> DataFrame:
    """Stored page results with a fixed schema; what does not parse is in _corrupt_record."""
    schema = T.StructType([*PAGE_RESULT.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").json(path)


def read_responses(spark: SparkSession, path: str, packed: str | None = None) -> DataFrame:
    """response_id (the file's name without its suffix), path, response and error of each stored provider response, as it came, in files and packs; what is no JSON object is an error."""
    files = read_files(spark, path, packed)
    rows = files.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("response_id"), "path", F.regexp_replace(_text(), r"^\s+|\s+$", "").alias("response"))
    value = F.try_parse_json("response")
    error = F.when(F.length("response") == 0, "empty response").when(value.isNull(), "invalid JSON").when(~F.schema_of_variant(value).startswith("OBJECT"), "not a JSON object")
    return rows.withColumn("error", error)
