"""Journal entries, review findings, learning records, lists of files, and counts over a corpus."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import numbered
from .near import near_duplicates  # noqa: F401

CAPTIONS = (".vtt", ".srt", ".json3")


def journal_names(captures: DataFrame, day_starts_at_hour: int = 6) -> DataFrame:
    """Adds day (an assigned date wins; before the hour it is the day before), part and name (YYYYMMDD, YYYYMMDD-part2, ...)."""
    day = F.coalesce("assigned_date", F.to_date(F.col("captured_at") - F.expr(f"INTERVAL {day_starts_at_hour} HOURS")))
    rows = captures.withColumn("day", day)
    part = F.row_number().over(Window.partitionBy("user_id", "day").orderBy("captured_at", "capture_id"))
    stem = F.date_format("day", "yyyyMMdd")
    return rows.withColumn("part", part).withColumn("name", F.when(F.col("part") == 1, stem).otherwise(F.concat(stem, F.lit("-part"), F.col("part").cast("string"))))


def number_records(existing: DataFrame, new: DataFrame) -> DataFrame:
    """new with record_no from the highest existing number on, by slug. One number is fetched; rows are numbered in ranges of the slug."""
    top = existing.agg(F.max("record_no")).first()[0] or 0
    rows = numbered(new, "record_no", "slug")
    return rows.withColumn("record_no", (F.col("record_no") + top).cast("int"))


def current_records(records: DataFrame) -> DataFrame:
    return records.join(records.select(F.col("supersedes").alias("record_no")), "record_no", "left_anti")


def severity_rank(severity_order: list[str]):
    """0 for the gravest."""
    return F.coalesce(*(F.when(F.col("severity") == s, i) for i, s in enumerate(severity_order)), F.lit(len(severity_order)))


def merge_findings(findings: DataFrame, severity_order: list[str] | None = None) -> DataFrame:
    """One finding for each axis, file, line and rule: the gravest, then the first by evidence."""
    rank = severity_rank(severity_order) if severity_order else F.col("severity")
    return findings.groupBy("axis", "file", "line", "rule").agg(F.min(F.struct(rank.alias("r"), "severity", "evidence")).alias("x")).select("axis", "file", "line", "rule", "x.severity", "x.evidence")


def findings_summary(findings: DataFrame, axes: list[str], severity_order: list[str]) -> DataFrame:
    """Per axis the number of findings and the gravest severity; an axis without any appears too."""
    sums = findings.groupBy("axis").agg(F.count("*").alias("n"), F.min_by("severity", severity_rank(severity_order)).alias("highest"))
    wanted = findings.sparkSession.createDataFrame([(a,) for a in axes], "axis string")
    return wanted.join(sums, "axis", "left").select("axis", F.coalesce("n", F.lit(0)).alias("n"), "highest")


def rank_findings(findings: DataFrame, severity_order: list[str]) -> DataFrame:
    """Adds place: within its axis by severity, file, line, rule and evidence. All rows are numbered in ranges, and an axis begins at its least number."""
    rows = numbered(findings, "place", F.col("axis"), severity_rank(severity_order), F.col("file"), F.col("line"), F.col("rule"), F.col("evidence"))
    first = rows.groupBy("axis").agg(F.min("place").alias("first")).withColumnRenamed("axis", "of")
    placed = rows.join(first, F.col("axis").eqNullSafe(F.col("of")))
    return placed.withColumn("place", (F.col("place") - F.col("first") + 1).cast("int")).drop("of", "first")


def new_files(before: DataFrame, after: DataFrame, started_s: float) -> DataFrame:
    """Caption files that are new in their folder; in a folder without any, those modified since a second before the start. Columns: folder, path, modified_s."""
    captions = after.where(F.lower("path").rlike("|".join(rf"\{s}$" for s in CAPTIONS)))
    fresh = captions.join(before.select("path"), "path", "left_anti").withColumn("reason", F.lit("new"))
    touched = captions.where(F.col("modified_s") >= started_s - 1).join(fresh.select("folder"), "folder", "left_anti").withColumn("reason", F.lit("touched"))
    return fresh.unionByName(touched).select("folder", "path", "reason")


def created_files(before: DataFrame, after: DataFrame) -> DataFrame:
    return after.select("path").subtract(before.select("path"))


def _terms(text: str):
    return F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def term_counts(documents: DataFrame, approx: bool = False, text: str = "text") -> DataFrame:
    """term, n (occurrences) and documents (that have it), over all texts; counts are summed up before the shuffle.

    A document's own repeats are counted in the row, so the exact count of documents needs no distinct. With ``approx``
    documents are told apart by their ids, in sketches (see ``term_sketches``).
    """
    if approx:
        return term_estimates(term_sketches(documents, text))
    rows = documents.select(F.explode(_terms(text)).alias("term"))
    per_doc = documents.select(F.explode(F.array_distinct(_terms(text))).alias("term")).groupBy("term").agg(F.count("*").alias("documents"))
    return rows.groupBy("term").agg(F.count("*").alias("n")).join(per_doc, "term")


def term_sketches(documents: DataFrame, text: str = "text", precision: int = 12) -> DataFrame:
    """term, n and a sketch of the ids of the documents that have it: what is kept of a delivery, so that later ones need not read it again.

    A sketch of ``precision`` p has 2^p counters at most; its estimates are off by about 1.04 / sqrt(2^p), 1.6 % at 12,
    and by next to nothing for few documents. A document that is delivered twice counts once in the sketch.
    """
    rows = documents.select("doc_id", F.explode(_terms(text)).alias("term"))
    return rows.groupBy("term").agg(F.count("*").alias("n"), F.hll_sketch_agg("doc_id", precision).alias("sketch"))


def merge_sketches(*deliveries: DataFrame) -> DataFrame:
    """The sketches of several deliveries as one."""
    return all_of(deliveries).groupBy("term").agg(F.sum("n").alias("n"), F.hll_union_agg("sketch").alias("sketch"))


def term_estimates(sketches: DataFrame) -> DataFrame:
    """term, n and documents (an estimate) of sketches."""
    return sketches.select("term", "n", F.hll_sketch_estimate("sketch").alias("documents"))


def all_of(frames) -> DataFrame:
    out, *rest = frames
    for df in rest:
        out = out.unionByName(df)
    return out


def frequent_sketch(documents: DataFrame, text: str = "text", tracked: int = 10_000) -> DataFrame:
    """One row with a sketch of the most frequent terms of a delivery: ``tracked`` counters, however many terms there are."""
    return documents.select(F.explode(_terms(text)).alias("term")).agg(F.expr(f"approx_top_k_accumulate(term, {tracked})").alias("sketch"))


def frequent_terms(sketches: DataFrame, k: int = 100, tracked: int = 10_000) -> DataFrame:
    """term and n (an estimate, which is exact where no more than ``tracked`` terms occur) of the ``k`` most frequent terms of all deliveries whose sketches these are."""
    whole = sketches.agg(F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("sketch"))
    return whole.select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {k})")).alias("x")).select(F.col("x.item").alias("term"), F.col("x.count").alias("n"))
