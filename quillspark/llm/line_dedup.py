"""Substring dedup by hashing lines: units that occur before are removed, with their offsets.

A unit is a line, cut after each full stop or question mark that a blank follows, so that a passage that
was copied into the middle of another line is met too. Units are normalised (lower case, white space as
single blanks), digests are grouped over all documents, and the occurrence of the lowest rank stays.

A unit of ``min_words`` words and more is hashed by itself. Shorter ones say too little alone: neighbours among
them are one unit together, cut after those whose own digest begins with 0 to 7 (one in two), so that the same
cuts are met wherever a passage is copied. Where such a unit still has too few words, it is hashed with the
unit before it, if both together have enough, and removed where it occurs behind the same unit. So short sentences
inside a repeated passage go with it, but for some at its ends, and stay where they merely recur.

Rank is the document id (null last), then a hash of the text, then the offset. Offsets are in characters of
the original text. Defined results: null and empty texts have no units; very long texts are cut whole;
repeated rows with the same id and text count as one, and none of them takes text from another; equal or null
ids are told apart by their texts; an empty table gives an empty result; other columns, of any name, are
ignored by ``repeats`` and kept by ``remove``.
"""

import re
from hashlib import md5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free, pieces, prepare, release, texts

#: Pieces that together make up the whole text.
UNIT = r"[^\n]*?[.?][ \t]+|[^\n]*\n|[^\n]+"
_UNIT = re.compile(UNIT)
MIN_WORDS = 8


def text_units(text: str, min_words: int = MIN_WORDS) -> list[tuple[int, int, int, bytes]]:
    """start, stop, words and digest of each unit of a text. Lines without a word are no units, and are removed between units only."""
    found, open_ = [], False  # start, stop, words, normalised text; whether the last may go on
    for m in _UNIT.finditer(text):
        words = m.group().lower().split()
        if not words:
            continue
        plain, long = " ".join(words), len(words) >= min_words
        if open_ and not long:
            found[-1][1:] = [m.end(), found[-1][2] + len(words), f"{found[-1][3]}\n{plain}"]
        else:
            found.append([m.start(), m.end(), len(words), plain])
        open_ = not long and md5(plain.encode()).digest()[0] >= 128
    out = []
    for i, (start, stop, size, plain) in enumerate(found):
        if size >= min_words:
            out.append((start, stop, size, md5(plain.encode()).digest()))
        elif i and size + found[i - 1][2] >= min_words:
            out.append((start, stop, size, md5(f"{found[i - 1][3]}\t{plain}".encode()).digest()))
    return out


def units(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, tie (a hash of the text), start, stop, n_words and digest of every unit that may be removed."""
    prepare(docs.sparkSession)

    def run(batches):
        release()
        for batch in pieces(batches):
            rows = [(name, tie, *unit) for name, tie, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch)) for unit in text_units(text, min_words)]
            columns = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "tie", "start", "stop", "n_words", "digest"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, tie long, start int, stop int, n_words int, digest binary")


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The units to remove: doc_id, tie, start, stop, n_words, digest (hex), and where the kept one is (kept_doc_id, kept_start).

    The first occurrence of a digest is found by an aggregation, which sums up a frequent unit before the
    shuffle, and written; so the join back has a shuffle of its own and may split a frequent digest among tasks.
    """
    found = cut(units(docs, min_words).distinct())
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie", "start")
    first = cut(found.groupBy("digest").agg(F.min(rank).alias("kept"), F.count("*").alias("n")).where("n > 1"))
    joined = found.join(first, "digest").where(rank != F.col("kept"))
    return joined.select("doc_id", "tie", "start", "stop", "n_words", F.lower(F.hex("digest")).alias("digest"), F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.start").alias("kept_start"))


def remove(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The documents without the spans (doc_id, tie, start, stop) of their texts. A span belongs to the rows of its id and text only."""
    own_id, own_tie, parts, key = free(docs, "span_id", "span_tie", "spans", "tie")
    listed = spans.groupBy(F.col("doc_id").alias(own_id), F.col("tie").alias(own_tie)).agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias(parts))
    left = F.aggregate(
        parts,
        F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(F.array_append(acc["kept"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])).alias("kept"), s["stop"].alias("at")),
        lambda acc: F.concat(F.array_join(acc["kept"], ""), F.substring(F.col("text"), acc["at"] + 1, F.length("text"))),
    )
    keyed = docs.withColumn(key, F.xxhash64(F.col("text").cast("string")))
    joined = keyed.join(listed, F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(key) == F.col(own_tie)), "left")
    return joined.withColumn("text", F.when(F.col(parts).isNull(), F.col("text")).otherwise(left)).select(*docs.columns)
