from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import captions as C
from quillspark.plans import fixtures as I
from quillspark.session import get_session  # noqa: F401
from quillspark.sources import readers
from quillspark.sources.sinks import write_table, write_transcripts
from conftest import SMALL
import pytest

FILES = "file_id string, format string, text string"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_literals(spark):
    L = F.lit
    assert one(spark, X.parse_time(L("01:02:03,500"))) == 3723.5
    assert one(spark, X.parse_time(L("02:03.5"))) == 123.5
    assert one(spark, X.parse_time(L("3"))) is None
    assert one(spark, X.clean_cue_text(L("<00:00:01.000><c>&lt;b&gt; a b</c>\u200b  &amp;"))) == "<b> a b &"
    assert one(spark, X.token_key(L("Été_1!"))) == "été1"
    assert one(spark, X.token_key(L("--"))) == "--"
    assert one(spark, X.tokens(L("  a  b "))) == ["a", "b"]
    assert one(spark, X.tokens(L("   "))) == []
    assert one(spark, X.format_text(F.array(L("("), L("a"), L(")"), L(","), L("b"), L("!")))) == "(a), b!"
    assert one(spark, X.ends_sentence(F.array(L('done."')))) is True
    assert one(spark, X.ends_sentence(F.array().cast("array<string>"))) is False
    assert one(spark, X.overlap(F.array(L("a"), L("b")), F.array(L("b"), L("c")), 5)) == 1
    assert one(spark, X.overlap(F.array().cast("array<string>"), F.array(L("b")), 5)) == 0
    assert one(spark, X.format_timestamp(L(3725.9))) == "1:02:05"
    assert one(spark, X.format_timestamp(L(65.9))) == "01:05"
    assert one(spark, X.stamp(L(0.5))) == "00:00:00" and one(spark, X.stamp(L(1.5))) == "00:00:02" and one(spark, X.stamp(L(-4.0))) == "00:00:00"


def test_blocks(spark, rows):
    vtt = "WEBVTT\n\nNOTE\n1\n00:00.000 --> 00:01.000 align:start\n00:00.500 --> 00:00.700\nHello <b>you</b>\r\n \nx\n\n00:02.000 --> 00:03.000\n\n00:04.000 --> 00:05.000\nA &amp; B\nC"
    files = spark.createDataFrame([("a", "VTT", vtt), ("b", "txt", vtt), ("c", "srt", None), ("d", "vtt", "")], FILES)
    assert rows(C.explode_cue_blocks(files).drop("cue_seq")) == [("a", 0.0, 1.0, "00:00.500 --> 00:00.700 Hello you"), ("a", 4.0, 5.0, "A & B C")]
    assert rows(C.empty_inputs(files, C.explode_cue_blocks(files))) == [("b",), ("c",), ("d",)]


def test_events(spark, rows):
    js = '{"events": [{"tStartMs": 1000, "dDurationMs": 500, "segs": [{"utf8": "a"}, {"utf8": "b"}, {}]}, {"tStartMs": 1}, {"segs": [{"utf8": "z"}]}]}'
    files = spark.createDataFrame([("a", "json3", js), ("b", "json3", "not json")], FILES)
    assert rows(C.explode_cue_events(files)) == [("a", 0, 1.0, 1.5, "ab"), ("a", 2, 0.0, 0.0, "z")]


def paragraphs(spark, cues, **kw):
    df = spark.createDataFrame([("f", i, float(a), float(b), t) for i, (a, b, t) in enumerate(cues)], "file_id string, cue_seq int, start_s double, end_s double, text string")
    return [(r.start_s, r.text) for r in C.build_paragraphs(df, **kw).orderBy("para_seq").collect()]


def test_paragraph_rules(spark):
    assert paragraphs(spark, [(0, 1, "so we begin"), (1, 2, "we begin here"), (2, 3, "begin here now.")]) == [(0.0, "so we begin here now.")]
    # a pause ends a paragraph only after a sentence or enough words; an equal gap is no pause
    assert paragraphs(spark, [(0, 1, "One."), (4, 5, "Two.")]) == [(0.0, "One."), (4.0, "Two.")]
    assert paragraphs(spark, [(0, 1, "One."), (3.5, 5, "Two.")]) == [(0.0, "One. Two.")]
    assert paragraphs(spark, [(0, 1, "one"), (9, 10, "two")]) == [(0.0, "one two")]
    # a change of speaker starts anew after a sentence, and is dropped within one
    assert paragraphs(spark, [(0, 1, "Yes."), (1, 2, ">> No.")]) == [(0.0, "Yes."), (1.0, ">> No.")]
    assert paragraphs(spark, [(0, 1, "well I"), (1, 2, ">> I think so.")]) == [(0.0, "well I think so.")]
    assert paragraphs(spark, [(0, 1, "a b. c d."), (1, 2, "e.")], max_words=4) == [(0.0, "a b. c d."), (1.0, "e.")]
    assert paragraphs(spark, [(0, 1, ""), (1, 2, "  ")]) == []


def test_rolling_cues_come_back_as_their_text(spark):
    cues = I.rolling_cues(spark, SMALL)
    text = C.build_paragraphs(cues).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("para_seq", "text"))).alias("p")).select("file_id", F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("text"))
    whole = I.table(spark, SMALL, "documents").select(F.col("doc_id").cast("string").alias("file_id"), X.tokens("text").alias("w"))
    joined = text.join(whole, "file_id").select(F.size(X.tokens("text")).alias("n"), F.size("w").alias("m")).collect()
    assert sum(r.n <= r.m for r in joined) == len(joined) and sum(abs(r.n - r.m) <= 6 for r in joined) > 0.5 * len(joined)


def test_partitions_do_not_matter(spark, rows):
    cues = I.rolling_cues(spark, SMALL)
    want = rows(C.build_paragraphs(cues))
    for n in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        assert rows(C.build_paragraphs(cues.orderBy(F.rand(3)))) == want
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_files_in_and_out(spark, tmp_path, rows):
    (tmp_path / "a.vtt").write_bytes("\ufeffWEBVTT\n\n00:00.000 --> 00:01.000\nHé".encode() + b"\xff\n")
    (tmp_path / "b.doc").write_text("x")
    found = {r.file_id: r for r in readers.read_captions(spark, str(tmp_path)).collect()}
    assert found["a.vtt"].format == "vtt" and found["a.vtt"].text.startswith("WEBVTT") and "�" in found["a.vtt"].text
    assert found["b.doc"].text is None and "unsupported" in found["b.doc"].error
    docs = C.assemble_transcripts(spark.createDataFrame([("a", 1, 70.0, "Two."), ("a", 0, 0.0, "One.")], C.PARAGRAPHS.replace("para_seq int, start_s", "para_seq int, start_s")))
    assert docs.first().markdown == "# Transcript\n\nSource captions: `a`\n\n**[00:00]** One.\n\n**[01:10]** Two.\n"
    out = str(tmp_path / "out")
    write_transcripts(docs, out)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        write_transcripts(docs, out)
    write_table(docs, out, overwrite=True)
    assert spark.read.parquet(out).count() == 1


def test_values_are_computed_once_and_cues_without_slices_of_all_tokens(spark, tmp_path):
    """What a column function names often is computed once; a long text's cues do not take the square of its length."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(spark.range(1).select(X.parse_time(F.reverse(F.col("id").cast("string"))).alias("x"))).count("reverse(") == 1
    pair = spark.range(1).select(X.overlap(F.split(F.reverse(F.col("id").cast("string")), ","), F.array(F.lit("a")), 5).alias("x"))
    assert plan(pair).count("reverse(") == 1
    w = [f"w{i}" for i in range(60_000)]
    spark.createDataFrame([(1, " \n".join(w)), (2, " ".join(w[:11])), (3, " ".join(w[:13])), (4, None), (5, "  "), (6, "x" * 300_000)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    cues = I.rolling_cues(spark, str(tmp_path))
    assert "slice(" not in plan(cues)
    got = sorted((r.file_id, r.cue_seq, r.text) for r in cues.collect())
    assert got == sorted([("1", i, " ".join(w[i * 6 : i * 6 + 12])) for i in range(9_999)] + [("3", 0, " ".join(w[:12]))])


def test_cues_of_a_file_are_not_dealt_out(spark, rows):
    """Files were put together from dealt cues, written, and their cues dealt once more: several times the texts on disk."""
    from quillspark.plans import captions as plans

    found = plans.captions_to_transcripts(spark, SMALL)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(file_id") == 1 and "hashpartitioning(xxhash64(file_id" not in plan and "ExistingRDD" not in plan
    files = I.caption_files(spark, SMALL)
    cues = C.explode_cue_blocks(files).unionByName(C.explode_cue_events(files))
    assert rows(found) == rows(C.assemble_transcripts(C.build_paragraphs(cues.repartition(5)))) != []
