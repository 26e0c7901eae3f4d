import re

import tiktoken  # noqa: F401
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SMALL
from test_bpe_and_file import reference
from test_near import brute_components, brute_print


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "src1", 0), (9002, "123 456", "en", None, 7), (9003, "", None, "src2", 0)], docs.schema)
    docs = docs.unionByName(odd).withColumn("component_id", F.lit("mine"))
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    got = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        got[name] = docs.collect()
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    accepted = {r.doc_id for r in got["language ID"]}
    assert not accepted & {9001, 9002, 9003} and len(accepted) >= 0.99 * (len(before) - 3)
    want = brute_components({i: brute_print(before[i].text) for i in accepted})
    assert sorted(r.doc_id for r in got["SimHash near-dedup"]) == sorted(set(want.values()))
    scanned = {r.doc_id: r for r in got["secret scan"]}
    assert set(scanned) == set(want.values()) and all(r.n_chars == len(r.text) for r in scanned.values())
    for i, r in scanned.items():
        assert re.sub(r"\[SECRET\]", "", r.text) == r.text.replace("[SECRET]", "") and (r.text == before[i].text or "[SECRET]" in r.text)
    mixed = got["source mix"]
    assert {r.doc_id for r in mixed} <= set(scanned) and 0.6 * len(scanned) < len(mixed) < 1.5 * len(scanned)
    assert all(r.text == scanned[r.doc_id].text for r in mixed)
    ref = reference()
    tokens = got["byte-level BPE"]
    assert len(tokens) == len(mixed) and all(r.round_trip and r.ids == ref.encode_ordinary(scanned[r.doc_id].text) for r in tokens)


def test_run_equals_its_stages_in_rows(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert set(out.columns) >= {"doc_id", "ids"} and out.count() > 0 and out.where("not round_trip").count() == 0


def chain(spark, docs, tmp_path):
    """The rows that each stage leaves, each written and read again as in a run."""
    got = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        got[name] = docs
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    return got


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    got = chain(spark, docs, tmp_path)
    assert all(out.count() == 0 for out in got.values())
    assert {"doc_id", "ids", "n_tokens", "round_trip"} <= set(got["byte-level BPE"].columns)


def test_stages_on_odd_rows(spark, tmp_path):
    """Null ids and sources, repeated rows, one id with two texts, a text of a million characters, other columns of inner names."""
    plain = spark.read.parquet(f"{SMALL}/documents.parquet")
    base = [r for r in plain.orderBy("doc_id").collect() if r.text and r.lang and len(r.text.split()) > 50]
    first, second, third = base[0], base[1], base[2]
    long_text = "\n".join(f"{r.text} {i}" for i in range(1 + 1_000_000 // sum(len(r.text) + 2 for r in base)) for r in base)
    odd = [
        (None, first.text[::-1], first.lang, None, 1), (None, second.text + " " + third.text, second.lang, "s", None),
        (9100, second.text[: len(second.text) // 2] * 2, second.lang, "s", 5), (9100, third.text[len(third.text) // 2 :] * 2, third.lang, "s", 5),
        (9101, long_text, first.lang, "s", len(long_text)), (9102, None, None, None, None), (9103, "", "en", "s", 0),
    ]
    docs = plain.unionByName(spark.createDataFrame(odd + [tuple(second)] * 3, plain.schema))
    docs = docs.withColumn("tie", F.lit("a")).withColumn("key", F.lit(1)).withColumn("component", F.lit(2)).withColumn("salt", F.lit(3)).withColumn("spans", F.lit("b")).withColumn("copy", F.lit(4)).withColumn("ids", F.lit(5))
    got = chain(spark, docs, tmp_path)
    accepted = got["language ID"].collect()
    assert not {9102, 9103} & {r.doc_id for r in accepted} and 9101 in {r.doc_id for r in accepted}
    assert [r.text for r in accepted if r.doc_id == 9101] == [long_text]
    single = got["SimHash near-dedup"].collect()
    assert sum(r.text == second.text for r in single) <= 1 and len({(r.doc_id, r.text) for r in single}) == len(single)
    classes = brute_components({i: brute_print(r.text) for i, r in enumerate(accepted)})
    assert len(single) == len(set(classes.values()))
    assert all((r.tie, r.key, r.component, r.salt, r.spans) == ("a", 1, 2, 3, "b") for r in got["source mix"].collect())
    assert got["secret scan"].count() == len(single)
    tokens = got["byte-level BPE"]
    assert tokens.count() == got["source mix"].count() and tokens.where("not round_trip").count() == 0
