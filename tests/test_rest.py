import time
from concurrent.futures import ThreadPoolExecutor
from datetime import date

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from quillspark import session
from quillspark.operators import graph, notes as N, pages as P, statements as S, tasks as T
from quillspark.plans import fixtures as I
from quillspark.sources import readers
from quillspark.streaming import jobs
from quillspark.operators import captions as C


def test_pages_selection(spark, rows):
    df = spark.createDataFrame([(1, "1-3,7,9", 8), (2, " ,", 3), (3, "5-2", 9), (4, "x", 9), (5, None, 9)], "k int, spec string, n int")
    assert rows(P.expand_pages(df, "k", "spec", "n")) == [(1, 1, None), (1, 2, None), (1, 3, None), (1, 7, None), (2, None, "no pages selected"), (3, None, "no pages selected"), (4, None, "invalid page selection"), (5, None, "invalid page selection")]
    strict = P.expand_pages(df.where("k > 1"), "k", "spec", strict=True)
    assert {r.error for r in strict.collect()} == {"invalid page selection"}


def test_redaction_and_errors(spark, rows):
    xml = '<R><FlexStatement accountId="U" ClientIDx="1" currency="USD" toDate=""><OpenPosition symbol="A" position="0"/></FlexStatement></R>'
    e = S.statement_elements(spark.createDataFrame([(1, xml), (2, "<a"), (3, None), (4, "<!DOCTYPE a><a/>")], "statement_id long, xml string")).cache()
    assert [(r.statement_id, r.error) for r in e.where("error is not null").orderBy("statement_id").collect()] == [(2, "not XML"), (3, "not XML"), (4, "not XML")]
    assert S.redact(e.where("error is null")).where(F.exists(F.map_keys("attrs"), lambda k: F.lower(k).rlike("account|clientid"))).count() == 0
    assert S.positions(e).first().position == "0"


def test_filter_and_its_opposite_split_the_tasks(spark):
    t, p = I.tasks(spark, SMALL), I.projects(spark, SMALL)
    n = t.count()
    for x in ("today", "overdue", "5 days", "no date", "p1", "@home", "no labels", "#NATION_3", "##ASIA", "assigned to: me", "recurring", "created before: -7 days", "/A"):
        a, b = (T.filter_tasks(t, e, date(1998, 6, 15), me=7, projects=p).count() for e in (x, f"!({x})"))
        assert a + b == n
    for bad in ("(p1", "p1 &", "nonsense", "p1 p2 )"):
        with pytest.raises(ValueError):
            T.filter_tasks(t, bad, date(1998, 6, 15))


def test_cycle_of_projects_ends(spark, rows):
    p = spark.createDataFrame([(1, 2, "a"), (2, 1, "b"), (3, 2, "c")], "project_id int, parent_id int, name string")
    assert rows(T.project_subtree(p, "A")) == [(1,), (2,), (3,)]


def test_components(spark, rows):
    links = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (1, 1), (3, 5), (10, 9), (None, 2)], "a long, b long")
    assert dict(rows(graph.components(links))) == {3: 3, 4: 3, 5: 3, 8: 8, 9: 8, 10: 8}
    chain = spark.range(1, 300).selectExpr("id as a", "id - 1 as b")
    assert graph.components(chain).agg(F.max("component"), F.count("*")).first()[:] == (0, 300)
    assert graph.components(links.where("a > 99")).count() == 0


def test_near_duplicates_against_brute_force(spark):
    import random

    random.seed(2)
    words = [f"w{i}" for i in range(50)]
    texts = [" ".join(random.choice(words) for _ in range(80)) for _ in range(12)]
    for t in texts[:6]:
        for k in (1, 2, 3):
            w = t.split()
            for _ in range(k):
                w[random.randrange(len(w))] = "x"
            texts.append(" ".join(w))
    texts += [texts[0], "a b", "A  b", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}

    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i in root:
            for j in range(len(texts)):
                if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                    root[j] = root[i] = min(root[i], root[j])
    root[len(texts) - 1] = len(texts) - 1  # a null text is no empty one
    assert dict(N.near_duplicates(df).collect()) == dict(enumerate(root))
    assert dict(N.near_duplicates(df, common=0).collect()) == dict(enumerate(root))


def test_stream_of_files_equals_batch(spark, tmp_path, rows):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    files = I.caption_files(spark, SMALL).limit(9).collect()
    (tmp_path / "in").mkdir()
    for i, part in enumerate((files[:4], files[4:])):
        for f in part:
            (tmp_path / "in" / f.path).write_text(f.text)
        jobs.stream_captions(spark, source, out, state).awaitTermination()
        before = spark.read.parquet(out).count()
        jobs.stream_captions(spark, source, out, state).awaitTermination()
        assert spark.read.parquet(out).count() == before
    batch = readers.read_captions(spark, source)
    want = rows(C.explode_cue_blocks(batch).unionByName(C.explode_cue_events(batch)).select("file_id", "cue_seq", "start_s", "end_s", "text"))
    assert rows(spark.read.parquet(out).select("file_id", "cue_seq", "start_s", "end_s", "text")) == want


def test_live_paragraphs_equal_batch(spark, tmp_path, rows):
    from pyspark.sql import Window

    cues = I.plain_cues(spark, SMALL)
    last = F.col("cue_seq") == F.max("cue_seq").over(Window.partitionBy("file_id"))
    for part in range(3):
        cues.withColumn("last", last).where(f"cue_seq div 3 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ordered = spark.readStream.schema(cues.withColumn("last", last).schema).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
    q = jobs.live_paragraphs(ordered).writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")).where("text is not null").drop("late_cues")) == rows(C.build_paragraphs(cues))


def test_live_paragraphs_count_late_cues_and_flush_on_a_timer(spark, tmp_path):
    import time

    schema = "file_id string, cue_seq int, start_s double, end_s double, text string, last boolean"
    put = lambda *r: spark.createDataFrame([*r], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put(("a", 0, 0.0, 1.0, "one two", False), ("a", 1, 1.0, 2.0, "three", False))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = jobs.live_paragraphs(stream, idle="4 seconds").writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="500 milliseconds").start()

    def wait(wanted):
        for _ in range(80):
            time.sleep(0.5)
            got = {tuple(r) for r in spark.read.schema(jobs.LIVE).parquet(str(tmp_path / "out")).select("file_id", "text", "late_cues").collect()} if (tmp_path / "out").exists() else set()
            if wanted <= got:
                return got
        return got

    try:
        assert ("a", "one two three", 0) in wait({("a", "one two three", 0)})
        put(("b", 0, 0.0, 1.0, "x y", False))
        time.sleep(2)
        put(("b", 0, 0.0, 1.0, "late", False), ("b", 1, 1.0, 2.0, "z.", True))
        assert {("b", "x y z.", 0), ("b", None, 1)} <= wait({("b", "x y z.", 0), ("b", None, 1)})
    finally:
        q.stop()


def test_raw_responses(spark, tmp_path, rows):
    for name, text in {"page-0001.json": '\ufeff{"choices": []}\n', "page-0002.json": "{broken", "page-0003.txt": "[1]", "page-0004": " \n"}.items():
        (tmp_path / name).write_text(text)
    got = rows(readers.read_responses(spark, str(tmp_path)).drop("path"))
    assert got == [("page-0001", '{"choices": []}', None), ("page-0002", "{broken", "invalid JSON"), ("page-0003", "[1]", "not a JSON object"), ("page-0004", "", "empty response")]


def test_rows_are_numbered_in_ranges(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS v", "id % 3 AS g")
    for n in (1, 7):
        out = graph.numbered(df, "at", "v", partitions=n).collect()
        assert all(r["at"] == r.v + 1 for r in out) and len(out) == 1000
    assert graph.numbered(df.where("v < 0"), "at", "v").count() == 0


def test_summary_reads_elements_once(spark):
    e = S.statement_elements(spark.createDataFrame([(1, '<R><FlexStatement currency="USD" fromDate="2024-02-01"/><ChangeInNAV total="5" currency="EUR"/><ChangeInNAV total="5"/><CashReportCurrency endingCash="-1"/></R>'), (2, "<R/>"), (3, "no")], "statement_id long, xml string"))
    s = S.summarize_statements(e, include_positions=True)
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange") <= 3
    got = {r.statement_id: r for r in s.collect()}
    assert set(got) == {1, 2} and got[1].base_currency == "USD" and got[1].report_dates == ["2024-02-01"] and [n.value for n in got[1].nav_candidates] == ["5"] and got[1].cash[0].currency == "unknown" and got[2].cash is None


def test_names_are_found_by_parts(spark, rows):
    names = ["Alpha Beta", "alphabet", "Gamma", "a", "Beta"]
    things = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id long, name string")
    refs = spark.createDataFrame([(r,) for r in ("alpha", "PHA B", "zz", "a", "am", "", "alphabets", "id:9", "beta")], "ref string")
    got = {}
    for r in T.resolve_refs(refs, things).collect():
        got.setdefault(r.ref, set()).add((r.match, r.name))
    assert got == {"alpha": {("part", "Alpha Beta"), ("part", "alphabet")}, "PHA B": {("part", "Alpha Beta")}, "a": {("name", "a")}, "am": {("part", "Gamma")}, "beta": {("name", "Beta")}}


def test_json_results(spark, tmp_path):
    (tmp_path / "page-0001.json").write_text('{"bundle_id": 1, "page_number": 1, "status": "ok", "dpi": 300}')
    (tmp_path / "page-0002.json").write_text("{broken")
    r = readers.read_page_results(spark, str(tmp_path)).cache()
    assert r.count() == 2 and r.where("_corrupt_record is not null").count() == 1 and r.where("status = 'ok'").first().dpi == "300"
    (tmp_path / "s.xml").write_text("<a/>")
    (tmp_path / "t.xml").write_text("hello")
    assert sorted(str(x.error) for x in readers.read_statements(spark, str(tmp_path / "*.xml")).collect()) == ["None", "not XML"]


def test_queries_may_start_in_several_threads(spark, monkeypatch):
    added = []
    monkeypatch.setattr(session, "_shipped", set())
    monkeypatch.setattr(type(spark.sparkContext), "addPyFile", lambda self, path: (time.sleep(0.05), added.append(path)))
    with ThreadPoolExecutor(8) as threads:
        list(threads.map(lambda _: session.ship(spark), range(8)))
    assert len(added) == 1


def test_elements_are_given_out_in_bounded_batches():
    """A batch of reports is not held as elements: what was read ahead of the first rows is a part of it."""
    import pyarrow as pa

    reports = pa.RecordBatch.from_pydict({"statement_id": list(range(500)), "xml": ["<R>" + '<P a="1"/>' * 99 + "</R>"] * 499 + ["<R"]})
    found = [*S._walk([reports], 2_000)]
    assert max(b.num_rows for b in found) == 2_000 and sum(b.num_rows for b in found) == 499 * 100 + 1
    assert found[-1].column("error")[-1].as_py() == "not XML"


def test_ampersands_that_begin_no_known_entity_are_text(spark, tmp_path, rows):
    """Pages that break off amid an entity agree with the SQL."""
    from compare import same_rows

    from quillspark.plans import captions as plans

    pages = [(1, "http://a/b&copy=1", "<p>x&amp{margin}&am<b>p; &ampp &amp;lt; &eacute;</p>"), (2, "http://a/", "&lt;&&amp;"), (3, "http://a/c", "<<b>>&copy")]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/written")
    (written,) = (tmp_path / "written").glob("*.parquet")
    written.rename(tmp_path / "pages.parquet")
    same_rows(plans.str2_clean_cue_text(spark, str(tmp_path)), plans.SQL["str2_clean_cue_text"], str(tmp_path))


def test_chunk_bounds_and_silences_are_rounded_as_in_sql(spark):
    """The product's half decides, not that of the double's own decimals."""
    import duckdb
    import random

    from quillspark.operators import lectures as L

    draw = random.Random(7)
    bounds = [draw.randrange(10_800_000) / 1000 + draw.randrange(1, 64) / 2**21 for _ in range(2_000)] + [k / 10_000_000 for k in range(5, 200_000, 10)]
    want = [x for (x,) in duckdb.connect().execute("SELECT round(x, 6) FROM (SELECT unnest(?) AS x)", [bounds]).fetchall()]
    assert [L._micro(x) for x in bounds] == want and [round(x, 6) for x in bounds] != want


def test_shingles_of_one_text_make_no_rows(spark, monkeypatch):
    """Nothing is written for buckets in which texts cannot meet."""
    from quillspark.operators import near

    written = []

    def kept(df):
        if {"band", "key", "pos"} <= {*df.columns}:
            written.append(df.count())
        return df.localCheckpoint()

    monkeypatch.setattr(near, "cut", kept)
    texts = [(i, " ".join(f"w{i}_{k}" for k in range(40))) for i in range(20)]
    found = near.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted(map(tuple, found)) == [(i, i) for i in range(20)] and sum(written) == 0


def test_rolling_times_are_the_rolling_cues_and_count_a_text_once(spark, tmp_path, rows):
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (0, 1, 11, 12, 17, 18, 40, 75)] + [None, "", " a b\n c d " * 9, " x\u0085y\t" * 6]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    times = I.rolling_times(spark, str(tmp_path), 3)
    assert rows(times) == rows(I.rolling_cues(spark, str(tmp_path)).drop("text"))
    assert times.rdd.getNumPartitions() == 3
    assert not any("documents" in f for f in times.inputFiles())


def test_state_of_bursts_is_on_disk_and_settings_stay(spark, tmp_path, rows):
    cues = I.rolling_cues(spark, SMALL).drop("text").withColumn("cue_ts", F.timestamp_millis((F.col("start_s") * 1000).cast("long")))
    cues.coalesce(1).write.parquet(str(tmp_path / "in"))
    bursts = jobs.cue_bursts(spark.readStream.schema(cues.schema).parquet(str(tmp_path / "in")).withWatermark("cue_ts", "1 day"))
    before = {k: spark.conf.get(k, None) for k in jobs.ON_DISK}
    with jobs.state_on_disk(spark):
        q = bursts.writeStream.format("memory").queryName("bursts_on_disk").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {k: spark.conf.get(k, None) for k in jobs.ON_DISK} == before
    assert any("rocksdb" in k for k in q.lastProgress["stateOperators"][0]["customMetrics"])
    assert rows(spark.table("bursts_on_disk")) == rows(jobs.cue_bursts(I.rolling_cues(spark, SMALL)))


def test_live_paragraphs_are_fed_by_all_tasks_and_take_frames_of_any_order(spark, tmp_path, rows, monkeypatch):
    from quillspark.plans import records

    monkeypatch.setattr(records, "_drained", lambda spark, stream, path: spark.read.parquet(f"{path}/in").withColumn("late_cues", F.lit(0)))
    fed = records.stm4_live_paragraphs(spark, SMALL)
    assert len(fed.inputFiles()) > 8  # four for each of both parts before
    words = [(f, i, 4.0 * i, 4.0 * i + 1, f"a{i} b{i}.", i == 3) for f in "xy" for i in (2, 0, 3, 1)]
    cues = spark.createDataFrame(words, "file_id string, cue_seq int, start_s double, end_s double, text string, last boolean")
    cues.coalesce(1).write.parquet(str(tmp_path / "in"))
    with jobs.state_on_disk(spark):
        q = jobs.live_paragraphs(spark.readStream.schema(cues.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("live_any_order").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("live_any_order").drop("late_cues")) == rows(C.build_paragraphs(cues))
    assert any("rocksdb" in k for k in q.lastProgress["stateOperators"][0]["customMetrics"])


def test_reports_of_many_lines_are_dealt_to_more_tasks(spark, monkeypatch):
    """What one task sorts or groups depends on the rows that it gets, not on how many there are, and the sums are the same."""
    from compare import same_rows

    from quillspark.plans import records

    monkeypatch.setattr(I, "ROWS_A_TASK", 500)
    n = I.tasks_for(I.table(spark, SMALL, "lineitem"))
    assert n > 8  # tasks of a shuffle here
    assert S.positions_in_base(I.statement_elements(spark, SMALL)).rdd.getNumPartitions() == n
    for name in ("agg9_positions_in_base", "win11_nav_share", "agg8_summaries"):
        same_rows(records.Q[name](spark, SMALL), records.SQL[name], SMALL)


def test_sums_of_positions_keep_missing_categories_apart_from_subtotals(spark, rows):
    values = [(1, None, None, "2"), (1, None, "USD", "3"), (1, "A", "USD", "x"), (1, "A", "EUR", "4"), (2, "A", "EUR", None)]
    elements = spark.createDataFrame([(s, i, "OpenPosition", {k: v for k, v in (("assetCategory", a), ("currency", c), ("positionValue", v)) if v is not None}) for i, (s, a, c, v) in enumerate(values)], "statement_id long, elem_seq int, tag string, attrs map<string,string>")
    found = S.positions_in_base(elements).select("statement_id", "asset_category", "currency", "level", F.col("value").cast("double"))
    want = [(1, None, None, 0, 2.0), (1, None, "USD", 0, 3.0), (1, "A", "USD", 0, None), (1, "A", "EUR", 0, 4.0), (2, "A", "EUR", 0, None), (1, None, None, 1, 5.0), (1, "A", None, 1, 4.0), (2, "A", None, 1, None), (1, None, None, 3, 9.0), (2, None, None, 3, None)]
    assert rows(found) == sorted(want, key=repr)
