"""Outputs that are replaced or added to as a whole, deep trees, marks of pages, overlaps, and near duplicates amid boilerplate."""

import random

import numpy as np
import pytest
from conftest import SMALL
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import lectures as L, near, notes as N, pages as P, statements as S, tasks as T
from quillspark.sources import files, readers, sinks
from quillspark.sources.sinks import read_table, write_table
from quillspark.streaming import jobs, store as store_module
from quillspark.streaming.store import Store


def failing(df):
    """Rows of which the last to be written fails."""
    return df.withColumn("id", F.when(F.col("id") == 9, F.raise_error(F.lit("midway")).cast("long")).otherwise(F.col("id")))


def test_a_failed_overwrite_leaves_the_table(spark, tmp_path):
    path, rows = str(tmp_path / "t"), spark.range(10)
    with pytest.raises(PySparkException):
        write_table(failing(rows), path)
    assert not (tmp_path / "t").exists()
    write_table(rows.where("id < 3"), path)
    with pytest.raises(FileExistsError):
        write_table(rows, path)
    with pytest.raises(PySparkException):
        write_table(failing(rows), path, overwrite=True)
    assert read_table(spark, path).count() == 3 and spark.read.parquet(path).count() == 3
    write_table(read_table(spark, path).selectExpr("id + 5 AS id"), path, overwrite=True)  # from itself
    assert sorted(r.id for r in read_table(spark, path).collect()) == [5, 6, 7]
    assert sorted(x.name for x in tmp_path.iterdir() if not x.name.endswith(".crc")) == ["t"]


def test_a_writer_that_died_between_the_renames(spark, tmp_path):
    path = str(tmp_path / "t")
    write_table(spark.range(4), path)
    files.move(spark, path, str(tmp_path / ".t.previous"))
    assert read_table(spark, path).count() == 4
    files.move(spark, path, str(tmp_path / ".t.previous"))
    with pytest.raises(FileExistsError):
        write_table(spark.range(1), path)
    files.move(spark, path, str(tmp_path / ".t.previous"))
    write_table(spark.range(1), path, overwrite=True)
    assert read_table(spark, path).count() == 1


def test_a_swap_that_fails_is_taken_back(spark, tmp_path, monkeypatch):
    path, plain = str(tmp_path / "t"), files.move
    write_table(spark.range(4), path)

    def move(session, source, target):
        if "staged" in source:
            raise OSError("store is down")
        plain(session, source, target)

    monkeypatch.setattr(files, "move", move)
    with pytest.raises(OSError):
        write_table(spark.range(1), path, overwrite=True)
    monkeypatch.undo()
    assert read_table(spark, path).count() == 4
    with pytest.raises(FileExistsError):
        files.move(spark, path, str(tmp_path))


@pytest.mark.parametrize("depth", [1, 30, 5000])
def test_chains_of_projects_are_complete(spark, depth):
    chain = spark.range(depth).selectExpr("id AS project_id", "id - 1 AS parent_id", "concat('p', id) AS name").withColumn("parent_id", F.when(F.col("parent_id") >= 0, F.col("parent_id")))
    other = spark.createDataFrame([(90_000, None, "q"), (90_001, 90_000, "r"), (None, 0, "n")], "project_id long, parent_id long, name string")
    tree = chain.unionByName(other)
    assert T.project_subtree(tree, "P0").agg(F.count("*"), F.max("project_id")).first()[:] == (depth, depth - 1)
    assert T.project_subtree(tree, f"p{depth // 2}").count() == depth - depth // 2
    assert T.project_subtree(tree, "q").count() == 2 and T.project_subtree(tree, "none").count() == 0


def test_cycles_and_bushes_of_projects(spark):
    rng = random.Random(4)
    parent = {i: rng.randrange(i) if i and rng.random() < 0.9 else None for i in range(400)}
    parent |= {1000 + i: 1000 + (i + 1) % 7 for i in range(7)} | {2000: 1003, 2001: 2001}
    tree = spark.createDataFrame([(i, p, f"n{i}") for i, p in parent.items()], "project_id int, parent_id int, name string")

    def below(root):
        found, new = {root}, {root}
        while new:
            new = {i for i, p in parent.items() if p in new} - found
            found |= new
        return found

    for root in (0, 5, 1002, 2000, 2001):
        assert {r.project_id for r in T.project_subtree(tree, f"N{root}").collect()} == below(root)


def test_marks_of_many_pages_and_inside_texts(spark):
    texts = {1: "a <!-- PAGE 0002 -->\n\nb", 2: "<!-- \\PAGE 10001 --> c", 9_999: "x", 10_000: "y\n\nz", 123_456: "w"}
    results = spark.createDataFrame([(1, i, "ok", t) for i, t in texts.items()], "bundle_id long, page_number int, status string, ocr_markdown string")
    document = P.canonical_documents(spark.createDataFrame([(1, len(texts))], "bundle_id long, page_count int"), results)
    assert "<!-- PAGE 10000 -->" in document.first().document
    assert {r.page_number: r.text for r in P.split_pages(document).collect()} == texts
    many = spark.range(1, 10_002).selectExpr("1L AS bundle_id", "cast(id AS int) AS page_number", "'ok' AS status", "concat('t', id) AS ocr_markdown", "'s' AS sha256", "'s' AS source_pdf_sha256", "'stop' AS finish_reason", "array(1) AS images")
    bundle = spark.createDataFrame([(1, 10_001, "s")], "bundle_id long, page_count int, sha256 string")
    checked = P.validate_bundles(bundle, many.drop("sha256"), P.canonical_documents(bundle, many)).first()
    assert checked.markers_in_order and checked.pages_ok


def test_overlap_by_plain_search(spark):
    rng, rows = random.Random(1), []
    for i in range(400):
        letters = "abc"[: rng.choice([1, 2, 3])]
        rows.append((i, [rng.choice(letters) for _ in range(rng.randrange(20))], [rng.choice(letters) for _ in range(rng.randrange(20))]))
    rows += [(900, ["a"] * 130, ["a"] * 125), (901, ["a"] * 50 + ["b"], ["a"] * 30 + ["b"]), (902, None, ["a"]), (903, [None, "a"], [None, "a"]), (904, ["x"] * 130, ["x"] * 119 + ["y"]), (905, ["a", "b"] * 60, ["a", "b"] * 60)]
    df = spark.createDataFrame(rows, "i int, a array<string>, b array<string>")
    plain = lambda a, b, limit: max((n for n in range(1, min(len(a or []), len(b), limit) + 1) if a[-n:] == b[:n]), default=0)
    for limit in (7, 120):
        assert dict(df.select("i", X.overlap("a", "b", limit)).collect()) == {i: plain(a, b, limit) for i, a, b in rows}


def test_drafts_are_paired_by_attempt(spark):
    drafts = spark.createDataFrame([(1, 0, "m", "second", 2), (1, 0, "m", "first", 1), (1, 0, "n", "x", 1), (1, 1, "n", "y", 1)], "recording_id long, index int, model string, text string, attempt int")
    for df in (drafts, drafts.orderBy("attempt")):
        got = {r["index"]: (r.m, r.n, r.missing) for r in L.pair_drafts(df, ["m", "n"]).collect()}
        assert got == {0: ("first", "x", []), 1: (None, "y", ["m"])}
    assert L.pair_drafts(drafts.drop("attempt"), ["m"]).where("index = 0").first().m == "first"


KEYED = "k long, v string"


def test_filters_hold_all_keys():
    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 20_000)
    raw = store_module.bloom(keys[:10_000])
    assert store_module.passes(keys[:10_000], raw).all() and store_module.passes(keys[10_000:], raw).mean() < 0.002


def test_a_store_of_a_million_opens_few_files(spark, tmp_path):
    kept = Store(spark, str(tmp_path / "s"), spark.createDataFrame([], KEYED).schema, ["k"], rows_per_file=20_000)
    for i in range(4):
        kept.add(spark.range(i * 250_000, (i + 1) * 250_000).selectExpr("id AS k", "'x' AS v"), partitions=16)
    assert kept.read().count() == 1_000_000 and kept.manifest().count() >= 50
    one_batch, new = spark.range(100).selectExpr("id AS k"), spark.range(10**7, 10**7 + 100).selectExpr("id AS k")
    total = kept.manifest().count()
    assert 0 < len(kept.files_for(one_batch)) <= total // 4 + 2 and len(kept.files_for(new)) <= 3 and len(kept.files_for(spark.range(5, 6).selectExpr("id AS k"))) <= 2
    both = one_batch.unionByName(new).withColumn("v", F.lit("y"))
    assert sorted(r.k for r in kept.without_known(both).collect()) == list(range(10**7, 10**7 + 100))


def test_a_batch_that_fails_leaves_nothing(spark, tmp_path):
    rows = spark.range(10).selectExpr("id", "nullif(id, 3) AS k").coalesce(1)
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for state, fn in (("a", failing), ("b", lambda df: df)):
        q = jobs.resumable(stream, str(tmp_path / "s"), str(tmp_path / state), ["k"], fn)
        if state == "a":
            with pytest.raises(Exception, match="midway"):
                q.awaitTermination()
            assert jobs.result_store(stream, str(tmp_path / "s"), ["k"], fn).read().count() == 0
        else:
            q.awaitTermination()
    rows.selectExpr("id + 5 AS id", "id + 5 AS k").write.mode("append").parquet(str(tmp_path / "in"))
    for state in ("b", "c"):  # what is new, and all once more
        jobs.resumable(stream, str(tmp_path / "s"), str(tmp_path / state), ["k"], lambda df: df).awaitTermination()
    got = jobs.result_store(stream, str(tmp_path / "s"), ["k"], lambda df: df).read()
    assert sorted(str(r.k) for r in got.collect()) == sorted(map(str, [None, 0, 1, 2, *range(4, 15)]))


def boilerplate(n, seed):
    """Texts that are mostly a form: with fields of few values, with a paragraph of their own, with two words changed, and short ones."""
    rng, form = random.Random(seed), [f"b{i}" for i in range(60)]
    out = []
    for i in range(n):
        words = list(form)
        if i % 4 == 0:
            words += [f"x{rng.randrange(6)}" for _ in range(14)]
        elif i % 4 == 1:
            words[40:40] = [f"y{i}_{k}" for k in range(10)]
        elif i % 4 == 2:
            for _ in range(rng.randrange(3)):
                words[rng.randrange(60)] = f"z{rng.randrange(9)}"
        else:
            words = [f"u{rng.randrange(4)}" for _ in range(rng.randrange(1, 12))]
        out.append(" ".join(words))
    return out


def brute_classes(texts):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))})
    root, links = list(range(len(texts))), 0

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in ((i, j) for i in range(len(texts)) for j in range(i)):
        if (texts[i] is None) == (texts[j] is None) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b], links = a, links + 1
    return {i: find(i) for i in range(len(texts))}, links


@pytest.mark.parametrize("few,cells", [(32, 1 << 16), (0, 1 << 8)])
def test_near_duplicates_amid_boilerplate(spark, monkeypatch, few, cells):
    monkeypatch.setattr(near, "FEW", few)
    texts = boilerplate(160, 7) + ["", "a b", "A  b", None, None]
    want, links = brute_classes(texts)
    assert links > 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert dict(near.near_duplicates(df, common=cells).collect()) == want


def test_candidates_grow_with_links_not_with_buckets(spark):
    """Three sizes of a corpus in which all texts share most of a form: pairs that are verified, against texts."""
    verified = []
    for n in (200, 400, 800):
        form = " ".join(f"b{i}" for i in range(60))
        texts = [f"{form} " + " ".join(f"own{i // 2}_{k}" for k in range(30)) + (" more" if i % 2 else "") for i in range(n)]
        seen = []
        got = near.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), seen=seen).collect()
        assert {r.doc_id: r.class_id for r in got} == {i: i - i % 2 for i in range(n)}
        verified.append(sum(seen))
    assert verified[0] <= 2 * 200 and verified[2] <= 5 * verified[0]


def test_near_duplicates_keep_neither_texts_nor_shingles(spark, monkeypatch):
    """What is written of texts that are no copies is less than they are (their shingles as hashes were more than twice as much), and a hub's close texts need no pairs of their own."""
    import random

    random.seed(3)
    kept = []
    for name in ("cut", "written"):
        monkeypatch.setattr(near, name, lambda df, own=getattr(near, name, near.cut): kept.append(own(df)) or kept[-1])
    word = lambda: "".join(random.choices("abcdefghij", k=5))
    texts = [" ".join(word() for _ in range(400)) for _ in range(60)]
    hub = texts[0].split()
    texts += [" ".join("new" if k == 7 * i % 400 else w for k, w in enumerate(hub)) for i in range(40)]
    seen = []
    got = dict(near.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), seen=seen).collect())
    assert got == {i: 0 if i > 59 else i for i in range(100)}
    longs = sum(len(r[c]) for df in kept for c, kind in df.dtypes if kind == "array<bigint>" for r in df.select(c).collect())
    assert longs * 8 < sum(map(len, texts)) / 2 and sum(seen) <= 100
    assert not any(kind == "string" and c == "text" for df in kept for c, kind in df.dtypes)


def test_shingles_are_told_apart(spark):
    import pyarrow as pa
    import random

    random.seed(1)
    words = ["a", "bb", "é", "x" * 40, "y" * 40, "x" * 32, "ab", "ba"]
    texts = [" ".join(random.choices(words, k=random.randrange(30))) for _ in range(300)] + ["", "", "a"]
    one = {}
    for array in (pa.array(texts), pa.array(["zz", *texts])[1:], pa.array(["", ""])):
        for text, found in zip(array.to_pylist(), near.shingle_sets(array, 5)):
            w = text.split(" ")
            want = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}
            assert len(found) == len(want)
            if len(want) == 1:
                assert one.setdefault(want.pop(), found[0]) == found[0]
    assert len(set(one.values())) == len(one) > 20


def test_sketches_of_deliveries(spark):
    """Terms in up to 20,000 documents: the merged estimates within five deviations, and the most frequent terms as they are."""
    docs = spark.range(20_000).selectExpr("id AS doc_id", "concat('all all t', id % 7, ' u', id % 1000, if(id % 3 = 0, ' third', '')) AS text")
    parts = [docs.where(f"doc_id % 4 = {i}") for i in range(4)]
    merged = N.merge_sketches(*(N.term_sketches(p) for p in (*parts, parts[0])))  # one delivery comes twice
    exact = {r.term: r.documents for r in N.term_counts(docs).collect()}
    got = {r.term: r.documents for r in N.term_estimates(merged).collect()}
    assert got.keys() == exact.keys() and all(abs(got[t] - n) <= max(1, 5 * 1.04 / 64 * n) for t, n in exact.items())
    top = N.frequent_terms(N.all_of([N.frequent_sketch(p) for p in parts]), k=2).collect()
    assert [(r.term, r.n) for r in top] == [("all", 40_000), ("third", 6667)]


def test_sections_of_large_reports(spark, tmp_path):
    """One report cut into many tasks' work, and small ones; both forms give the same positions."""
    line = lambda i: f'<OpenPosition symbol="S{i}" description="{"a &amp; b > c" * (i % 2)}"\n currency=\'USD\' position="{i}" accountId="U1"/>'
    for name, n in (("a.xml", 3000), ("b.xml", 0), ("c.xml", 2)):
        (tmp_path / name).write_text("<R><FlexStatement><OpenPositions>" + "\n".join(map(line, range(n))) + "</OpenPositions><ChangeInNAV total='1'/></FlexStatement></R>")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        rows = readers.read_section(spark, str(tmp_path), "OpenPosition", S.POSITION)
        assert rows.rdd.getNumPartitions() > 4
        got = sorted(map(str, rows.drop("path").collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    whole = S.positions(S.statement_elements(readers.read_statements(spark, str(tmp_path))))
    assert got == sorted(map(str, whole.drop("statement_id", "elem_seq").collect())) and len(got) == 3002


def test_files_and_packs_are_read_alike(spark, tmp_path, rows):
    """What a reader makes of files it makes of the same files in a pack, and of some loose and some packed."""
    texts = {"a.vtt": "\ufeffWEBVTT\n\n00:00.000 --> 00:01.000\nHé".encode() + b"\xff\n", "b.doc": b"x", "c.xml": b'<R><P a="1"/><P a="x &gt; y"></P><PQ a="3"/></R>', "d.json": b' {"a": 1}\n', "e": b""}
    for folder, names in (("all", texts), ("some", list(texts)[::2]), ("rest", list(texts)[1::2])):
        (tmp_path / folder).mkdir()
        for name in names:
            (tmp_path / folder / name).write_bytes(texts[name])
    whole, some, rest, packs = (str(tmp_path / x) for x in ("all", "some", "rest", "packs"))
    sinks.pack_files(readers.read_files(spark, rest), packs)
    reads = {"captions": readers.read_captions, "statements": readers.read_statements, "responses": readers.read_responses, "section": lambda s, p, **kw: readers.read_section(s, p, "P", ["a"], **kw)}
    for name, read in reads.items():
        plain, mixed = read(spark, whole), read(spark, some, packed=packs)
        own = [c for c in plain.columns if c not in ("path", "modified", "statement_id")]
        at = F.regexp_extract("path", "([^/]+)$", 1)
        assert rows(plain.select(at, *own)) == rows(mixed.select(at, *own)) != [], name


def test_rows_become_few_files(spark, monkeypatch, tmp_path):
    """The queries that read files make as many of 200 rows as of a hundred; SRC and STM-1 made one for each row."""
    import os
    import pathlib

    from quillspark.plans import records

    monkeypatch.setattr(records, "_folder", lambda _, name: f"file://{tmp_path}/{name}")
    records.Q["src3_read_responses"](spark, SMALL).count()
    records._captions(spark, SMALL)
    records._reports(spark, SMALL)
    for name in ("responses", "captions", "reports"):
        n = [f for _, _, files in os.walk(pathlib.Path(tmp_path) / name) for f in files if not f.startswith(("_", "."))]
        assert 90 <= sum(f.endswith(".txt") for f in n) <= 100 and len(n) <= 100 + 3 * 8


def test_a_stream_takes_a_path_once(spark, tmp_path):
    """Of files and packs alike: a pack with a file that was taken loose, or from an older pack, adds its new ones only."""
    cue = "00:00.000 --> 00:01.000\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.vtt").write_text("WEBVTT\n\n" + cue + "a\n")
    loose, packs, out, state = (str(tmp_path / x) for x in ("in", "packs", "out", "state"))

    def run():
        jobs.stream_captions(spark, loose, out, state, packed=packs).awaitTermination()
        return sorted(r.text for r in spark.read.parquet(out).collect())

    pack = lambda *names: sinks.pack_files(spark.createDataFrame([(f"{n}.vtt", f"WEBVTT\n\n{cue}{n}\n") for n in names], "path string, text string"), packs)
    pack("b")
    assert run() == ["a", "b"] and run() == ["a", "b"]
    pack("b", "c")
    sinks.pack_files(readers.read_files(spark, loose), packs)
    assert run() == ["a", "b", "c"]


def test_prompts_carry_the_fields_they_list(spark):
    """Notes and boxes of images were shuffled twice for prompts that have neither."""
    from quillspark.plans import pages

    plan = pages.Q["prj20_page_prompts"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "asset_path" in plan and P.NOTES["small_form_control"] not in plan
    images = spark.createDataFrame([(1, 1, 2, "b"), (1, 1, 1, "a")], "bundle_id long, page_number int, page_image_index int, asset_path string")
    assert [[tuple(i) for i in r.images] for r in P.images_by_page(images, ["page_image_index", "asset_path"]).collect()] == [[(1, "a"), (2, "b")]]
