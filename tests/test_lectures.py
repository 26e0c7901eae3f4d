from pyspark.sql import functions as F

from quillspark.operators import lectures as L

RUN = "recording_id long, start_s double, end_s double, chunk_seconds double, boundary_window double"


def plan(spark, run, spans):
    r = spark.createDataFrame([(1, *map(float, run))], RUN)
    s = spark.createDataFrame([(1, float(a), float(b)) for a, b in spans], "recording_id long, start_s double, end_s double")
    return [(c.start_s, c.end_s, c.forced_boundary) for c in L.plan_chunks(r, s).orderBy("index").collect()], r, s


def test_plan(spark):
    # the latest silence that reaches into the window is cut in its middle; without one the cut is hard, but for the end
    assert plan(spark, (1000, 1190, 90, 30), [(1062, 1066), (1078, 1084), (1120, 1124)])[0] == [(1000, 1081, False), (1081, 1171, True), (1171, 1190, False)]
    # a silence that begins before the window counts from the window's start on
    assert plan(spark, (0, 100, 60, 10), [(20, 54)])[0] == [(0, 52, False), (52, 100, False)]
    chunks, r, s = plan(spark, (40, 7240, 200, 25), [(x, x + 3) for x in range(50, 7240, 61)])
    assert chunks[0][0] == 40 and chunks[-1][1] == 7240
    assert all(a[1] == b[0] for a, b in zip(chunks, chunks[1:])) and all(0 < b - a <= 200.000001 for a, b, _ in chunks)
    assert L.coverage_gaps(L.plan_chunks(r, s), r).count() == 0
    assert plan(spark, (5, 47, 20, 3), [])[0] == [(5, 25, True), (25, 45, True), (45, 47, False)]


def test_stages_have_as_many_tasks_as_asked_for(spark):
    """Adaptive execution does not join the partitions that Python works on."""
    from conftest import SMALL
    from quillspark.operators import captions as C
    from quillspark.plans import fixtures as I

    assert L.plan_chunks(I.recordings(spark, SMALL), I.spans(spark, SMALL), partitions=8).rdd.getNumPartitions() == 8
    assert C.build_paragraphs(I.rolling_cues(spark, SMALL), partitions=8).rdd.getNumPartitions() == 8


def test_silence_log(spark, rows):
    logs = spark.createDataFrame([(1, "silence_end: 1\nsilence_start: 2\nsilence_start: 3\nx silence_end: 4.5 | silence_duration: 1\nsilence_start: 9")], "recording_id long, log string")
    runs = spark.createDataFrame([(1, 100.0, 110.0)], "recording_id long, start_s double, end_s double")
    assert rows(L.silence_spans(logs, runs)) == [(1, 0, 103.0, 104.5), (1, 1, 109.0, 110.0)]


def test_responses(spark):
    d = spark.createDataFrame([("{}",), ('{"text": null}',), ('{"text": ""}',), ("x",), (None,)], "response string")
    assert [r.error is None for r in L.check_stt(d).collect()] == [False, False, True, False, False]

    def attempt(reason, content):
        import json

        return (1, 0, 1, json.dumps({"choices": [{"finish_reason": reason, "message": {"content": content}}]}), 30.0)

    cases = [("stop", '{"text": "a", "uncertainties": [{"offset_seconds": 3, "reason": "r"}]}', None), ("length", "{}", "incomplete"), ("stop", None, "no text"), ("stop", "{", "invalid JSON"), ("stop", '{"text": "a"}', "invalid schema"), ("stop", '{"text": "a", "uncertainties": [{"offset_seconds": 99, "reason": "r"}]}', "invalid uncertainty timestamp"), ("stop", '{"text": "a", "uncertainties": [{"offset_seconds": true, "reason": "r"}]}', "invalid uncertainty timestamp"), ("stop", '{"text": "a", "uncertainties": [{"offset_seconds": 1}]}', "invalid uncertainty entry")]
    df = spark.createDataFrame([attempt(a, b) for a, b, _ in cases], "recording_id long, index int, attempt int, response string, audio_duration double").coalesce(1)
    assert [r.error for r in L.check_reconciliation(df).collect()] == [c[2] for c in cases]


def test_boundaries_are_flagged_once_and_kept(spark):
    schema = "recording_id long, index int, text string, flags array<string>"
    df = spark.createDataFrame([(7, 3, "and then the Σοφός STRASSE", []), (7, 4, "σοφόσ straße, he said", ["other"]), (7, 5, "no repeat", None)], schema)
    once = L.audit_boundaries(df)
    again = {r["index"]: r for r in L.audit_boundaries(once).collect()}
    assert again[4].text == "σοφόσ straße, he said" and len(again[4].flags) == 2 and again[4].flags[0] == "other" and "strasse'" in again[4].flags[1] and again[3].flags == [] and again[5].flags == []


def test_payload_and_preflight(spark, rows):
    import json

    chunks = spark.createDataFrame([(1, 0)], "recording_id long, index int")
    p = json.loads(L.request_payloads(chunks, ["custom/model"], options={"custom/model": '{"prompt":"EBITDA"}'}).first().payload)
    assert "language" not in p and "prompt" not in p and p["provider"]["options"] == {"prompt": "EBITDA"}
    schema = "id string, architecture struct<input_modalities array<string>>, supported_parameters array<string>"
    catalogue = spark.createDataFrame([("a", (["audio"],), []), ("b", (["audio"],), []), ("r", (["audio"],), ["response_format"])], schema)
    wanted = spark.createDataFrame([("a",), ("b",)], "id string")
    assert rows(L.preflight(wanted, catalogue, "r")) == [] and rows(L.preflight(wanted, catalogue, "b")) == [("b", "no structured output")]
    assert rows(L.preflight(spark.createDataFrame([("z",)], "id string"), catalogue)) == [("z", "missing")]


def test_config_changes(spark, rows):
    schema = "recording_id long, language string, mode string"
    a = spark.createDataFrame([(1, None, "standard"), (2, "en", "standard")], schema)
    b = spark.createDataFrame([(1, None, "standard"), (2, None, "dual-pass")], schema)
    assert rows(L.config_changes(a, b)) == [(2, ["language", "mode"])]


def brute(said, meant):
    """Cost of a least edit by the plain table."""
    t = [[i + j if not i * j else 0 for j in range(len(said) + 1)] for i in range(len(meant) + 1)]
    for i in range(1, len(meant) + 1):
        for j in range(1, len(said) + 1):
            t[i][j] = min(t[i - 1][j] + 1, t[i][j - 1] + 1, t[i - 1][j - 1] + (said[j - 1] != meant[i - 1]))
    return t[-1][-1]


def test_word_errors():
    import random

    random.seed(5)
    pairs = [tuple([random.choice("abc") for _ in range(random.randint(0, 9))] for _ in range(2)) for _ in range(300)]
    pairs += [tuple([random.choice("abcdefgh") for _ in range(random.randint(30, 60))] for _ in range(2)) for _ in range(20)]
    for at_once in (1, 100, 50_000):
        for (a, b), (s, d, i) in zip(pairs, L.word_errors(pairs, at_once), strict=True):
            assert s + d + i == brute(a, b) and len(b) - d + i == len(a) and min(s, d, i) >= 0
    meant = "we owe her eleven crowns , never twelve .".split()
    assert L.word_errors([([w for w in meant if w != "never"], meant)]) == [(0, 1, 0)]
    words = [str(random.randrange(500)) for _ in range(20_000)]
    assert L.word_errors([([w for j, w in enumerate(words) if j % 50], words), (words, words)]) == [(0, 400, 0), (0, 0, 0)]


def test_lost_negation_is_counted(spark):
    k = (1, 0)
    drafts = spark.createDataFrame([(*k, "a", "it is 20"), (*k, "b", "it is not")], "recording_id long, index int, model string, text string")
    refs = spark.createDataFrame([(*k, "It is not 20")], "recording_id long, index int, text string")
    r = {x.model: x for x in L.word_error_rate(drafts, refs).collect()}
    assert (r["a"].lost_negations, r["a"].lost_numbers, r["b"].lost_numbers) == (1, 0, 1) and r["a"].wer == 0.25


def test_status(spark, rows):
    chunks = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 0)], "recording_id long, index int")
    finals = spark.createDataFrame([(1, 0, [], []), (2, 0, ["f"], []), (3, 0, [], [])], "recording_id long, index int, flags array<string>, uncertainties array<string>")
    assert rows(L.run_status(chunks, finals)) == [(1, "incomplete"), (2, "complete_needs_review"), (3, "complete")]
    assert rows(L.pending(chunks, finals, ["recording_id", "index"])) == [(1, 1)]
    _ = F


def test_waves_follow_few_paths_where_the_least_edits_are_known():
    """A long text without every tenth word, and one with a strange word at every fifteenth: the places followed are as many as the edits, not as their square."""
    import random

    from quillspark.operators import lectures as L

    draw = random.Random(1)
    meant = [f"v{draw.randrange(3_000)}" for _ in range(8_000)]
    pairs = [([w for i, w in enumerate(meant) if (i + 1) % 10], meant), (["x" if (i + 1) % 15 == 0 else w for i, w in enumerate(meant)], meant)]
    found, widest = [], 0
    real = L.np.full

    def full(shape, *args):
        nonlocal widest
        widest = max(widest, shape[1])
        return real(shape, *args)

    try:
        L.np.full = full
        found = L.word_errors(pairs)
    finally:
        L.np.full = real
    assert found == [(0, 800, 0), (533, 0, 0)] and 0 < widest < 50
