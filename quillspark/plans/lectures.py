"""Queries on lectures, and their SQL."""

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import lectures as L
from . import fixtures as I

Q, SQL = {}, {}

RUNS = """runs AS (SELECT r AS recording_id, r % 2 = 0 AS standard, CASE WHEN r % 2 = 0 THEN 300.0 ELSE 120.0 END AS chunk_seconds, CASE WHEN r % 9 = 0 THEN 11.0 ELSE 2.0 END AS padding FROM (SELECT DISTINCT user_id AS r FROM events))"""
SPANS = """spans AS (SELECT user_id AS recording_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS span_seq, round(s, 3) AS start_s, round(s + abs(value) / 100, 3) AS end_s
  FROM (SELECT *, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 / 240 AS s FROM events))"""
#: The greedy plan, one chunk at a time.
PLAN = """plan AS (
  SELECT recording_id, 0 AS i, 0.0::DOUBLE AS a, NULL::DOUBLE AS b, false AS forced, chunk_seconds, 0.0::DOUBLE AS nxt FROM runs
  UNION ALL
  SELECT p.recording_id, p.i + 1, p.nxt, c.cut, c.forced, p.chunk_seconds, c.cut FROM plan p, LATERAL (
    SELECT CASE WHEN lim < 10800 AND m IS NOT NULL THEN m ELSE lim END AS cut, lim < 10800 AND m IS NULL AS forced FROM (
      SELECT least(10800.0, p.nxt + p.chunk_seconds) AS lim, (SELECT max(greatest(s.start_s, least(10800.0, p.nxt + p.chunk_seconds) - 20) + (least(s.end_s, least(10800.0, p.nxt + p.chunk_seconds)) - greatest(s.start_s, least(10800.0, p.nxt + p.chunk_seconds) - 20)) / 2)
        FROM spans s WHERE s.recording_id = p.recording_id AND least(s.end_s, least(10800.0, p.nxt + p.chunk_seconds)) > greatest(s.start_s, least(10800.0, p.nxt + p.chunk_seconds) - 20, p.nxt)) AS m)) c
  WHERE p.nxt < 10800 - 0.001)"""
CHUNKS = "chunks AS (SELECT recording_id, i - 1 AS index, round(a, 6) AS start_s, round(b, 6) AS end_s, forced AS forced_boundary, chunk_seconds FROM plan WHERE i > 0)"
TEXTS = r"""texts AS (SELECT doc_id // 8 AS recording_id, (doc_id % 8)::INT AS index, doc_id, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM documents),
tails AS (SELECT *, lag(CASE WHEN len(w) >= 3 THEN w[-3:] ELSE w END) OVER (PARTITION BY recording_id ORDER BY index) AS before FROM texts),
finals AS (SELECT recording_id, index, doc_id, greatest(index * 120.0 - 2, 0.0) AS audio_start, CASE WHEN doc_id % 17 = 0 THEN '' ELSE array_to_string(CASE WHEN doc_id % 4 = 1 AND before IS NOT NULL THEN list_concat(before, w) ELSE w END, ' ') || CASE WHEN doc_id % 11 = 0 THEN ' [unclear]' ELSE '' END END AS text, doc_id % 10 = 0 AS unsure, (doc_id % 130)::DOUBLE AS off FROM tails),
drafts AS (SELECT recording_id, index, doc_id, m AS model, CASE WHEN doc_id % 17 = 0 AND m = 'b' THEN '' WHEN m = 'a' THEN array_to_string([w[j] for j in range(1, len(w) + 1) if j % 10 <> 0], ' ') ELSE array_to_string([CASE WHEN j % 15 = 0 THEN 'x' ELSE w[j] END for j in range(1, len(w) + 1)], ' ') END AS text, CASE WHEN doc_id % 6 <> 0 THEN (doc_id % 7) / 100.0 END AS cost, w FROM texts, (VALUES ('a'), ('b')) AS v(m) WHERE NOT (doc_id % 23 = 0 AND m = 'b'))"""
FLAGGED = r"""words AS (SELECT recording_id, index, text, list_slice(v, 1, 12) AS head, CASE WHEN len(v) > 12 THEN v[-12:] ELSE v END AS tail FROM (SELECT *, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}_]+') AS v FROM finals)),
pairs AS (SELECT *, lag(tail) OVER (PARTITION BY recording_id ORDER BY index) AS prior FROM words),
sized AS (SELECT *, coalesce(list_max(list_filter(range(1, least(len(prior), len(head)) + 1), lambda n: prior[len(prior) - n + 1:] = head[1:n])), 0) AS n FROM pairs),
flagged AS (SELECT recording_id, index, text, CASE WHEN n > 0 THEN ['Possible repeated boundary phrase: ''' || array_to_string(head[1:n], ' ') || '''; check audio before removing anything.'] ELSE []::VARCHAR[] END AS flags FROM sized)"""


def query(f):
    Q[f.__name__] = f
    return f


def _planned(spark, sf):
    return L.plan_chunks(I.recordings(spark, sf), I.spans(spark, sf))


def _audited(spark, sf):
    flags = L.audit_boundaries(I.finals(spark, sf)).select(*L.KEYS, "flags")
    return I.finals(spark, sf).drop("flags").join(flags, L.KEYS)


def _attempts(spark, sf):
    """Two attempts for each final: the first with the faults of the recipe, the second valid."""
    f = I.finals(spark, sf)
    i, t = F.col("doc_id"), F.col("text")
    offset = F.when(i % 19 == 0, "true").when(i % 13 == 0, "500").otherwise("1.5")
    content = F.when(i % 7 == 0, F.to_json(F.struct(t.alias("text")))).otherwise(F.concat(F.expr("left(to_json(struct(text)), length(to_json(struct(text))) - 1)"), F.lit(',"uncertainties":[{"offset_seconds":'), offset, F.lit(',"reason":"r"}]}')))
    good = F.concat(F.expr("left(to_json(struct(text)), length(to_json(struct(text))) - 1)"), F.lit(',"uncertainties":[]}'))
    wrap = lambda c, reason: F.to_json(F.struct(F.array(F.struct(reason.alias("finish_reason"), F.struct(c.alias("content")).alias("message"))).alias("choices")))
    both = F.array(F.struct(F.lit(1).alias("attempt"), wrap(content, F.when(i % 9 == 0, "length").otherwise("stop")).alias("response")), F.struct(F.lit(2).alias("attempt"), wrap(good, F.lit("stop")).alias("response")))
    return f.select("recording_id", "index", "doc_id", F.explode(both).alias("x")).select("recording_id", "index", "doc_id", "x.attempt", "x.response", F.lit(124.0).alias("audio_duration"))


@query
def win3_silence_spans(spark, sf):
    return L.silence_spans(I.silence_logs(spark, sf), I.recordings(spark, sf))


SQL["win3_silence_spans"] = f"""WITH {SPANS}, n AS (SELECT *, count(*) OVER (PARTITION BY recording_id) AS n FROM spans)
SELECT recording_id, span_seq, start_s, CASE WHEN recording_id % 4 = 0 AND span_seq = n - 1 THEN 10800.0 ELSE least(10800.0, end_s) END AS end_s FROM n"""


@query
def fld2_plan_chunks(spark, sf):
    return _planned(spark, sf)


SQL["fld2_plan_chunks"] = f"WITH RECURSIVE {RUNS}, {SPANS}, {PLAN}, {CHUNKS} SELECT recording_id, index, start_s, end_s, forced_boundary FROM chunks"


@query
def win4_coverage_gaps(spark, sf):
    shifted = _planned(spark, sf).withColumn("end_s", F.when((F.col("recording_id") % 5 == 0) & (F.col("index") == 3), F.col("end_s") + 1).otherwise(F.col("end_s"))).where(~((F.col("recording_id") % 7 == 0) & (F.col("index") == 0)))
    return L.coverage_gaps(shifted, I.recordings(spark, sf))


SQL["win4_coverage_gaps"] = f"""WITH RECURSIVE {RUNS}, {SPANS}, {PLAN}, {CHUNKS},
s AS (SELECT * REPLACE (CASE WHEN recording_id % 5 = 0 AND index = 3 THEN end_s + 1 ELSE end_s END AS end_s) FROM chunks WHERE NOT (recording_id % 7 = 0 AND index = 0)),
n AS (SELECT *, lead(start_s) OVER w AS nxt, row_number() OVER w AS r FROM s WINDOW w AS (PARTITION BY recording_id ORDER BY index)),
p AS (SELECT recording_id, index, CASE WHEN nxt IS NOT NULL AND abs(nxt - end_s) > 1e-6 THEN 'gap' WHEN r = 1 AND abs(start_s) > 1e-6 THEN 'start' WHEN nxt IS NULL AND abs(end_s - 10800) > 0.001 THEN 'end' WHEN end_s - start_s > chunk_seconds + 1e-6 THEN 'length' END AS problem FROM n)
SELECT * FROM p WHERE problem IS NOT NULL"""


@query
def prj16_audio_window(spark, sf):
    return L.audio_window(_planned(spark, sf), I.recordings(spark, sf)).select(*L.KEYS, "audio_start", "audio_end", F.round("core_start", 6).alias("core_start"), F.round("core_end", 6).alias("core_end"))


SQL["prj16_audio_window"] = f"""WITH RECURSIVE {RUNS}, {SPANS}, {PLAN}, {CHUNKS}, w AS (SELECT c.*, greatest(0.0, start_s - padding) AS audio_start, least(10800.0, end_s + padding) AS audio_end FROM chunks c JOIN runs USING (recording_id))
SELECT recording_id, index, audio_start, audio_end, round(start_s - audio_start, 6) AS core_start, round(end_s - audio_start, 6) AS core_end FROM w"""


@query
def fil5_excerpt(spark, sf):
    return L.excerpt(_planned(spark, sf), 1000.0, 2500.0).select(*L.KEYS, "start_s", "end_s")


SQL["fil5_excerpt"] = f"WITH RECURSIVE {RUNS}, {SPANS}, {PLAN}, {CHUNKS} SELECT recording_id, index, greatest(start_s, 1000.0) AS start_s, least(end_s, 2500.0) AS end_s FROM chunks WHERE start_s < 2500 AND end_s > 1000"


@query
def prj17_config_errors(spark, sf):
    return L.config_errors(I.recordings(spark, sf))


SQL["prj17_config_errors"] = f"""WITH {RUNS} SELECT recording_id, list_filter([CASE WHEN recording_id % 9 = 0 THEN 'padding_seconds' END, CASE WHEN recording_id % 7 = 0 THEN 'sample_rate' END, CASE WHEN NOT standard AND recording_id % 13 = 0 THEN 'models' END,
  CASE WHEN NOT standard AND recording_id % 5 = 0 THEN 'dual_jobs' END, CASE WHEN recording_id % 3 = 1 THEN 'language' END], lambda x: x IS NOT NULL) AS errors FROM runs"""


@query
def prj12_check_stt(spark, sf):
    d = I.drafts(spark, sf)
    i = F.col("recording_id") * 8 + F.col("index")
    response = F.when(i % 3 == 0, "{}").when(i % 3 == 1, '{"text": null}').otherwise(F.to_json(F.struct("text")))
    return L.check_stt(d.withColumn("response", response)).select(*L.KEYS, "model", "text", "error")


SQL["prj12_check_stt"] = f"WITH {TEXTS} SELECT recording_id, index, model, CASE WHEN doc_id % 3 = 2 THEN text END AS text, CASE WHEN doc_id % 3 <> 2 THEN 'STT response lacks text' END AS error FROM drafts"


@query
def prj13_check_reconciliation(spark, sf):
    r = L.check_reconciliation(_attempts(spark, sf))
    return r.select(*L.KEYS, "attempt", "error", F.col("final.text").alias("text"), F.size("final.uncertainties").alias("n"))


SQL["prj13_check_reconciliation"] = f"""WITH {TEXTS}, a AS (SELECT recording_id, index, unnest([1, 2])::INT AS attempt, doc_id, text AS t FROM finals),
e AS (SELECT *, CASE WHEN attempt = 2 THEN NULL WHEN doc_id % 9 = 0 THEN 'incomplete' WHEN doc_id % 7 = 0 THEN 'invalid schema' WHEN doc_id % 19 = 0 OR doc_id % 13 = 0 THEN 'invalid uncertainty timestamp' END AS error FROM a)
SELECT recording_id, index, attempt, error, CASE WHEN error IS NULL THEN t END AS text, CASE WHEN error IS NULL THEN 2 - attempt ELSE NULL END::INT AS n FROM e"""


@query
def win14_first_valid_attempt(spark, sf):
    """A third of the chunks have their second attempt broken too, and a tenth have a third one that comes too late."""
    a = L.check_reconciliation(_attempts(spark, sf))
    i = F.col("doc_id")
    a = a.withColumn("error", F.when((F.col("attempt") == 2) & (i % 3 == 0), "incomplete").otherwise(F.col("error")))
    late = a.where((F.col("attempt") == 2) & (i % 10 == 0)).withColumn("attempt", F.lit(7)).withColumn("error", F.lit(None).cast("string"))
    r = L.first_valid_attempt(a.unionByName(late), limit=2)
    return r.select(*L.KEYS, "attempts", "error", F.col("final.text").alias("text"))


SQL["win14_first_valid_attempt"] = f"""WITH {TEXTS}, a AS (SELECT recording_id, index, doc_id, unnest([1, 2])::INT AS attempt, text FROM finals),
e AS (SELECT *, CASE WHEN attempt = 2 THEN CASE WHEN doc_id % 3 = 0 THEN 'incomplete' END WHEN doc_id % 9 = 0 THEN 'incomplete' WHEN doc_id % 7 = 0 THEN 'invalid schema' WHEN doc_id % 19 = 0 OR doc_id % 13 = 0 THEN 'invalid uncertainty timestamp' END AS error FROM a),
n AS (SELECT *, row_number() OVER (PARTITION BY recording_id, index ORDER BY attempt) AS r FROM e),
f AS (SELECT recording_id, index, min(r) FILTER (error IS NULL) AS valid, max(r) AS tried FROM n WHERE r <= 2 GROUP BY ALL)
SELECT n.recording_id, n.index, n.r::INT AS attempts, n.error, CASE WHEN n.error IS NULL THEN n.text END AS text FROM n JOIN f ON n.recording_id = f.recording_id AND n.index = f.index AND n.r = coalesce(valid, tried)"""


@query
def join4_pair_drafts(spark, sf):
    return L.pair_drafts(I.drafts(spark, sf), ["a", "b"])


SQL["join4_pair_drafts"] = f"WITH {TEXTS} SELECT recording_id, index, max(text) FILTER (model = 'a') AS a, max(text) FILTER (model = 'b') AS b, CASE WHEN count(*) = 1 THEN ['b'] ELSE []::VARCHAR[] END AS missing FROM drafts GROUP BY recording_id, index"


@query
def prj15_chunk_flags_standard(spark, sf):
    return L.chunk_flags(I.lecture_chunks(spark, sf), I.finals(spark, sf), I.drafts(spark, sf), "standard")


SQL["prj15_chunk_flags_standard"] = f"""WITH {TEXTS} SELECT recording_id, index, list_filter([CASE WHEN doc_id % 6 = 0 THEN 'Hard cut through possible speech: audit this join using a wider repair excerpt.' END, CASE WHEN trim(text) = '' THEN 'Primary ASR returned no text: confirm silence against audio.' END, CASE WHEN contains(text, '[unclear]') THEN 'Unclear speech remains.' END], lambda x: x IS NOT NULL) AS flags FROM finals"""


@query
def prj15_chunk_flags_dual(spark, sf):
    return L.chunk_flags(I.lecture_chunks(spark, sf), I.finals(spark, sf), I.drafts(spark, sf), "dual-pass")


SQL["prj15_chunk_flags_dual"] = f"""WITH {TEXTS}, s AS (SELECT recording_id, index, max(length(text)) AS longest, bool_or(trim(text) = '') AS blank FROM drafts GROUP BY ALL)
SELECT recording_id, index, list_filter([CASE WHEN doc_id % 6 = 0 THEN 'Hard cut through possible speech: audit this join using padded source audio.' END, CASE WHEN blank THEN 'One or both ASR drafts empty: confirm silence against audio.' END, CASE WHEN length(text) < 0.65 * longest THEN 'Reconciled text much shorter than a draft: audit for omissions.' END, CASE WHEN contains(text, '[unclear]') THEN 'Unclear speech remains.' END], lambda x: x IS NOT NULL) AS flags FROM finals JOIN s USING (recording_id, index)"""


@query
def win1_audit_boundaries(spark, sf):
    return L.audit_boundaries(I.finals(spark, sf))


SQL["win1_audit_boundaries"] = f"WITH {TEXTS}, {FLAGGED} SELECT recording_id, index, text, flags FROM flagged"


@query
def agg5_run_status(spark, sf):
    done = _audited(spark, sf).where("recording_id % 5 <> 0 or index <> 2")
    return L.run_status(I.lecture_chunks(spark, sf), done)


SQL["agg5_run_status"] = f"""WITH {TEXTS}, {FLAGGED} SELECT recording_id, CASE WHEN recording_id % 5 = 0 AND bool_or(index = 2) THEN 'incomplete' WHEN bool_or(len(flags) > 0 OR unsure) THEN 'complete_needs_review' ELSE 'complete' END AS status FROM finals JOIN flagged USING (recording_id, index) GROUP BY recording_id"""


@query
def agg2_lecture_documents(spark, sf):
    done = _audited(spark, sf).where("recording_id % 5 <> 0 or index <> 2")
    chunks = I.lecture_chunks(spark, sf)
    runs = L.run_status(chunks, done).withColumn("title", F.concat(F.lit("Lecture "), F.col("recording_id").cast("string")))
    return L.lecture_documents(runs, chunks, done)


_HMS = "printf('%02d:%02d:%02d', ({0}) // 3600, ({0}) // 60 % 60, ({0}) % 60)"
_LABEL = f"'[' || {_HMS.format('index * 120')} || '–' || {_HMS.format('index * 120 + 120')} || ']'"
SQL["agg2_lecture_documents"] = f"""WITH {TEXTS}, {FLAGGED}, j AS (SELECT f.recording_id, f.index, f.doc_id, f.text, g.flags, unsure, off, audio_start, NOT (f.recording_id % 5 <> 0 OR f.index <> 2) AS missing FROM finals f JOIN flagged g USING (recording_id, index)),
l AS (SELECT *, list_concat(CASE WHEN missing THEN [] ELSE list_transform(flags, lambda x: '- ' || {_LABEL} || ': ' || x) END, CASE WHEN unsure AND NOT missing THEN ['- [' || {_HMS.format('(audio_start + off)::INT')} || ']: name'] ELSE [] END) AS lines FROM j),
s AS (SELECT recording_id, CASE WHEN bool_or(missing) THEN 'incomplete' WHEN bool_or(len(flags) > 0 OR unsure) THEN 'complete_needs_review' ELSE 'complete' END AS status,
  string_agg('## ' || {_LABEL} || chr(10) || chr(10) || CASE WHEN missing THEN '[Pending transcription]' ELSE text END || chr(10), chr(10) ORDER BY index) AS body, flatten(list(lines ORDER BY index)) AS lines FROM l GROUP BY recording_id)
SELECT recording_id, '# Lecture ' || recording_id || ' transcript' || chr(10) || chr(10) || 'Status: ' || status || chr(10) || chr(10) || 'Times are source chunk ranges, not word alignment. Review flags are heuristic.' || chr(10) || chr(10) || body AS transcript,
  array_to_string(list_concat(['# Lecture ' || recording_id || ' review', '', 'Status: ' || status, ''], lines), chr(10)) || chr(10) AS review FROM s"""


@query
def join1_pending_chunks(spark, sf):
    return L.pending(_planned(spark, sf).select(*L.KEYS), I.finals(spark, sf), L.KEYS)


SQL["join1_pending_chunks"] = f"WITH RECURSIVE {RUNS}, {SPANS}, {PLAN}, {CHUNKS} SELECT recording_id, index FROM chunks WHERE (recording_id, index) NOT IN (SELECT (doc_id // 8, doc_id % 8) FROM documents)"


@query
def join3_config_changes(spark, sf):
    r = I.recordings(spark, sf).select("recording_id", "mode", "language", "model", "chunk_seconds")
    r2 = r.withColumn("language", F.when(F.col("recording_id") % 4 == 0, "fr").otherwise(F.col("language"))).withColumn("chunk_seconds", F.when(F.col("recording_id") % 6 == 0, 60.0).otherwise(F.col("chunk_seconds")))
    return L.config_changes(r, r2)


SQL["join3_config_changes"] = f"WITH {RUNS}, c AS (SELECT recording_id, list_filter([CASE WHEN recording_id % 6 = 0 THEN 'chunk_seconds' END, CASE WHEN recording_id % 4 = 0 THEN 'language' END], lambda x: x IS NOT NULL) AS changed FROM runs) SELECT * FROM c WHERE len(changed) > 0"


@query
def join5_preflight(spark, sf):
    """Every model of a document is wanted; what it takes and supports comes from the document. The reviewer is the longest one."""
    d = I.table(spark, sf, "documents")
    i, size = F.col("doc_id"), F.coalesce(F.length("text"), F.lit(0))
    inputs = F.array_compact(F.array(F.lit("text"), F.when(size % 2 == 0, "audio")))
    supported = F.array_compact(F.array(F.lit("temperature"), F.when(size % 3 == 0, "response_format"), F.when(size % 5 == 0, "structured_outputs")))
    catalogue = d.where((size % 7 != 0) | (size > 9)).select(F.concat(F.lit("m"), i.cast("string")).alias("id"), F.struct(inputs.alias("input_modalities")).alias("architecture"), supported.alias("supported_parameters"))
    reviewer = d.agg(F.max(F.struct(size.alias("n"), i.alias("i"))).alias("x")).first().x.i
    return L.preflight(d.select(F.concat(F.lit("m"), i.cast("string")).alias("id")), catalogue.where("substring(id, 2) % 4 <> 0 or id = 'm" + str(reviewer) + "'"), reviewer=f"m{reviewer}")


SQL["join5_preflight"] = """WITH d AS (SELECT doc_id, coalesce(length(text), 0) AS n FROM documents), r AS (SELECT doc_id, n FROM d ORDER BY n DESC, doc_id DESC LIMIT 1),
p AS (SELECT 'm' || doc_id AS id, CASE WHEN n % 2 <> 0 THEN 'no audio input' WHEN n % 3 <> 0 AND n % 5 <> 0 THEN 'no structured output' END AS problem FROM r)
SELECT 'm' || doc_id AS id, 'missing' AS problem FROM d WHERE NOT ((n % 7 <> 0 OR n > 9) AND (doc_id % 4 <> 0 OR doc_id IN (SELECT doc_id FROM r))) UNION ALL SELECT * FROM p WHERE problem IS NOT NULL"""


@query
def join8_locate_uncertainties(spark, sf):
    return L.locate_uncertainties(I.finals(spark, sf), I.lecture_chunks(spark, sf))


SQL["join8_locate_uncertainties"] = f"""WITH {TEXTS}, u AS (SELECT recording_id, index AS from_index, audio_start + off AS "at" FROM finals WHERE unsure)
SELECT u.recording_id, from_index, f.index, "at", {_HMS.format('"at"::INT')} AS stamp, 'name' AS reason FROM u LEFT JOIN finals f ON f.recording_id = u.recording_id AND "at" >= f.index * 120 AND "at" < f.index * 120 + 120"""


@query
def prj22_request_payloads(spark, sf):
    return L.request_payloads(I.lecture_chunks(spark, sf), ["a", "microsoft/mai-transcribe-2"], "en", {"a": '{"a":{"prompt":"X"}}'})


SQL["prj22_request_payloads"] = """SELECT doc_id // 8 AS recording_id, (doc_id % 8)::INT AS index, unnest(['a', 'microsoft/mai-transcribe-2']) AS model, unnest(['{"model":"a","temperature":0,"language":"en","provider":{"options":{"a":{"prompt":"X"}}}}', '{"model":"microsoft/mai-transcribe-2","temperature":0,"language":"en","response_format":"verbose_json","timestamp_granularities":["segment","word"]}']) AS payload FROM documents"""


@query
def agg10_usage_cost(spark, sf):
    return L.usage_cost(I.drafts(spark, sf)).withColumn("cost", F.round("cost", 4))  # a sum's last digits depend on its order


SQL["agg10_usage_cost"] = f"WITH {TEXTS} SELECT recording_id, round(sum(cost), 4) AS cost, count(*) AS requests, count(*) - count(cost) AS unknown FROM drafts GROUP BY recording_id"


@query
def agg11_request_plan(spark, sf):
    return L.request_plan(_planned(spark, sf), "dual-pass", {"a": 0.1, "b": 0.27})


SQL["agg11_request_plan"] = f"WITH RECURSIVE {RUNS}, {SPANS}, {PLAN}, {CHUNKS} SELECT recording_id, count(*) AS chunks, count(*) * 3 AS requests, sum(end_s - start_s) / 3600 * 0.37 AS cost FROM chunks GROUP BY recording_id"


@query
def agg16_word_error_rate(spark, sf):
    references = I.lecture_texts(spark, sf).select("recording_id", "index", F.array_join("w", " ").alias("text"))
    return L.word_error_rate(I.drafts(spark, sf), references)


@query
def dat2_stamp(spark, sf):
    return _planned(spark, sf).select(*L.KEYS, X.stamp(F.col("index") + 0.5).alias("half"), X.stamp(F.round(F.col("start_s") - 1000)).alias("floor"))


SQL["dat2_stamp"] = f"WITH RECURSIVE {RUNS}, {SPANS}, {PLAN}, {CHUNKS} SELECT recording_id, index, {_HMS.format('(index + index % 2)')} AS half, {_HMS.format('greatest(round(start_s - 1000), 0)::INT')} AS floor FROM chunks"


@query
def hsh1_hashes(spark, sf):
    return I.table(spark, sf, "documents").select("doc_id", X.content_hash("text").alias("text_sha256"), X.config_hash("lang", "doc_id", "source").alias("config_sha256"))


SQL["hsh1_hashes"] = """SELECT doc_id, sha256(text) AS text_sha256, sha256('{"doc_id":' || doc_id || ',"lang":' || coalesce('"' || lang || '"', 'null') || ',"source":' || coalesce('"' || source || '"', 'null') || '}') AS config_sha256 FROM documents"""
