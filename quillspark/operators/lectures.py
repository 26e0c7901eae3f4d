"""Lectures: silence logs to chunk plans, drafts and attempts to audited transcripts, costs and word errors."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.names import free
from ..session import ship

KEYS = ["recording_id", "index"]
FLAG = "Possible repeated boundary phrase"
CONFIG = ("chunk_seconds", "boundary_window", "padding_seconds", "start_s", "end_s", "mode", "language", "model", "second_model")
#: Negations for word_error_rate, in the languages at hand.
NEGATIONS = ("not", "no", "never", "none", "nicht", "kein", "nie", "ne", "pas", "jamais", "nunca")


def silence_spans(logs: DataFrame, recordings: DataFrame) -> DataFrame:
    """Log lines to spans: a later start replaces an open one, an end without one is dropped, an open last one ends with the run; times count from the run's start."""
    found = F.regexp_extract_all("log", F.lit(r"silence_(?:start|end):\s*[\d.]+"), F.lit(0))
    rows = logs.join(recordings.select("recording_id", "start_s", "end_s"), "recording_id").select("recording_id", "start_s", "end_s", F.posexplode(found).alias("at", "line"))
    rows = rows.select("recording_id", "end_s", "at", F.regexp_extract("line", "silence_(start|end)", 1).alias("kind"), (F.col("start_s") + F.regexp_extract("line", r"([\d.]+)$", 1).cast("double")).alias("t"))
    order = Window.partitionBy("recording_id").orderBy("at")
    rows = rows.withColumn("next_kind", F.lead("kind").over(order)).withColumn("next_t", F.lead("t").over(order))
    starts = rows.where("kind = 'start' and (next_kind = 'end' or next_kind is null)")
    spans = starts.select("recording_id", "at", F.col("t").alias("start_s"), F.when(F.col("next_t").isNull(), F.col("end_s")).otherwise(F.least("end_s", "next_t")).alias("stop"))
    return spans.select("recording_id", (F.row_number().over(order) - 1).alias("span_seq"), "start_s", F.col("stop").alias("end_s"))


def _micro(x: float) -> float:
    """To six digits as SQL rounds: the product, halves away from zero (times are none below it). Python's ``round`` takes the double's own decimals, so the two differ where a half is a bit off."""
    scaled = x * 1e6
    whole = math.floor(scaled)
    return (whole + (scaled - whole >= 0.5)) / 1e6


def _plan(start: float, end: float, maximum: float, window: float, a: np.ndarray, b: np.ndarray):
    """Chunks up to ``maximum`` long, each cut in the middle of the latest silence within ``window`` before its limit."""
    begun = start
    while begun < end - 0.001:
        limit = min(end, begun + maximum)
        # Spans are sorted by their ends: those that reach into the window are a run.
        k = slice(np.searchsorted(b, max(limit - window, begun), "right"), None)
        lo, hi = np.maximum(a[k], limit - window), np.minimum(b[k], limit)
        inside = hi > np.maximum(lo, begun)
        middle = lo[inside] + (hi[inside] - lo[inside]) / 2
        forced = limit < end and not len(middle)
        cut = float(middle.max()) if limit < end and len(middle) else limit
        yield _micro(begun), _micro(cut), forced
        begun = cut


def plan_chunks(recordings: DataFrame, spans: DataFrame, partitions: int | None = None) -> DataFrame:
    """recording_id, index, start_s, end_s and forced_boundary; recordings: start_s, end_s, chunk_seconds and boundary_window.

    Runs and silences are one table, dealt by recording to ``partitions`` tasks (by default as many as shuffles have) and
    sorted there: a recording's runs come first, then its silences by their ends. (Dealt by a hash of the key, as Spark would
    leave out a dealing by the key itself where it has one already, whose partitions adaptive execution may join.)
    """
    ship(recordings.sparkSession)
    columns = ["recording_id", "index", "start_s", "end_s", "forced_boundary"]
    kinds = (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.bool_())

    def plan(batches):
        now, runs, a, b = None, [], [], []

        def planned():
            rows = [(now, i, *chunk) for run in runs for i, chunk in enumerate(_plan(*run, np.array(a, float), np.array(b, float)))]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 5, kinds)], names=columns)

        for batch in batches:
            for key, span, start, end, maximum, window in zip(*(c.to_pylist() for c in batch.columns)):
                if key != now:
                    yield planned()
                    now, runs, a, b = key, [], [], []
                if not span:
                    runs.append((start, end, maximum, window))
                elif runs:
                    a.append(start)
                    b.append(end)
        yield planned()

    none = F.lit(None).cast("double")
    own = recordings.select("recording_id", F.lit(0).alias("span"), "start_s", "end_s", "chunk_seconds", "boundary_window")
    rows = own.unionByName(spans.select("recording_id", F.lit(1).alias("span"), "start_s", "end_s", none.alias("chunk_seconds"), none.alias("boundary_window")))
    n = partitions or int(recordings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.where("recording_id is not null").repartition(n, F.xxhash64("recording_id")).sortWithinPartitions("recording_id", "span", "end_s", "start_s")
    return dealt.mapInArrow(plan, "recording_id long, index int, start_s double, end_s double, forced_boundary boolean")


def coverage_gaps(chunks: DataFrame, recordings: DataFrame) -> DataFrame:
    """Chunks that break the cover of their recording: problem is gap, start, end or length."""
    order = Window.partitionBy("recording_id").orderBy("index")
    runs = recordings.select("recording_id", F.col("start_s").alias("run_start"), F.col("end_s").alias("run_end"), "chunk_seconds")
    rows = chunks.withColumn("next", F.lead("start_s").over(order)).withColumn("r", F.row_number().over(order)).join(runs, "recording_id")
    near = lambda a, b: F.abs(a - b) <= 1e-6
    problem = F.when(F.col("next").isNotNull() & ~near(F.col("next"), F.col("end_s")), "gap").when((F.col("r") == 1) & ~near(F.col("start_s"), F.col("run_start")), "start").when(F.col("next").isNull() & (F.abs(F.col("end_s") - F.col("run_end")) > 0.001), "end").when(F.col("end_s") - F.col("start_s") > F.col("chunk_seconds") + 1e-6, "length")
    return rows.select(*KEYS, problem.alias("problem")).where("problem is not null")


def audio_window(chunks: DataFrame, recordings: DataFrame) -> DataFrame:
    """Adds audio_start and audio_end (padded, within the run) and the core's offsets from audio_start."""
    runs = recordings.select("recording_id", F.col("start_s").alias("run_start"), F.col("end_s").alias("run_end"), "padding_seconds")
    start, end = F.greatest("run_start", F.col("start_s") - F.col("padding_seconds")), F.least("run_end", F.col("end_s") + F.col("padding_seconds"))
    rows = chunks.join(runs, "recording_id").select(*chunks.columns, start.alias("audio_start"), end.alias("audio_end"))
    return rows.withColumn("core_start", F.col("start_s") - F.col("audio_start")).withColumn("core_end", F.col("end_s") - F.col("audio_start"))


def excerpt(df: DataFrame, start_s: float, end_s: float) -> DataFrame:
    """Rows that overlap [start_s, end_s], cut to it."""
    if not 0 <= start_s < end_s:
        raise ValueError("0 <= start < end is required")
    inside = df.where((F.col("start_s") < end_s) & (F.col("end_s") > start_s))
    return inside.withColumn("start_s", F.greatest("start_s", F.lit(float(start_s)))).withColumn("end_s", F.least("end_s", F.lit(float(end_s))))


def config_errors(recordings: DataFrame) -> DataFrame:
    """recording_id and errors: the names of the rules that its settings break."""
    c = F.col
    rules = {
        "chunk_seconds": ~c("chunk_seconds").between(10, 300), "boundary_window": ~((c("boundary_window") >= 0) & (c("boundary_window") < c("chunk_seconds"))), "padding_seconds": ~c("padding_seconds").between(0, 10),
        "sample_rate": ~c("sample_rate").isin(16000, 24000, 32000, 44100, 48000), "max_retries": c("max_retries") < 0, "reconcile_attempts": ~c("reconcile_attempts").between(1, 5), "jobs": ~c("jobs").between(1, 8), "timeout": c("timeout") <= 0,
        "models": (c("mode") == "dual-pass") & (c("model") == c("second_model")), "dual_jobs": (c("mode") == "dual-pass") & (c("jobs") != 1), "language": c("language").isNotNull() & ~c("language").rlike("^[a-z]{2}$"), "range": ~((c("start_s") >= 0) & (c("start_s") < c("end_s")) & (c("end_s") <= c("duration_s"))),
    }
    return recordings.select("recording_id", F.array_compact(F.array(*(F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in rules.items()))).alias("errors"))


def check_stt(drafts: DataFrame) -> DataFrame:
    """Adds text and error: the response must have a string under text, which may be blank."""
    value = F.try_variant_get(F.try_parse_json("response"), "$.text", "variant")
    good = F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))
    return drafts.withColumn("text", F.when(good, F.try_variant_get(F.try_parse_json("response"), "$.text", "string"))).withColumn("error", F.when(~good, F.lit("STT response lacks text")))


def check_reconciliation(attempts: DataFrame) -> DataFrame:
    """Adds final (text and uncertainties) or error, the first check that fails."""
    response = F.try_parse_json("response")
    get = lambda v, path, kind: F.try_variant_get(v, path, kind)
    kind = lambda v, path: F.coalesce(F.schema_of_variant(get(v, path, "variant")), F.lit("VOID"))
    content = F.when(kind(response, "$.choices[0].message.content") == "STRING", get(response, "$.choices[0].message.content", "string"))
    own, parsed = free(attempts, "content", "value")
    rows = attempts.withColumn(own, content).withColumn(parsed, F.try_parse_json(own))
    value = F.col(parsed)
    items = get(value, "$.uncertainties", "array<variant>")
    shape = (kind(value, "$.text") == "STRING") & kind(value, "$.uncertainties").startswith("ARRAY")
    number = F.lit(r"^(BIGINT|DOUBLE|DECIMAL.*|FLOAT|INT|SMALLINT|TINYINT)$")
    entry = F.exists(items, lambda u: ~(kind(u, "$.reason") == "STRING"))
    offset = F.exists(items, lambda u: ~(F.rlike(kind(u, "$.offset_seconds"), number) & F.coalesce(get(u, "$.offset_seconds", "double").between(F.lit(0.0), F.col("audio_duration")), F.lit(False))))
    error = F.when(~F.coalesce(get(response, "$.choices[0].finish_reason", "string") == "stop", F.lit(False)), F.lit("incomplete")).when(F.col(own).isNull(), F.lit("no text")).when(value.isNull(), F.lit("invalid JSON")).when(~shape, F.lit("invalid schema")).when(F.coalesce(entry, F.lit(False)), F.lit("invalid uncertainty entry")).when(F.coalesce(offset, F.lit(False)), F.lit("invalid uncertainty timestamp"))
    final = F.struct(get(value, "$.text", "string").alias("text"), F.transform(items, lambda u: F.struct(get(u, "$.offset_seconds", "double").alias("offset_seconds"), get(u, "$.reason", "string").alias("reason"))).alias("uncertainties"))
    return rows.withColumn("error", error).withColumn("final", F.when(F.col("error").isNull(), final)).drop(own, parsed)


def first_valid_attempt(checked: DataFrame, limit: int = 2) -> DataFrame:
    """Per chunk the first valid one of its first ``limit`` attempts, and how many were used; without one the last error."""
    tried = checked.withColumn("r", F.row_number().over(Window.partitionBy(*KEYS).orderBy("attempt"))).where(F.col("r") <= limit)
    valid = F.when(F.col("error").isNull(), F.col("r"))
    return tried.groupBy(*KEYS).agg(F.min_by("final", valid).alias("final"), F.coalesce(F.min(valid), F.max("r")).alias("attempts"), F.when(F.min(valid).isNull(), F.max_by("error", "r")).alias("error"))


def pair_drafts(drafts: DataFrame, models: list[str]) -> DataFrame:
    """A chunk's drafts side by side, and the models it lacks. Of a model's several drafts the first attempt counts; where there are no attempts, or equal ones, the first text in order."""
    order = F.struct("attempt", "text") if "attempt" in drafts.columns else F.col("text")
    wide = drafts.groupBy(*KEYS).pivot("model", models).agg(F.min_by("text", order))
    return wide.withColumn("missing", F.array_compact(F.array(*(F.when(F.col(f"`{m}`").isNull(), F.lit(m)) for m in models))))


def chunk_flags(chunks: DataFrame, finals: DataFrame, drafts: DataFrame, mode: str = "standard") -> DataFrame:
    """recording_id, index and flags. In dual-pass mode the drafts' texts are compared with the final one."""
    rows = chunks.join(finals.select(*KEYS, "text"), KEYS)
    blank, unclear = lambda c: ~F.coalesce(c.rlike(r"(?U)\S"), F.lit(False)), F.when(F.contains("text", F.lit("[unclear]")), F.lit("Unclear speech remains."))
    if mode == "standard":
        flags = [F.when(F.col("forced_boundary"), F.lit("Hard cut through possible speech: audit this join using a wider repair excerpt.")), F.when(blank(F.col("text")), F.lit("Primary ASR returned no text: confirm silence against audio."))]
    else:
        sides = drafts.groupBy(*KEYS).agg(F.max(F.length("text")).alias("longest"), F.bool_or(blank(F.col("text"))).alias("some_blank"))
        rows = rows.join(sides, KEYS)
        flags = [F.when(F.col("forced_boundary"), F.lit("Hard cut through possible speech: audit this join using padded source audio.")), F.when(F.col("some_blank"), F.lit("One or both ASR drafts empty: confirm silence against audio.")), F.when(F.length("text") < 0.65 * F.col("longest"), F.lit("Reconciled text much shorter than a draft: audit for omissions."))]
    return rows.select(*KEYS, F.array_compact(F.array(*flags, unclear)).alias("flags"))


def audit_boundaries(finals: DataFrame, max_words: int = 12) -> DataFrame:
    """Each chunk's flags anew: older flags of this kind go, and one is added where it begins with the words that the chunk before ends with. Nothing is removed from texts; the window carries the words at the ends only."""
    words = F.regexp_extract_all(X.fold_case(F.coalesce("text", F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))
    kept = F.filter(F.coalesce("flags", F.array().cast("array<string>")), lambda f: ~f.startswith(FLAG))
    rows = finals.select(*KEYS, "text", kept.alias("flags"), F.slice(words, 1, max_words).alias("head"), F.when(F.size(words) > max_words, F.slice(words, -max_words, max_words)).otherwise(words).alias("tail"))
    before = F.lag("tail").over(Window.partitionBy("recording_id").orderBy("index"))
    rows = rows.withColumn("before", before).withColumn("n", F.when(F.col("before").isNotNull(), X.overlap("before", "head", max_words)).otherwise(0))
    phrase = F.concat(F.lit(f"{FLAG}: '"), F.array_join(F.slice("head", F.lit(1), F.col("n")), " "), F.lit("'; check audio before removing anything."))
    return rows.select(*KEYS, "text", F.when(F.col("n") > 0, F.array_append("flags", phrase)).otherwise(F.col("flags")).alias("flags"))


def run_status(chunks: DataFrame, finals: DataFrame) -> DataFrame:
    """incomplete while a final is missing, else complete_needs_review with any flag or uncertainty, else complete. finals: flags and uncertainties."""
    rows = chunks.select(*KEYS).join(finals.select(*KEYS, F.lit(True).alias("there"), (F.coalesce(F.size("flags"), F.lit(0)) + F.coalesce(F.size("uncertainties"), F.lit(0)) > 0).alias("open")), KEYS, "left")
    status = F.when(~F.every(F.coalesce("there", F.lit(False))), "incomplete").when(F.bool_or("open"), "complete_needs_review").otherwise("complete")
    return rows.groupBy("recording_id").agg(status.alias("status"))


def lecture_documents(recordings: DataFrame, chunks: DataFrame, finals: DataFrame) -> DataFrame:
    """recording_id, transcript and review; recordings: title and status; finals: audio_start, text, flags and uncertainties."""
    rows = chunks.select(*KEYS, "start_s", "end_s").join(finals.select(*KEYS, "audio_start", "text", "flags", "uncertainties"), KEYS, "left")
    label = F.concat(F.lit("["), X.stamp("start_s"), F.lit("–"), X.stamp("end_s"), F.lit("]"))
    part = F.concat(F.lit("## "), label, F.lit("\n\n"), F.coalesce("text", F.lit("[Pending transcription]")), F.lit("\n"))
    flagged = F.transform(F.coalesce("flags", F.array().cast("array<string>")), lambda f: F.concat(F.lit("- "), label, F.lit(": "), f))
    unsure = F.transform(F.coalesce("uncertainties", F.array().cast("array<struct<offset_seconds double, reason string>>")), lambda u: F.concat(F.lit("- ["), X.stamp(F.col("audio_start") + u["offset_seconds"]), F.lit("]: "), u["reason"]))
    grouped = rows.select("recording_id", "index", part.alias("part"), F.concat(flagged, unsure).alias("lines")).groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct("index", "part", "lines"))).alias("rows"))
    joined = recordings.select("recording_id", "title", "status").join(grouped, "recording_id", "left")
    rows_ = F.coalesce("rows", F.array().cast(grouped.schema["rows"].dataType))
    transcript = F.concat(F.lit("# "), F.col("title"), F.lit(" transcript\n\nStatus: "), F.col("status"), F.lit("\n\nTimes are source chunk ranges, not word alignment. Review flags are heuristic.\n\n"), F.array_join(F.transform(rows_, lambda r: r["part"]), "\n"))
    review = F.concat(F.array_join(F.concat(F.array(F.concat(F.lit("# "), F.col("title"), F.lit(" review")), F.lit(""), F.concat(F.lit("Status: "), F.col("status")), F.lit("")), F.flatten(F.transform(rows_, lambda r: r["lines"]))), "\n"), F.lit("\n"))
    return joined.select("recording_id", transcript.alias("transcript"), review.alias("review"))


def pending(planned: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return planned.join(done.select(*keys), keys, "left_anti")


def config_changes(stored: DataFrame, requested: DataFrame, key: str = "recording_id") -> DataFrame:
    """Runs whose settings changed, with the names of the fields that did; null equals null. One hash is compared first."""
    fields = sorted(set(stored.columns) & set(requested.columns) - {key})
    a = stored.select(key, F.struct(*fields).alias("a"), X.config_hash(*fields).alias("ha"))
    b = requested.select(key, F.struct(*fields).alias("b"), X.config_hash(*fields).alias("hb"))
    changed = F.array_compact(F.array(*(F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in fields)))
    return a.join(b, key).where("ha <> hb").select(key, changed.alias("changed"))


def preflight(requested: DataFrame, catalogue: DataFrame, reviewer: str | None = None) -> DataFrame:
    """id and problem of models that are missing, and of a reviewer without audio input or structured output. A catalogue is a provider's list of models: small, and joined as Spark's statistics say."""
    missing = requested.select("id").join(catalogue.select("id"), "id", "left_anti").select("id", F.lit("missing").alias("problem"))
    if reviewer is None:
        return missing
    found = requested.sparkSession.createDataFrame([(reviewer,)], "id string").join(catalogue, "id", "left")
    audio = F.coalesce(F.array_contains("architecture.input_modalities", "audio"), F.lit(False))
    formats = F.coalesce(F.arrays_overlap("supported_parameters", F.array(F.lit("response_format"), F.lit("structured_outputs"))), F.lit(False))
    problem = F.when(~audio, "no audio input").when(~formats, "no structured output")
    return missing.unionByName(found.select("id", problem.alias("problem")).where("problem is not null"))


def locate_uncertainties(finals: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each uncertainty's absolute time, its stamp and the chunk it falls in: a range within the recording's key."""
    rows = finals.select("recording_id", F.col("index").alias("from_index"), F.explode("uncertainties").alias("u"), "audio_start")
    rows = rows.select("recording_id", "from_index", (F.col("audio_start") + F.col("u.offset_seconds")).alias("at"), F.col("u.reason").alias("reason"))
    held = chunks.select(F.col("recording_id").alias("r"), "index", "start_s", "end_s")
    inside = (F.col("recording_id") == F.col("r")) & (F.col("at") >= F.col("start_s")) & (F.col("at") < F.col("end_s"))
    return rows.join(held, inside, "left").select("recording_id", "from_index", "index", "at", X.stamp("at").alias("stamp"), "reason")


def request_payloads(chunks: DataFrame, models: list[str], language: str | None = None, options: dict[str, str] | None = None, timed: str = "microsoft/mai-transcribe-2") -> DataFrame:
    """A JSON request for each chunk and model; options (JSON by model) are nested under the provider."""
    rows = chunks.select(*KEYS, F.explode(F.array(*map(F.lit, models))).alias("model"))
    chosen = F.lit(None).cast("string")
    for model, value in (options or {}).items():
        chosen = F.when(F.col("model") == model, F.lit(value)).otherwise(chosen)
    is_timed = F.col("model") == timed
    body = F.to_json(F.struct("model", F.lit(0).alias("temperature"), F.lit(language).alias("language"), F.when(is_timed, F.lit("verbose_json")).alias("response_format"), F.when(is_timed, F.array(F.lit("segment"), F.lit("word"))).alias("timestamp_granularities")))
    nested = F.when(chosen.isNotNull(), F.concat(F.expr("left(body, length(body) - 1)"), F.lit(',"provider":{"options":'), chosen, F.lit("}}"))).otherwise(F.col("body"))
    return rows.withColumn("body", body).select(*KEYS, "model", nested.alias("payload"))


def usage_cost(drafts: DataFrame) -> DataFrame:
    """Per recording the cost reported, the requests, and those of unknown cost (which is not zero)."""
    return drafts.groupBy("recording_id").agg(F.sum("cost").alias("cost"), F.count("*").alias("requests"), F.count_if(F.col("cost").isNull()).alias("unknown"))


def request_plan(chunks: DataFrame, mode: str, rates: dict[str, float]) -> DataFrame:
    """Per recording chunks, requests (3 for each in dual-pass mode) and the drafts' cost at the rates by hour."""
    hours = F.sum(F.col("end_s") - F.col("start_s")) / 3600
    return chunks.groupBy("recording_id").agg(F.count("*").alias("chunks"), (F.count("*") * (3 if mode == "dual-pass" else 1)).alias("requests"), (hours * sum(rates.values())).alias("cost"))


def word_errors(pairs: list[tuple[list[str], list[str]]], at_once: int = 1_000_000) -> list[tuple[int, int, int]]:
    """Substitutions, deletions and insertions of a least edit that makes the second text of each pair into the first.

    Pairs of like length are worked on together, up to ``at_once`` words (or a single pair).
    """
    out, order = [(0, 0, 0)] * len(pairs), sorted(range(len(pairs)), key=lambda i: sum(map(len, pairs[i])))
    held, size = [], 0
    for i in [*order, None]:
        if i is None or held and size + sum(map(len, pairs[i])) > at_once:
            for k, found in zip(held, _waves([pairs[k] for k in held])):
                out[k] = found
            held, size = [], 0
        if i is not None:
            held.append(i)
            size += sum(map(len, pairs[i]))
    return out


def _waves(pairs: list[tuple[list[str], list[str]]], cells: int = 500_000) -> list[tuple[int, int, int]]:
    """The edits of each pair, with as little slack as will do: first only paths are followed that may end with the least edits that its texts need, then more."""
    number: dict[str, int] = {}
    coded = [tuple(np.array([number.setdefault(w, len(number)) for w in words], np.int64) for words in (meant, said)) for said, meant in pairs]
    least = np.array([_needs(meant, said) for meant, said in coded], np.int64)
    out, open_, slack = [(0, 0, 0)] * len(pairs), [*range(len(pairs))], 0
    while open_:
        # Without slack few diagonals are followed; with it, so many pairs at once as have ``cells`` of them (or a single pair).
        part = np.cumsum(2 * (least[open_] + slack) + 1) // cells if slack else np.zeros(len(open_), np.int64)
        left = []
        for own in (np.array(open_)[part == x].tolist() for x in np.unique(part)):
            for k, x in zip(own, _within([coded[k] for k in own], least[own] + slack)):
                if x is None:
                    left.append(k)
                else:
                    out[k] = x
        open_, slack = left, 4 * slack + 4
    return out


def _alone(words: np.ndarray, others: np.ndarray) -> np.ndarray:
    """For each place, how many words from there on the other text has nowhere; each of them takes an edit."""
    return np.append(np.cumsum(~np.isin(words, others)[::-1])[::-1], 0)


def _needs(meant: np.ndarray, said: np.ndarray) -> int:
    return max(abs(len(said) - len(meant)), int(_alone(meant, said)[0]), int(_alone(said, meant)[0]))


def _within(pairs: list[tuple[np.ndarray, np.ndarray]], most: np.ndarray) -> list[tuple[int, int, int] | None]:
    """For 0, 1, 2, ... edits the furthest place in ``meant`` that each diagonal of each pair reaches; on ties by a substitution, then a deletion. None where a pair takes more than its ``most`` edits.

    A place is left where the edits so far and those that the rest needs at least (as many as the diagonal is away from the last
    one, and as words are left that the other text lacks) are more than ``most``. What an edit leads to needs one less at most,
    and so does no place further back on a diagonal, so what is kept is as without that. Of each pair the
    diagonals are held from its first to its last. Texts lie one behind the other, each with an end that equals nothing.
    """
    ends = lambda side, end: np.concatenate([np.append(p[side], end) for p in pairs])
    meant, said = ends(0, -1), ends(1, -2)
    rest_m, rest_n = np.concatenate([_alone(*p) for p in pairs]), np.concatenate([_alone(p[1], p[0]) for p in pairs])
    m, n = (np.array([len(p[side]) for p in pairs]) for side in (0, 1))
    at_m, at_n = np.cumsum(m + 1) - m - 1, np.cumsum(n + 1) - n - 1
    out, live, most = [None] * len(pairs), np.arange(len(pairs)), np.array(most)
    reach, swaps, drops = (np.zeros((len(pairs), 1), np.int64) for _ in range(3))
    nowhere, edits, low = np.int64(-(1 << 40)), 0, np.zeros(len(pairs), np.int64)
    while True:
        rows, columns = np.nonzero(reach >= 0)
        i, diagonal = reach[rows, columns], columns + low[rows]
        a, b = at_m[rows] + i, at_n[rows] + i + diagonal
        going = np.arange(len(i))
        while len(going := going[meant[a[going]] == said[b[going]]]):
            a[going] += 1
            b[going] += 1
        needs = np.maximum(np.abs((n - m)[rows] - diagonal), np.maximum(rest_m[a], rest_n[b]))
        reach[rows, columns] = np.where(edits + needs <= most[rows], a - at_m[rows], nowhere)
        last = n - m - low
        inside = (last >= 0) & (last < reach.shape[1])
        own = np.arange(len(live))
        at = np.where(inside, last, 0)
        ended = inside & (reach[own, at] >= m)
        for k in np.flatnonzero(ended):
            s, d = int(swaps[k, at[k]]), int(drops[k, at[k]])
            out[live[k]] = (s, d, edits - s - d)
        keep = ~ended & (reach >= 0).any(axis=1)
        if not keep.all():
            live, m, n, at_m, at_n, most, low, reach, swaps, drops = (x[keep] for x in (live, m, n, at_m, at_n, most, low, reach, swaps, drops))
        if not len(live):
            return out
        there = reach >= 0
        first, total = there.argmax(axis=1), there.shape[1]
        own = first[:, None] + np.arange(int((total - there[:, ::-1].argmax(axis=1) - first).max()))
        edits, low = edits + 1, low + first - 1

        def wide(x, fill):
            padded = np.full((len(x), own.shape[1] + 4), fill, np.int64)
            padded[:, 2:-2] = np.where(own < total, np.take_along_axis(x, np.minimum(own, total - 1), 1), fill)
            return padded

        far, swaps, drops = wide(reach, nowhere), wide(swaps, 0), wide(drops, 0)
        diagonal = low[:, None] + np.arange(far.shape[1] - 2)
        options = np.stack([far[:, 1:-1] + 1, far[:, 2:] + 1, far[:, :-2]])
        options[(options > m[:, None]) | (options + diagonal > n[:, None])] = nowhere
        which = options.argmax(axis=0)
        reach = options.max(axis=0)
        take = lambda x: np.choose(which, (x[:, 1:-1], x[:, 2:], x[:, :-2]))
        swaps, drops = take(swaps) + (which == 0), take(drops) + (which == 1)


def word_error_rate(drafts: DataFrame, references: DataFrame, negations: tuple[str, ...] = NEGATIONS, partitions: int | None = None) -> DataFrame:
    """Per recording and model: words, substitutions, deletions, insertions, wer, omission_rate, and the numbers and negations that drafts lack."""
    spark = drafts.sparkSession
    ship(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    own, right = (df.repartition(n, *KEYS) for df in (drafts.select(*KEYS, "model", F.lower("text").alias("said")), references.select(*KEYS, F.lower("text").alias("meant"))))
    names = ("words", "substitutions", "deletions", "insertions", "lost_numbers", "lost_negations")

    def count(batches):
        for whole in batches:
            for batch in (whole.slice(i, 250) for i in range(0, whole.num_rows, 250)):
                said, meant = ([(x or "").split() for x in batch.column(c).to_pylist()] for c in ("said", "meant"))
                special = lambda words: (sum(any("0" <= c <= "9" for c in w) for w in words), sum(w in negations for w in words))
                lost = [[max(a - b, 0) for a, b in zip(special(m), special(s))] for s, m in zip(said, meant)]
                rows = [(len(m), *errors, *own) for m, errors, own in zip(meant, word_errors([*zip(said, meant)]), lost)]
                columns = [pa.array(c, pa.int64()) for c in (list(zip(*rows)) or [()] * len(names))]
                yield pa.RecordBatch.from_arrays([batch.column("recording_id"), batch.column("model"), *columns], names=["recording_id", "model", *names])

    rows = own.join(right, KEYS).select("recording_id", "model", "said", "meant").mapInArrow(count, "recording_id long, model string, " + ", ".join(f"{c} long" for c in names))
    sums = rows.groupBy("recording_id", "model").agg(*(F.sum(c).alias(c) for c in names))
    words = F.nullif(F.col("words"), F.lit(0))
    return sums.withColumn("wer", (F.col("substitutions") + F.col("deletions") + F.col("insertions")) / words).withColumn("omission_rate", F.col("deletions") / words)
