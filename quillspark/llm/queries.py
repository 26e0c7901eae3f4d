"""One query for each operator, over whole tables with production parameters, and its SQL where SQL can say it."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, hamming, host_rules, language, licenses, line_dedup, mixing, quality, secrets, simhash, token_file, whitening
from .common import fresh_path, read

RANKS = {"ranks": public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}
FILE = {"file": public_tokenizers.path("byte_bpe_50k.json")}
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "stop", F.sha2("value", 256).alias("secret_sha256"), "score")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode(docs, RANKS).drop("text")
    decoded = bpe.decode(encoded, RANKS)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.col("n_split").cast("long").alias("n_split_chars"),
        F.coalesce(F.try_element_at("starts", F.lit(-1)).cast("long"), F.lit(-1)).alias("last_start"),
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "source", "copy", "n_copies", "shuffle_key", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def op4_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = hamming.sign_codes(read(spark, sf_dir, "embeddings"))
    return hamming.top_k(codes, codes.where("id % 20 = 0"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeats(read(spark, sf_dir, "documents")).drop("tie")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "documents"))


def op8_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-file")
    token_file.write(read(spark, sf_dir, "documents"), FILE, path, end_id=2)
    return token_file.crc32_of_ids(token_file.read(spark, path))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op10_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.apply_rules(read(spark, sf_dir, "documents")).withColumn("host_rate", F.round("host_rate", 9))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.to_json("spans").alias("spans"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read(spark, sf_dir, "documents"), FILE, PIECES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_secrets, op2_byte_bpe, op3_mixing, op4_hamming, op5_quality, op6_line_dedup, op7_language, op8_token_file, op9_simhash, op10_host_rules, op11_whitening, op12_licenses, op13_alignment)}

ORACLE: dict[str, str] = {}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
ORACLE["op10_host_rules"] = rf"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest(range(0, 8)) AS k FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n, count(*) AS n_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
counts AS (SELECT d.doc_id, host, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(lines.n_lines, 0) AS n_lines, coalesce(repeated.n, 0) AS n_repeat_words
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    [('base', base_failed), ('lines', 10 * n_dup_lines > 3 * n_lines), ('symbols', 10 * n_symbols > n_words), ('word_length', word_chars < 2 * n_words OR word_chars > 12 * n_words)] AS verdicts FROM counts),
hosts AS (SELECT host, v[1] AS rule, count(*)::DOUBLE AS n, sum(v[2]::INT)::DOUBLE AS f FROM (SELECT host, unnest(verdicts) AS v FROM judged WHERE host IS NOT NULL) GROUP BY ALL),
moments AS (SELECT rule, sum(f) / sum(n) AS m, sum(n) AS n, count(*) AS h, sum(f * f / n) AS ff FROM hosts GROUP BY rule),
beyond AS (SELECT *, CASE WHEN m * (1 - m) > 1e-12 THEN (ff - n * m * m) / (m * (1 - m)) - h ELSE 0 END AS v FROM moments),
prior AS (SELECT rule, m, least(greatest(CASE WHEN v > 1e-9 THEN (n - h) / v - 1 ELSE 1e4 END, 1.0), 1e4) AS s FROM beyond),
rates AS (SELECT host, rule, n, m, s, (f + m * s) / (n + s) AS rate FROM hosts JOIN prior USING (rule)),
verdict AS (SELECT host, max(rate) FILTER (rule = 'base') AS rate, coalesce(string_agg(rule, ',' ORDER BY rule) FILTER (rate - 3 * sqrt(rate * (1 - rate) / (n + s + 1)) > least(m + 0.2, 0.5)), '') AS failed FROM rates GROUP BY host),
nobody AS (SELECT max(m) FILTER (rule = 'base') AS rate, coalesce(string_agg(rule, ',' ORDER BY rule) FILTER (m > 0.5), '') AS failed FROM prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(verdict.failed, nobody.failed) = '' AS kept,
  round(coalesce(verdict.rate, nobody.rate), 9) AS host_rate, coalesce(verdict.failed, nobody.failed) AS host_failed
FROM judged LEFT JOIN verdict USING (host), nobody
"""

ORACLE["op3_mixing"] = """
WITH sources AS (SELECT source, count(*)::DOUBLE AS n, sqrt(count(*)::DOUBLE) AS w FROM documents GROUP BY source),
rates AS (SELECT source, w / (SELECT sum(w) FROM sources) * (SELECT sum(n) FROM sources) / n AS rate FROM sources),
parts AS (SELECT source, greatest(ceil(rate / 8.0), 1)::INT AS pieces, rate / greatest(ceil(rate / 8.0), 1) AS mean FROM rates),
steps AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c
  FROM (SELECT source, k, exp(-mean + k * ln(mean) - lgamma(k + 1)) AS p FROM parts, range(64) AS r(k))),
draws AS (SELECT doc_id, d.source, md5(coalesce(text, '')) AS body, unnest(range(1, pieces + 1)) AS j FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source),
drawn AS (SELECT doc_id, source, body, j, ('0x' || substr(md5('mix:' || doc_id || ':' || body || ':' || j), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM draws),
hits AS (SELECT doc_id, source, body, (SELECT count(*) FROM steps s WHERE s.source IS NOT DISTINCT FROM d.source AND s.c <= d.u)::INT AS n FROM drawn d),
counts AS (SELECT doc_id, source, body, sum(n)::INT AS n_copies FROM hits GROUP BY ALL),
copies AS (SELECT doc_id, source, body, n_copies, unnest(range(1, n_copies + 1))::INT AS copy FROM counts)
SELECT doc_id, source, copy, n_copies, ('0x' || substr(md5('mix:order:' || doc_id || ':' || body || ':' || copy), 1, 15))::BIGINT AS shuffle_key, body AS text_md5 FROM copies
"""

ORACLE["op4_hamming"] = """
WITH c AS (SELECT vec_id AS id, list_sum(list_transform(range(0, 64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN pow(2::HUGEINT, i)::HUGEINT ELSE 0 END))::UBIGINT AS code FROM embeddings),
pairs AS (SELECT q.id AS query_id, c.id AS neighbor_id, bit_count(xor(q.code, c.code))::BIGINT AS distance FROM c AS q, c WHERE q.id % 20 = 0 AND q.id <> c.id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id))::INT AS rank, neighbor_id, distance FROM pairs QUALIFY rank <= 10
"""

ORACLE["op6_line_dedup"] = rf"""
WITH pieces AS (SELECT doc_id, unnest(p) AS piece, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{line_dedup.UNIT}') AS p FROM documents)),
placed AS (SELECT doc_id, i, (sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i))::INT AS stop, length(piece)::INT AS size, list_filter(string_split_regex(lower(piece), '\s+'), lambda x: x <> '') AS w FROM pieces),
lines AS (SELECT doc_id, i, stop - size AS start, stop, len(w) AS n, array_to_string(w, ' ') AS plain, len(w) >= {line_dedup.MIN_WORDS} AS long FROM placed WHERE len(w) > 0),
cuts AS (SELECT *, (long OR coalesce(lag(long) OVER o, true) OR lag(md5(plain)) OVER o < '8')::INT AS new FROM lines WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS u FROM cuts),
units AS (SELECT doc_id, u, min(start) AS start, max(stop) AS stop, sum(n)::INT AS n_words, string_agg(plain, chr(10) ORDER BY i) AS plain FROM numbered GROUP BY doc_id, u),
behind AS (SELECT *, lag(plain) OVER o AS plain_before, coalesce(lag(n_words) OVER o, -{line_dedup.MIN_WORDS}) AS n_before FROM units WINDOW o AS (PARTITION BY doc_id ORDER BY u)),
found AS (SELECT doc_id, start, stop, n_words, md5(CASE WHEN n_words >= {line_dedup.MIN_WORDS} THEN plain ELSE plain_before || chr(9) || plain END) AS digest FROM behind WHERE n_words >= {line_dedup.MIN_WORDS} OR n_words + n_before >= {line_dedup.MIN_WORDS}),
ranked AS (SELECT *, first_value(doc_id) OVER o AS kept_doc_id, first_value(start) OVER o AS kept_start, row_number() OVER o AS r FROM found WINDOW o AS (PARTITION BY digest ORDER BY doc_id, start))
SELECT doc_id, start, stop, n_words, digest, kept_doc_id, kept_start FROM ranked WHERE r > 1
"""
