import base64
import hashlib
import random
from zlib import crc32

import numpy as np
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspark.llm import bpe, queries, token_file
from conftest import SMALL

RANKS = queries.RANKS
ODD = ["a", "b", "aa", "A", " a", "'s", " 's", "1", "½", "!", "..", " ", "  ", "\n", "\t", " \n ", "é", "日本", "🙂", "́", "\x1c", "\x85", " ", "<|endoftext|>", "\x00", ""]
SCHEMA = "doc_id long, text string, ids_ string"


def reference(pattern=P.PATTERN):
    with open(RANKS["ranks"], "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n):
    random.seed(n)
    return ["".join(random.choice(ODD) for _ in range(random.randint(0, 40))) for _ in range(n)] + ["a" * 300, "ab" * 100, " " * 50, "x" * 5000 + " " + "y" * 5000]


def test_encoder_equals_the_libraries():
    texts, enc, ref = odd_texts(4000), bpe.Encoder(RANKS, limit=500), reference()
    assert enc.usual
    got = [np.frombuffer(x, enc.dtype).tolist() for i in range(0, len(texts), 300) for x in enc.encode(texts[i : i + 300])]
    assert got == [ref.encode_ordinary(t) for t in texts]
    texts += ["x<|endoftext|>y", "<|endoftext|>", "é 日 <|endoftext|> b"]
    own, plain = bpe.Encoder(queries.FILE, limit=500), bpe.Encoder({**queries.FILE, "special": "text"}, limit=500)
    tok = Tokenizer.from_file(queries.FILE["file"])
    assert own.usual and [np.frombuffer(x, own.dtype).tolist() for x in own.encode(texts)] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert np.frombuffer(own.encode(["x<|endoftext|>y"])[0], own.dtype).tolist() == [87, 50256, 88]
    tok.encode_special_tokens = True
    assert [np.frombuffer(x, plain.dtype).tolist() for x in plain.encode(texts)] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_encoder_honours_another_pattern():
    spec = {"ranks": RANKS["ranks"], "pattern": r"\p{N}{1,3}|\p{L}+|\s+|[^\s\p{L}\p{N}]+"}
    enc, ref = bpe.Encoder(spec, limit=500), reference(spec["pattern"])
    texts = [*odd_texts(500), "abc 123456 def", "don't 1234567"]
    assert not enc.usual and [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts)] == [ref.encode_ordinary(t) for t in texts]


def test_round_trip_and_offsets(spark):
    texts = [*odd_texts(200), None, ""]
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "doc_id long, text string, extra string")
    out = bpe.decode(bpe.encode(df, RANKS), RANKS).collect()
    ref = reference()
    table = bpe.byte_table(RANKS)
    for r in out:
        text = texts[r.doc_id] or ""
        assert bytes(r.decoded) == text.encode() and r.ids == ref.encode_ordinary(text) and r.extra == "kept"
        at, split = 0, 0
        for i, start in zip(r.ids, r.starts):
            head = text.encode()[:at]
            whole = len(head.decode(errors="ignore").encode()) == len(head)
            split += not whole
            assert start == (len(head.decode()) if whole else len(head.decode(errors="ignore")))
            at += len(table[i])
        assert split == r.n_split
    taken = bpe.decode(bpe.encode(df.withColumn("IDS", F.lit(1)).withColumn("Decoded", F.lit("mine")), RANKS), RANKS, "ids_").collect()
    assert {(r.IDS, r.Decoded) for r in taken} == {(1, "mine")} and all(bytes(r.decoded_) == (texts[r.doc_id] or "").encode() for r in taken)
    assert bpe.encode(df.where("doc_id < 0"), RANKS).count() == 0


def test_query_digests(spark):
    ref = reference()
    texts = dict(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    for r in queries.op2_byte_bpe(spark, SMALL).collect():
        ids = ref.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_elias_fano():
    random.seed(1)
    for n, top in ((0, 5), (1, 0), (5, 3), (64, 64), (65, 999), (300, 10), (300, 100_000), (1000, 10**9)):
        values = np.sort(np.array([random.randint(0, top) for _ in range(n)], np.int64))
        width, *parts = token_file.EliasFano.encode(values, top)
        assert tuple(map(len, parts)) == token_file.EliasFano.sizes(n, top, width)
        ef = token_file.EliasFano(n, width, *parts)
        assert ef.select(0, n).tolist() == values.tolist()
        for _ in range(100):
            a = random.randint(0, n)
            b = random.randint(a, n)
            assert ef.select(a, b).tolist() == values[a:b].tolist()


def test_bits_a_document():
    """Measured, index included: 2 + log2(ids / documents) bits, and 5 / 8 for the index, where a table would have 64."""
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 1000, 20_000)
    ends = np.cumsum(sizes)
    width, *parts = token_file.EliasFano.encode(ends, int(ends[-1]))
    bits = 8 * sum(map(len, parts)) / len(ends)
    assert bits <= 2 + np.log2(ends[-1] / len(ends)) + 0.7 < 13
    ef = token_file.EliasFano(len(ends), width, *parts)
    assert sum(x.nbytes for x in (ef.low, ef.high, ef.bytes, ef.skips)) == sum(map(len, parts))  # nothing is unpacked to be kept


def test_file(spark, tmp_path):
    rows = [(5, "b b", 1), (2, None, 1), (None, "x", 1), (9, "日本 語" * 50, 1), (2, "a", 2), (7, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int")
    ties = dict(df.select("text", F.xxhash64("text")).collect())
    for block, path in ((1 << 20, "one"), (4, "many")):
        token_file.write(df, queries.FILE, str(tmp_path / path), end_id=2, block_ids=block, partitions=3)
        got = token_file.read(spark, str(tmp_path / path)).orderBy("start").collect()
        tok = Tokenizer.from_file(queries.FILE["file"])
        ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, ties[r[1]]))
        at = 0
        for r, (doc, text, _) in zip(got, ordered, strict=True):
            ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
            assert (r.doc_id, r.start, r.n_tokens, r.ids) == (doc, at, len(ids), ids)
            at += len(ids)
    block = token_file.Block(bytes(spark.read.parquet(str(tmp_path / "one")).orderBy("part").first().block))
    assert block.document(0).tolist()[-1] == 2
    token_file.write(df.where("doc_id < 0"), queries.FILE, str(tmp_path / "none"), end_id=2)
    assert token_file.read(spark, str(tmp_path / "none")).count() == 0


def test_file_query(spark):
    tok = Tokenizer.from_file(queries.FILE["file"])
    at, want = 0, {}
    for doc, text in sorted(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        want[doc] = (at, len(ids), crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op8_token_file(spark, SMALL).collect()} == want


def test_a_frequent_id_is_dealt_to_many_tasks(spark, tmp_path):
    df = spark.range(4000, numPartitions=4).selectExpr("IF(id < 3000, NULL, id) AS doc_id", "'same text' AS text")
    token_file.write(df, queries.FILE, str(tmp_path / "f"), end_id=2, partitions=8)
    sizes = [r.n_docs for r in spark.read.parquet(str(tmp_path / "f")).collect()]
    assert sum(sizes) == 4000 and max(sizes) < 1500
    starts = [r.start for r in token_file.read(spark, str(tmp_path / "f")).orderBy("start").collect()]
    assert starts == list(range(0, 4000 * (starts[1] - starts[0]), starts[1] - starts[0]))
