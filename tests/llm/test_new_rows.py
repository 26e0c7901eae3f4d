"""Whitening, licence scans and alignment against plain forms of the same rules."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SMALL
from quillspark.llm import alignment, licenses, queries, whitening
from quillspark.llm.bpe import byte_characters

VECTORS = "vec_id long, embedding array<float>, label int"


def plain_whitening(rows):
    """vec_id, and by numpy: the integers, S, V's eigenvalues and unit vectors."""
    kept = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    x = np.floor(1024 * np.array([v for _, v in kept], np.float32).astype(float)).astype(np.int64) + 100000
    centred = x - x.sum(axis=0) / len(x)
    e, u = np.linalg.eigh(centred.T @ centred / len(x))
    return [i for i, _ in kept], x, centred, e[::-1], u[:, ::-1]


def check_whitening(got, rows, components=8):
    ids, x, centred, e, u = plain_whitening(rows)
    n, k = len(x), min(components, int((e > 1e-9 * e[0]).sum()))
    assert len(got) == n * k
    want = Counter((i, ((n * a - x.sum(axis=0)) ** 2).sum()) for i, a in zip(ids, x))
    assert Counter((r.vec_id, r.deviation) for r in got if r.component == 1) == want
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error <= 1e-9
    for c in range(1, k + 1):
        own = [r for r in got if r.component == c]
        assert own[0].explained == pytest.approx(e[c - 1] / e.sum(), rel=1e-9)
        plain = centred @ u[:, c - 1] / np.sqrt(e[c - 1])
        a, b = sorted(r.whitened for r in own), [sorted(s * plain) for s in (1, -1)]
        assert min(np.abs(np.array(a) - p).max() for p in b) < 1e-7
    return e


def test_whitening_of_the_tables(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    check_whitening(queries.op11_whitening(spark, SMALL).collect(), rows)


def test_whitening_with_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i % 37) if i % 5 else None, [float(v) for v in rng.normal(size=5) * [5, 3, 2, 1, 0.01] + 40]) for i in range(200)]
    odd = [(1, None), (2, [1.0, None, 1.0, 1.0, 1.0]), (3, [float("nan")] * 5), (4, [float("inf")] + [0.0] * 4), (5, []), (6, [1.0, 2.0]), (7, [1e30] + [0.0] * 4)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows + odd + rows[:9]], VECTORS).withColumn("n", F.lit("x")).withColumn("component", F.lit(1)).repartition(7)
    check_whitening(whitening.whiten(df).collect(), rows + rows[:9])


def test_whitening_without_spread(spark):
    none = spark.createDataFrame([], VECTORS)
    same = spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(5)], VECTORS)
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 3.0], 0) for i in range(6)], VECTORS)
    assert [whitening.whiten(df).count() for df in (none, same, line)] == [0, 0, 6]
    assert whitening.whiten(line).agg(F.max("explained")).first()[0] == pytest.approx(1)


def test_products_are_exact():
    rng = np.random.default_rng(2)
    for top in (10, 1 << 20, 1 << 27, 1 << 33, 1 << 50):
        y = rng.integers(-top, top, (50, 3))
        wide = y.astype(object)
        assert (whitening.products(y).astype(object) == wide.T @ wide).all()


@pytest.mark.parametrize("rank,size", [(1, 1), (3, 7), (20, 20), (9, 33)])
def test_eigen(rank, size):
    rng = np.random.default_rng(rank)
    a = rng.normal(size=(size, rank)) * np.logspace(0, -6, rank)
    values, vectors = whitening.eigen(a @ a.T)
    want = np.linalg.svd(a, compute_uv=False) ** 2
    known = want > 1e-13 * want[0]
    assert len(values) >= known.sum() and np.allclose(values[: known.sum()], want[known], rtol=1e-2 if rank > 3 else 1e-6)
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-10)
    assert np.allclose(vectors * values @ vectors.T, a @ a.T, atol=1e-12 * want[0])


def test_large_deviations_are_null():
    at = whitening.Centre(10**9, np.zeros(2, np.int64), np.array([5, -7]))
    y = np.array([[0, 0], [1, 2], [3, 1], [10**6, 0]])
    whole = [sum((10**9 * int(v) - int(r)) ** 2 for v, r in zip(row, at.rest)) for row in y]
    assert whitening.deviations(y, at) == [v if v < 1 << 63 else None for v in whole]


AUTO = licenses.templates()
SEQUENCES = [w for _, w in AUTO.phrases + AUTO.long]


def longest_run(words, i):
    return max(next((k for k in range(min(e, i) + 1) if s[e - k] != words[i - k]), min(e, i) + 1) for s in SEQUENCES for e in range(len(s)))


@pytest.mark.parametrize("seed", range(4))
def test_matching_statistics_and_places(seed):
    rng, words = random.Random(seed), []
    while len(words) < 150:
        s = rng.choice(SEQUENCES)
        at = rng.randrange(len(s))
        words += s[at : at + rng.randrange(1, 14)] + ([b"zzz"] if rng.random() < 0.3 else [])
    got = [n for _, n in AUTO.statistics([AUTO.number.get(w, -1) for w in words])]
    assert got == [longest_run(words, i) for i in range(len(words))]
    places = {(k, i) for k, (_, p) in enumerate(AUTO.phrases) for i in range(len(words)) if words[i : i + len(p)] == p}
    found = licenses.scan_words(AUTO, words, 0.6)[0]
    assert set(found) == places and len(found) == len(places)


def test_base_columns_of_the_tables(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    texts |= {-1: "MIT License, mit license", -2: "x CC-BY cc by " + "gnu general public license " * 3, -3: "ǅ MIT license Apache\tLicense"}
    df = spark.createDataFrame([(i, t or None, "s") for i, t in texts.items()], "doc_id long, text string, labels string")
    for r in licenses.scan(df).collect():
        words = plain_words(texts[r.doc_id])
        places = sorted((i, label) for p, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert {*r.base_labels.split(",")} - {""} <= {*r.labels.split(",")} and 0 <= r.score <= 1
        assert r.score == 1 or not places


def plain_words(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def test_changed_licences_are_spans(spark):
    text = dict(licenses.TEXTS)
    mit = text["mit"].split()
    changed = mit[:30] + ["Acme", "Corp"] + mit[32:50] + mit[56:]
    rows = [(1, "Header\n" + text["mit"]), (2, " ".join(changed)), (3, " ".join(mit[:20])), (4, " ".join(mit[44:] + ["and"] * 99 + mit[:44])), (5, "lorem " * 50 + text["isc"] + text["mpl"]), (6, None), (7, ""), (7, ""), (8, "permission is " * 30_000)]
    got = sorted(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=lambda r: (r.doc_id, r.labels))
    assert [r.labels for r in got] == ["mit", "mit", "", "", "isc,mpl", "", "", "", ""]
    assert [(s.start, s.stop, s.share) for s in got[0].spans] == [(1, 88, 1.0)]
    assert 0.8 < got[1].score < 1 and 0.2 < got[2].score < 0.3 and 0.4 < got[3].score < 0.6
    assert got[4].spans[0].start == 50 and [r.score for r in got[5:8]] == [0, 0, 0]
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


A, B = queries.FILE, queries.PIECES
PLAIN_A, PLAIN_B = Tokenizer.from_file(A["file"]), sentencepiece.SentencePieceProcessor(model_file=B)
PLAIN_A.encode_special_tokens = True
BACK = {c: b for b, c in byte_characters().items()}


def plain_alignment(text):
    """n_a, n_b, the groups and the links as pairs of ids, by looking at all pairs of tokens; None without tokens."""
    if not text:
        return None
    a, b = PLAIN_A.encode(" " + text, add_special_tokens=False).ids, PLAIN_B.encode(text)
    raw_a = [bytes(BACK[c] for c in PLAIN_A.id_to_token(i)) for i in a]
    raw_b = [bytes([int(PLAIN_B.id_to_piece(i)[3:5], 16)]) if PLAIN_B.is_byte(i) else PLAIN_B.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
        return None
    spans = []
    for ids, raw in ((a, raw_a), (b, raw_b)):
        at, own = 0, []
        for i, x in zip(ids, raw):
            own.append((at, at + len(x), i))
            at += len(x)
        spans.append(own)
    listed, start = [], 0
    for cut in sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]}):
        listed.append("|".join(",".join(str(i) for _, e, i in own if start < e <= cut) for own in spans))
        start = cut
    links = [(i, j) for x, y, i in spans[0] for v, w, j in spans[1] if max(x, v) < min(y, w)]
    return len(a), len(b), listed, links


def rows_by_plain_alignment(rows):
    found = [plain_alignment(t) for _, t in rows]
    counts = Counter(link for f in found if f for link in f[3])
    top = defaultdict(int)
    for (_, j), n in counts.items():
        top[j] = max(top[j], n)
    out = []
    for (i, _), f in zip(rows, found):
        out.append((i, *((0,) * 6 + ("",) if f is None else (f[0], f[1], len(f[2]), len(f[3]), sum(counts[x] == top[x[1]] for x in f[3]), sum(counts[x] for x in f[3]), hashlib.sha256(";".join(f[2]).encode()).hexdigest()))))
    return sorted(out, key=repr)


def odd_texts(seed, n=120):
    rng = random.Random(seed)
    parts = ["a", "b", " ", "  ", "\n", "\t", "é", "é", "日本", "😀", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "ing", "the ", "\x00", "▁", "ﬁ", "​", "123", "'s", "ก", "\x85", "﻿"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(n)]


@pytest.mark.parametrize("block", [1, 300, alignment.BLOCK])
def test_alignment_by_plain_search(spark, block, rows):
    texts = [None, "", " ", "the end", "the end", "x" * 3000, " " * 2000 + "a", *odd_texts(block)]
    given = [(i if i % 7 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, "x", 1) for r in given], "doc_id long, text string, block string, n_a int").repartition(3)
    assert rows(alignment.align(df, A, B, block)) == rows_by_plain_alignment(given)


def test_alignment_of_the_tables(spark, rows):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    short = [(i, t if t is None or len(t) < 600 else t[:600]) for i, t in docs]  # the plain search looks at all pairs of tokens
    assert rows(alignment.align(spark.createDataFrame(short, "doc_id long, text string"), A, B)) == rows_by_plain_alignment(short)
    assert queries.op13_alignment(spark, SMALL).count() == len(docs)


def test_alignment_of_nothing(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


def test_fast_ids_are_the_librarys():
    own = alignment.Bytes(A)
    assert own.fast is not None
    texts = odd_texts(99, 2000)
    assert own.encode(texts) == [e.ids for e in PLAIN_A.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("seed", range(20))
def test_groups_end_where_both_end(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.integers(1, 60))
    a, b = (np.unique(np.append(rng.integers(1, size + 1, rng.integers(1, size + 1)), size)) for _ in range(2))
    of_a, of_b, n = alignment.Ends(a, b).groups()
    common = np.intersect1d(a, b)
    assert n == len(common) and (of_a == np.searchsorted(common, a)).all() and (of_b == np.searchsorted(common, b)).all()
