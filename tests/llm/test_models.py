import math
from collections import defaultdict
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from conftest import SMALL
from quillspark.llm import language, quality, queries, secrets

MEDIUM = "/root/testdata/sf0.01"


def brute_tree(training, order=language.ORDER):
    tree = defaultdict(lambda: defaultdict(int))
    for t in training:
        raw = b"\n" * order + t.lower().encode()
        for i in range(order, len(raw)):
            for k in range(order + 1):
                tree[raw[i - k : i]][raw[i]] += 1
    return tree


def tree_bits(tree, text, order=language.ORDER):
    raw, bits = b"\n" * order + text.lower().encode(), 0.0
    for i in range(order, len(raw)):
        for k in range(order, -1, -1):
            seen = tree.get(raw[i - k : i])
            if not seen:
                continue
            total = sum(seen.values()) + len(seen)
            if raw[i] in seen:
                bits -= math.log2(seen[raw[i]] / total)
                break
            bits -= math.log2(len(seen) / total)
        else:
            bits += 8
    return bits


def brute_bits(training, text):
    """Code length of a text by a plain context tree of the training texts."""
    return tree_bits(brute_tree(training), text)


def test_code_lengths(spark, monkeypatch):
    training = {"x": ["the cat sat", "a Cat"], "y": ["le chat à la", ""]}
    rows = [(5 * i + 1, t, lang) for i, (lang, t) in enumerate((k, t) for k, v in training.items() for t in v)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), least=1)
    tests = ["the cat", "là", "zzz é", "", "chat sat the", "日本"]
    for cells in (1 << 22, 5):
        monkeypatch.setattr(language, "CELLS", cells)
        got = model.bits([t.lower().encode() for t in tests])
        for row, text in zip(got, tests):
            assert np.allclose(row, [brute_bits(training[lang], text) for lang in model.langs], atol=1e-3)


def test_language_odd_rows(spark):
    rows = [(i, t, lang, "s") for i, (t, lang) in enumerate([("hello there", "en"), ("hallo dort", "de"), (None, "en"), ("123 !!", "de"), ("hello", None), ("", "en"), ("hello " * 3000, "en"), ("hallo", "de"), ("ab", "en"), ("ab", "de")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in language.identify(df).collect()}
    assert len(got) == len(rows) and all(got[i].lang_pred == "und" and got[i].score == 0 for i in (2, 3, 5)) and got[6].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.identify(df.where("doc_id < 0")).count() == 0
    assert {r.lang_pred for r in language.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_all_languages_are_learned_but_slips(spark):
    df = spark.createDataFrame([(5 * i + 1, f"text {chr(97 + i % 26)}{chr(97 + i // 26)} " * (1 + i % 3) + str(k), f"l{i:02}") for i in range(70) for k in range(3)] + [(9, "a", "slip"), (11, "b", "slip")], "doc_id long, text string, lang string")
    assert language.train(df).langs == [f"l{i:02}" for i in range(70)]
    assert language.train(df, least=1).langs == [f"l{i:02}" for i in range(70)] + ["slip"]
    assert language.train(df, least=9).langs == []


def test_equal_ids_teach_by_their_texts(spark):
    rows = [(7, f"{'the cat and' if i % 2 else 'le chat et'} {i}", "en" if i % 2 else "fr") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for docs in (df, df.withColumn("doc_id", F.lit(4).cast("long"))):
        taken = language.sample(docs, "lang", 1500, "doc_id", "text").groupBy("lang").count().collect()
        assert {r.lang: r["count"] for r in taken} == {"en": 1500, "fr": 1500}
        assert language.train(docs).langs == ["en", "fr"]
    same = df.where("text like 'the%'").withColumn("text", F.lit("x")).withColumn("doc_id", F.lit(None).cast("long"))
    assert language.sample(same, "lang", 9, "doc_id", "text").count() == 1


def test_language_query_by_brute_force(spark):
    """Every document of the tables by a plain context tree of the same training texts, which are all that are not held out."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    training = defaultdict(dict)
    for r in docs:
        if crc32(str(r.doc_id).encode()) % 5 and r.lang is not None and r.text is not None:
            training[r.lang][r.doc_id, r.text] = r.text
    trees = {lang: brute_tree(texts.values()) for lang, texts in sorted(training.items()) if len(texts) >= 3}
    got = {r.doc_id: r for r in queries.op7_language(spark, SMALL).collect()}
    for r in docs[:60] + [r for r in docs if not (r.text or "").strip()]:
        own = got[r.doc_id]
        assert own.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0)
        if not any(map(str.isalpha, r.text or "")):
            assert (own.lang_pred, own.score) == ("und", 0)
            continue
        bits = {lang: tree_bits(tree, r.text) for lang, tree in trees.items()}
        best = min(bits, key=bits.get)
        assert own.lang_pred == best and math.isclose(own.bits, bits[best], rel_tol=1e-5)
        assert math.isclose(own.score, 1 / sum(2.0 ** max(bits[best] - b, -1000) for b in bits.values()), abs_tol=1e-2)
    assert len(got) == len(docs)


def test_language_held_out_accuracy(spark):
    assert queries.op7_language(spark, MEDIUM).columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    found = queries.op7_language(spark, MEDIUM).join(spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert len(found) == 1000 and (found.lang == found.lang_pred)[found.held_out].mean() > 0.97


def test_quality(spark):
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    got = queries.op5_quality(spark, MEDIUM).toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all() and ((got.score >= 0.3).astype(int) == got.predicted).all()
    own = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    good, bad = own.score[own.quality == 1], own.score[own.quality == 0]
    assert np.mean([(b < good).mean() for b in bad]) > 0.95 and own.predicted[own.quality == 1].mean() > 0.97


def plain_features(text):
    """The features of the quality model by loops over bytes, words and lines."""
    raw = (text or "").encode()
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x]
    shares = [sum(b in own for b in raw) / max(len(raw), 1) for own in quality.CLASSES.values()]
    return shares + [math.log(1 + len(raw)), math.log(1 + len(words)), sum(len(w) for w in words) / max(len(words), 1), len(set(words)) / max(len(words), 1), sum(a == b for a, b in zip(words, words[1:])) / max(len(words), 1), len(set(lines)) / max(len(lines), 1), math.log(1 + len(words) / max(len(lines), 1))]


def test_quality_query_by_plain_rescoring(spark):
    """Every document of the tables scored again: one table entry for each feature and pair, added up one by one."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    texts = dict(docs.select("doc_id", "text").collect())
    got = queries.op5_quality(spark, SMALL)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    for r in rows:
        x = plain_features(texts[r.doc_id])
        assert np.allclose(x, quality.features([texts[r.doc_id] or ""])[0])
        at = [sum(edge <= v for edge in edges) for v, edges in zip(x, model.edges)]
        total = model.base + sum(table[i] for table, i in zip(model.tables, at)) + sum(table[at[i] // model.coarse, at[j] // model.coarse] for (i, j), table in model.pairs.items())
        assert math.isclose(r.score, 1 / (1 + math.exp(-total)), abs_tol=1e-6) and r.predicted == (r.score >= 0.3)
    assert len(rows) == len(texts) and model.pairs


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "w " * 50_000, "a"), (3, "w " * 50_000, "a"), (None, "x", "b")], "doc_id long, text string, score string")
    for y in ([], [(1, 1), (2, None)], [(1, 1), (2, 0), (3, 1)]):
        got = quality.classify(docs, spark.createDataFrame(y, "doc_id long, quality int")).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert quality.classify(docs.where("doc_id < 0"), spark.createDataFrame([(1, 1)], "doc_id long, quality int")).count() == 0


def test_pairs_are_learned():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    plain, full = quality.fit(x, y, n_pairs=0), quality.fit(x, y, n_pairs=2)
    assert (0, 1) in full.pairs and ((full.score(x) > 0.5) == y).mean() > 0.9 > ((plain.score(x) > 0.5) == y).mean()


TOKEN = "0123456789abcdef" * 2 + "01234567"


def secret_docs(spark):
    words = "internationalisation misunderstandingness counterproductively"
    rows = [(i, f'some text here token = "{TOKEN[i % 16:]}{TOKEN[: i % 16]}" and {words} 1234567890123456 end', "src") for i in range(40)]
    rows += [(100, None, None), (101, "", "t"), (102, f"{TOKEN}", "t"), (103, f"x {TOKEN} {TOKEN}", None), (104, "a" * 20_000, "t"), (0, rows[0][1], "src")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), rows


def test_candidates(spark):
    import re

    docs, rows = secret_docs(spark)
    got = sorted((r.doc_id, r.start, r.stop, r.value, r.before, r.after) for r in secrets.candidates(docs).collect())
    want = []
    for i, text, _ in rows:
        last = 0
        for m in re.finditer(r"[A-Za-z0-9_+/=~.\-]{16,}", text or ""):
            want.append((i, m.start(), m.end(), m.group(), text[max(last, m.start() - 48) : m.start()], None))
            last = m.end()
    assert [g[:5] for g in got] == [w[:5] for w in sorted(want)]
    texts = {i: t for i, t, _ in rows}
    assert all(g[5] == texts[g[0]][g[2] : g[2] + len(g[5])] for g in got)


def test_scan_and_redact(spark):
    docs, rows = secret_docs(spark)
    found = secrets.scan(docs)
    spans = {(r.doc_id, r.value) for r in found.collect()}
    assert {i for i, _ in spans} >= set(range(40)) and all(len(v) == 40 for i, v in spans if i < 40)
    clean = {r.doc_id: r.text for r in secrets.redact(docs, found).collect()}
    assert clean[0] == 'some text here token = "[SECRET]" and internationalisation misunderstandingness counterproductively 1234567890123456 end'
    assert clean[100] is None and clean[101] == ""
    assert secrets.redact(docs, found).count() == len(rows)
    few = docs.where("doc_id > 99")  # nothing here has a label: the forest knows the reviewed kinds
    assert {(r.doc_id, r.value) for r in secrets.scan(few).collect()} == {(102, TOKEN), (103, TOKEN)}
    assert secrets.scan(docs.where("doc_id < 0")).count() == 0


#: An id that is held out, so that what its document says labels nothing.
HELD = next(i for i in range(5, 99) if crc32(str(i).encode()) % 5 == 0)


def test_scan_without_labels_leaves_clean_text(spark):
    rows = [(1, "anthrererendanhe internationalisation 1234567890123456 a/path/of/letters-only", "s"), (2, "passwords: misunderstandingness", "s"), (HELD, 'api_key = "Zx9QwertyUiop77asdfGh"', "s"), (4, f"the key is {TOKEN} now", "s"), (8, "commit 9f3c1b7ad2e84f60915cc7be03a8d61f4e2790bd", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {(r.doc_id, r.value) for r in secrets.scan(docs).collect()} == {(HELD, "Zx9QwertyUiop77asdfGh"), (4, TOKEN)}


def test_features_take_whole_candidates(spark):
    """Both features of a token whose first 256 characters say otherwise, by brute force, over words of all documents."""
    value = "7" * 300 + "-planet-planet-zzz" + "7" * 20_000
    docs = spark.createDataFrame([(None, f"planet a {value} b", "s"), (1, "planet", "s")], "doc_id long, text string, source string")
    words = secrets.corpus_words(docs)
    assert [(r.word, r.n) for r in words.collect()] == [("planet", 2)]
    odds = spark.createDataFrame([], "word string, odds double")
    row = secrets.featured(secrets.candidates(docs), words, secrets.letter_table(words), odds).collect()[0]
    pair, sums = {}, {}
    for a, b in zip("planet", "lanet"):
        pair[a, b], sums[a] = pair.get((a, b), 0) + 2, sums.get(a, 0) + 2
    kind = ["other" if not c.isalpha() else c for c in value]
    bits = [-math.log2((pair.get(p, 0) + 1) / (sums.get(p[0], 0) + 27)) for p in zip(kind, kind[1:])]
    assert math.isclose(row.coverage, 12 / len(value)) and math.isclose(row.letter_bits, sum(bits) / len(bits), rel_tol=1e-9)


def test_dictionary_counts_all_documents(spark, monkeypatch):
    docs, _ = secret_docs(spark)
    docs = docs.unionByName(spark.range(1000, 5000).selectExpr("if(id % 2 = 0, id, null) AS doc_id", "'rareword here' AS text", "'s' AS source"))
    seen, plain = [], secrets.corpus_words
    monkeypatch.setattr(secrets, "corpus_words", lambda d, n: seen.append(d.count()) or plain(d, n))
    secrets.scan(docs)
    assert seen == [docs.count()]


def planted(n=360):
    """Documents with one string each: secrets of six kinds, most of them assigned to a name in one of several ways, and harmless strings of six kinds; (id, text, path), kinds and values."""
    import base64
    import random

    random.seed(12)
    pick = lambda alphabet, n: "".join(random.choice(alphabet) for _ in range(n))
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    any_ = letters + letters.upper() + digits
    raw = lambda n: bytes(random.randrange(256) for _ in range(n))
    words = ["planet", "window", "garden", "silver", "market", "number", "summer", "bridge", "letter", "castle"]
    secrets_ = {
        "hex": lambda: pick("0123456789abcdef", random.choice((32, 40, 64))),
        "base64": lambda: base64.b64encode(raw(30)).decode(),
        "jwt": lambda: ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (b'{"alg":"HS256"}', raw(24), raw(32))),
        "prefixed": lambda: f"sk_live_{pick(any_, 24)}",
        "upper": lambda: "AKIA" + pick(letters.upper() + digits, 16),
        "mixed": lambda: pick(any_ + "_-", 36),
    }
    harmless = {
        "words": lambda: "".join(random.sample(words, 4)),
        "path": lambda: f"/usr/{'/'.join(random.sample(words, 3))}.txt",
        "digits": lambda: pick(digits, 20),
        "camel": lambda: "".join(w.title() for w in random.sample(words, 3)) + str(random.randint(1, 9)),
        "snake": lambda: "_".join(random.sample(words, 3)) + f"_{random.randint(1, 99)}",
        "dashes": lambda: "-".join(["2024", "01", "31", *random.sample(words, 2)]),
    }
    rows, facts = [], []
    for i in range(n):
        secret = i % 2 == 0
        kinds = secrets_ if secret else harmless
        kind = [*kinds][i // 2 % 6]
        value = kinds[kind]()
        name = random.choice(("api_key = \"{}\"", "token: {}", "password={}", "the key is {} so", "{} was sent")) if secret else random.choice(("see {} for it", "file = {}", "name: {}", "the {} there", "{}"))
        around = " ".join(random.sample(words, 5))
        rows.append((i, f"{around} {name.format(value)} {around}", f"src/{random.choice(words)}.py"))
        facts.append((secret, kind, value))
    return rows, facts


def test_held_out_recall_of_each_kind(spark):
    """Reviewed labels of half of the documents; of the other half, each kind of secret is found and each harmless kind left."""
    rows, facts = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    reviewed = {i: int(secret) for i, (secret, _, _) in enumerate(facts) if i // 12 % 2}
    labels = spark.createDataFrame([*reviewed.items()], "doc_id long, label int")
    labelled = secrets.candidates(docs).join(labels, "doc_id")
    found = {(r.doc_id, r.value) for r in secrets.scan(docs, labelled).collect()}
    recall, kept = {}, {}
    for i, (secret, kind, value) in enumerate(facts):
        if i not in reviewed:
            hit = any(d == i and (value in v or v in value) for d, v in found)
            (recall if secret else kept).setdefault(kind, []).append(hit if secret else not hit)
    assert {k: np.mean(v) for k, v in recall.items() if np.mean(v) < 0.9} == {} and len(recall) == 6
    assert {k: np.mean(v) for k, v in kept.items() if np.mean(v) < 0.8} == {}


def test_weak_labels_are_harmless(spark):
    rows, facts = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = {r.doc_id: r.label for r in secrets.weak_labels(secrets.candidates(docs)).collect()}
    assert {*labels.values()} == {0} and not any(facts[i][0] for i in labels) and {facts[i][1] for i in labels} >= {"words", "digits"}


def test_reviewed_base_has_all_kinds(spark):
    words = spark.createDataFrame([("planet", 3), ("garden", 2)], "word string, n long")
    base = secrets.reviewed(spark, words, each=5)
    got, kinds = base.collect(), secrets.reviewed_kinds()
    assert len(got) == 5 * len(kinds) and {r.label for r in got} == {0, 1} and all(r.text and r.source for r in got)
    assert got == secrets.reviewed(spark, words, each=5).collect()
    found = secrets.candidates(base.withColumn("doc_id", F.col("doc_id"))).groupBy((F.col("doc_id") / 5).cast("int").alias("kind")).count().collect()
    assert len({r.kind for r in found}) >= 0.95 * len(kinds)  # a few words run together may be too short


def test_recall_and_false_positives_of_the_query_by_kind(spark):
    """Strings of another generator than the base's, in documents with no label of their own, judged by the query's model."""
    import base64
    import random
    import uuid

    rng, words = random.Random(5), "planet window garden silver market number summer bridge letter castle".split()
    pick = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    low, digits, hexed = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
    any_ = low + low.upper() + digits
    secret = {
        "stripe": lambda: f"sk_live_{pick(any_, 24)}", "aws": lambda: f"AKIA{pick(low.upper() + digits, 16)}", "base64": lambda: base64.b64encode(rng.randbytes(30)).decode(), "hex": lambda: pick(hexed, 40), "github": lambda: f"ghp_{pick(any_, 36)}",
        "password": lambda: f'password = "{pick(low, 24)}"', "token": lambda: f'token = "{pick(hexed, 40)}"', "mixed": lambda: pick(any_ + "_-", 36), "jwt": lambda: f"eyJhbGciOiJIUzI1NiJ9.{base64.urlsafe_b64encode(rng.randbytes(24)).decode()}.{pick(any_, 43)}",
    }
    harmless = {
        "uuid": lambda: str(uuid.UUID(int=rng.getrandbits(128))), "commit": lambda: f"commit {pick(hexed, 40)}", "sha1": lambda: f'sha1 = "{pick(hexed, 40)}"', "md5": lambda: f"md5: {pick(hexed, 32)}", "sha256": lambda: f"sha256: {pick(hexed, 64)}",
        "host": lambda: f"db{rng.randint(1, 99)}-{pick(digits, 3)}.prod.{rng.choice(words)}.example.com", "camel": lambda: "".join(rng.choice(words).title() for _ in range(4)), "snake": lambda: "_".join(rng.choice(words) for _ in range(4)), "path": lambda: f"/usr/{'/'.join(rng.choice(words) for _ in range(3))}.txt",
    }
    makers, rows, kinds = {**secret, **harmless}, [], {}
    for i in range(30 * len(makers)):
        kind = [*makers][i % len(makers)]
        kinds[10**6 + i] = kind
        rows.append((10**6 + i, f"{' '.join(rng.choices(words, k=6))} {makers[kind]()} {' '.join(rng.choices(words, k=6))}", "s"))
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text", "source")
    hit = {r.doc_id for r in secrets.scan(docs.unionByName(spark.createDataFrame(rows, docs.schema))).collect()}
    share = {k: np.mean([i in hit for i, kind in kinds.items() if kind == k]) for k in makers}
    assert {k: v for k, v in share.items() if k in secret and v < 0.9 or k in harmless and v > 0.1} == {}


def test_features_by_brute_force(spark):
    """All features of every planted string, by loops over characters."""
    import re
    from collections import Counter

    rows, facts = planted(120)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    words = secrets.corpus_words(docs)
    known = {r.word for r in words.collect()}
    found = secrets.candidates(docs)
    labels = spark.createDataFrame([(i, int(secret)) for i, (secret, _, _) in enumerate(facts)], "doc_id long, label int")
    last = lambda before: ([""] + re.findall("[^\\W\\d_]+", before.lower()))[-1]
    counts, yes = Counter(), Counter()
    for r in found.join(labels, "doc_id").collect():
        counts[last(r.before)] += 1
        yes[last(r.before)] += r.label
    plain_odds = {w: math.log2((yes[w] + 1) / (n - yes[w] + 1)) for w, n in counts.items() if n > 2 and w}
    odds = secrets.word_odds(found.join(labels, "doc_id"), least=3)
    got_odds = {r.word: r.odds for r in odds.collect()}
    assert got_odds.keys() == plain_odds.keys() and plain_odds and all(math.isclose(v, plain_odds[w]) for w, v in got_odds.items())
    pair, sums = Counter(), Counter()
    for r in words.collect():
        for a, b in zip(r.word, r.word[1:]):
            pair[a, b] += r.n
            sums[a] += r.n
    got = secrets.featured(found, words, secrets.letter_table(words), odds).collect()
    assert {*secrets.FEATURES} <= {*got[0].__fields__}
    buckets = {r.path: r.b for r in found.select("path", F.pmod(F.xxhash64("path"), F.lit(16)).alias("b")).distinct().collect()}
    kind = lambda c: 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3
    for r in got:
        v = r.value
        n = len(v)
        assert (r.length, r.lower_share, r.upper_share, r.digit_share) == (n, sum(map(str.islower, v)) / n, sum(map(str.isupper, v)) / n, sum(map(str.isdigit, v)) / n)
        assert math.isclose(r.kinds_share, len(set(v)) / min(n, 64)) and math.isclose(r.transitions, (1 + sum(kind(a) != kind(b) for a, b in zip(v, v[1:]))) / n)
        assert r.assigned == bool(re.search(r"[=:]\s*[\"']?$", r.before)) and r.quoted == (r.before[-1:] in "\"'" and r.after[:1] in "\"'" and r.before != "" and r.after != "")
        covered = 0
        for run in re.findall("[a-z]{3,}", v.lower()):
            heads, ends = ([k for k in range(3, min(len(run), 20) + 1) if x(k) in known] for x in (lambda k: run[:k], lambda k: run[-k:]))
            covered += min(len(run), max(heads, default=0) + max(ends, default=0))
        assert math.isclose(r.coverage, covered / n)
        letters = [c if "a" <= c <= "z" else "other" for c in v.lower()]
        bits = [-math.log2((pair[p] + 1) / (sums[p[0]] + 27)) for p in zip(letters, letters[1:])]
        assert math.isclose(r.letter_bits, sum(bits) / len(bits), rel_tol=1e-9)
        near = lambda names: bool(re.search(rf"({names})\w*\W{{0,6}}$", r.before.lower()))  # noqa: E731, B023
        assert (r.named, r.checked) == (near(secrets.NAMES), near(secrets.CHECKS)) and r.follows_word == bool(re.match(r"[\"']?\s+[^\W\d_]", r.after))
        assert math.isclose(r.word_odds, plain_odds.get(last(r.before), 0)) and r.path_bucket == buckets[r.path] and r.harmless_path == any(x in r.path.lower() for x in secrets.HARMLESS_PATHS.split("|"))
        assert (r.separators, r.hex_share) == (sum(not c.isalnum() for c in v) / n, sum(c in "0123456789abcdefABCDEF" for c in v) / n) and r.longest_part == max(map(len, re.findall("[A-Za-z0-9]+", v)))
    assert len(got) >= 110


def test_redaction_is_by_id_and_text(spark, rows):
    """Rows without an id and of one id, and columns named like inner ones."""
    own = [(None, f'token = "{TOKEN}" a', 1, "x"), (None, f'token = "{TOKEN}" b', 2, "x"), (5, f'x token = "{TOKEN}"', 3, "x"), (5, "clean text of that id, longer than the other one, much longer indeed", 4, "x")]
    df = spark.createDataFrame(own, "doc_id long, text string, __key long, source string").withColumn("spans", F.lit("s")).withColumn("key", F.lit("k"))
    out = secrets.redact(df, secrets.scan(df))
    assert out.columns == df.columns and rows(out) == sorted([(i, t.replace(TOKEN, "[SECRET]"), k, p, "s", "k") for i, t, k, p in own], key=repr)


def test_secrets_of_the_tables(spark):
    """Of the strings behind a secret's name in documents that taught nothing (ids whose crc32 leaves 0), found by a search of another form."""
    import re

    texts = dict(spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text").collect())
    want = {(i, m.start(1), m.end(1)) for i, t in texts.items() for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', t or "")}
    got = {(r.doc_id, r.start, r.stop) for r in queries.op1_secrets(spark, MEDIUM).collect()}
    held = {i for i in texts if crc32(str(i).encode()) % 5 == 0}
    assert len(want & got) >= 0.9 * len(want) and len(got - want) <= 0.1 * len(want) + 1
    assert all(x in got for x in want if x[0] in held)
