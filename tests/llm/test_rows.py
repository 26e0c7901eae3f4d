import math
import re
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from compare import same_rows
from conftest import SMALL
from quillspark.llm import host_rules, line_dedup, mixing, queries
from quillspark.llm.common import join_keyed


@pytest.mark.parametrize("name", ["op3_mixing", "op6_line_dedup", "op10_host_rules"])
def test_queries_agree_with_sql(spark, name):
    same_rows(queries.QUERIES[name](spark, SMALL), queries.ORACLE[name], SMALL)


def brute_repeats(words, n=8):
    seen = {}
    for i in range(len(words) - n + 1):
        seen.setdefault(tuple(words[i : i + n]), []).append(i)
    return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(n)})


def test_repeated_words():
    import random

    random.seed(4)
    for _ in range(300):
        words = [random.choice([b"a", b"b", b"c"]) for _ in range(random.randint(0, 120))]
        assert host_rules.repeated_words(words) == brute_repeats(words)
    assert host_rules.repeated_words([b"w"] * 9) == 9 and host_rules.repeated_words([b"w"] * 8) == 0


def test_host_rules_odd_rows(spark):
    long_ = " ".join(f"w{i}" for i in range(30))
    rows = [(1, None, "h"), (2, "", "h"), (3, long_, "h"), (4, long_, None), (4, long_, None), (5, "a b " * 30_000, "i"), (None, "x\nx\n \ny#", "i"), (6, "é " * 25, "bad")] + [(10 + i, "spam", "bad") for i in range(30)] + [(50, long_, "bad")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("kept", F.lit("x"))
    got = host_rules.apply_rules(df).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by[1].n_words == 0 and by[1].base_failed and by[3].n_words == 30
    assert by[4].kept == (by[4].host_rate <= 0.5) and not by[50].kept and not by[50].base_failed
    assert (by[None].n_words, by[None].word_chars, by[None].n_symbols, by[None].n_dup_lines) == (3, 4, 1, 1)
    assert by[5].n_repeat_words == 60_000
    assert host_rules.apply_rules(df.where("doc_id < 0")).count() == 0


def test_prior_without_sampling_noise(spark):
    """Hosts of few documents whose rates are drawn from a beta distribution of strength 20: the raw spread of rates would say about 3."""
    import numpy as np

    rng = np.random.default_rng(1)
    n = rng.integers(3, 6, 4000)
    failed = rng.binomial(n, rng.beta(6, 14, len(n)))
    other = {f"failed_{r}": F.lit(False) for r in host_rules.RULES if r != "base"}
    stats = spark.createDataFrame([(int(i), bool(k < f)) for i, (m, f) in enumerate(zip(n, failed)) for k in range(m)], "host long, failed_base boolean").withColumn("host", F.col("host").cast("string")).withColumns(other)
    hosts, means = host_rules.host_verdicts(stats)
    mean = means["base"]
    r = hosts.where("host = '0'").first()
    m, f = int(n[0]), int(failed[0])
    strength = (f - m * r.host_rate) / (r.host_rate - mean)  # rate = (f + mean * s) / (m + s)
    assert abs(mean - 0.3) < 0.01 and 15 < strength < 28
    one = spark.createDataFrame([("a", True)] * 3 + [("b", False)] * 300, "host string, failed_base boolean").withColumns(other)
    assert host_rules.host_verdicts(one)[0].count() == 2 and host_rules.host_verdicts(one.where("host = 'z'"))[1]["base"] == 0


def test_planted_bad_hosts_lose_their_documents(spark):
    """Forty usual hosts, one bad by each rule, a small one whose two bad documents say little, and a large bad one of a third of all rows."""
    import numpy as np

    rng, rows = np.random.default_rng(3), []
    good = lambda: "\n".join(" ".join(f"w{v}xy" for v in rng.integers(0, 9999, 12)) for _ in range(3))
    bad = {"spam": lambda: "buy now", "lined": lambda: "\n".join([good()] + ["menu one two three"] * 3), "marked": lambda: good().replace(" ", " # "), "long": lambda: " ".join("x" * 30 + str(v) for v in range(30))}
    put = lambda host, text: rows.append((len(rows), text, host))
    for i in range(2000):
        put(f"h{i % 40}", "short" if rng.random() < 0.1 else good())
    for host, make in bad.items():
        for i in range(60):
            put(host, good() if i % 4 == 0 else make())
    for i in range(4):
        put("small", good() if i % 2 else "buy now")
    for i in range(1200):
        put("huge", good() if i % 3 == 0 else bad["spam"]())
    got = host_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)).collect()
    failed = {rows[r.doc_id][2]: r.host_failed for r in got}
    assert failed.pop("spam") == "base" and failed.pop("huge") == "base" and failed.pop("lined") == "lines" and failed.pop("marked") == "symbols" and failed.pop("long") == "word_length"
    assert {*failed.values()} == {""} and len(failed) == 41
    assert all(r.kept == (not r.base_failed and r.host_failed == "") for r in got) and not any(r.kept for r in got if rows[r.doc_id][2] == "huge")
    assert len(got) == len(rows)


def test_join_keyed_both_ways(spark, rows):
    big = spark.createDataFrame([(i, ["a", "b", None, "z"][i % 4]) for i in range(40)], "doc_id long, k string")
    small = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert rows(join_keyed(big, small, "k", "doc_id").select("doc_id", "v")) == rows(join_keyed(big, small, "k", "doc_id", limit=1).select("doc_id", "v"))


def test_poisson(spark):
    rows = [(i, "t", "a" if i % 3 else None) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = spark.createDataFrame([("a", 3.0), (None, 1.0), ("unused", 1.0)], "source string, weight double")
    mixed = mixing.mix(df, weights, size=4.0).cache()
    by = {r.source: r.n for r in mixed.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(by["a"] - 18000) < 800 and abs(by[None] - 6000) < 500
    counts = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    rate = 18000 / 4000
    for k in range(8):
        share = sum(counts.get(i, 0) == k for i, _, s in rows if s) / 4000
        assert abs(share - math.exp(-rate) * rate**k / math.factorial(k)) < 0.03
    assert mixed.groupBy("doc_id").agg(F.count_distinct("copy").alias("d"), F.max("copy").alias("m"), F.max("n_copies").alias("n")).where("d <> m or m <> n").count() == 0
    keys = [r.shuffle_key for r in mixing.mix(df, weights, partitions=1).collect()]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    assert mixing.mix(df, weights).count() == mixing.mix(df.orderBy(F.desc("doc_id")), weights).count()


def test_rows_without_ids_are_drawn_and_dealt_apart(spark):
    """Two thousand documents, half of them without an id; then a text that is half of all rows, without an id too."""
    df = spark.range(2000, numPartitions=4).selectExpr("IF(id % 2 = 0, NULL, id) AS doc_id", "concat('text ', id) AS text", "'s' AS source")
    mixed = mixing.mix(df, size=2.0, partitions=8)
    sizes = [r[1] for r in mixed.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / 8
    null = mixed.where("doc_id is null").groupBy("text").agg(F.max("n_copies").alias("n")).groupBy("n").count().collect()
    assert len(null) > 3 and abs(sum(r.n * r["count"] for r in null) - 2000) < 200
    same = df.withColumn("text", F.when(F.col("doc_id").isNull(), "one text").otherwise(F.col("text")))
    parts = mixing.mix(same, size=4.0, partitions=8, seed="b").where("doc_id is null").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) in (0, 5, 6, 7, 8)


def test_mixing_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(i, f"t{i}", "a", i, "c") for i in range(50)], "doc_id long, text string, source string, draws long, cdf string").withColumn("__source", F.lit("mine")).withColumn("text_hash", F.lit("h"))
    out = mixing.mix(df, size=3.0)
    assert out.columns == [*df.columns, "copy", "n_copies", "shuffle_key"] and {(r["__source"], r.text_hash, r.cdf) for r in out.collect()} == {("mine", "h", "c")} and all(r.draws == r.doc_id for r in out.collect())


def test_poisson_odd_rows(spark):
    rows = [(None, None, "a"), (1, "", "a"), (1, "", "a"), (2, "x" * 100_000, None), (3, "q", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("rate", F.lit(1)).withColumn("source2", F.lit("z"))
    weights = spark.createDataFrame([("a", 1.0), ("b", 0.0)], "source string, weight double")
    out = mixing.mix(df, weights, size=40.0)
    assert {r.source for r in out.collect()} == {"a"} and out.count() > 100  # a mean of 66 copies, in pieces of 8
    assert mixing.mix(df.where("doc_id < 0")).count() == 0
    taken = mixing.mix(df.withColumn("Copy", F.lit("mine")).withColumn("n_copies", F.lit("mine")), weights, size=40.0)
    assert taken.columns[-3:] == ["copy_", "n_copies_", "shuffle_key"]
    again = [(r.doc_id, r.text, r.source, r.copy_, r.n_copies_) for r in taken.collect() if r.Copy == r.n_copies == "mine"]
    assert sorted(again, key=repr) == sorted(((r.doc_id, r.text, r.source, r.copy, r.n_copies) for r in out.collect()), key=repr)


def brute_units(text):
    """(start, stop, normalised, words) by the rule in words: long lines alone, short neighbours together up to a cut."""
    lines = [(m.start(), m.end(), m.group().lower().split()) for m in re.finditer(line_dedup.UNIT, text or "") if m.group().split()]
    groups = []
    for i, (a, b, w) in enumerate(lines):
        before = lines[i - 1][2] if i else None
        new = before is None or len(w) >= 8 or len(before) >= 8 or md5(" ".join(before).encode()).hexdigest()[0] in "01234567"
        groups += [[]] if new else []
        groups[-1].append((a, b, w))
    return [(g[0][0], g[-1][1], "\n".join(" ".join(w) for *_, w in g), sum(len(w) for *_, w in g)) for g in groups]


def brute_lines(rows, tie):
    seen, out, found = {}, set(), []
    for doc, text in {(d, t) for d, t in rows if t}:
        own = brute_units(text)
        for i, (a, b, plain, n) in enumerate(own):
            if n >= 8 or i and n + own[i - 1][3] >= 8:
                digest = md5((plain if n >= 8 else own[i - 1][2] + "\t" + plain).encode()).hexdigest()
                found.append((doc is None, doc or 0, tie[text], a, b, n, digest, doc))
    for none, _, t, start, stop, n, digest, doc in sorted(found, key=lambda x: x[:4]):
        if digest in seen:
            out.add((doc, t, start, stop, n, digest, *seen[digest]))
        else:
            seen[digest] = (doc, start)
    return out


def line_rows(spark, own):
    df = spark.createDataFrame(own, "doc_id long, text string")
    return df, dict(df.select("text", F.xxhash64("text")).collect())


def test_line_dedup(spark):
    s = "one two three four five six seven eight nine."
    short = "He came. She saw. They went on. It rained. No one spoke. Then it was late. We slept. All was well. "
    own = [(3, f"A b. {s} Tail"), (1, f"{s.upper()}\n{s} {s}"), (2, f"prefix {s}"), (9, None), (8, ""), (7, "short. " * 50), (None, s), (3, f"A b. {s} Tail"), (6, s * 3), (5, f"{s}\n" * 400), (20, f"Before it. {short}After it."), (21, f"Something else there. {short * 2}\n \nEnd."), (22, "He came. Apart."), (None, f"{short}x"), (None, f"{short}y"), (4, short), (4, short + s)]
    df, tie = line_rows(spark, own)
    found = line_dedup.repeats(df.withColumn("digest", F.lit("x")))
    got = {(r.doc_id, r.tie, r.start, r.stop, r.n_words, r.digest, r.kept_doc_id, r.kept_start) for r in found.collect()}
    assert got == brute_lines(own, tie) and len(got) > 400
    texts = {r.doc_id: r.text for r in line_dedup.remove(df, found).where("doc_id in (1, 3, 5, 9, 22)").collect()}
    assert texts == {1: f"{s.upper()}\n", 3: "A b. Tail", 5: "", 9: None, 22: "He came. Apart."}
    assert line_dedup.repeats(df.where("doc_id < 0")).count() == 0


def test_short_sentences_of_a_copied_passage_go_with_it(spark):
    import random

    random.seed(8)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(5))
    passage = " ".join(f"{' '.join(word() for _ in range(random.randint(2, 6)))}." for _ in range(60))
    own = [(1, f"{word()} begins. {passage} {word()} ends."), (2, f"{word()} {word()} other. {passage} {word()} {word()}.")]
    df, _ = line_rows(spark, own)
    gone = sum(r.n_words for r in line_dedup.repeats(df).collect() if r.doc_id == 2)
    assert gone > 0.8 * len(passage.split())
    assert line_dedup.repeats(df.where("doc_id = 1")).count() == 0


def test_removal_is_by_id_and_text(spark, rows):
    s = "alpha beta gamma delta epsilon zeta eta theta."
    own = [(1, s), (2, f"{s} More of it."), (2, "alphaX betaX gammaX deltaX epsilonX zetaX etaX thetaX. Kept."), (None, f"{s} Null."), (None, "Innocent text that nobody else has here at all.")]
    df = spark.createDataFrame(own, "doc_id long, text string").withColumn("tie", F.lit("t")).withColumn("__spans", F.lit(7)).withColumn("spans", F.lit("u"))
    out = line_dedup.remove(df, line_dedup.repeats(df))
    assert out.columns == df.columns and rows(out.select("doc_id", "text", "__spans", "spans", "tie")) == sorted([(i, t, 7, "u", "t") for i, t in [(1, s), (2, "More of it."), own[2], (None, "Null."), own[4]]], key=repr)
