import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from compare import same_rows
from conftest import SMALL
from quillspark.llm import hamming, queries, simhash


def brute_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    parts = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """{id: fingerprint} to {id: least id reachable}."""
    ids = sorted(prints, key=lambda x: (x is None, x))
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)), key=ids.index)
                root[y] = x
    return {i: find(i) for i in ids}


def near_codes(n, seed):
    rng = np.random.default_rng(seed)
    codes = rng.integers(0, 2**63, 12, dtype=np.uint64)[rng.integers(0, 12, n)]
    for _ in range(int(rng.integers(1, 6))):
        codes = codes ^ (np.uint64(1) << rng.integers(0, rng.integers(4, 65), n).astype(np.uint64)) * (rng.random(n) < 0.7).astype(np.uint64)
    return np.unique(codes)


def test_parts():
    assert [simhash.parts_for(n, 4) for n in (0, 300_000, 10**7, 10**9, 10**12)] == [5, 5, 6, 7, 8]
    assert len(simhash.layout(4, 6)) == 15


@pytest.mark.parametrize("split,parts", [(20_000, None), (6, 5), (6, 6)])
def test_links_connect_what_is_near(spark, split, parts):
    codes = near_codes(250, split)
    df = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "code long")
    prints = {i: int(c) for i, c in enumerate(codes)}
    number = {int(c): i for i, c in enumerate(codes.view(np.int64))}
    root = list(range(len(codes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in simhash.links(df, split=split, parts=parts).collect():
        assert (prints[number[a]] ^ prints[number[b]]).bit_count() <= 4
        x, y = sorted((find(number[a]), find(number[b])))
        root[y] = x
    assert {i: find(i) for i in prints} == brute_components(prints)


def test_trie_links_in_groups():
    for seed in range(40):
        codes = np.sort(near_codes(200, seed))
        found = simhash.trie_links(codes, np.zeros(len(codes), int), np.zeros(len(codes), int), 0, 4, at_once=64)
        assert found.shape[1] < len(codes) and (np.bitwise_count(codes[found[0]] ^ codes[found[1]]) <= 4).all()
        want = brute_components({i: int(c) for i, c in enumerate(codes)})
        assert found.shape[1] == len(codes) - len(set(want.values()))


def test_trie_links_with_one_sided_groups():
    """A group that holds side 1 only must not take the group before it away."""
    for seed in range(10):
        rng = np.random.default_rng(seed)
        parts = [(np.sort(near_codes(200, 100 * seed + i)), i, int(i % 2)) for i in range(6)] + [(np.sort(rng.integers(0, 2**63, 20, dtype=np.uint64)), 6, 1)]
        codes, group, side = (np.concatenate([np.broadcast_to(x[k], len(x[0])) for x in parts]) for k in range(3))
        found = simhash.trie_links(codes, group, side, 0, 4)
        assert (group[found[0]] == group[found[1]]).all()
        for number in (0, 2, 4):
            own = np.flatnonzero(group == number)
            want = brute_components({i: int(codes[i]) for i in own.tolist()})
            assert (group[found[0]] == number).sum() == len(own) - len(set(want.values()))


@pytest.mark.parametrize("partitions", [1, 7, 211])
def test_links_of_split_groups_with_empty_nodes(spark, partitions):
    """Pairs that share one part only, in a split group most of whose nodes are empty, over few and many tasks."""
    rng = np.random.default_rng(partitions)
    codes = []
    for base in rng.integers(0, 2**62, 40).tolist():
        base = base >> 12 << 12 | 5
        codes += [base, base ^ sum(1 << int(rng.integers(a, a + 12)) for a in (13, 26, 39, 51))]
    df = spark.createDataFrame([(c,) for c in codes], "code long")
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {tuple(sorted(r)) for r in simhash.links(df, split=6, parts=5).collect()}
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert got == {(min(a, b), max(a, b)) for i, a in enumerate(codes) for b in codes[i + 1 :] if (a ^ b).bit_count() <= 4}


def test_groups_are_split_until_they_are_small(spark):
    """All codes within three bits of one: splitting once leaves a node that is far too large."""
    from itertools import combinations

    flips = [sum(1 << b for b in bits) for r in range(4) for bits in combinations(range(20, 44), r)]
    codes = [0x123456789ABCDEF ^ f for f in flips] + [0x7000000000000000 ^ f << 3 for f in flips[:300]]
    df = spark.createDataFrame([(c,) for c in codes], "code long")
    sizes = []
    plain = simhash._by_trie

    def traced(rows):
        for trie, group, side, own in plain(rows):
            sizes.append(np.bincount(group).max())
            yield trie, group, side, own

    found = simhash.links(df, split=500, parts=5).collect()
    from quillspark.operators.graph import components

    names = dict(components(spark.createDataFrame(found, "a long, b long")).collect())
    first, second = codes[: len(flips)], codes[len(flips) :]
    assert len({names[c] for c in first}) == 1 and len({names[c] for c in second}) == 1 and names[first[0]] != names[second[0]]
    assert all((a ^ b).bit_count() <= 4 for a, b in found)
    _ = traced


def test_whole_groups_come_together():
    """Batches of every size give the same groups, none of them cut."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    rows = np.array(sorted(zip(rng.integers(0, 2, 500), rng.integers(0, 6, 500), rng.integers(0, 2, 500), np.zeros(500, int), rng.integers(0, 99, 500)))).T
    want = {tuple(k): sorted(rows[4][(rows[:3] == np.array(k)[:, None]).all(axis=0)]) for k in rows[:3].T}
    for size in (1, 7, 40, 500):
        for at_once in (1, 60, 10**6):
            batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in rows[:, i : i + size]], names=list("abcde")) for i in range(0, 500, size)]
            got = [sorted(own[group == g].view(np.int64)) for _, group, _, own in simhash._whole_groups(batches, at_once) for g in np.unique(group)]
            assert sorted(map(list, got)) == sorted(map(list, want.values()))


def test_representatives_keep_documents_without_ids(spark, rows):
    """Four texts without an id, two rows of one id, repeated rows, and columns named like inner ones."""
    texts = ["the quick brown fox jumps", "a wholly different text is here", "third one about the sea and ships", "numbers one two three four five"]
    own = [(None, t, i, "k", "x") for i, t in enumerate(texts)] + [(7, "first text of number seven here", 7, "k", "x"), (7, "another text entirely of that id", 7, "k", "x"), (7, "another text entirely of that id", 7, "k", "x"), (9, texts[0], 9, "k", "x")]
    df = spark.createDataFrame(own, "doc_id long, text string, __key long, tie string, leaving string")
    kept = simhash.representatives(df)
    assert kept.columns == df.columns
    assert rows(kept.select("doc_id", "text", "__key", "tie")) == sorted([(None, t, i, "k") for i, t in enumerate(texts) if i] + [(7, own[4][1], 7, "k"), (7, own[5][1], 7, "k"), (9, texts[0], 9, "k")], key=repr)


def test_odd_documents(spark):
    texts = ["A b\tc\nd e", "a b c d e", "", None, " \n", "one", "ONE ", "É É É É É", "é é é é é", "x " * 5000, "a b c d"]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = simhash.near_duplicates(df).collect()
    prints = {i: brute_print(t) for i, t in enumerate(texts)}
    assert len(got) == len(rows) and {r.doc_id: int(r.fingerprint, 16) for r in got} == prints
    assert {r.doc_id: r.component_id for r in got} == brute_components(prints)
    kept = simhash.representatives(df).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(brute_components(prints).values())) and kept[0].component_id == "x"
    assert simhash.near_duplicates(df.where("doc_id < 0")).count() == 0 and simhash.representatives(df.where("doc_id < 0")).count() == 0
    null = spark.createDataFrame([(None, "q"), (3, "q"), (None, "zz yy xx ww vv")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(null).collect()), key=str) == [(3, 3), (None, 3), (None, None)]


def test_query(spark):
    texts = dict(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    prints = {i: brute_print(t) for i, t in texts.items()}
    want = brute_components(prints)
    got = queries.op9_simhash(spark, SMALL).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{p:016x}", want[i]) for i, p in prints.items()}


def brute_top(codes, query_id, code, k):
    return sorted(((c ^ code).bit_count(), i) for i, c in codes if i != query_id)[:k]


@pytest.mark.parametrize("small,at_once", [(hamming.SMALL, hamming.AT_ONCE), (0, 50)])
def test_hamming_search(spark, monkeypatch, small, at_once):
    """With the index broadcast and dealt out, and with few and many steps in a round."""
    monkeypatch.setattr(hamming, "SMALL", small)
    monkeypatch.setattr(hamming, "AT_ONCE", at_once)
    rng = np.random.default_rng(3)
    codes = [(i, int(c)) for i, c in enumerate(near_codes(90, 1))] + [(1000 + i, 5) for i in range(60)] + [(2000 + i, int(rng.integers(0, 2**63))) for i in range(50)]
    signed = [(i, c - 2**64 if c >= 2**63 else c) for i, c in codes]
    df = spark.createDataFrame(signed, "id long, code long")
    wanted = df.where("id % 20 = 0")
    got = {}
    for r in hamming.top_k(df, wanted, k=7).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.distance, r.neighbor_id)
    assert got == {i: dict(enumerate(brute_top(codes, i, c, 7), 1)) for i, c in codes if i % 20 == 0}
    assert hamming.top_k(df.where("id < 0"), wanted.where("id < 0")).count() == 0
    assert hamming.top_k(df.where("id = 0"), wanted.where("id = 0")).count() == 0


def test_hamming_layout():
    assert [len(hamming.layout(n)) for n in (0, 1000, 50_000, 10**7, 10**9)] == [16, 8, 5, 3, 2]
    assert all(sum(w for _, w in hamming.layout(n)) == 64 for n in (1, 10**4, 10**8))


def test_sign_codes(spark):
    df = spark.createDataFrame([(1, [1.0, -1.0, None, 2.0]), (2, None), (None, [1.0]), (3, [])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, hamming.sign_codes(df).collect())) == [(1, 9), (3, 0)]
    with pytest.raises(Exception, match="more than 64"):
        hamming.sign_codes(df.select("vec_id", F.array_repeat(F.lit(1.0), 65).alias("embedding"))).collect()


def test_hamming_query(spark):
    same_rows(queries.op4_hamming(spark, SMALL), queries.ORACLE["op4_hamming"], SMALL)
