"""SimHash near-dedup: fingerprints of word shingles, linked by a self-join of binary tries.

Two fingerprints that differ in few bits agree in whole parts: of the ``parts`` of the 64 bits at least
``parts - distance`` are equal. For each choice of that many parts there is one trie, whose bits begin with
the chosen parts; the nodes at that depth are the groups that Spark deals out. Below it a pair of nodes is
traversed together: each pair splits into pairs of children, differing bits are added up, and a pair that
exceeds the distance is pruned, and so is one whose leaves are connected already. A group sends on the
links that connect its leaves (a forest), never all its pairs. A group above ``split`` leaves is cut into
pairs of deeper nodes that stay within the distance, which are dealt out anew, and cut again until none is
above it. Links then become components by joins.

Only distinct fingerprints take part, so copies cost nothing; documents get their component back by a join.

Defined results: a null text, an empty one and one of white space have fingerprint zero, and are linked like
any other; a very long text is hashed whole; repeated rows each get a row (and one of them stays as a
representative); an empty table gives an empty result; other columns, of any name, are ignored by
``near_duplicates`` and kept by ``representatives``. A null document id stays null and never names a component
unless its component has no other; documents without an id are told apart by their texts alone.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import components
from .common import cut, free, pieces, prepare, release, texts

SEED = 42
BITS = 64


def hashes(raw: bytes, shingle: int) -> np.ndarray:
    """XXH64 of every shingle of lower-cased words, repeats included."""
    from xxhash import xxh64_intdigest

    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate([[0], blanks + 1])[: len(words) - shingle + 1].tolist()
    ends = np.concatenate([blanks, [len(joined)]])[shingle - 1 :].tolist()
    return np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends)], np.uint64)


def fingerprint(h: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 14):
        part = h[i : i + (1 << 14)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = np.packbits(2 * counts > len(h), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, **others: Column) -> DataFrame:
    """doc_id and ``code``, the fingerprint as a signed 64-bit integer; between them other columns of the documents."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), *(c.alias(n) for n, c in others.items()))
    names = [*rows.columns[1:], "code"]

    def run(batches):
        release()
        for batch in pieces(batches):
            codes = [fingerprint(hashes(x.encode(), shingle)) for x in texts(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(codes, pa.int64())], names=names)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[1:], T.StructField("code", T.LongType())]))


def layout(distance: int, parts: int) -> list[tuple[list[int], int]]:
    """For each trie the bits in their order, highest first, and how many of them two codes must share."""
    edges = np.linspace(0, BITS, parts + 1).astype(int)
    blocks = [list(range(edges[i], edges[i + 1])) for i in range(parts)]
    out = []
    for chosen in combinations(range(parts), parts - distance):
        first = [b for i in chosen for b in blocks[i]]
        out.append((first + [b for i in range(parts) if i not in chosen for b in blocks[i]], len(first)))
    return out


def arranged(codes: np.ndarray, order: list[int]) -> np.ndarray:
    """The codes with their bits in that order, the first one highest."""
    codes, out = codes.view(np.uint64), np.zeros(len(codes), np.uint64)
    for to, bit in enumerate(order):
        out |= ((codes >> np.uint64(bit)) & np.uint64(1)) << np.uint64(BITS - 1 - to)
    return out


class Forest:
    """Which leaves are connected, by the least leaf of each tree; and the links that joined trees."""

    def __init__(self, n: int):
        self.root, self.links = np.arange(n), []

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.root[a], self.root[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], np.minimum(x, y)[apart], np.maximum(x, y)[apart]
            if not len(a):
                return
            _, one = np.unique(y, return_index=True)  # each tree is hung under one smaller root at a time
            self.links.append(np.stack([a[one], b[one]]))
            self.root[y[one]] = x[one]
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


def trie_links(codes: np.ndarray, group: np.ndarray, side: np.ndarray, shared: int, distance: int, small: int = 8, at_once: int = 1 << 18) -> np.ndarray:
    """Links (pairs of indices) that connect all codes within ``distance`` in the same group, by a joint traversal of pairs of trie nodes.

    codes: arranged, sorted by (group, side, code). A group's root pair is (root, root), or (side 0, side 1)
    where a group holds two nodes. Side 1 alone has no pair. Leaves in a node are a range of indices.
    """
    n = len(codes)
    forest = Forest(n)
    near = np.flatnonzero((group[1:] == group[:-1]) & (side[1:] == side[:-1]))
    near = near[np.bitwise_count(codes[near] ^ codes[near + 1]) <= distance]
    forest.join(near, near + 1)  # neighbours in the order are leaves that lie close together in the trie
    key = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (side[1:] != side[:-1])])) if n else np.zeros(0, int)
    ends = np.append(key[1:], n)
    second = np.flatnonzero(side[key] == 1)
    two = second[(second > 0) & (group[key[second]] == group[key[second - 1]])]
    # A side 1 whose other node is empty is left out: the node's own group has its links.
    one = np.setdiff1d(np.arange(len(key)), np.concatenate([second, two - 1]))
    pairs = np.concatenate([np.stack([key[one], ends[one], key[one], ends[one]]), np.stack([key[two - 1], ends[two - 1], key[two], ends[two]])], axis=1)
    stack = [(pairs, shared)]
    while stack:
        pairs, depth = stack.pop()
        if pairs.shape[1] > at_once:
            stack += [(pairs[:, at_once:], depth), (pairs[:, :at_once], depth)]
            continue
        a0, a1, b0, b1 = pairs
        spans = np.maximum(a1 - a0, 0) * np.maximum(b1 - b0, 0)
        live = (spans > 0) & ~((a0 == b0) & (a1 - a0 == 1))
        if depth < BITS:  # the bits so far must be within the distance; those below are compared by the children
            top = np.uint64(0) if not depth else ~np.uint64(0) << np.uint64(BITS - depth)
            live[live] &= np.bitwise_count((codes[a0[live]] ^ codes[b0[live]]) & top) <= distance
        live[live] &= ~_connected(forest.root, pairs[:, live])
        pairs, spans = pairs[:, live], spans[live]
        few = (spans <= small * small) | (depth >= BITS)
        if few.any():
            _compare(codes, forest, pairs[:, few], distance)
        a0, a1, b0, b1 = pairs[:, ~few]
        if not len(a0):
            continue
        am, bm = _middle(codes, a0, a1, depth), _middle(codes, b0, b1, depth)
        other = a0 != b0
        children = [np.stack(x) for x in ((a0, am, b0, bm), (am, a1, bm, b1), (a0, am, bm, b1))] + [np.stack((am, a1, b0, bm))[:, other]]
        stack.append((np.concatenate(children[2:], axis=1), depth + 1))  # crossing pairs last: by then their leaves may be connected
        stack.append((np.concatenate(children[:2], axis=1), depth + 1))
    return np.concatenate(forest.links, axis=1) if forest.links else np.zeros((2, 0), int)


def _connected(root: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Of each pair of nodes, whether all their leaves are in one tree already."""
    changes = np.concatenate([[0], np.cumsum(root[1:] != root[:-1])]) if len(root) else root
    a0, a1, b0, b1 = pairs
    return (changes[a0] == changes[a1 - 1]) & (changes[b0] == changes[b1 - 1]) & (root[a0] == root[b0])


def _middle(codes: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
    """Where the bit at ``depth`` turns from 0 to 1 in each range: a binary search in all ranges at once."""
    bit = np.uint64(BITS - 1 - depth)
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        one = ((codes[np.minimum(mid, len(codes) - 1)] >> bit) & np.uint64(1)).astype(bool)
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)
    return lo


def _compare(codes: np.ndarray, forest: Forest, pairs: np.ndarray, distance: int) -> None:
    """Compares the leaves of small nodes one by one."""
    a0, a1, b0, b1 = pairs
    wide = b1 - b0
    sizes = (a1 - a0) * wide
    which = np.repeat(np.arange(len(sizes)), sizes)
    k = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    a, b = a0[which] + k // wide[which], b0[which] + k % wide[which]
    near = (a != b) & (np.bitwise_count(codes[a] ^ codes[b]) <= distance)
    forest.join(a[near], b[near])


def parts_for(n: int, distance: int, group: int = 64) -> int:
    """The fewest parts for which n codes, were they random, would make groups of at most that many."""
    parts = distance + 1
    while parts < distance + 4 and n > group * 2.0 ** (BITS * (parts - distance) / parts):
        parts += 1
    return parts


def links(codes: DataFrame, distance: int = 4, parts: int | None = None, split: int = 20_000, split_bits: int = 6) -> DataFrame:
    """Links (a, b) between distinct codes (column code) that connect whatever is within ``distance`` bits.

    ``parts`` follows from the number of codes if it is not given. A trie shares 64 * (parts - distance) / parts
    bits: 5 parts (5 tries of 12 bits) do for 400,000 codes, 6 (15 of 21) for 160 million, 7 (35 of 27) for
    billions. The links are the same; a code is sent to fewer or more, larger or smaller groups.

    A row is a code in a pair of nodes (a, b), of which it is below the first (side 0) or the second (side 1);
    at first both are the node at the shared depth. Pairs that are too large, and they alone, go down another level.
    """
    spark = codes.sparkSession
    tries = layout(distance, parts or parts_for(codes.count(), distance))
    prepare(spark)

    def deal(batches):
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            for t, (order, shared) in enumerate(tries):
                codes_ = arranged(own, order)
                key = pa.array((codes_ >> np.uint64(BITS - shared)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), t, np.int32)), key, key, pa.array(np.zeros(len(own), np.int32)), pa.array(codes_.view(np.int64))], names=[*PAIR, "side", "arranged"])

    rows = codes.select("code").mapInArrow(deal, "trie int, a long, b long, side int, arranged long")
    depths, groups = [shared for _, shared in tries], None
    while True:
        sides = rows.groupBy(*PAIR).agg(F.count_if(F.col("side") == 0).alias("left"), F.count_if(F.col("side") == 1).alias("right"))
        sizes = sides.where("a = b AND left > 1 OR left > 0 AND right > 0").select(*PAIR, (F.col("left") + F.col("right")).alias("size"))
        sized = cut(rows.join(sizes, list(PAIR)))
        deeper = max(depths) + split_bits <= BITS
        fit = (sized.where(F.col("size") <= split) if deeper else sized).drop("size")
        groups = fit if groups is None else groups.unionAll(fit)
        large = sized.where(F.col("size") > split).drop("size")
        if not deeper or not large.limit(1).count():
            break
        rows = cut(_lower(large, depths, distance, split_bits))
        depths = [d + split_bits for d in depths]
    shared = {t: s for t, (_, s) in enumerate(tries)}
    back = [np.array(order) for order, _ in tries]

    def traverse(batches):
        for trie, group, side, own in _whole_groups(batches):
            found = trie_links(own, group, side, shared[trie], distance)
            original = np.zeros(len(own), np.uint64)
            for to, bit in enumerate(back[trie]):
                original |= ((own >> np.uint64(BITS - 1 - to)) & np.uint64(1)) << np.uint64(bit)
            original = original.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(original[found[0]]), pa.array(original[found[1]])], names=["a", "b"])

    dealt_out = groups.repartition(*PAIR).sortWithinPartitions(*PAIR, "side", F.col("arranged") < 0, "arranged")
    return dealt_out.mapInArrow(traverse, "a long, b long").distinct()


PAIR = ("trie", "a", "b")


def _lower(rows: DataFrame, depths: list[int], distance: int, bits: int) -> DataFrame:
    """The pairs of nodes ``bits`` further down that are still within the distance, with the codes below them."""
    kinds = range(1 << bits)
    near = [[[y for y in kinds if (x ^ y).bit_count() <= left] for x in kinds] for left in range(distance + 1)]
    below = ", ".join(str(BITS - bits - d) for d in depths)
    digit = F.pmod(F.expr(f"shiftrightunsigned(arranged, array({below})[trie])"), F.lit(1 << bits)).cast("int")
    left = F.lit(distance) - F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    partners = F.get(F.get(F.from_json(F.lit(str(near)), "array<array<array<int>>>"), left), F.col("own"))
    met = rows.withColumn("own", digit).select(*PAIR, "side", "arranged", "own", F.explode(partners).alias("other"))
    # A pair of one node with itself has its lower node first; of two nodes, each keeps its side.
    first = F.when(F.col("a") == F.col("b"), F.least("own", "other")).when(F.col("side") == 0, F.col("own")).otherwise(F.col("other"))
    second = F.when(F.col("a") == F.col("b"), F.greatest("own", "other")).when(F.col("side") == 0, F.col("other")).otherwise(F.col("own"))
    side = F.when(F.col("a") == F.col("b"), (F.col("own") > F.col("other")).cast("int")).otherwise(F.col("side"))
    down = lambda node, at: F.shiftleft(node, bits).bitwiseOR(at.cast("long"))
    return met.select("trie", down("a", first).alias("a"), down("b", second).alias("b"), side.alias("side"), "arranged")


def _whole_groups(batches, at_once: int = 30_000):
    """The rows of some whole groups at a time, in their order: (trie, group number, side, codes). Rows are put together once a group has ended."""
    held, size = [], 0
    for batch in batches:
        now = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)])
        if not now.shape[1]:
            continue
        same = np.all(now[:3] == now[:3, -1:], axis=0)
        last = 0 if same.all() else now.shape[1] - int(np.argmin(same[::-1]))  # where the batch's last group begins
        if not last and held and not np.array_equal(held[-1][:3, -1], now[:3, 0]):
            last = -1  # a new group begins with the batch
        if last and size + max(last, 0) > at_once:
            last = max(last, 0)
            yield from _by_trie(np.concatenate([*held, now[:, :last]], axis=1))
            held, size, now = [], 0, now[:, last:]
        held.append(now)
        size += now.shape[1]
    if held:
        yield from _by_trie(np.concatenate(held, axis=1))


def _by_trie(rows: np.ndarray):
    for trie in np.unique(rows[0]).tolist():
        own = rows[:, rows[0] == trie]
        group = np.concatenate([[0], np.cumsum(np.any(own[1:3, 1:] != own[1:3, :-1], axis=0))])
        yield trie, group, own[3], own[4].view(np.uint64)


def classes(prints: DataFrame, distance: int = 4, parts: int | None = None) -> DataFrame:
    """code, component (its least code) and component_id (its least document id) of every distinct code of ``prints`` (doc_id, code)."""
    distinct = cut(prints.groupBy("code").agg(F.min("doc_id").alias("first")))
    found = components(links(distinct, distance, parts))
    named = cut(distinct.join(found.withColumnRenamed("node", "code"), "code", "left").select("code", "first", F.coalesce("component", "code").alias("component")))
    least = cut(named.groupBy("component").agg(F.min("first").alias("component_id")))
    # Written, so that a join of all documents to it has a shuffle of its own on both sides, and a common code may be split among tasks.
    return cut(named.join(least, "component").select("code", "component", "component_id"))


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, parts: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest document id that can be reached, itself included."""
    prints = cut(fingerprints(docs, shingle))
    return prints.join(classes(prints, distance, parts), "code").select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, shingle: int = 4, distance: int = 4, parts: int | None = None) -> DataFrame:
    """The documents, whole rows, of the lowest id in each component (without ids: the least by a hash of the text). Rows of equal id and text stay once.

    Only ids, hashes of texts and fingerprints are shuffled; the rows that leave are then taken out of the documents.
    """
    hashed = F.xxhash64(F.col("text").cast("string"))
    prints = cut(fingerprints(docs, shingle, tie=hashed))
    joined = prints.join(classes(prints, distance, parts), "code")
    stay = joined.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("best")).select(F.col("best.doc_id").alias("stays"), F.col("best.tie").alias("stays_tie"))
    rows = prints.groupBy("doc_id", "tie").agg(F.count("*").alias("n"))
    leaving, leaving_tie, own, tie = free(docs, "leaving", "leaving_tie", "own_id", "tie")
    leave = cut(rows.join(stay, F.col("doc_id").eqNullSafe(F.col("stays")) & (F.col("tie") == F.col("stays_tie")), "left_anti").select(F.col("doc_id").alias(leaving), F.col("tie").alias(leaving_tie)))
    keyed = docs.withColumn(own, F.col("doc_id").cast("long")).withColumn(tie, hashed)
    kept = keyed.join(leave, F.col(own).eqNullSafe(F.col(leaving)) & (F.col(tie) == F.col(leaving_tie)), "left_anti")
    if rows.where("n > 1").limit(1).count():
        kept = kept.dropDuplicates([own, tie])
    return kept.select(*docs.columns)
