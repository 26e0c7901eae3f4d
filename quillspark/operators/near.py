"""Near-duplicate documents: classes of texts whose word shingles are similar, exactly, whatever shingles are common."""

from functools import lru_cache, partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut, ship, shuffles_end, written
from .graph import components

#: A bucket in which so many rows at most are apart from the rest is compared row by row; a larger one is split if that leaves half as many pairs.
FEW = 32
#: So many shared shingles are asked for, one after the other, before a bucket is compared whatever its size.
LEVELS = 6
#: So many times the rows of a bucket are compared with one of them before those still apart are compared otherwise.
STARS = 3
#: Words of 64 bits in a set's bitmap.
WORDS = 4
#: Counts that one row of the frequencies holds.
BLOCK = 1024
#: Cells of the table of ids by which texts that no pair asks for are left where they are.
ASKED = 1 << 20
#: Bytes of texts whose words a task holds at once.
PIECE = 1 << 19


def plain_text(c):
    """Lower case with single blanks: what a text's words are taken from."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def _pieces(batches, *texts: str):
    """The batches in slices of about PIECE bytes of these texts, a single row at least."""
    for batch in batches:
        size = sum(pc.binary_length(batch.column(t)).to_numpy(zero_copy_only=False) for t in texts)
        part = np.cumsum(size) // PIECE
        ends = [*(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
        for a, b in zip([0, *ends], ends):
            if b > a:
                yield batch.slice(a, b - a)


_BYTES = np.random.default_rng(1).integers(1, 1 << 64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
#: Words of more bytes have a cryptographic hash.
_LONG = 32


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, base, np.uint64))))


def _word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of plain texts, and where each text's begin: sums over the bytes in one pass, of which a word's is a difference."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset :][: len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]]
    at -= at[0]
    blanks = np.flatnonzero(data == 32)
    starts, ends = np.sort(np.concatenate((at[:-1], blanks + 1)), kind="stable"), np.sort(np.concatenate((blanks, at[1:])), kind="stable")
    size = 1 << int(len(data)).bit_length()
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * _powers(_BASE, size)[: len(data)])))
    hashes = (sums[ends] - sums[starts]) * _powers(pow(_BASE, -1, 1 << 64), size)[starts]
    for i in np.flatnonzero(ends - starts > _LONG):
        hashes[i] = int.from_bytes(blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    # A text has a word more than blanks; the empty text's is empty.
    return hashes, np.searchsorted(blanks, at) + np.arange(len(at))


def _and(x: np.ndarray, word: np.ndarray) -> np.ndarray:
    x = (x ^ word) * np.uint64(_BASE)
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: pa.Array, shingle: int) -> list[np.ndarray]:
    """The different shingles of each plain text as hashes in order; a text of fewer words is one shingle."""
    words, ends = _word_hashes(texts)
    counts = np.maximum(np.diff(ends) - shingle + 1, 1)
    first = np.concatenate(([0], np.cumsum(counts)))
    at = np.arange(first[-1]) + np.repeat(ends[:-1] - first[:-1], counts)
    x = np.zeros(len(at), np.uint64)
    for k in range(shingle):
        x = _and(x, np.take(words, at + k, mode="clip"))
    for i in np.flatnonzero(np.diff(ends) < shingle):
        own = np.zeros(1, np.uint64)
        for k in range(ends[i], ends[i + 1]):
            own = _and(own, words[k : k + 1])
        x[first[i]] = own[0]
    sets = (np.sort(x[a:b]) for a, b in zip(first[:-1], first[1:]))
    return [s[np.concatenate(([True], s[1:] != s[:-1]))] for s in sets]


def _counted(batches, cells: int, shingle: int):
    """How many shingles of a task's texts fall on each cell, a block of cells a row."""
    total = np.zeros(cells, np.int32)
    for piece in _pieces(batches, "text"):
        np.add.at(total, (np.concatenate(shingle_sets(piece.column("text"), shingle)) % np.uint64(cells)).astype(np.int64), 1)
    if total.any():
        starts = range(0, cells, BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(starts)), pa.int32()), pa.array([total[i : i + BLOCK] for i in starts], pa.list_(pa.int32()))], names=["block", "n"])


def _summed(batches):
    """The sums of the rows of each block."""
    sums = {}
    for batch in batches:
        for block, n in zip(batch.column("block").to_pylist(), batch.column("n")):
            sums[block] = sums.get(block, 0) + n.values.to_numpy().astype(np.int64)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array(sums.values(), pa.list_(pa.int64()))], names=["block", "n"])


def frequencies(texts: DataFrame, shingle: int, cells: int) -> np.ndarray:
    """How often the shingles of each cell occur in all texts; a shingle's cell follows from its hash. ``cells`` numbers, however many shingles there are."""
    blocks = texts.select("text").mapInArrow(partial(_counted, cells=cells, shingle=shingle), "block int, n array<int>").repartition("block")
    counts = blocks.mapInArrow(_summed, "block int, n array<long>").toArrow()
    out = np.zeros(cells, np.int64)
    for block, n in zip(counts.column("block").to_pylist(), counts.column("n")):
        out[block * BLOCK :][: len(n)] = n.values.to_numpy()
    return out


def _ordered(batches, counts, shingle: int, threshold: float):
    """Each text's number of shingles, its least overlap with a similar one, its first shingles in the order, and its bitmap.

    The order is by the frequency of a shingle's cell, rarest first, then by hash: one for all sets. A bit of the map is the parity of the shingles that fall on it.
    """
    table = counts.value
    for batch in _pieces(batches, "text"):
        firsts, sizes, least, maps = [], [], [], []
        for x in shingle_sets(batch.column("text"), shingle):
            if len(table):
                x = x[np.argsort(table[x % np.uint64(len(table))], kind="stable")]
            need = int(np.ceil(threshold * len(x) - 1e-9))
            firsts.append(x[: len(x) - need + LEVELS].view(np.int64))
            sizes.append(len(x))
            least.append(need)
            # The low bits have chosen the cell; others choose the bit of the map.
            bits = np.bincount(((x >> np.uint64(32)) & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1
            maps.append(np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64))
        ends = np.zeros(len(firsts) + 1, np.int32)
        np.cumsum([len(x) for x in firsts], out=ends[1:])
        first = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(firsts)))
        maps = np.array(maps, np.int64).reshape(len(firsts), WORDS)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), pa.array(sizes, pa.int32()), pa.array(least, pa.int32()), first, *(pa.array(m) for m in maps.T)], names=["id", "h", "size", "least", "first", *_maps("m")])


def _maps(name: str) -> list[str]:
    return [f"{name}{i}" for i in range(WORDS)]


def _may_be_similar(level: int, threshold: float):
    """Whether the two texts of a pair, with their facts in x and y, may be similar: by their sizes, by what is left of both behind the last shingle that they are known to share, and by their bitmaps."""
    a, b = F.col("x.size"), F.col("y.size")
    need = F.ceil(threshold / (1 + threshold) * (a + b) - 1e-6)
    rest = F.least(a - F.col("pos_a"), b - F.col("pos_b")) - 1 + level
    apart = sum((F.bit_count(F.col(f"x.{m}").bitwiseXOR(F.col(f"y.{m}"))) for m in _maps("m")), F.lit(0))
    return (F.least(a, b) >= threshold * F.greatest(a, b) - 1e-9) & (rest >= need) & (apart <= a + b - 2 * need)


def _asked(batches, cells):
    """The rows whose cell some pair asks for."""
    for batch in batches:
        yield batch.filter(pa.array(cells.value[batch.column("cell").to_numpy()])).drop_columns(["cell"])


def _similar(batches, shingle: int, threshold: float):
    """The pairs whose shingles have that Jaccard similarity."""
    for batch in _pieces(batches, "ta", "tb"):
        good = []
        for x, y in zip(*(shingle_sets(batch.column(t), shingle) for t in ("ta", "tb"))):
            common = len(np.intersect1d(x, y, assume_unique=True))
            good.append(common / (len(x) + len(y) - common) >= threshold)
        yield batch.filter(pa.array(good, pa.bool_())).drop_columns(["ta", "tb"])


#: What a row is in its bucket, as bits that pairs need one of each: at home in the band, and with the shingle so early that a text as large or larger may be similar.
HOME, LEAD = 1, 2
_PAIR = "a long, b long, label_a long, label_b long"


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """Those of the pairs (a and b, with the hashes h_a and h_b of their texts, and labels) whose texts (id, text) are similar. Only texts that a pair asks for are dealt out, compressed as they are and never as shingles."""
    spark: SparkSession = pairs.sparkSession
    cell = F.pmod(F.xxhash64("id"), F.lit(ASKED)).cast("int")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).select(cell.alias("cell")).distinct()
    cells = np.zeros(ASKED, bool)
    cells[ids.toArrow().column("cell").to_numpy()] = True
    asked = texts.withColumn("cell", cell).mapInArrow(partial(_asked, cells=spark.sparkContext.broadcast(cells)), "id long, text string")
    asked = asked.select("id", F.sha2("text", 256).alias("h"), plain_text("text").alias("text"))
    one = pairs.join(asked.select(F.col("id").alias("a"), F.col("h").alias("h_a"), F.col("text").alias("ta")), ["a", "h_a"])
    both = one.join(asked.select(F.col("id").alias("b"), F.col("h").alias("h_b"), F.col("text").alias("tb")), ["b", "h_b"])
    return both.select("a", "b", "label_a", "label_b", "ta", "tb").mapInArrow(partial(_similar, shingle=shingle, threshold=threshold), _PAIR)


def _pairs(rows: DataFrame, x: str, y: str) -> DataFrame:
    """The different pairs of the rows' structs x and y, the lower id first, each with the least places of the shingles that they share: where they share the first ones."""
    x, y = (F.when(F.col(f"{x}.id") < F.col(f"{y}.id"), F.col(p)).otherwise(F.col(q)) for p, q in ((x, y), (y, x)))
    low, high = rows.select(x.alias("x"), y.alias("y")), lambda c, n: F.col(f"{c}.{n}")
    return low.groupBy(high("x", "id").alias("a"), high("y", "id").alias("b")).agg(F.min("x.pos").alias("pos_a"), F.min("y.pos").alias("pos_b"), F.min("x.label").alias("label_a"), F.min("y.label").alias("label_b"))


def links(texts: DataFrame, shingle: int, threshold: float, cells: int, seen: list | None = None) -> DataFrame:
    """Links (a, b) of similar texts (id, text), enough of them to connect every two that are similar. seen, if given, gets the number of pairs that each step verifies."""
    spark: SparkSession = texts.sparkSession
    plain = texts.select("id", F.sha2("text", 256).alias("h"), plain_text("text").alias("text"))
    counts = spark.sparkContext.broadcast(frequencies(plain, shingle, cells) if cells else np.zeros(0, np.int64))  # ``cells`` numbers
    facts = "size int, least int, first array<long>, " + ", ".join(f"{m} long" for m in _maps("m"))
    ordered = plain.mapInArrow(partial(_ordered, counts=counts, shingle=shingle, threshold=threshold), f"id long, h string, {facts}")
    ordered = written(ordered.groupBy("h").agg(F.min("id").alias("id"), *(F.first(c).alias(c) for c in ("size", "least", "first", *_maps("m")))).where("id is not null"))
    known = ordered.select("id", F.struct("h", "size", *_maps("m")).alias("facts"))
    # Sizes are cut into bands that are as wide as the threshold; a set is in its own band (home) and in the next one, where all others are larger.
    own = F.floor(F.log("size") / -np.log(threshold) + 1e-9).cast("int")
    # Where the other is as large or larger, the shingle is among fewer of its first ones.
    early = lambda level: F.col("size") - F.ceil(2 * threshold / (1 + threshold) * F.col("size") - 1e-6).cast("int") + level
    hashed = lambda n, band, role: F.transform(F.slice("first", F.lit(1), n), lambda x, i: F.struct(F.xxhash64(band, x).alias("key"), i.alias("pos"), role(i).alias("role")))
    at_home, away = hashed(F.col("size") - F.col("least") + 1, own, lambda i: F.when(i < early(1), HOME | LEAD).otherwise(HOME)), hashed(early(1), own + 1, lambda i: F.lit(LEAD))
    rows = ordered.select("id", F.explode(F.concat(at_home, away)).alias("r")).select("r.key", "id", "r.pos", "r.role")
    found = None

    def checked(pairs: DataFrame, level: int) -> DataFrame:
        nonlocal found
        pairs = pairs.join(known.select(F.col("id").alias("a"), F.col("facts").alias("x")), "a").join(known.select(F.col("id").alias("b"), F.col("facts").alias("y")), "b")
        pairs = written(pairs.where(_may_be_similar(level, threshold)).select("a", "b", F.col("x.h").alias("h_a"), F.col("y.h").alias("h_b"), "label_a", "label_b"))
        if seen is not None:
            seen.append(pairs.count())
        if pairs.isEmpty():
            return pairs
        good = written(verified(pairs, texts, shingle, threshold))
        found = good if found is None else found.unionByName(good)
        return good

    def renamed(rows: DataFrame, good: DataFrame) -> DataFrame:
        """The rows with the labels that the links give them."""
        if good.isEmpty():
            return rows
        joined = components(good.select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))).withColumnRenamed("node", "label")
        return rows.join(joined, "label", "left").withColumn("label", F.coalesce("component", "label")).drop("component")

    def parted(rows: DataFrame) -> DataFrame:
        """The rows of buckets that hold two labels and both roles: base is the label that most of a bucket's rows have, n the number of the others, pairs how many pairs they are in."""
        labels = rows.groupBy("key", "label").agg(F.count("*").alias("n"), F.bit_or("role").alias("role"))
        buckets = labels.groupBy("key").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("all"), F.count("*").alias("labels"), F.bit_or("role").alias("role")).where(F.col("role") == HOME | LEAD).where("labels > 1")
        n = F.col("all") - F.col("most.n")
        return rows.join(buckets.select("key", F.col("most.label").alias("base"), n.alias("n"), (n * F.col("all")).alias("pairs")), "key")

    def split(rows: DataFrame, level: int) -> DataFrame:
        """The rows in buckets of one more shingle, with the one from which they come: similar sets share the next one, too, among so many more of their first ones."""
        full = rows.join(ordered.select("id", "size", "least", "first"), "id")
        last = F.col("size") - F.col("least") + 1 + level
        own = ["key", "id", "pos", "role", "label", "size"]
        more = full.select(*own, F.posexplode(F.slice("first", F.col("pos") + 2, F.greatest(last - F.col("pos") - 1, F.lit(0)))).alias("k", "next"))
        more = more.select(F.xxhash64("key", "next").alias("to"), *((F.col("pos") + 1 + F.col("k")).alias("pos") if c == "pos" else c for c in own))
        # Sets so small that similar ones may share no more than they do stay together.
        small = full.where(F.col("least") <= level).select(F.xxhash64("key", F.lit("small")).alias("to"), *own)
        role = F.col("role").bitwiseAND(F.lit(HOME)) + F.when(F.col("pos") < early(level + 1), LEAD).otherwise(0)
        return more.unionByName(small).select(F.col("key").alias("of"), F.col("to").alias("key"), "id", "pos", role.alias("role"), "label")

    label = "id"  # until the first links are known, a set is alone
    for level in range(1, LEVELS + 1):
        for turn in range(STARS):
            # Every row of a bucket is compared with one of them; afterwards only where many are apart, with one of these. Before the shingle that
            # all share, a text that was changed has rarer ones of its own, so the one with the fewest is nearest to the others.
            w = Window.partitionBy("key")
            todo = rows if not turn else rows.where(F.col("n") > FEW)
            named = [] if label == "id" else [label]
            center = F.min(F.struct((F.col("label") == F.col("base") if turn else F.lit(False)).alias("in_base"), "pos", "id", *named)).over(w)
            starred = todo.select("key", "id", "pos", "role", *named, center.alias("center"), F.min(label).over(w).alias("x"), F.max(label).over(w).alias("y"), F.bit_or("role").over(w).alias("roles"))
            starred = starred.where("x <> y").where(F.col("roles") == HOME | LEAD)
            starred = written(starred.select("key", "id", "pos", "role", F.col(label).alias("label"), F.struct("center.id", "center.pos", F.col(f"center.{label}").alias("label")).alias("center")))
            if starred.isEmpty():
                break
            pairs = _pairs(starred.where("label <> center.label").withColumn("row", F.struct("id", "pos", "label")), "center", "row")
            good = checked(pairs, level)
            if turn and good.isEmpty():
                break
            rows = starred.drop("center") if not turn else rows.drop("base", "n", "pairs")
            rows, label = written(parted(renamed(rows, good))), "label"
        if not turn and starred.isEmpty():
            break
        now, more = rows, None
        if level < LEVELS and not (many := rows.where(F.col("n") > FEW)).isEmpty():
            # The others meet again by one more shingle, if that leaves them few pairs: rows that share much would be in ever more buckets.
            more = written(split(many, level))
            left = more.groupBy("of", "key").agg(F.count("*").alias("c")).where("c > 1").groupBy("of").agg(F.sum(F.col("c") * F.col("c")).alias("left"))
            kept = many.select("key", "pairs").distinct().join(left.withColumnRenamed("of", "key"), "key").where("2 * left > pairs").select("key")
            kept = written(kept)
            now = rows.where(F.col("n") <= FEW).unionByName(many.join(kept, "key", "left_semi"))
            more = more.join(kept.select(F.col("key").alias("of")), "of", "left_anti").drop("of")
        row = F.struct("id", "pos", "role", "label", (F.col("label") != F.col("base")).alias("apart"))
        met = now.where("label <> base").select("key", row.alias("l")).join(now.select("key", row.alias("r")), "key")
        met = met.where("l.label <> r.label and (not r.apart or l.id < r.id)").where(F.col("l.role").bitwiseOR(F.col("r.role")) == HOME | LEAD)
        good = checked(_pairs(met, "l", "r"), level)
        if more is None:
            break
        rows = renamed(more, good)
    return found.select("a", "b") if found is not None else spark.createDataFrame([], "a long, b long")


def near_duplicates(documents: DataFrame, shingle: int = 5, threshold: float = 0.8, common: int = 1 << 20, seen: list | None = None) -> DataFrame:
    """doc_id and class_id (the lowest id that can be reached) of every document: texts are linked whose word shingles' Jaccard similarity is the threshold or more.

    Equal texts are one text first. Of two sets that similar, each has one of the other's shingles among its first
    ``n - ceil(threshold * n) + 1`` in any order that all sets share. The order is by frequency, rarest first, from a table of
    ``common`` cells that counts all shingles, so frequent ones come last in a corpus of any size. Texts meet by such a
    shingle where their sizes allow the threshold, and those pairs are verified that sizes, positions and bitmaps allow.

    In a bucket every text is compared with one of them, which connects those close to it in all buckets. Where many are still
    apart, that is done anew with another. If few are apart then, those are compared with all; if many, the bucket is split
    by the next shingle that similar texts share, up to ``LEVELS`` of them, where that leaves half as many pairs or fewer, and
    those connected already are not compared again. So boilerplate that many texts share does not make pairs of them all, and no link between classes is lost. A null
    text has no shingles and is linked to null texts only.

    The documents are read once for the frequencies, once for the first shingles and once for each step that verifies
    pairs, so neither texts nor their sets are kept beside them.
    """
    spark = documents.sparkSession
    ship(spark)
    with shuffles_end(spark):
        texts = documents.where("text is not null").select(F.col("doc_id").cast("long").alias("id"), "text")
        members = cut(documents.select("doc_id", F.coalesce(F.sha2("text", 256), F.lit("null")).alias("h")))
        classes = components(links(texts, shingle, threshold, common, seen))
        sets = members.groupBy("h").agg(F.min("doc_id").alias("id"))
        named = cut(sets.join(classes.withColumnRenamed("node", "id"), "id", "left").select("h", F.coalesce("component", "id").alias("class_id")))
        return members.join(named, "h").select("doc_id", "class_id")
