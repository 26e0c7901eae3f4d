"""Token ids in binary blocks whose document boundaries are Elias-Fano encoded.

``write`` encodes every text, appends an end id and writes the ids in ascending order of the document id.
The file is a Parquet dataset, so that any store Spark can write holds it and the write commits as one; each
row is one block: ``part`` and ``seq`` give the order, ``n_ids`` the ids in it, ``before`` those of the part before it, and ``block`` the bytes

    magic "EFT2" | id width (1 byte) | low bits (1 byte) | 2 bytes free | documents (8 bytes) | ids (8 bytes)
    | low parts of the boundaries | high parts, unary | index | document ids (8 bytes each) and null flags | ids

with all numbers little-endian. A boundary's low bits are packed side by side and its high bits written as a
gap in unary, which takes about 2 + log2(ids / documents) bits a document. The index has 5 bytes for every
64th one among the high bits: the byte that holds it (4) and how many ones that byte has before it (1).
``select`` starts from there and unpacks only the bits it needs, so that no table of all boundaries is made.

Defined results: a null or empty text is the end id alone; a null document id sorts first; equal document
ids are kept, in the order of a hash of their texts, and may be split among tasks; a very long text is one
document of a block of its own size; repeated rows are documents each; an empty table gives an empty file;
other columns are ignored.
"""

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import pieces, prepare, texts

MAGIC = b"EFT2"
HEADER = struct.Struct("<4sBBHQQ")
SAMPLE = 64


class EliasFano:
    """Non-decreasing numbers below ``universe`` + 1 in about 2 + log2(universe / n) bits each, and 5 / 8 bits for the index."""

    def __init__(self, n: int, width: int, low: bytes, high: bytes, index: bytes):
        self.n, self.width = n, width
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        samples = -(-n // SAMPLE)
        self.bytes, self.skips = np.frombuffer(index, "<u4", samples), np.frombuffer(index, np.uint8, samples, 4 * samples)

    @staticmethod
    def sizes(n: int, n_ids: int, width: int) -> tuple[int, int, int]:
        """Bytes of the low parts, the high parts and the index."""
        return (n * width + 7) // 8, (n + (n_ids >> width) + 8) // 8, 5 * -(-n // SAMPLE)

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> tuple[int, bytes, bytes, bytes]:
        n = len(values)
        width = max(0, int(universe // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        low = ((values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
        ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        high = np.zeros(n + (universe >> width) + 1, np.uint8)
        high[ones] = 1
        every = np.arange(0, n, SAMPLE)
        starts = ones[every] >> 3
        skips = every - np.searchsorted(ones, starts << 3)
        index = starts.astype("<u4").tobytes() + skips.astype(np.uint8).tobytes()
        return width, np.packbits(low, bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), index

    def select(self, first: int, last: int) -> np.ndarray:
        """The numbers from the first-th up to, but without, the last-th. The bytes from the sampled one before ``first`` to that after ``last`` are unpacked."""
        if first >= last:
            return np.zeros(0, np.int64)
        own, end = first // SAMPLE, (last - 1) // SAMPLE + 1
        a, b = int(self.bytes[own]), int(self.bytes[end]) + 1 if end < len(self.bytes) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[a:b], bitorder="little"))
        at = first - own * SAMPLE + int(self.skips[own])
        ones = ones[at : at + last - first] + 8 * a
        x, y = first * self.width, last * self.width
        bits = np.unpackbits(self.low[x // 8 : (y + 7) // 8], bitorder="little")[x % 8 : x % 8 + y - x]
        low = bits.reshape(last - first, self.width).astype(np.int64) @ (np.int64(1) << np.arange(self.width, dtype=np.int64))
        return ((ones - np.arange(first, last)) << self.width) | low


def pack(doc_ids: list[int | None], documents: list[bytes], dtype: np.dtype) -> bytes:
    """One block of documents, each given as the bytes of its ids."""
    ends = np.cumsum([len(x) // dtype.itemsize for x in documents], dtype=np.int64)
    width, *parts = EliasFano.encode(ends, int(ends[-1]))
    head = HEADER.pack(MAGIC, dtype.itemsize, width, 0, len(documents), int(ends[-1]))
    named = np.array([x or 0 for x in doc_ids], "<i8").tobytes()
    nulls = np.packbits(np.array([x is None for x in doc_ids], np.uint8), bitorder="little").tobytes()
    return b"".join([head, *parts, named, nulls, *documents])


class Block:
    """Reads what ``pack`` wrote."""

    def __init__(self, raw: bytes):
        magic, item, width, _, self.n, self.n_ids = HEADER.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        at = HEADER.size
        cuts = []
        for size in (*EliasFano.sizes(self.n, self.n_ids, width), 8 * self.n, (self.n + 7) // 8):
            cuts.append(memoryview(raw)[at : at + size])
            at += size
        self.ends = EliasFano(self.n, width, *cuts[:3])
        self.named, self.nulls = np.frombuffer(cuts[3], "<i8"), np.frombuffer(cuts[4], np.uint8)
        self.ids = np.frombuffer(raw, f"<u{item}", self.n_ids, at)

    def doc_ids(self, first: int, last: int) -> pa.Array:
        null = np.unpackbits(self.nulls[first // 8 : (last + 7) // 8], bitorder="little")[first % 8 : first % 8 + last - first]
        return pa.array(self.named[first:last], pa.int64(), mask=null.astype(bool))

    def bounds(self, first: int, last: int) -> np.ndarray:
        """Where the documents from first to last begin, and where the last of them ends."""
        ends = self.ends.select(max(first - 1, 0), last)
        return ends if first else np.concatenate([[0], ends])

    def document(self, i: int) -> np.ndarray:
        a, b = self.bounds(i, i + 1)
        return self.ids[a:b]


def write(docs: DataFrame, spec: dict, path: str, end_id: int, block_ids: int = 1 << 20, partitions: int | None = None) -> None:
    """Range-partitions by document id, so that every task encodes and writes a run of the order. A block holds whole documents, about ``block_ids`` ids.

    Documents of one id (or of none) are dealt on by a hash of the text and the row's place in the input, so that a frequent id is no single task's.
    """
    spark = docs.sparkSession
    prepare(spark)

    def run(batches):
        from pyspark import TaskContext

        enc, part, seq = encoder(spec), TaskContext.get().partitionId(), 0
        end = np.array([end_id], enc.dtype).tobytes()
        names, held, size, before = [], [], 0, 0

        def block():
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "n_docs": [len(held)], "n_ids": [size // enc.dtype.itemsize], "before": [before], "block": [pack(names, held, enc.dtype)]}, schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("before", pa.int64()), ("block", pa.binary())]))

        for batch in pieces(batches):
            for name, ids in zip(batch.column(0).to_pylist(), enc.encode(texts(batch))):
                names.append(name)
                held.append(ids + end)
                size += len(held[-1])
                if size >= block_ids * enc.dtype.itemsize:
                    yield block()
                    before += size // enc.dtype.itemsize
                    names, held, size, seq = [], [], 0, seq + 1
        if held:
            yield block()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("tie"), F.monotonically_increasing_id().alias("place"))
    order = ["doc_id", "tie", "place"]
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ordered.select("doc_id", "text").mapInArrow(run, "part int, seq int, n_docs long, n_ids long, before long, block binary").write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str, at_once: int = 500) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, and ids of every document in the file.

    Where each part starts comes from a row for each task that wrote (``partitions`` of ``write`` at most), which is what is summed up and broadcast.
    """
    blocks = spark.read.parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    before = F.sum("part_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("part_start"))
    prepare(spark)

    def run(batches):
        for batch in pieces(batches, rows=1):
            start, block = batch.column(0)[0].as_py(), Block(batch.column(1)[0].as_buffer().to_pybytes())
            for i in range(0, block.n, at_once):
                last = min(i + at_once, block.n)
                own = block.bounds(i, last)
                ids = pa.ListArray.from_arrays(pa.array((own - own[0]).astype(np.int32)), pa.array(block.ids[own[0] : own[-1]].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([block.doc_ids(i, last), pa.array(own[:-1] + start, pa.int64()), pa.array(np.diff(own), pa.int64()), ids], names=["doc_id", "start", "n_tokens", "ids"])

    starts = blocks.join(F.broadcast(parts), "part").select((F.col("part_start") + F.col("before")).alias("start"), "block")
    return starts.mapInArrow(run, "doc_id long, start long, n_tokens long, ids array<int>")


def crc32_of_ids(rows: DataFrame) -> DataFrame:
    """Adds ``ids_crc32``: of the ids as little-endian unsigned 32-bit integers."""
    from zlib import crc32

    prepare(rows.sparkSession)

    def run(batches):
        for batch in pieces(batches):
            column = batch.column(batch.schema.get_field_index("ids"))
            sums = [crc32(x.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()) for x in column]
            keep = [batch.schema.get_field_index(c) for c in ("doc_id", "start", "n_tokens")]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
