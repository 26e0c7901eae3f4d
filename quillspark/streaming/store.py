"""A store of results by key that batches are added to as a whole, and in which few files are opened to look keys up.

    store/data/<batch>/...      the rows of a batch, dealt out by ranges of a hash of their keys
    store/manifest/<batch>/...  one row for each of its files: path, rows, least and greatest hash, and a Bloom filter of the hashes

A batch belongs to the store from the moment its manifest is renamed into place; what a batch that died left under
``data`` is never read. Keys are looked up in the manifest first: a file is opened only if one of them lies between its
least and greatest hash and passes its filter.
"""

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import free
from ..session import ship
from ..sources import files

#: Bits of a filter for each key, and how many of them a key sets: about one wrong answer in 15,000.
BITS, HASHES = 20, 14
MANIFEST = "path string, n long, lo long, hi long, bloom binary"
#: Keys of a batch up to this number (counted) are sent to the tasks that read the manifest; a larger batch meets all files, as it would anyway.
LOOKED_UP = 1_000_000


def _places(keys: np.ndarray, size: int) -> np.ndarray:
    """The bits of each key in a filter of ``size`` bits: sums of two halves of its hash."""
    raw = keys.astype(np.uint64)
    low, high = raw & np.uint64(0xFFFFFFFF), (raw >> np.uint64(32)) | np.uint64(1)
    return ((low[:, None] + np.arange(HASHES, dtype=np.uint64) * high[:, None]) % np.uint64(size)).astype(np.int64)


def bloom(keys: np.ndarray) -> bytes:
    size = max(8, -(-len(keys) * BITS // 8) * 8)
    bits = np.zeros(size, np.uint8)
    bits[_places(keys, size).ravel()] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def passes(keys: np.ndarray, raw: bytes) -> np.ndarray:
    """Whether each key may be one of those that the filter was made of. One that is, always passes."""
    table = np.frombuffer(raw, np.uint8)
    at = _places(keys, 8 * len(table))
    return ((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def _described(key, rows):
    """The manifest's row of one file, from the hashes of its rows."""
    hashes = np.unique(rows.column("h").to_numpy())
    return pa.table({"path": [key[0].as_py()], "n": pa.array([rows.num_rows], pa.int64()), "lo": pa.array(hashes[:1]), "hi": pa.array(hashes[-1:]), "bloom": pa.array([bloom(hashes)], pa.binary())})


class Store:
    """schema: that of the rows. keys: the columns that tell rows' keys. rows_per_file: at most so many rows, whose hashes one task holds, go to a file."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], rows_per_file: int = 1_000_000):
        self.spark, self.path, self.schema, self.keys, self.rows_per_file = spark, path.rstrip("/"), schema, keys, rows_per_file
        ship(spark)

    def _hash(self):
        return F.xxhash64(*self.keys)

    def manifest(self) -> DataFrame:
        """path, n, lo, hi and bloom of every file of every batch that was added."""
        at = f"{self.path}/manifest"
        batches = [f"{at}/{x}" for x in files.names(self.spark, at) if not x.startswith((".", "_"))]
        return self.spark.read.schema(MANIFEST).parquet(*batches) if batches else self.spark.createDataFrame([], MANIFEST)

    def add(self, rows: DataFrame, partitions: int | None = None) -> None:
        """Adds a batch, all of it or, if anything fails, nothing."""
        batch = uuid.uuid4().hex
        data, staged = f"{self.path}/data/{batch}", f"{self.path}/manifest/.staged-{batch}"
        (h,) = free(rows, "h")
        n = partitions or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = rows.withColumn(h, self._hash()).repartitionByRange(n, h).sortWithinPartitions(h).drop(h)
        try:
            dealt.write.option("maxRecordsPerFile", self.rows_per_file).parquet(data)
            written = self.spark.read.schema(self.schema).parquet(data)
            hashed = written.select(F.input_file_name().alias("path"), self._hash().alias("h"))
            hashed.groupBy("path").applyInArrow(_described, MANIFEST).coalesce(1).write.parquet(staged)
            files.move(self.spark, staged, f"{self.path}/manifest/{batch}")
        except BaseException:
            files.delete(self.spark, staged)
            files.delete(self.spark, data)
            raise

    def read(self, paths: list[str] | None = None) -> DataFrame:
        """The rows of the files, or of the whole store."""
        if paths is None:
            paths = [r.path for r in self.manifest().select("path").collect()]  # a name for each file
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def files_for(self, keys: DataFrame) -> list[str]:
        """The files that may hold one of the keys. The manifest is filtered in tasks; names come to the driver, which has to open them."""
        wanted = keys.select(self._hash().alias("h")).distinct().limit(LOOKED_UP + 1).toArrow().column("h").to_numpy()
        manifest = self.manifest()
        if len(wanted) > LOOKED_UP:
            return [r.path for r in manifest.select("path").collect()]
        shared = self.spark.sparkContext.broadcast(np.sort(wanted))

        def run(batches):
            hashes = shared.value
            for batch in batches:
                found = []
                for path, lo, hi, raw in zip(*(batch.column(c).to_pylist() for c in ("path", "lo", "hi", "bloom"))):
                    own = hashes[np.searchsorted(hashes, lo, "left") : np.searchsorted(hashes, hi, "right")]
                    if len(own) and passes(own, raw).any():
                        found.append(path)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["path"])

        return [r.path for r in manifest.select("path", "lo", "hi", "bloom").mapInArrow(run, "path string").collect()]

    def without_known(self, rows: DataFrame) -> DataFrame:
        """The rows whose keys the store does not hold; of the store, only files that may hold one are read, and only their keys. Null keys are keys."""
        known = self.read(self.files_for(rows)).select(*(F.col(k).alias(f"known_{i}") for i, k in enumerate(self.keys))).distinct()
        same = [F.col(k).eqNullSafe(F.col(f"known_{i}")) for i, k in enumerate(self.keys)]
        condition = same[0]
        for x in same[1:]:
            condition = condition & x
        return rows.join(known, condition, "left_anti")
