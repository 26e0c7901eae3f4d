"""What several operators of this subpackage share."""

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, shared_dir, ship  # noqa: F401

#: Characters that separate words: the blank and \x09 to \x0D.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def free(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of ``df`` has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> None:
    """The package on the executors; and, where the session has no setting of its own, Arrow batches of 4 MB.

    That is one value for all operators, so no plan depends on what was called last. Without it Spark hands over
    64 MB at a time, and buffers of such batches take most of a small executor's memory.
    """
    ship(spark)
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, "4m")


def pieces(batches, rows: int = 500, size: int = 1 << 25):
    """The batches in slices of at most so many rows and (but for a single row) bytes, so that a task never holds more than that decoded.

    Spark itself ends a batch by bytes too (see ``prepare``).
    """
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * size // max(batch.nbytes, 1)))
        for i in range(0, batch.num_rows, step):
            part = batch.slice(i, step)
            if part.num_rows > 1 and part.nbytes > size:  # long texts side by side
                yield from (part.slice(k, 1) for k in range(part.num_rows))
            else:
                yield part


def join_keyed(rows: DataFrame, small: DataFrame, key: str, spread: str, limit: int = 200_000, salts: int = 32) -> DataFrame:
    """Left join of many rows, one key of which may hold a third of them, to one row per key.

    Up to ``limit`` keys (counted, not estimated) the small side is broadcast. Beyond it the key is
    salted with a hash of the column ``spread`` and the small side repeated for each salt.
    """
    prepare(rows.sparkSession)
    if small.limit(limit + 1).count() <= limit:
        return rows.join(F.broadcast(small), key, "left")
    (salt,) = free(rows, "salt")
    salted = rows.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [key, salt], "left").drop(salt)


def held_out(doc_id="doc_id"):
    """True for the fifth of the documents that no model learns from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column's strings; a null is an empty text."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


_resident: dict = {}


def resident(key, make):
    """What a worker keeps from task to task: one large object at a time."""
    if key not in _resident:
        _resident.clear()
        _resident[key] = make()
    return _resident[key]


def release() -> None:
    """Called by tasks that need none of it, in a worker that may have kept one."""
    _resident.clear()
