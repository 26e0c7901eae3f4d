"""Session settings, and the package on the executors."""

import os
import tempfile
import threading
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_shipping = threading.Lock()


def get_session(master: str = "local[8]", partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session with the settings that the operators expect: UTC, adaptive execution with skew joins."""
    builder = SparkSession.builder.master(master).config("spark.driver.memory", memory)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.shuffle.partitions": str(partitions), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application (as --py-files would), whichever thread asks first."""
    context = spark.sparkContext
    with _shipping:
        if context.applicationId in _shipped:
            return
        root = os.path.dirname(os.path.abspath(__file__))
        target = os.path.join(tempfile.mkdtemp(), "quillspark.zip")
        with zipfile.ZipFile(target, "w") as z:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(root)))
        context.addPyFile(target)
        _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from spark.checkpoint.dir. Where none is set, a temporary one on a single machine; on a cluster an error, as executors would not see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"


def written(df: DataFrame) -> DataFrame:
    """The rows from a Parquet table of their own in the shared folder: like ``cut``, and nothing of the plan before is known to what follows, columns' identities included."""
    path = f"{shared_dir(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """The rows, materialised once in the shared folder, so that a lost executor costs no recomputation and what follows starts from files."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


_SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_end(spark: SparkSession):
    """Within it, and where the session has no setting of its own, a query's shuffle files go when it has ended, not when the driver happens to collect its garbage. For work in steps, each of which is written before the next one."""
    own = spark.conf.get(_SHUFFLES_END, None)
    if own is None:
        spark.conf.set(_SHUFFLES_END, "true")
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(_SHUFFLES_END)
