"""Folders of any store that Hadoop's FileSystem reaches: whether they are there, renaming, deleting."""

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    """The path, and the file system that it is in."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    at, fs = _at(spark, path)
    fs.delete(at, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """What is in a folder, by name; nothing where there is none."""
    at, fs = _at(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def move(spark: SparkSession, source: str, target: str) -> None:
    """Renames a folder in its store, in one step where the store can. What is at the target already is an error, and stays as it is.

    A rename of Hadoop's may also move a folder into one that is there; so the target is looked up first, and what was moved into it is moved out again.
    """
    (a, fs), (b, _) = _at(spark, source), _at(spark, target)
    if fs.exists(b):
        raise FileExistsError(f"{target} already exists")
    fs.mkdirs(b.getParent())
    if not fs.rename(a, b):
        raise FileExistsError(f"{source} could not be moved: {target} already exists or is out of reach")
    inside = spark._jvm.org.apache.hadoop.fs.Path(b, a.getName())
    if fs.exists(inside):  # another writer was there between the two
        fs.rename(inside, a)
        raise FileExistsError(f"{target} already exists")
