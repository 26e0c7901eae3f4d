"""All queries by name, each run with the package on the executors, and the SQL of those that SQL can say."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from . import captions, lectures, pages, records

AREAS = (captions, pages, lectures, records)


def with_package(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: with_package(f) for area in AREAS for name, f in area.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for area in AREAS for name, sql in area.SQL.items()}
