"""Connected components of a graph of links, as joins and aggregations; and numbers of rows in an order."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One step of the alternating star algorithm (Kiveris et al., 2014): links every neighbour of a node to the least of the node and its neighbours.

    The least neighbour comes from an aggregation and is joined back, so a node with very many links is pre-aggregated and its rows may be split among tasks.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    if not large:
        both = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): for every node of ``links`` (columns a and b) the least node that it reaches.

    Each round ends in files of the shared folder. A null or a loop is no link; an empty table has no nodes.
    Without convergence in ``rounds`` rounds (far above the logarithm of any input) it raises.
    """
    links = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(rounds):
        now = links.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("h"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("x")).first()
        if now == mark or not now.n:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(links.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        mark = now
        links = cut(_stars(_stars(links, True), False))
    raise RuntimeError(f"no convergence in {rounds} rounds")


def numbered(df: DataFrame, name: str, *order, partitions: int | None = None) -> DataFrame:
    """The rows with their places (from 1) in the order, as ``name``. No task sees all of them.

    Rows are dealt out in ranges of the order and written; a row's place is that in its range after the sizes of the
    ranges before it, of which there is one for each task.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order))
    at = held.withColumn(name, F.monotonically_increasing_id())
    part = F.shiftright(name, 33)
    sizes = {r.part: r.n for r in at.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # a row for each range
    starts, total = {}, 0
    for own in sorted(sizes):
        starts[own], total = total, total + sizes[own]
    table = F.from_json(F.lit(str([starts.get(i, 0) for i in range(max(starts, default=0) + 1)])), "array<long>")
    return at.withColumn(name, F.get(table, part.cast("int")) + F.col(name).bitwiseAND(F.lit((1 << 33) - 1)) + 1)
