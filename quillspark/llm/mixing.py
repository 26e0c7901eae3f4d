"""Mixing sources to target weights by Poisson replication.

A source with n of N documents and target weight w is to be repeated w * size * N / n times on average. Each
document draws its number of copies from a Poisson distribution of that mean: a hash of the seed, its id and
its text is a uniform number, which inverts the distribution. Documents are exploded by their counts and dealt
out and sorted by another hash, which is a global shuffle that any rerun repeats.

A mean above ``PIECE`` is the sum of several draws of equal means up to ``PIECE``, each with a hash of its
own, so that no table of probabilities underflows; a table of 64 sums is exact to double precision there.

Defined results: a null source is a source of its own; a source without a weight (or with weight 0) is
left out; a null text is kept as it is, and drawn like an empty one; a null id is drawn by its text; rows of
equal id and text draw equal counts and keys, and are dealt to several tasks by their place in the input;
very long texts are hashed whole and moved once; an empty table gives an empty result; other columns, of any
name, are kept, and an added column whose name is taken gets an underscore behind it.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free, join_keyed

PIECE = 8.0
STEPS = 64
#: Tasks that rows of one shuffle key may be dealt to.
SPREAD = 32


def digest(seed: str, *parts) -> F.Column:
    return F.md5(F.concat_ws(":", F.lit(seed), *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts)))


def uniform(seed: str, *parts) -> F.Column:
    """A number in [0, 1) with 52 random bits, from the MD5 of the seed and the parts."""
    return F.conv(F.substring(digest(seed, *parts), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def tempered_weights(docs: DataFrame, power: float = 0.5, source: str = "source") -> DataFrame:
    """source and weight: shares of documents to a power, so that small sources are raised."""
    return docs.groupBy(F.col(source).alias("source")).agg(F.pow(F.count("*").cast("double"), F.lit(power)).alias("weight"))


def repetition_rates(docs: DataFrame, weights: DataFrame, size: float = 1.0, source: str = "source") -> DataFrame:
    """source, rate, pieces (draws) and cdf (sums of the probabilities of 0, 1, ... copies in one draw)."""
    counts = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"))
    wanted = weights.select(F.col("source").alias("wanted"), F.col("weight").cast("double").alias("weight"))
    counted = cut(counts.join(wanted, F.col("source").eqNullSafe(F.col("wanted")), "left").select("source", "n", "weight"))
    total = counted.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("weight") > 0, F.col("weight"))).alias("w")).first()
    sources = counted.where("weight > 0")
    rate = F.col("weight") / F.lit(total.w or 1.0) * F.lit(size * (total.n or 0)) / F.col("n")
    rates = sources.select("source", rate.alias("rate")).withColumn("pieces", F.greatest(F.ceil(F.col("rate") / PIECE), F.lit(1)).cast("int"))
    mean = F.col("rate") / F.col("pieces")
    first = F.exp(-mean)
    sums = F.aggregate(
        F.sequence(F.lit(1), F.lit(STEPS - 1)),
        F.struct(first.alias("p"), first.alias("total"), F.array(first).alias("cdf")),
        lambda s, k: F.struct((s["p"] * mean / k).alias("p"), (s["total"] + s["p"] * mean / k).alias("total"), F.concat(s["cdf"], F.array(s["total"] + s["p"] * mean / k)).alias("cdf")),
        lambda s: s["cdf"],
    )
    return rates.withColumn("cdf", sums)


def mix(docs: DataFrame, weights: DataFrame | None = None, size: float = 1.0, seed: str = "mix", source: str = "source", text: str = "text", partitions: int | None = None) -> DataFrame:
    """The documents, each as often as drawn, in shuffled order; with copy (from 1), n_copies and shuffle_key, or free names like these."""
    rates = cut(repetition_rates(docs, tempered_weights(docs, source=source) if weights is None else weights, size, source))
    copy, n_copies, shuffle_key, name, draws, cdf, body, place = free(docs, "copy", "n_copies", "shuffle_key", "source_key", "draws", "cdf", "text_hash", "place")
    keyed = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    table = rates.select(keyed("source").alias(name), F.col("pieces").alias(draws), F.col("cdf").alias(cdf))
    rows = docs.withColumn(name, keyed(source)).withColumn(body, F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))).withColumn(place, F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)))
    rated = join_keyed(rows, table, name, body)
    numbers = F.transform(F.sequence(F.lit(1), F.col(draws)), lambda j: uniform(seed, F.col("doc_id"), F.col(body), j))
    count = F.aggregate(numbers, F.lit(0), lambda total, u: total + F.size(F.filter(cdf, lambda c: c <= u)))
    drawn = rated.where(F.col(draws).isNotNull()).withColumn(n_copies, count).where(F.col(n_copies) > 0)
    copies = drawn.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n_copies))))
    key = F.conv(F.substring(digest(seed, F.lit("order"), F.col("doc_id"), F.col(body), F.col(copy)), 1, 15), 16, 10).cast("long")
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = copies.select(*docs.columns, copy, n_copies, key.alias(shuffle_key), place).repartition(n, shuffle_key, place)
    return dealt.sortWithinPartitions(shuffle_key, "doc_id", copy).drop(place)
