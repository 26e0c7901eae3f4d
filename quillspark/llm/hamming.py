"""Exact top-k search in binary codes by incremental multi-index hashing.

Codes of 64 bits are cut into segments of about log2(codes) bits, and the index has a row for each code and
segment. A query's radius grows segment by segment: at radius r it probes all values of a segment that differ from
its own in exactly r bits, and an equi-join on (segment, value) meets the codes that have them. With radius r in
the segments up to j, and r - 1 in those after it, every code within segments * r + j bits has been met, since a
farther one differs by more in each segment. What is met is verified by its whole distance, which must not
exceed the kth verified one so far; a query whose kth distance is covered in that sense is done, and only the
others go on. Steps with few probes make one round together.

A pair that meets in several segments or radii counts where it meets first (least radius, then segment), which
follows from the two codes alone; so nothing has to be remembered or made distinct. Distinct codes only are
searched, each with its k + 1 lowest ids; equal codes with higher ids cannot be among the k nearest, ties going
to the lower id. A query sends on its k + 1 best from each task.

Defined results: a null vector has no code and is neither found nor a query; null elements count as 0, and
so do missing ones; longer vectors are an error; repeated ids are members each; fewer than k other rows give
fewer neighbours; an empty table gives an empty result; other columns are ignored; there are no texts.
"""

import json
from itertools import combinations
from math import comb, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, pieces, prepare

BITS = 64


def sign_codes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id and code: bit i is 1 if element i is above 0."""
    prepare(vectors.sparkSession)

    def run(batches):
        for batch in pieces(batches, rows=4096):
            rows = batch.column(1).to_pylist()
            if any(len(x) > BITS for x in rows):
                raise ValueError(f"vectors have more than {BITS} elements")
            signs = np.zeros((len(rows), BITS), np.uint8)
            for i, x in enumerate(rows):
                signs[i, : len(x)] = [e is not None and e > 0 for e in x]
            codes = np.packbits(signs, axis=1, bitorder="little").view("<i8").ravel()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.int64())], names=["id", "code"])

    return vectors.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long"), vector).mapInArrow(run, "id long, code long")


#: Steps are taken together up to so many probes (counted for the queries at hand); what a round costs besides does not depend on them.
AT_ONCE = 2_000_000
#: Up to so many rows (counted) the index is broadcast; beyond, probes and index are both dealt out by segment and value.
SMALL = 500_000


def layout(n: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of each segment for n codes: so many bits that a value has about four codes, where probes and codes met are about as many."""
    segments = max(2, min(16, round(BITS / max(log2(max(n, 1)) - 2, 4))))
    edges = [BITS * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def steps(segments: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(radius, segment) in the order in which they are searched; after step i codes within i bits have been met."""
    return [(radius, j) for radius in range(max(w for _, w in segments) + 1) for j in range(len(segments))]


def _ones(width: int, most: int) -> list[list[int]]:
    """All numbers of ``width`` bits by how many ones they have, up to ``most``."""
    return [[sum(1 << b for b in bits) for bits in combinations(range(width), r)] for r in range(min(width, most) + 1)]


def _flips(segments: list[tuple[int, int]], chosen: list[tuple[int, int]]) -> F.Column:
    """What the chosen steps flip: per step the segment's bits, and (low, high) lists whose pairs make up all numbers with ``radius`` ones."""
    rows = []
    for radius, j in chosen:
        start, width = segments[j]
        half = width // 2
        low, high = _ones(half, radius), _ones(width - half, radius)
        rows += [{"segment": j, "radius": radius, "start": start, "mask": (1 << width) - 1, "half": half, "low": low[a], "high": high[radius - a]} for a in range(len(low)) if 0 <= radius - a < len(high)]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<segment int, radius int, start int, mask long, half int, low array<long>, high array<long>>>")


def segment(code: str, start: int, width: int) -> F.Column:
    return F.shiftrightunsigned(code, start).bitwiseAND(F.lit((1 << width) - 1)) if width < BITS else F.col(code)


def probes(queries: DataFrame, segments: list[tuple[int, int]], chosen: list[tuple[int, int]]) -> DataFrame:
    """segment, radius, value, query and bound: for each step chosen, all values of the segment that differ from the query's own in exactly ``radius`` bits."""
    own = queries.select(F.col("code").alias("query"), "bound", F.inline(_flips(segments, chosen)))
    own = own.select("query", "bound", "segment", "radius", F.expr("shiftrightunsigned(query, start) & mask").alias("own"), "half", "high", F.explode("low").alias("low"))
    own = own.select("query", "bound", "segment", "radius", "own", "half", "low", F.explode("high").alias("high"))
    return own.select("segment", "radius", F.expr("own ^ low ^ shiftleft(high, half)").alias("value"), "query", "bound")


def _met_first(difference: F.Column, segments: list[tuple[int, int]]) -> F.Column:
    """Whether this segment and radius are the first to bring two codes together: they differ more in the segments before it, and no less in those after it."""
    out = F.lit(True)
    for j, (start, width) in enumerate(segments):
        bits = F.bit_count(difference.bitwiseAND(F.lit(((1 << width) - 1 << start) - (1 << 64 if start + width == 64 else 0))))
        out = out & F.when(F.col("segment") > j, bits > F.col("radius")).when(F.col("segment") < j, bits >= F.col("radius")).otherwise(True)
    return out


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, neighbor_id and distance: for each query (id, code) its k nearest rows of ``codes``, itself left out."""
    codes, queries = cut(codes.select("id", "code")), cut(queries.select("id", "code"))
    lowest = Window.partitionBy("code").orderBy("id")
    # The rank's limit is applied before the shuffle too, so a very common code sends k + 1 rows a task at most.
    members = codes.withColumn("r", F.row_number().over(lowest)).where(F.col("r") <= k + 1).groupBy("code").agg(F.collect_list("id").alias("members"))
    distinct = cut(members.withColumn("least", F.array_min("members")))
    segments = layout(distinct.count())
    values = F.array(*(F.struct(F.lit(j).alias("segment"), segment("code", *s).alias("value")) for j, s in enumerate(segments)))
    index = cut(distinct.select(F.explode(values).alias("x"), "code", "least").select("x.segment", "x.value", "code", "least"))
    index = F.broadcast(index) if index.limit(SMALL + 1).count() <= SMALL else index
    tasks = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    active = cut(queries.select("code").distinct().withColumn("bound", F.lit(BITS)).repartition(tasks, "code"))
    first = lambda rows, *order: rows.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("r") <= k + 1).drop("r")
    difference = F.col("query").bitwiseXOR(F.col("code"))
    found, done, ahead, covered = None, [], steps(segments), -1
    while ahead:
        n, volume, chosen = active.count(), 0, []
        while ahead and (not chosen or volume + n * comb(segments[ahead[0][1]][1], ahead[0][0]) <= AT_ONCE):
            radius, j = ahead.pop(0)
            covered += 1
            volume += n * comb(segments[j][1], radius)
            if radius <= segments[j][1]:
                chosen.append((radius, j))
        if not n or not chosen:
            break
        pairs = probes(active, segments, chosen).join(index, ["segment", "value"]).where((F.bit_count(difference) <= F.col("bound")) & _met_first(difference, segments))
        # The k + 1 nearest ids have their codes among the k + 1 that are nearest by distance and least id.
        near = first(pairs.select("query", "code", F.bit_count(difference).alias("distance"), "least"), "distance", "least")
        rows = near.join(distinct.select("code", "members"), "code").select("query", F.explode("members").alias("id"), "distance")
        found = cut(first(rows if found is None else found.unionByName(rows), "distance", "id"))
        kth = found.groupBy(F.col("query").alias("code")).agg(F.when(F.count("*") > k, F.max("distance")).otherwise(BITS).alias("bound"), F.count_if(F.col("distance") <= covered).alias("sure"))
        active = cut(active.select("code").join(kth, "code", "left").where(F.coalesce("sure", F.lit(0)) <= k).select("code", F.coalesce("bound", F.lit(BITS)).alias("bound")).repartition(tasks, "code"))
        unsure = active.select(F.col("code").alias("query"))
        done.append(found.join(unsure, "query", "left_anti"))
        found = found.join(unsure, "query", "left_semi")
    if found is None:
        found = cut(active.select(F.col("code").alias("query"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("int").alias("distance")).where("false"))
    for part in done:
        found = found.unionByName(part)
    lists = cut(found.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("distance", "id"))).alias("near")))
    own = queries.join(lists, queries["code"] == lists["query"]).select(F.col("id").alias("query_id"), F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k).alias("near"))
    return own.select("query_id", F.posexplode("near").alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("neighbor_id"), F.col("x.distance").cast("long").alias("distance"))
