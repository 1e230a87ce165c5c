"""Exact top-k by Hamming distance: incremental multi-index hashing of binary codes.

A vector's code is the sign bits of its elements, in segments of 16 bits.  Each distinct code is
indexed once per segment, with its least ids.  Round a looks up, for each open query and
segment, all values at distance a from the query's.  A code within distance m * (a + 1) - 1
differs from the query by at most a in some of the m segments, so after round a all such codes have been
verified; a query whose k-th verified distance lies within that radius is done.  The last
round covers everything, so the answer is exact for any data.

A code is taken from its nearest segment only (the first of equals), in the round of that
distance: it is verified once, inside the join, and goes on only if it is no farther than the
k-th so far.  Copies of a code are one index entry; their ids are cut to
the k + 1 least in two steps (by salt, then by code), so a code that a third of all rows share is no hot group.

Defined results: rows without id or vector are neither indexed nor asked; a null, missing or
NaN element is bit 0; equal distances rank by id; a vector is not its own neighbour; repeated
rows count once; fewer than k others give fewer rows; other columns are not carried.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evigraph.session import cut

BITS, SALTS = 16, 16


def coded(df: DataFrame, vector: str, key: str) -> tuple[DataFrame, list[str]]:
    """(id, s0, s1, ...): the code's segments as numbers."""
    width = df.agg(F.max(F.size(vector)).alias("n")).first()["n"] or 1
    bit = lambda i: F.when((F.get(F.col(vector), F.lit(i)) > 0) & ~F.isnan(F.get(F.col(vector), F.lit(i))), F.lit(1 << i % BITS)).otherwise(F.lit(0))
    segments = [sum((bit(i) for i in range(a, min(a + BITS, width))), F.lit(0)).alias(f"s{a // BITS}") for a in range(0, width, BITS)]
    names = [f"s{j}" for j in range(len(segments))]
    return df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("id"), *segments).distinct(), names


def _places(names: list[str], value) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(j).alias("part"), value(n).alias("value")) for j, n in enumerate(names)]))


def top_k(df: DataFrame, queries: DataFrame, k: int = 10, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(query_id, rank, id, distance) for each row of ``queries``."""
    rows, names = coded(df, vector, key)
    asked = cut(coded(queries, vector, key)[0].withColumnRenamed("id", "query"), "topk-queries")
    for n in names:
        if n not in asked.columns:
            asked = asked.withColumn(n, F.lit(0))
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS))
    some = rows.withColumn("r", F.row_number().over(Window.partitionBy(*names, salt).orderBy("id"))).where(F.col("r") <= k + 1)
    least = some.withColumn("r", F.row_number().over(Window.partitionBy(*names).orderBy("id"))).where(F.col("r") <= k + 1)
    codes = cut(least.groupBy(*names).agg(F.array_sort(F.collect_list("id")).alias("ids")), "topk-codes")
    index = codes.select(_places(names, F.col).alias("p"), *[F.col(n).alias(f"c{n}") for n in names], "ids").select("p.part", "p.value", "ids", *[f"c{n}" for n in names])
    apart = [F.bit_count(F.col(n).bitwiseXOR(F.col(f"c{n}"))) for n in names]
    distance = reduce(lambda a, b: a + b, apart)
    nearest = F.least(*apart) if len(apart) > 1 else apart[0]
    first = reduce(lambda rest, j: F.when(apart[j] == nearest, F.lit(j)).otherwise(rest), reversed(range(len(names))), F.lit(-1))
    best, open_, m = None, asked.withColumn("bound", F.lit(len(names) * BITS)), len(names)
    for a in range(BITS + 1):
        probes = open_.select("query", "bound", *names, _places(names, F.col).alias("p")).select("query", "bound", *names, "p.part", F.col("p.value").alias("own"), F.explode(_at_distance(a)).alias("mask"))
        probes = probes.select("query", "bound", *names, "part", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))
        # the planner can't know how many probes a query makes, so it must not send them to every worker
        met = probes.join(index.hint("merge"), ["part", "value"]).where((nearest == a) & (first == F.col("part")) & (distance <= F.col("bound")))
        new = met.select("query", distance.alias("distance"), F.explode("ids").alias("id")).where("id != query")
        ranked = (new if best is None else best.select("query", "distance", "id").union(new)).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))).where(F.col("rank") <= k)
        best = cut(ranked.select("query", "distance", "id", "rank"), "topk-best")
        # the k-th verified distance ends a query once covered; until then nothing beyond it is of use
        kth = best.where(F.col("rank") == k).select("query", F.col("distance").alias("bound"))
        open_ = asked.join(kth, "query", "left").withColumn("bound", F.coalesce("bound", F.lit(m * BITS))).where(F.col("bound") > m * (a + 1) - 1)
        if open_.isEmpty():
            break
    return best.select(F.col("query").alias("query_id"), "rank", "id", "distance")


def _at_distance(a: int) -> Column:
    """All 16-bit masks with ``a`` bits set."""
    return F.filter(F.sequence(F.lit(0), F.lit((1 << BITS) - 1)), lambda x: F.bit_count(x) == a)
