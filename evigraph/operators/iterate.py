"""Bounded iteration: components, sampled betweenness, hop-bounded paths.

Each round writes its state as a table and reads it back, so plans stay short
and a lost executor never restarts the loop.  Only counters reach the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.functions import scalars as S
from evigraph.operators.graph import EvidenceGraph
from evigraph.operators.metrics import both_ways, edges_of, keyed
from evigraph.operators.ranking import numbered
from evigraph.session import cut

#: The cost of an edge of full confidence, in hundredths.
LEAST_COST = 100
#: Sources of one search, a bit each.
LANES = 32


def connected_components(g: EvidenceGraph, max_rounds: int = 100) -> DataFrame:
    """(node, component) with the smallest member id as component.

    Nodes are numbered once in id order, so rounds move pairs of BIGINTs and the smallest
    number of a component is that of its smallest id.  A round turns the edges of each node
    towards the smallest node around it, first those of larger neighbours, then its own;
    edges that fall together are dropped, until every node hangs on its component's
    smallest one.  Chains of any length need a logarithmic number of rounds, and no round
    gathers the edges of a node in one place.
    """
    ids = cut(numbered(g.nodes.select(F.col("id").alias("node")), [], ["node"], "n"), "numbers")
    ends = edges_of(g).select("source", "target").filter("source <> target")
    named = lambda end, n: ids.select(F.col("node").alias(end), F.col("n").alias(n))
    pairs = ends.join(named("source", "a"), "source").join(named("target", "b"), "target")
    edges = cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "component-edges")
    before = None
    for _ in range(max_rounds):
        row = edges.agg(F.count(F.lit(1)).alias("k"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (row["k"], row["h"]) == before:
            break
        before = (row["k"], row["h"])
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        turned = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = turned.groupBy("u").agg(F.min("v").alias("m"))
        rest = turned.join(down, "u").filter("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        edges = cut(rest.union(down.select("u", F.col("m").alias("v"))).distinct(), "component-edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    labelled = ids.join(edges.withColumnsRenamed({"u": "n", "v": "root"}), "n", "left").select("node", F.coalesce("root", "n").alias("n"))
    return labelled.join(ids.select("n", F.col("node").alias("component")), "n").select("node", "component")


def sample_positions(total: int, sources: int) -> list[int]:
    """Evenly spaced places, from one, in a list of ``total``; with no more entries than ``sources`` every place."""
    return sorted({min(total - 1, int(i * (total / sources))) + 1 for i in range(sources)}) if total else []


def sampled_betweenness(g: EvidenceGraph, sources: int = 32, max_depth: int = 10_000) -> DataFrame:
    """(node, score): dependency sums over a fixed source sample, largest score one.

    Up to ``LANES`` sources advance together, one level per round.  A node is one row with a
    column per source, so an edge is joined once for all of them.
    """
    nodes, pairs = keyed(g)
    ids = cut(numbered(nodes.select("id", "key"), [], ["id"], "n"), "numbers")
    adj = both_ways(pairs).filter("node <> nbr").select("node", "nbr")
    picked = sample_positions(ids.count(), sources)
    deltas = [d for i in range(0, len(picked), LANES) for d in _dependencies(ids, adj, picked[i : i + LANES], max_depth)]
    if not deltas:
        return ids.select(F.col("id").alias("node"), F.lit(0.0).alias("score"))
    sums = cut(reduce(DataFrame.unionByName, deltas).groupBy("node").agg(F.sum("delta").alias("sum")), "scores")
    peak = sums.agg(F.max("sum").alias("peak"))
    scaled = ids.join(sums.withColumnRenamed("node", "key"), "key", "left").join(F.broadcast(peak))
    return scaled.select(F.col("id").alias("node"), F.when(F.col("peak") > 0, F.coalesce("sum", F.lit(0.0)) / F.col("peak")).otherwise(0.0).alias("score"))


def _dependencies(ids: DataFrame, adj: DataFrame, picked: list[int], max_depth: int) -> list[DataFrame]:
    """(node, delta) per level: dependency sums of the sources at the ``picked`` numbers.

    ``p0``, ``p1``, ... count the shortest paths from each source, zero where the node lies on another
    level; bit i of ``met`` says that it lies on this one for source i.
    """
    paths, found = ([f"{x}{i}" for i in range(len(picked))] for x in "pd")
    none = F.lit(0).cast("bigint")
    met = reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.col(c) > 0, F.lit(1 << i).cast("bigint")).otherwise(none) for i, c in enumerate(paths)]).alias("met")
    start = ids.filter(F.col("n").isin(picked)).select(F.col("key").alias("node"), *[F.when(F.col("n") == n, 1.0).otherwise(0.0).alias(c) for n, c in zip(picked, paths, strict=True)])
    levels = [cut(start.select("*", met), "level")]
    for _ in range(max_depth):
        reached = levels[-1].select("node", *paths).join(adj, "node").groupBy(F.col("nbr").alias("node")).agg(*[F.sum(c).alias(c) for c in paths])
        # a neighbour of level d lies on level d-1, d or d+1
        known = none
        for j, old in enumerate(levels[-2:]):
            reached = reached.join(old.select("node", F.col("met").alias(f"met{j}")), "node", "left")
            known = known.bitwiseOR(F.coalesce(f"met{j}", none))
        fresh = reached.select("node", *[F.when(F.getbit(known, F.lit(i)) == 0, F.col(c)).otherwise(0.0).alias(c) for i, c in enumerate(paths)])
        fresh = cut(fresh.select("*", met).filter("met <> 0"), "level")
        if fresh.isEmpty():
            break
        levels.append(fresh)
    else:
        raise RuntimeError(f"the search did not end within {max_depth} levels")
    deltas = []
    below = None
    for level in reversed(levels[1:]):
        here = level.select("node", *paths)
        if below is None:
            here = here.select("*", *[F.lit(0.0).alias(d) for d in found])
        else:
            share = below.select("node", *[F.when(F.col(c) > 0, (1 + F.col(d)) / F.col(c)).otherwise(0.0).alias(d) for c, d in zip(paths, found, strict=True)])
            parts = share.join(adj, "node").groupBy(F.col("nbr").alias("node")).agg(*[F.sum(d).alias(d) for d in found])
            here = here.join(parts, "node", "left").select("node", *paths, *[(F.col(c) * F.coalesce(d, F.lit(0.0))).alias(d) for c, d in zip(paths, found, strict=True)])
        below = cut(here, "delta")
        deltas.append(below.select("node", reduce(lambda a, b: a + b, [F.col(d) for d in found]).alias("delta")))
    return deltas


def connection_paths(g: EvidenceGraph, pairs: DataFrame, max_hops: int = 8) -> tuple[DataFrame, DataFrame]:
    """Cheapest stored path of at most ``max_hops`` edges for every (pair_id, source, target).

    An edge costs 1 + (100 - confidence) / 100.  Returns one summary row per pair
    and one row per step.  Labels are kept per hop, so a cheap long route never
    hides a legal short one.  What cannot end in a better path is dropped: labels whose cost and one more
    edge reach the cost that the pair has already, and at the last hops, which are searched from the other end, all
    labels that the hops left cannot bring to the target.  The last two hops join labels to the edges that lead
    to the target, or to its neighbours, by pair and node, so that no label meets all edges of a hub.  All that is
    dropped is no part of a path that counts, so labels and choices stay as they were.
    """
    e = edges_of(g)
    cost = (F.lit(200) - F.col("confidence")).cast("bigint")  # in hundredths, so sums are exact
    both = F.array(F.struct(F.col("source").alias("node"), F.col("target").alias("nbr"), F.lit(True).alias("forward")),
                   F.struct(F.col("target").alias("node"), F.col("source").alias("nbr"), F.lit(False).alias("forward")))
    hops = e.select(F.col("id").alias("edge_id"), "confidence", cost.alias("w"), F.explode(both).alias("h")).select("edge_id", "confidence", "w", "h.*")
    hops = hops.filter("node <> nbr")  # parallel edges are settled per label below, so the graph itself is never shuffled for them
    asked = cut(pairs.select("pair_id", "source", "target"), "pairs")
    layer = asked.select("pair_id", F.col("source").alias("node"), F.lit(0).cast("bigint").alias("cost"), F.lit(0).alias("hop"),
                         *[F.lit(None).cast(t).alias(n) for n, t in (("prev", "string"), ("edge_id", "string"), ("confidence", "int"), ("forward", "boolean"))])
    layers = [cut(layer, "layer")]
    targets = asked.select("pair_id", F.col("target").alias("node"))
    # edges that end at the target, and edges that end at one of its neighbours, per pair
    last = cut(hops.join(targets.withColumnRenamed("node", "nbr"), "nbr"), "last-hop")
    around = last.select("pair_id", "node").unionByName(targets).distinct()
    ways = {max_hops: last}
    if max_hops > 1:
        ways[max_hops - 1] = cut(hops.join(around.withColumnRenamed("node", "nbr"), "nbr"), "last-hop")
        near = cut(ways[max_hops - 1].select("pair_id", "node").unionByName(around).distinct(), "near-target")
    for hop in range(1, max_hops + 1):
        best = reduce(DataFrame.unionByName, [x.select("pair_id", "node", "cost") for x in layers]).groupBy("pair_id", "node").agg(F.min("cost").alias("cost"))
        bound = best.join(targets, ["pair_id", "node"]).select("pair_id", F.col("cost").alias("bound"))
        open_labels = layers[-1].join(targets, ["pair_id", "node"], "left_anti").join(bound, "pair_id", "left")
        open_labels = open_labels.filter(F.col("bound").isNull() | (F.col("cost") + LEAST_COST < F.col("bound")))
        step = open_labels.select("pair_id", "node", "cost", "bound").join(ways.get(hop, hops), ["pair_id", "node"] if hop in ways else "node").select("pair_id", F.col("nbr").alias("node"), (F.col("cost") + F.col("w")).alias("cost"),
                                                                                                F.col("node").alias("prev"), "edge_id", "confidence", "forward", "bound")
        step = step.filter(F.col("bound").isNull() | (F.col("cost") < F.col("bound"))).drop("bound")
        if max_hops - hop == 2:
            step = step.join(near, ["pair_id", "node"], "left_semi")
        step = step.groupBy("pair_id", "node").agg(F.min(F.struct("cost", "prev", "edge_id", "confidence", "forward")).alias("s")).select("pair_id", "node", "s.*")
        old = best.select("pair_id", "node", F.col("cost").alias("known"))
        fresh = step.join(old, ["pair_id", "node"], "left").filter(F.col("known").isNull() | (F.col("cost") < F.col("known"))).drop("known")
        fresh = cut(fresh.withColumn("hop", F.lit(hop)), "layer")
        if hop < max_hops and fresh.isEmpty():
            break
        layers.append(fresh)
    hits = None
    for layer in layers:
        hit = layer.join(targets, ["pair_id", "node"]).select("pair_id", "node", "cost", "hop")
        hits = hit if hits is None else hits.unionByName(hit)
    goal = cut(hits.groupBy("pair_id", "node").agg(F.min(F.struct("cost", "hop")).alias("g")).select("pair_id", "node", "g.cost", "g.hop"), "goal")

    # walk back: a label of hop h was built from the label of hop h-1 at its predecessor
    steps, cursor = None, goal.select("pair_id", "node", "hop")
    for hop in range(len(layers) - 1, 0, -1):
        here = cursor.filter(F.col("hop") == hop).drop("hop").join(layers[hop], ["pair_id", "node"])
        part = here.select("pair_id", F.lit(hop).alias("step"), F.col("prev").alias("from_id"), F.col("node").alias("to_id"), "edge_id",
                           "confidence", F.when(F.col("forward"), "forward").otherwise("reverse traversal").alias("direction"))
        part = cut(part, "steps")
        steps = part if steps is None else steps.unionByName(part)
        cursor = cursor.filter(F.col("hop") < hop).unionByName(part.select("pair_id", F.col("from_id").alias("node"), F.lit(hop - 1).alias("hop")))
    if steps is None:
        steps = layers[0].filter("false").select("pair_id", F.lit(0).alias("step"), F.col("prev").alias("from_id"), F.col("node").alias("to_id"),
                                                 "edge_id", "confidence", F.lit("").alias("direction"))
    strength = steps.groupBy("pair_id").agg(F.product(F.col("confidence") / 100.0).alias("p"))
    summary = asked.join(goal.select("pair_id", "cost", "hop"), "pair_id", "left").join(strength, "pair_id", "left").select(
        "pair_id", "source", "target", F.col("cost").isNotNull().alias("found"), F.col("hop").alias("hops"), (F.col("cost") / 100.0).alias("cost"),
        F.when(F.col("cost").isNotNull(), 100.0 * F.coalesce("p", F.lit(1.0))).alias("path_confidence"),
        F.when(F.col("cost").isNotNull(), "observed-path").otherwise("no-observed-path").alias("epistemic_status"))
    described = steps.join(e.select(F.col("id").alias("edge_id"), F.col("label").alias("relationship"), "anomalous", "evidence_record_ids",
                                    "evidence_hashes", "source_types", "observed_at"), "edge_id")
    return summary.withColumn("receipt", S.receipt(F.struct("cost", "found", "hops", "pair_id", "source", "target"))), described
