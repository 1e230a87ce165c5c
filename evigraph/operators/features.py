"""Graph features, the mean-aggregator forward pass, and evaluation measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions import rules
from evigraph.operators.graph import EvidenceGraph, apply_protection
from evigraph.operators.metrics import both_ways, case_neighbours, multi_degrees
from evigraph.operators.ranking import numbered, rank_by
from evigraph.session import cut


def model_type() -> Column:
    beat = F.array_contains("tags", "police-beat") | F.col("name").startswith("Police Beat ")
    t = F.col("type")
    return (F.when(t == "event", "CASE").when(t == "person", "SUSPECT").when(t == "crime", "CRIME_TYPE").when(t == "vehicle", "VEHICLE")
            .when((t == "location") & beat, "POLICE_BEAT").when(t == "location", "LOCATION"))


def node_features(g: EvidenceGraph) -> DataFrame:
    """(id, features): six one-hot types and the multi-edge degree scaled by its maximum."""
    degree = multi_degrees(g).withColumnRenamed("node", "id")
    peak = degree.agg(F.coalesce(F.max("degree"), F.lit(1)).alias("peak"))
    rows = g.nodes.select("id", model_type().alias("kind")).join(degree, "id", "left").join(F.broadcast(peak))
    hot = [F.when(F.col("kind") == name, 1.0).otherwise(0.0) for name in rules.MODEL_TYPES]
    return rows.select("id", F.array(*hot, F.coalesce("degree", F.lit(0)) / F.col("peak")).alias("features"))


def keyed_features(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``node_features`` by key, (id, features), over the nodes and pairs of ``metrics.keyed``."""
    degree = weighted(pairs).groupBy(F.col("node").alias("key")).agg(F.sum("n").alias("degree"))
    peak = degree.agg(F.coalesce(F.max("degree"), F.lit(1)).alias("peak"))
    rows = nodes.select("key", model_type().alias("kind")).join(degree, "key", "left").join(F.broadcast(peak))
    hot = [F.when(F.col("kind") == name, 1.0).otherwise(0.0) for name in rules.MODEL_TYPES]
    return rows.select(F.col("key").alias("id"), F.array(*hot, F.coalesce("degree", F.lit(0)) / F.col("peak")).alias("features"))


def weighted(pairs: DataFrame) -> DataFrame:
    """(node, nbr, n) of the pairs of ``metrics.keyed`` in both directions; both ends of a loop count."""
    return both_ways(pairs).withColumn("n", F.when(F.col("node") == F.col("nbr"), 2 * F.col("n")).otherwise(F.col("n")))


def structural_preview(g: EvidenceGraph, k: int = 25) -> DataFrame:
    """Persons by case links, without probabilities; says when the model does not apply."""
    model = apply_protection(g)
    unsupported = model.nodes.filter(~F.col("type").isin(*rules.MODEL_ENTITY_TYPES)).select("type").distinct().agg(
        F.array_sort(F.collect_list("type")).alias("unsupported"))  # at most nine types
    people = model.nodes.filter("type = 'person'").select("id", "name", "risk")
    rows = people.join(case_neighbours(model), "id", "left").join(multi_degrees(model).withColumnRenamed("node", "id"), "id", "left")
    rows = rows.fillna(0, ["case_neighbours", "degree"]).join(F.broadcast(unsupported))
    safe = F.size("unsupported") > 0
    ranked = rank_by(rows, [F.desc("case_neighbours"), F.desc(F.when(safe, F.col("degree"))), F.desc("risk"), F.asc("name"), F.asc("id")], k)
    return ranked.select("rank", "id", "name", "case_neighbours", F.col("degree").alias("graph_degree"), "risk",
                         F.when(F.col("case_neighbours") >= 2, "suspicious").otherwise("normal").alias("derived_label"),
                         F.when(safe, "schema-incompatible-preview").otherwise("structural-preview").alias("mode"))


def _matmul(vector: Column, matrix: list[list[float]], bias: list[float] | None = None) -> Column:
    rows = F.lit([[float(x) for x in row] for row in matrix])
    dot = F.transform(rows, lambda row: F.aggregate(F.zip_with(row, vector, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))
    return dot if bias is None else F.zip_with(dot, F.lit([float(b) for b in bias]), lambda a, b: a + b)


def mean_layer(values: DataFrame, adj: DataFrame, width: int, weights: dict, relu: bool = True) -> DataFrame:
    """Mean over neighbours (parallel edges counted, a row of ``adj`` as ``n`` edges if it says so), two linear maps and their sum.

    The mean is ``width`` scalar sums and a count, so hubs combine before the exchange.
    """
    sent = adj.join(values.select(F.col("id").alias("nbr"), "features"), "nbr")
    n = F.col("n") if "n" in adj.columns else F.lit(1).cast("bigint")
    means = sent.groupBy("node").agg(F.sum(n).alias("total"), *[F.sum(n * F.col("features")[i]).alias(f"m{i}") for i in range(width)])
    means = means.select(F.col("node").alias("id"), F.array(*[F.col(f"m{i}") / F.col("total") for i in range(width)]).alias("mean"))
    rows = values.join(means, "id", "left").withColumn("mean", F.coalesce("mean", F.array(*[F.lit(0.0)] * width)))
    out = F.zip_with(_matmul(F.col("mean"), weights["neighbour"], weights["bias"]), _matmul(F.col("features"), weights["self"]), lambda a, b: a + b)
    if relu:
        out = F.transform(out, lambda x: F.greatest(x, F.lit(0.0)))
    return rows.select("id", out.alias("features"))


def mean_aggregator_scores(features: DataFrame, adj_multi: DataFrame, weights: dict) -> DataFrame:
    """Two layers and a softmax; ``weights`` holds layer1, layer2 and classifier."""
    adj = cut(adj_multi, "adjacency")
    width = len(weights["layer1"]["neighbour"][0])
    hidden = cut(mean_layer(features, adj, width, weights["layer1"]), "hidden")
    hidden = mean_layer(hidden, adj, len(weights["layer2"]["neighbour"][0]), weights["layer2"])
    logits = hidden.select("id", _matmul(F.col("features"), weights["classifier"]["weight"], weights["classifier"]["bias"]).alias("z"))
    p = 1 / (1 + F.exp(F.col("z")[0] - F.col("z")[1]))
    return logits.select("id", p.alias("probability"), F.when(p >= 0.5, "suspicious").otherwise("normal").alias("derived_label"))


def _hash_order(seed, *columns: str) -> Column:
    """A seeded order that every engine can follow: the MD5 of seed and key."""
    return F.md5(F.concat_ws(":", F.lit(seed) if isinstance(seed, int) else seed, *columns).cast("binary"))


def proxy_labels(g: EvidenceGraph) -> DataFrame:
    """(id, label) for persons: one when linked to two or more cases."""
    people = g.nodes.filter("type = 'person'").select("id")
    links = people.join(case_neighbours(g), "id", "left")
    return links.select("id", F.when(F.coalesce("case_neighbours", F.lit(0)) >= 2, 1).otherwise(0).alias("label"))


def stratified_split(df: DataFrame, label: str, fraction: float = 0.2, seed: int = 42, key: str = "id") -> DataFrame:
    """Exactly round(fraction x size) validation rows per label, in seeded hash order."""
    rows = numbered(df.withColumn("_h", _hash_order(seed, key)), [label], ["_h", key], "_n")
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_size"))
    return rows.join(sizes, label).withColumn(
        "split", F.when(F.col("_n") <= F.round(F.col("_size") * fraction), "validation").otherwise("train")).drop("_h", "_n", "_size")


def masking_stress(g: EvidenceGraph, rate: float = 0.2, seeds: tuple[int, ...] = tuple(range(1000, 1010))) -> DataFrame:
    """Per seed: drop exactly round(rate x n) person-event edges, relabel, compare with the full graph."""
    kinds = g.nodes.filter(F.col("type").isin("person", "event")).select("id", "type")
    e = g.edges.select(F.col("id").alias("edge_id"), "source", "target")
    e = e.join(kinds.select(F.col("id").alias("source"), F.col("type").alias("st")), "source").join(
        kinds.select(F.col("id").alias("target"), F.col("type").alias("tt")), "target").filter("st <> tt")
    links = cut(e.select("edge_id", F.when(F.col("st") == "person", F.col("source")).otherwise(F.col("target")).alias("id")), "links")
    n = links.count()
    dropped = round(n * rate)
    trials = links.select("edge_id", "id", F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"))  # one copy per fixed seed
    order = trials.withColumn("h", _hash_order(F.col("seed"), "edge_id"))
    order = order.withColumn("bucket", F.conv(F.substring("h", 1, 4), 16, 10).cast("int"))
    # the bucket of the hash in which each seed's cut falls, from a histogram; only that bucket is ranked
    run = Window.partitionBy("seed").orderBy("bucket")
    histogram = order.groupBy("seed", "bucket").agg(F.count(F.lit(1)).alias("k"))
    cuts = histogram.withColumn("until", F.sum("k").over(run)).filter((F.col("until") > dropped) & (F.col("until") - F.col("k") <= dropped)).select(
        "seed", F.col("bucket").alias("edge"), (F.lit(dropped) - F.col("until") + F.col("k")).alias("rest"))
    sided = order.join(F.broadcast(cuts), "seed")  # one row per seed
    place = F.row_number().over(Window.partitionBy("seed").orderBy("h", "edge_id"))
    at_edge = sided.filter("bucket = edge").withColumn("n", place).filter("n > rest")
    kept = sided.filter("bucket > edge").select("seed", "id").unionByName(at_edge.select("seed", "id"))
    after = kept.groupBy("seed", "id").agg((F.count(F.lit(1)) >= 2).cast("int").alias("pred"))
    truth = proxy_labels(g).select("id", "label", F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"))
    both = truth.join(after, ["seed", "id"], "left").withColumn("pred", F.coalesce("pred", F.lit(0)))
    return confusion(both, "label", "pred", ["seed"]).withColumn("masked_edges", F.lit(dropped).cast("bigint"))


def stress_summary(trials: DataFrame) -> DataFrame:
    names = ("precision", "recall", "f1", "accuracy")
    flat = trials.select(F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])).alias("measure", "v"))
    return flat.groupBy("measure").agg(F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"))


def confusion(df: DataFrame, truth: str, prediction: str, by: list[str] | None = None) -> DataFrame:
    t, p = F.col(truth), F.col(prediction)
    counts = df.groupBy(*(by or [])).agg(
        F.count_if((t == 1) & (p == 1)).alias("true_positive"), F.count_if((t == 0) & (p == 0)).alias("true_negative"),
        F.count_if((t == 0) & (p == 1)).alias("false_positive"), F.count_if((t == 1) & (p == 0)).alias("false_negative"))
    tp, tn, fp, fn = (F.col(c) for c in ("true_positive", "true_negative", "false_positive", "false_negative"))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    return counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn),
                               "accuracy": ratio(tp + tn, tp + tn + fp + fn)})


def brier(df: DataFrame, truth: str, probability: str) -> DataFrame:
    """Mean squared error; null when there are no rows or a probability is missing."""
    missing = F.count_if(F.col(truth).isNull() | F.col(probability).isNull())
    return df.agg(F.when(missing == 0, F.avg(F.pow(F.col(probability) - F.col(truth), 2))).alias("brier"))


def prediction_summary(df: DataFrame, probability: str = "link_probability", predicted: str = "predicted_link") -> DataFrame:
    p = F.round(probability, 8)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.col(predicted).cast("bigint")), F.lit(0)).alias("predicted_links"),
                  F.avg(probability).alias("mean_probability"), F.coalesce(F.min(p) == F.max(p), F.lit(True)).alias("uniform_probability"))


def median_p95(df: DataFrame, column: str, key: str) -> DataFrame:
    """Median, and the nearest-rank 95th percentile at position round(.95 (n - 1)).

    Positions come from range slices, so no task sees the whole column.
    """
    values = df.filter(F.col(column).isNotNull()).select(column, key)
    placed = numbered(values, [], [column, key], "n")
    total = values.agg(F.count(F.lit(1)).alias("total"))
    rows = placed.join(F.broadcast(total))
    at = F.col("n") - 1
    middle = (at == F.floor((F.col("total") - 1) / 2)) | (at == F.floor(F.col("total") / 2))
    tail = at == F.bround(F.lit(0.95) * (F.col("total") - 1)).cast("bigint")
    return rows.filter(middle | tail).agg(F.avg(F.when(middle, F.col(column))).alias("median"), F.max(F.when(tail, F.col(column))).alias("p95"))


def fixed_baselines(rows: DataFrame, label: str, predicates: dict[str, Column]) -> DataFrame:
    out = None
    for name, predicate in predicates.items():
        part = confusion(rows.withColumn("_p", predicate.cast("int")), label, "_p").withColumn("baseline", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
