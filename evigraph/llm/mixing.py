"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Every source gets a target number of words: weights share ``share`` of all words, a target
   stops at ``repeats`` times its source's size, and the excess goes to the others by weight
   until none is above.
2. The rows of a source lie in blocks by a hash of key and text.  A source is passed over as often as its
   target holds it whole; a last pass takes the rest.  Permuted by another hash, its rows that could fit at all are
   taken up to the first that does not; what is then left is filled with the smallest rows behind it, in
   order of size.  So a source stays below its target by less than the smallest row left out.
   Each (source, pass, block) is a unit; a source's number of units is its quota.
3. A binary tree deals the quotas out to shards.  At each node the units of each source that go
   left are one draw from the multivariate hypergeometric distribution: source after source, a
   hypergeometric draw by inversion over all values within nine
   standard deviations of the mean (beyond lies less than a double can tell).  Every shard
   gets its exact share of all units, and every unit goes to one shard.
4. A source's units, permuted again, go to its shards by prefix sums.  In its shard a row's
   place is a hash of shard, pass and row.

Texts are read once for their sizes and once for the result.  All between is on one narrow row per different
row (hash and size), on blocks (at most ``BLOCKS`` per source), on sources, or on sources times
shards; running sums over rows are running sums over blocks and inside a block.  What a source takes and where its
shards end are places in permuted orders, so a text meets one row per source and is not exchanged.  The number of steps is
fixed, and the tree is one plan.  Built-in functions only; all draws are hashes of ``seed``, so reruns agree.

Defined results: null and empty texts have size 0 and are never taken; a null source is a
source of its own and sorts last; equal rows are taken alike; an empty table gives no rows; other
columns pass through (added names replace equal ones).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evigraph.session import cut

BLOCKS, BLOCK_ROWS = 65_536, 128
RUN = 4096  # places of a shard that lie together
UNITS_ARRAY = "array<struct<rank: int, quota: long>>"
COPIES = "array<struct<shard: int, pass: int, place: long>>"
ADDED = ("size", "source_size", "target", "copies")


def words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text: each but the last stands before a gap."""
    gapless = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]++", "x")
    return F.length(F.regexp_replace(gapless, r"[\x20\x09-\x0D]++", "")).cast("long")


def drawn_key(*parts: Column) -> Column:
    """A number of 52 bits from the MD5 of the parts, the same in every engine."""
    return F.conv(F.substr(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary")), F.lit(1), F.lit(13)), 16, 10).cast("long")


def unit_hash(*parts: Column) -> Column:
    """A double in [0, 1) from a hash."""
    return drawn_key(*parts) / F.lit(2.0**52)


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, repeats: float = 3.0) -> DataFrame:
    """Adds ``rank``, ``weight`` and ``target`` to one row per source (source, words): one row per source in one task."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sizes.withColumn("rank", F.row_number().over(order).cast("int")).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")))
    # a source is full when its limit is below its share of what the sources with a smaller limit per weight leave
    by_limit = Window.orderBy(F.col("words") / F.col("weight"), "rank")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.lit(float(share)) * F.sum("words").over(every)
    left = total - repeats * F.coalesce(F.sum("words").over(before), F.lit(0))
    rate = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rated = ranked.withColumn("rate", rate).withColumn("place", F.row_number().over(by_limit))
    # up to the first source that is not full all are; its rate holds for it and for all after it
    rated = rated.withColumn("stop", F.min(F.when(F.col("rate") * F.col("weight") < repeats * F.col("words"), F.col("place"))).over(every))
    rated = rated.withColumn("full", F.col("stop").isNull() | (F.col("place") < F.col("stop")))
    final = F.max(F.when(F.col("place") == F.col("stop"), F.col("rate"))).over(every)
    return rated.withColumn("target", F.when(F.col("full"), repeats * F.col("words")).otherwise(F.col("weight") * final)).select("source", "rank", "weight", "words", "rows", "target")


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """Number of good units among ``drawn`` of ``total``, ``good`` of them good, by inversion of ``u``."""
    low, high = F.greatest(F.lit(0).cast("long"), drawn + good - total), F.least(good, drawn)
    mean = drawn * good / F.greatest(total, F.lit(1))
    spread = F.ceil(9 * F.sqrt(mean * (1 - good / F.greatest(total, F.lit(1))) + 1)).cast("long")
    mid = F.round(mean).cast("long")
    box = F.array(F.struct(F.greatest(low, mid - spread).alias("a"), F.least(high, mid + spread).alias("b")))  # worked out once, for all steps

    def inverted(range_: Column) -> Column:
        a, b = range_["a"], range_["b"]
        ks = F.when(b > a, F.sequence(a + 1, F.greatest(b, a + 1))).otherwise(F.slice(F.array(a), 1, 0))
        # weights relative to the least value, and their running sums
        grow = lambda s, k: F.struct((s["w"] * ((good - k + 1) * (drawn - k + 1) / (k * (total - good - drawn + k)))).alias("w"), s["sum"].alias("sum"))
        add = lambda s, k: (lambda t: F.struct(t["w"].alias("w"), (s["sum"] + t["w"]).alias("sum")))(grow(s, k))
        one = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("sum"))
        goal = u * F.aggregate(ks, one, add, lambda s: s["sum"])
        first = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("sum"), a.alias("k"), goal.alias("goal"))
        walk = lambda s, k: (lambda t: F.struct(t["w"].alias("w"), t["sum"].alias("sum"), F.when(s["sum"] <= s["goal"], k).otherwise(s["k"]).alias("k"), s["goal"].alias("goal")))(add(s, k))
        return F.aggregate(ks, first, walk, lambda s: s["k"])

    return F.element_at(F.transform(box, inverted), 1)


def split_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(shard, rank, quota) from one row per source (rank, quota), as one plan: a level is one step from nodes to their children.

    A node holds one entry per source.
    """
    depth = math.ceil(math.log2(shards)) if shards > 1 else 0
    nodes = quotas.agg(F.array_sort(F.collect_list(F.struct(F.col("rank"), F.col("quota")))).alias("parts")).select(F.lit(0).alias("low"), F.lit(shards).alias("high"), "parts")
    low, high, width = F.col("low"), F.col("high"), F.col("high") - F.col("low")
    total = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["quota"])
    # units before the boundary of the shards, so that every shard gets floor or ceil of its share
    drawn = F.when(width > 1, F.expr("total * half div (high - low)")).otherwise(F.col("total"))

    def deal(acc: Column, p: Column) -> Column:
        took = hypergeometric(acc["total"], p["quota"], acc["drawn"], unit_hash(F.lit(seed), low, high, p["rank"]))
        step = F.transform(F.array(took), lambda t: F.struct((acc["total"] - p["quota"]).alias("total"), (acc["drawn"] - t).alias("drawn"), F.concat(acc["out"], F.array(F.struct(p["rank"].alias("rank"), t.alias("quota")))).alias("out")))
        return F.element_at(step, 1)

    start = F.struct(F.col("total").alias("total"), F.col("drawn").alias("drawn"), F.from_json(F.lit("[]"), UNITS_ARRAY).alias("out"))
    left = F.aggregate("parts", start, deal, lambda acc: acc["out"])
    right = lambda x: F.zip_with("parts", x, lambda p, q: F.struct(p["rank"].alias("rank"), (p["quota"] - q["quota"]).alias("quota")))
    node = lambda a, b, parts: F.struct(a.alias("low"), b.alias("high"), parts.alias("parts"))
    sides = F.flatten(F.transform(F.array(left), lambda x: F.array(node(low, low + F.col("half"), x), node(low + F.col("half"), high, right(x)))))
    for _ in range(depth):
        sized = nodes.select("*", F.ceil(width / 2).cast("int").alias("half"), total.alias("total")).withColumn("drawn", drawn)
        nodes = sized.select(F.explode(sides).alias("n")).select("n.low", "n.high", "n.parts").where("high > low")
    return nodes.select(F.col("low").alias("shard"), F.explode("parts").alias("p")).select("shard", "p.rank", "p.quota").where("quota > 0")


def _running(rows: DataFrame, weight: Column, seed: int) -> DataFrame:
    """``rows`` (rank, block, spot) with ``until``: the sum of ``weight`` up to each in permuted order of blocks and, in a block, of rows."""
    weighed = rows.withColumn("weight", weight)
    order = Window.partitionBy("rank").orderBy(drawn_key(F.lit(seed), F.lit("block"), F.col("rank"), F.col("block")), "block")
    blocks = weighed.groupBy("rank", "block").agg(F.sum("weight").alias("all")).withColumn("ahead", F.sum("all").over(order) - F.col("all")).drop("all")
    inside = Window.partitionBy("rank", "block").orderBy(drawn_key(F.lit(seed), F.lit("row"), F.col("spot")), "spot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return weighed.join(blocks, ["rank", "block"]).withColumn("until", F.col("ahead") + F.sum("weight").over(inside)).drop("weight", "ahead")


def _turn(seed: int, rank: Column, block: Column, spot: Column) -> Column:
    """Place of a row in the permuted order of its source."""
    return F.struct(drawn_key(F.lit(seed), F.lit("block"), rank, block).alias("drawn"), block.alias("block"), drawn_key(F.lit(seed), F.lit("row"), spot).alias("row"), spot.alias("spot"))


def _unit(seed: int, rank: Column, pass_: Column, block: Column) -> Column:
    """Place of a unit among those of its source."""
    return F.struct(drawn_key(F.lit(seed), F.lit("unit"), rank, pass_, block).alias("drawn"), pass_.alias("pass"), block.alias("block"))


def last_pass(rows: DataFrame, rests: DataFrame, seed: int) -> DataFrame:
    """What decides the last pass over ``rows`` (rank, block, spot, words), one row per rank, given ``rest``.

    ``front`` is the turn of the last row before the first that does not fit, ``rem`` what is left then, ``stop`` the first size
    of which not all rows behind fit and ``edge`` the turn of the last of them that does.  ``_in_last_pass`` reads them.
    """
    walked = cut(_running(rows.join(rests, "rank").where("words > 0 and words <= rest"), F.col("words"), seed), "mix-walk")
    turn = _turn(seed, F.col("rank"), F.col("block"), F.col("spot"))
    fits = F.col("until") <= F.col("rest")
    left = walked.groupBy("rank", "rest").agg((F.col("rest") - F.coalesce(F.sum(F.when(fits, F.col("words"))), F.lit(0))).alias("rem"), F.max(F.when(fits, turn)).alias("front")).drop("rest")
    left = cut(left, "mix-left")  # its size is known then: small tables are sent to the rows
    behind = walked.where("until > rest").join(left.drop("front"), "rank").where("words <= rem")
    sizes = behind.groupBy("rank", "words", "rem").agg(F.sum("words").alias("all")).withColumn("upto", F.sum("all").over(Window.partitionBy("rank").orderBy("words")))
    # the first size of which not all rows fit, and how many of it do
    stop = sizes.where("upto > rem").groupBy("rank").agg(F.min(F.struct("words", F.expr("(rem - upto + all) div words").alias("number"))).alias("s")).select("rank", F.col("s.words").alias("stop"), F.col("s.number").alias("number"))
    stop = cut(left.join(stop, "rank", "left"), "mix-stop")
    equal = _running(behind.drop("rem", "until").join(stop.select("rank", "stop", "number"), "rank").where("words = stop and number > 0"), F.lit(1), seed).where("until <= number")
    edge = equal.groupBy("rank").agg(F.max(turn).alias("edge"))
    return cut(stop.drop("number").join(edge, "rank", "left"), "mix-last")


def _in_last_pass(words: Column, turn: Column, rule: Column) -> Column:
    """Whether the last pass takes a row of so many words; ``rule`` holds ``rest`` and the columns of ``last_pass``."""
    size = rule["stop"]
    small = (words <= rule["rem"]) & (size.isNull() | (words < size) | ((words == size) & F.coalesce(turn <= rule["edge"], F.lit(False))))
    return F.coalesce((words > 0) & (words <= rule["rest"]) & (F.coalesce(turn <= rule["front"], F.lit(False)) | small), F.lit(False))


def _copies(size: Column, block: Column, spot: Column, rule: Column, taken: Column, seed: int) -> Column:
    """The entries of a row: one per whole pass and one if the last takes it; its unit of a pass lies in the first shard that does not end before it."""
    passes = F.when((size > 0) & (rule["full"] + taken.cast("int") > 0), F.sequence(F.lit(0), rule["full"] + taken.cast("int") - 1)).otherwise(F.from_json(F.lit("[]"), "array<int>"))
    units = F.transform(passes, lambda p: _unit(seed, rule["rank"], p, block))
    sharded = F.transform(units, lambda u: F.struct(F.get(F.filter(rule["ends"], lambda e: u <= e["end"]), F.lit(0))["shard"].alias("shard"), u["pass"].alias("pass")))
    return F.transform(sharded, lambda s: F.struct(s["shard"].alias("shard"), s["pass"].alias("pass"), drawn_key(F.lit(seed), s["shard"], s["pass"], spot).alias("place"))).cast(COPIES)


def mix(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, repeats: float = 3.0, shards: int = 16, seed: int = 11) -> DataFrame:
    """``df`` with ``size``, ``source_size``, ``target`` and ``copies``: array<struct<shard, pass, place>>, one entry per time the mix takes the row."""
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ADDED]
    drawn = drawn_key(F.lit(seed), F.col(key), F.col(text))
    own = df.select(*kept, F.col(source).alias("__source"), drawn.alias("__spot"), words(F.col(text)).alias("size"))
    # all that the plan needs to know about the rows; equal ones as one
    narrow = cut(own.groupBy(F.col("__source").alias("source"), F.col("__spot").alias("spot")).agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("words"), F.min("size").alias("low"), F.max("size").alias("high")), "mix-rows")
    sources = cut(targets(narrow.groupBy("source").agg(F.sum("rows").alias("rows"), F.sum("words").alias("words")), weights, share, repeats)
                  .withColumn("blocks", F.least(F.lit(BLOCKS), F.ceil(F.col("rows") / BLOCK_ROWS)).cast("int"))
                  .withColumn("full", F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words"))).otherwise(0).cast("int"))
                  .withColumn("rest", F.floor(F.col("target") - F.col("full") * F.col("words")).cast("long")), "mix-sources")
    block = F.expr(f"cast(pmod(spot, {BLOCKS}) * blocks div {BLOCKS} as int)").alias("block")
    placed = narrow.join(sources.select(F.col("source").alias("s"), "rank", "blocks"), F.col("source").eqNullSafe(F.col("s"))).select("rank", block, "spot", "rows", "words", "low", "high")
    last = last_pass(placed.select("rank", "block", "spot", "words"), sources.select("rank", "rest"), seed)
    decided = placed.join(sources.select("rank", "rest").join(last, "rank"), "rank").withColumn("turn", _turn(seed, F.col("rank"), F.col("block"), F.col("spot")))
    rule = F.struct("rest", "rem", "front", "stop", "edge")
    decided = decided.withColumn("taken", _in_last_pass(F.col("words"), F.col("turn"), rule))
    whole = placed.where("words > 0").select("rank", "block").distinct().join(sources.select("rank", "full"), "rank").where("full > 0").select("rank", "block", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("pass"))
    units = cut(whole.unionByName(decided.where("taken").select("rank", "block").distinct().join(sources.select("rank", F.col("full").alias("pass")), "rank").select("rank", "block", "pass")), "mix-units")
    dealt = split_tree(units.groupBy("rank").agg(F.count(F.lit(1)).alias("quota")), shards, seed)
    ranges = dealt.withColumn("until", F.sum("quota").over(Window.partitionBy("rank").orderBy("shard"))).withColumn("from", F.col("until") - F.col("quota"))
    order = _unit(seed, F.col("rank"), F.col("pass"), F.col("block"))
    numbered = units.withColumn("unit", order).withColumn("n", F.row_number().over(Window.partitionBy("rank").orderBy("unit")) - 1)
    # a shard holds the units of a source up to a last one, so a row finds its shards by itself and texts are not exchanged
    ends = _in_range(numbered, ranges).groupBy("rank", "shard").agg(F.max("unit").alias("end")).groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("end", "shard"))).alias("ends"))
    rules = cut(sources.join(last, "rank", "left").join(ends, "rank", "left"), "mix-rules")
    # rows that are equal count as one of their words together, which a row does not know: those it would decide wrong go with their block
    wrong = (F.col("rows") > 1) & ((F.col("taken") != _in_last_pass(F.col("low"), F.col("turn"), rule)) | (F.col("taken") != _in_last_pass(F.col("high"), F.col("turn"), rule)))
    known = cut(decided.where(wrong).groupBy("rank", "block").agg(F.collect_list(F.struct("spot", "taken")).alias("known")), "mix-known")
    per_source = rules.select(F.col("source").alias("__s"), F.struct("rank", "blocks", "full", "rest", "rem", "front", "stop", "edge", "ends").alias("__rule"), F.col("words").alias("source_size"), "target")
    rows = own.join(per_source, F.col("__source").eqNullSafe(F.col("__s"))).withColumn("__block", F.expr(f"cast(pmod(__spot, {BLOCKS}) * __rule.blocks div {BLOCKS} as int)"))
    rows = rows.join(known.select(F.col("rank").alias("__r"), F.col("block").alias("__b"), F.col("known").alias("__known")), (F.col("__rule.rank") == F.col("__r")) & (F.col("__block") == F.col("__b")), "left")
    spot, block, rule = F.col("__spot"), F.col("__block"), F.col("__rule")
    said = F.get(F.filter("__known", lambda k: k["spot"] == spot), F.lit(0))["taken"]
    rows = rows.withColumn("__taken", F.coalesce(said, _in_last_pass(F.col("size"), _turn(seed, rule["rank"], block, spot), rule)))
    return rows.select(*kept, "size", "source_size", "target", _copies(F.col("size"), block, spot, rule, F.col("__taken"), seed).alias("copies"))


def _in_range(numbered: DataFrame, ranges: DataFrame) -> DataFrame:
    """Each unit's shard: a source's shards are few, so they travel as one array per source and are searched by prefix sum."""
    steps = ranges.groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("from", "until", "shard"))).alias("steps"))
    return numbered.join(steps, "rank").withColumn("shard", F.expr("get(filter(steps, s -> n >= s.from and n < s.until), 0).shard")).drop("steps")


def rows_of(mixed: DataFrame) -> DataFrame:
    """The mix itself, one row per copy, in order of places: runs of ``RUN`` places of a shard lie together, as a shard grows with the mix."""
    columns = [F.col(f"`{c}`") for c in mixed.columns if c not in ADDED]
    rows = mixed.select(*columns, F.explode("copies").alias("__c")).select(*columns, F.col("__c.shard").alias("shard"), F.col("__c.place").alias("place"))
    return rows.repartition("shard", F.floor(F.col("place") / RUN)).sortWithinPartitions("shard", "place")
