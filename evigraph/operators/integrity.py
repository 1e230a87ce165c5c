"""Receipts, audit chains, sealed objects and disclosure logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions import rules
from evigraph.functions import scalars as S
from evigraph.operators.ranking import numbered, rank_by
from evigraph.session import cut


def _around() -> tuple[Column, Column]:
    """Canonical JSON of an entry before and after the value of ``previous_hash``.

    Keys ascend, so the text splits into (action, actor, details) and
    (sequence, target, timestamp).
    """
    details = F.map_from_entries(F.array_sort(F.map_entries("details")))
    keep = {"ignoreNullFields": "false"}
    head = F.to_json(F.struct("action", "actor", details.alias("details")), keep)
    tail = F.to_json(F.struct("sequence", "target", "timestamp"), keep)
    return (F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"previous_hash":"')),
            F.concat(F.lit('",'), F.substring(tail, F.lit(2), F.length(tail))))


def entry_hash(previous: Column) -> Column:
    before, after = _around()
    return F.sha2(F.concat(before, previous, after), 256)


def chain_tails(entries: DataFrame, chain: str) -> DataFrame:
    """(chain, last, tail): number and hash of the last entry of each chain, all that an append needs to know."""
    return entries.groupBy(chain).agg(F.max("sequence").alias("last"), F.max_by("hash", "sequence").alias("tail"))


def seal_chain(events: DataFrame, chain: str, order: list[str], block: int = 1000, tails: DataFrame | None = None) -> DataFrame:
    """Number the events of each chain and link them by SHA-256.

    ``events`` has timestamp, actor, action, target (strings) and details (map).
    A chain is numbered from one and sealed in levels: inside a block of ``block``
    entries each entry hashes its predecessor and the first one the genesis value;
    ``chain_roots`` seals the block heads in the same way, level by level, until one
    root per chain.  Blocks of a level are folded in parallel, so a chain of any
    length is no single task and every entry is under the root.

    With ``tails`` (from ``chain_tails``) the events are appended to sealed chains: they go on from the last number,
    and in an unfinished block from its last hash, so nothing that was sealed is read or hashed
    again.  Sealing in batches gives the entries of sealing once, if each batch comes behind the one before
    in the given order.
    """
    rows = numbered(events, [chain], order, "sequence")
    if tails is None:
        rows = rows.withColumn("opened", F.lit(rules.GENESIS_HASH))
    else:
        held = tails.select(F.col(chain).alias("_chain"), "last", "tail")
        rows = rows.join(held, F.col(chain).eqNullSafe(F.col("_chain")), "left").withColumn("sequence", F.col("sequence") + F.coalesce("last", F.lit(0)))
        goes_on = F.floor((F.col("sequence") - 1) / block) == F.floor((F.col("last") - 1) / block)
        rows = rows.withColumn("opened", F.when(F.coalesce(goes_on, F.lit(False)), F.col("tail")).otherwise(rules.GENESIS_HASH)).drop("_chain", "last", "tail")
    rows = rows.withColumn("block", F.floor((F.col("sequence") - 1) / block))
    entry = F.struct("sequence", "timestamp", "actor", "action", "target", "details", *[c for c in order if c != "timestamp"])
    # the text around the previous hash is fixed per entry, so the fold only concatenates and hashes
    before, after = _around()
    rows = rows.withColumns({"entry": entry, "before": before, "after": after})
    folded = rows.groupBy(chain, "block", "opened").agg(F.array_sort(
        F.collect_list(F.struct("sequence", "entry", "before", "after")), lambda a, b: (a["sequence"] - b["sequence"]).cast("int")).alias("items"))  # at most ``block`` rows
    start = F.struct(F.col("opened").alias("last"), F.array().cast("array<string>").alias("hashes"))

    def link(acc: Column, item: Column) -> Column:
        h = F.sha2(F.concat(item["before"], acc["last"], item["after"]), 256)
        return F.struct(h.alias("last"), F.concat(acc["hashes"], F.array(h)).alias("hashes"))

    hashes = folded.withColumn("hashes", F.aggregate("items", start, link, lambda acc: acc["hashes"]))
    flat = hashes.select(chain, "block", "opened", F.posexplode_outer(F.arrays_zip("items", "hashes")).alias("pos", "z"), "hashes")
    previous = F.when(F.col("pos") == 0, F.col("opened")).otherwise(F.get("hashes", F.col("pos") - 1))
    return flat.select(chain, "block", "z.items.entry.*", previous.alias("previous_hash"), F.col("z.hashes").alias("hash"))


def chain_levels(entries: DataFrame, chain: str, block: int = 1000) -> list[DataFrame]:
    """Heads of each level as (chain, number, entries, head); the last level has one row per chain.

    A head of the next level folds up to ``block`` heads: each step hashes the hash
    before it, the head's number, its entries and its hash.  The driver reads one
    number per level.
    """
    last = entries.groupBy(chain, "sequence", "block").agg(F.min("hash").alias("hash"))  # of repeated entries one counts
    heads = last.groupBy(chain, F.col("block").alias("number")).agg(F.count(F.lit(1)).alias("entries"), F.max_by("hash", "sequence").alias("head"))
    levels = [cut(heads, "heads")]
    while len(levels) < 2 or _tall(levels[-1]):
        levels.append(cut(_upper(levels[-1], chain, block), "heads"))
    return levels


def _tall(level: DataFrame) -> bool:
    return level.agg(F.coalesce(F.max("number"), F.lit(0)).alias("n")).first()["n"] > 0


def _upper(level: DataFrame, chain: str, block: int) -> DataFrame:
    """Heads of the next level over all given heads."""
    step = lambda acc, x: F.sha2(F.concat_ws(":", acc, x["number"].cast("string"), x["entries"].cast("string"), x["head"]), 256)
    group = level.groupBy(chain, F.floor(F.col("number") / block).alias("upper")).agg(
        F.sum("entries").alias("entries"), F.array_sort(F.collect_list(F.struct("number", "entries", "head"))).alias("items"))  # at most ``block`` heads
    return group.select(chain, F.col("upper").alias("number"), "entries", F.aggregate("items", F.lit(rules.GENESIS_HASH), step).alias("head"))


def append_levels(levels: list[DataFrame], fresh: DataFrame, chain: str, block: int = 1000) -> list[DataFrame]:
    """The levels of ``chain_levels`` once the newly sealed entries ``fresh`` are appended.

    Of each level only the heads over new entries are folded again, each from the at most ``block`` heads
    below it; all others are taken as they are stored.
    """
    new = fresh.groupBy(chain, F.col("block").alias("number")).agg(F.count(F.lit(1)).alias("more"), F.max_by("hash", "sequence").alias("new_head"))
    same = lambda a, b: a[chain].eqNullSafe(b[chain]) & (a["number"] == b["number"])
    stored = levels[0]
    joined = new.join(stored, same(new, stored), "left").select(new[chain], new["number"], (F.coalesce(stored["entries"], F.lit(0)) + F.col("more")).alias("entries"), F.col("new_head").alias("head"))
    touched = cut(joined, "heads")
    out = [cut(stored.join(touched, same(stored, touched), "left_anti").unionByName(touched), "heads")]
    while len(out) < 2 or _tall(out[-1]):
        stored = levels[len(out)] if len(out) < len(levels) else None
        above = touched.select(F.col(chain).alias("_chain"), F.floor(F.col("number") / block).alias("_upper")).distinct()
        below = out[-1] if stored is None else out[-1].join(above, F.col(chain).eqNullSafe(F.col("_chain")) & (F.floor(F.col("number") / block) == F.col("_upper")), "left_semi")
        touched = cut(_upper(below, chain, block), "heads")
        out.append(touched if stored is None else cut(stored.join(touched, same(stored, touched), "left_anti").unionByName(touched), "heads"))
    return out


def chain_roots(entries: DataFrame, chain: str, block: int = 1000) -> DataFrame:
    """(chain, entries, root): what is stored apart from a sealed chain to verify it later."""
    return chain_levels(entries, chain, block)[-1].select(chain, "entries", F.col("head").alias("root"))


def verify_chain(entries: DataFrame, chain: str, roots: DataFrame | None = None, block: int = 1000) -> DataFrame:
    """Every violated rule, as (chain, sequence, reason).

    Entries must be numbered 1, 2, 3, ... without gap or repetition; an entry at the
    start of a block follows the genesis value, any other the entry one number
    earlier, found through an equi-join, so verification is parallel within a chain
    as well.  Given stored ``roots`` (from ``chain_roots``), a chain whose own root or
    number of entries differs, or of which nothing is left, is reported with a null
    sequence: a lost tail shows only there.
    """
    count = entries.groupBy(chain, "sequence").agg(F.count(F.lit(1)).alias("copies"), F.min("hash").alias("before"))
    before = count.select(chain, (F.col("sequence") + 1).alias("sequence"), "before")
    here = entries.join(count.select(chain, "sequence", "copies"), [chain, "sequence"]).join(before, [chain, "sequence"], "left")
    opens = (F.col("sequence") - 1) % block == 0
    expected = F.when(opens, F.lit(rules.GENESIS_HASH)).otherwise(F.col("before"))
    gap = (F.col("sequence") != 1) & F.col("before").isNull()
    misplaced = F.col("block") != F.floor((F.col("sequence") - 1) / block)
    reasons = F.filter(F.array(
        F.when((F.col("copies") > 1) | gap | misplaced | (F.col("sequence") < 1), "sequence mismatch"),
        F.when(~F.coalesce(F.col("previous_hash") == expected, F.lit(False)), "previous hash mismatch"),
        F.when(F.col("hash") != entry_hash(F.col("previous_hash")), "content hash mismatch"),
    ), lambda r: r.isNotNull())
    found = here.select(chain, "sequence", F.explode_outer(reasons).alias("reason")).filter("reason IS NOT NULL")
    if roots is None:
        return found
    now = chain_roots(entries, chain, block).withColumnsRenamed({"entries": "entries_now", "root": "root_now"})
    same = F.coalesce((F.col("entries") == F.col("entries_now")) & (F.col("root") == F.col("root_now")), F.lit(False))
    broken = roots.join(now, chain, "full").filter(~same).select(chain, F.lit(None).cast("bigint").alias("sequence"), F.lit("root mismatch").alias("reason"))
    return found.unionByName(broken)


def recent(entries: DataFrame, n: int, order=("sequence",)) -> DataFrame:
    return rank_by(entries, [F.desc(c) for c in order], n)


def disclosure_log(requests: DataFrame) -> DataFrame:
    """Requests as logged: the reason only as a hash, the disclosed fields by name."""
    return requests.select("profile_id", F.trim("authorization_reference").alias("authorization_reference"),
                           F.sha2(F.trim("reason"), 256).alias("reason_sha256"),
                           F.array(F.lit("legal_name"), F.lit("phone"), F.lit("address")).alias("fields_revealed"), "actor")


def masked_view(profiles: DataFrame) -> DataFrame:
    """The only view of protected profiles that leaves the vault."""
    return profiles.select("id", "graph_name", S.mask_name(F.col("legal_name")).alias("name"), S.mask_phone(F.col("phone")).alias("phone"),
                           F.lit("WITHHELD").alias("address"), F.lit("masked").alias("status"), F.lit("prohibited").alias("risk_scoring"))


def seal_objects(objects: DataFrame) -> DataFrame:
    return objects.select("key", "content", F.sha2("content", 256).alias("sha256"))


def verify_objects(sealed: DataFrame) -> DataFrame:
    return sealed.select("key", (F.sha2("content", 256) == F.col("sha256")).alias("ok"))
