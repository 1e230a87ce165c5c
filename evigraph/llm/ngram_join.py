"""Near duplicates by word n-gram Jaccard similarity: MinHash LSH forest, then exact verification.

1. Texts that are equal byte for byte form one class; its copies are never compared.
2. Every class has one path in each of ``trees`` prefix trees: ``LONGEST`` labels, each one byte of
   a min-hash over the class's word shingles, packed into a long whose order is that of the tree.
3. The paths of all trees are sorted by ranges.  What a path shares with its neighbours is the
   longest prefix it matches anywhere; paths that match no prefix of the shortest length go.
4. Trie nodes are counted at every matched depth.  All trees start at the longest prefix;
   the tree where one label less adds the fewest pairs for the recall it gains is shortened
   first, until a pair at the threshold meets in some tree with the target probability.
   So crowded trees keep long prefixes and the others make up for them.
5. Classes of a node at its tree's depth are linked to the least class there.  The components
   of these links are the candidate groups; each class's text goes to its group once.
6. Inside a group all pairs are verified exactly, by products of blocks of the
   class-by-shingle incidence matrix.  A group larger than a block is dealt out as pairs of
   blocks.  Pairs are never written: a task returns, per class, its number of links
   and the least class it is connected to within the task.
7. The components of verified links are the near-duplicate groups.

Defined results: a text without a word (null and empty too) is a group of its own without
links; a text of fewer than ``words`` words has one shingle, all its words; ties are
settled by the smallest id; repeated rows count as copies; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.llm import flat
from evigraph.llm.components import connected
from evigraph.session import cut

BLOCK_CLASSES, BLOCK_SHINGLES, BIN_SHINGLES, COLUMNS = 512, 400_000, 100_000, 4096
LONGEST = 8  # labels of a path, a byte each
HAS_WORD = r"[^\x20\x09-\x0D]"
LEAF = "cid long, tree int, path long, matched int"


def prefix_depth(threshold: float, trees: int, target: float, longest: int = LONGEST) -> int:
    """Longest prefix that is enough in all trees: pairs at the threshold meet with probability ``target``."""
    depth = longest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target:
        depth -= 1
    return depth


def tree_depths(pairs: dict[tuple[int, int], float], threshold: float, trees: int, target: float, shortest: int) -> list[int]:
    """Prefix length of every tree, shortened from ``LONGEST`` one label at a time until the target recall.

    ``pairs`` holds the pairs that meet per (tree, depth).  The next label is taken off the tree that
    adds the fewest pairs per gain in the logarithm of the pairs missed; ties fall to the first tree.
    """
    depth = [LONGEST] * trees

    def price(tree: int) -> tuple[float, int]:
        now = depth[tree]
        added = pairs.get((tree, now - 1), 0) - pairs.get((tree, now), 0)
        return added / (math.log1p(-(threshold**now)) - math.log1p(-(threshold ** (now - 1)))), tree

    while 1 - math.prod(1 - threshold**d for d in depth) < target and max(depth) > shortest:
        depth[min((t for t in range(trees) if depth[t] > shortest), key=price)] -= 1
    return depth


def shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of all texts, and n + 1 offsets."""
    buf, offsets = flat.flat(texts)
    starts, ends, first = flat.words(buf, offsets)
    hashes = flat.range_hashes(buf, starts, ends)
    n = np.diff(first)
    size = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(at[-1], np.uint64)
    long = n >= words
    if long.any():
        full = flat.window_hashes(hashes, words)
        rows = np.repeat(first[:-1][long], size[long]) + np.arange(size[long].sum()) - np.repeat(np.cumsum(size[long]) - size[long], size[long])
        out[np.repeat(long, size)] = full[rows]
    for k in range(1, words):
        short = np.flatnonzero(n == k)
        value = np.zeros(len(short), np.uint64)
        for j in range(k):
            value = value * flat.ROOT + hashes[first[:-1][short] + j]
        out[at[:-1][short]] = flat.mix(value + np.uint64(k))
    return out, at


def signatures(texts: pa.Array, words: int, trees: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Path of ``depth`` labels in each tree (texts x trees), first label highest, and the number of shingles."""
    rng = np.random.default_rng(20240607)
    factor, offset = (rng.integers(0, 2**64, (trees, depth), np.uint64) for _ in range(2))
    factor |= np.uint64(1)
    keys, sizes = [np.zeros((0, trees), np.uint64)], [np.zeros(0, np.int64)]
    for _, part in flat.chunks(texts, 1 << 19):
        hashes, at = shingles(part, words)
        size = np.diff(at)
        own = np.flatnonzero(size)
        out = np.zeros((len(part), trees), np.uint64)
        if len(own):
            for t in range(trees):
                for d in range(depth):
                    label = flat.mix(np.minimum.reduceat((hashes ^ offset[t, d]) * factor[t, d], at[:-1][own])) >> np.uint64(56)
                    out[own, t] |= label << np.uint64(56 - 8 * d)
        keys.append(out)
        sizes.append(size)
    return np.concatenate(keys), np.concatenate(sizes)


def _signature(text: Column, words: int, trees: int) -> Column:
    @F.arrow_udf("struct<size: long, paths: array<long>>")
    def sign(texts: pa.Array) -> pa.Array:
        keys, sizes = signatures(texts, words, trees, LONGEST)
        paths = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * trees), pa.array(keys.reshape(-1).view(np.int64)))
        return pa.StructArray.from_arrays([pa.array(sizes), paths], ["size", "paths"])

    return sign(text)


def shared_labels(tree: np.ndarray, path: np.ndarray) -> np.ndarray:
    """Labels that each sorted path shares with the next one."""
    differ = path[1:].view(np.uint64) ^ path[:-1].view(np.uint64)
    labels = sum((differ >> np.uint64(64 - 8 * k) == 0).astype(np.int32) for k in range(1, LONGEST)) + (differ == 0)
    return np.where(tree[1:] == tree[:-1], labels, 0).astype(np.int32)


def matches(batches: Iterator[pa.RecordBatch], shortest: int) -> Iterator[pa.RecordBatch]:
    """Leaves of a sorted slice whose longest match has at least ``shortest`` labels.

    What the first and last leaf share with other slices is unknown here; they count as full matches.
    """
    tree, path, cid, up = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.int32(LONGEST)

    def leaves(rows: slice, matched: np.ndarray) -> pa.RecordBatch:
        own = matched >= shortest
        return pa.RecordBatch.from_arrays([pa.array(cid[rows][own]), pa.array(tree[rows][own]), pa.array(path[rows][own]), pa.array(matched[own])], ["cid", "tree", "path", "matched"])

    for batch in batches:
        if batch.num_rows:
            tree, path, cid = (np.concatenate([held, batch.column(name).to_numpy()]) for held, name in ((tree, "tree"), (path, "path"), (cid, "cid")))
            near = shared_labels(tree, path)
            above = np.append(up, near).astype(np.int32)
            yield leaves(slice(0, len(near)), np.maximum(above[:-1], near))
            tree, path, cid, up = tree[-1:], path[-1:], cid[-1:], above[-1]
    yield leaves(slice(0, len(cid)), np.full(len(cid), LONGEST, np.int32))


def meetings(classes: DataFrame, threshold: float, trees: int, target: float) -> DataFrame:
    """Links (u, v) of classes (cid, paths) to the least class of each node they meet others in."""
    shortest = max(1, prefix_depth(threshold, trees, target) - 1)
    places = classes.select("cid", F.posexplode("paths").alias("tree", "path")).repartitionByRange("tree", "path", "cid").sortWithinPartitions("tree", "path", "cid")
    leaves = cut(places.select("cid", "tree", "path").mapInArrow(lambda batches: matches(batches, shortest), LEAF), "ngram-leaves")
    prefix = F.expr(f"shiftrightunsigned(path, 8 * ({LONGEST} - depth))").alias("prefix")
    at_depths = leaves.select("cid", "tree", "path", F.explode(F.sequence(F.lit(shortest), F.col("matched"))).alias("depth"))
    nodes = cut(at_depths.groupBy("tree", "depth", prefix).agg(F.min("cid").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1"), "ngram-nodes")
    pairs = nodes.groupBy("tree", "depth").agg(F.sum(F.col("n") * (F.col("n") - 1.0) / 2).alias("pairs")).collect()  # trees x depths at most
    depths = tree_depths({(r["tree"], r["depth"]): r["pairs"] for r in pairs}, threshold, trees, target, shortest)
    chosen = F.element_at(F.lit(depths), F.col("tree") + 1)
    own = leaves.withColumn("depth", chosen).where("matched >= depth").select("cid", "tree", prefix)
    least = nodes.where(F.col("depth") == chosen).select("tree", "prefix", "least")
    return own.join(least, ["tree", "prefix"]).where("cid != least").select(F.col("cid").alias("u"), F.col("least").alias("v")).distinct()


def verified(sets: np.ndarray, at: np.ndarray, side: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean matrix of the links between texts given by sorted distinct shingles; sides 0 and 1 are only compared with each other."""
    n, size = len(at) - 1, np.diff(at)
    column, count = np.unique(sets, return_inverse=True, return_counts=True)[1:]
    row = np.repeat(np.arange(n), size)
    shared = count > 1  # the others add nothing to an intersection
    number = np.cumsum(shared) - 1
    row, column = row[shared[column]], number[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((n, n), np.float32)
    for a in range(0, int(shared.sum()), COLUMNS):
        low, high = np.searchsorted(column, [a, a + COLUMNS])
        block = np.zeros((n, COLUMNS), np.float32)
        block[row[low:high], column[low:high] - a] = 1
        both += block @ block.T
    link = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-6
    np.fill_diagonal(link, False)
    if side.any():
        link &= side[:, None] != side[None, :]
    return link


def _roots(link: np.ndarray) -> np.ndarray:
    """Least number each row is connected to."""
    label = np.arange(len(link))
    while True:
        new = np.minimum(label, np.where(link, label[None, :], len(link)).min(axis=1, initial=len(link)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verify(table: pa.Table, words: int, threshold: float) -> pa.Table:
    """Links and roots of the classes of one bin of small groups, or of one pair of blocks."""
    table = table.combine_chunks().sort_by([("grp", "ascending"), ("digest", "ascending")])
    digest, group = table["digest"].to_numpy(zero_copy_only=False), table["grp"].to_numpy()
    copies, side = table["copies"].to_numpy(), table["side"].to_numpy()
    once = np.append(True, digest[1:] != digest[:-1]) if len(digest) else np.zeros(0, bool)
    texts = table["text"].combine_chunks() if isinstance(table["text"], pa.ChunkedArray) else table["text"]
    texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
    sets, sizes = [], []
    for _, part in flat.chunks(texts):
        hashes, at = shingles(part, words)
        own = np.repeat(np.arange(len(part)), np.diff(at))
        order = np.lexsort((hashes, own))
        hashes, own = hashes[order], own[order]
        keep = np.append(True, (hashes[1:] != hashes[:-1]) | (own[1:] != own[:-1])) if len(own) else np.zeros(0, bool)
        sets.append(hashes[keep])
        sizes.append(np.bincount(own[keep], minlength=len(part)))
    sets, at = np.concatenate(sets), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    links, roots = np.zeros(len(digest), np.int64), np.arange(len(digest))
    edge = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group))
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        link = verified(sets[at[a] : at[b]], at[a : b + 1] - at[a], side[a:b], threshold) & once[a:b, None] & once[None, a:b]
        links[a:b] = link @ copies[a:b]
        roots[a:b] = _roots(link) + a
    own = np.flatnonzero(once)
    return pa.table({"digest": pa.array(digest[own], pa.string()), "links": links[own], "root": pa.array(digest[roots[own]], pa.string())})


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.8, words: int = 5, trees: int = 24, target: float = 0.999) -> DataFrame:
    """One row per row of ``df``: key, ``digest``, ``class_id`` (least key of the group), ``copies`` (rows with this text), ``n_links`` (other rows with similarity of at least ``threshold``), ``kept`` (this text's least key is ``class_id``)."""
    flat.small_batches(df.sparkSession)
    digest = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    worded = F.coalesce(F.col(text).rlike(HAS_WORD), F.lit(False))
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), digest.alias("digest"), worded.alias("worded"))
    signed = rows.where("worded").select("key", "digest", _signature(F.col("text"), words, trees).alias("s"))
    classes = cut(signed.groupBy("digest").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("s").alias("s"))
                  .select("digest", F.xxhash64("digest").alias("cid"), "rep", "copies", F.col("s.size").alias("size"), F.col("s.paths").alias("paths")), "ngram-classes")
    groups = connected(meetings(classes, threshold, trees, target), "ngram-candidates").withColumnsRenamed({"node": "cid", "label": "grp"})
    members = cut(classes.drop("paths").join(groups, "cid"), "ngram-members")
    total = members.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    bins = total // BIN_SHINGLES + 1
    sizes = members.groupBy("grp").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES), F.ceil(F.sum("size") / BLOCK_SHINGLES)).alias("blocks"))
    block = F.pmod(F.xxhash64("digest", F.lit(7)), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    texts = rows.where("worded").select("key", "digest", "text")
    placed = members.join(sizes, "grp").select("digest", "rep", "copies", "grp", "blocks", block.alias("block"))
    # an exchange at any size: the ids of all candidates are no table to broadcast, and disk then grows with the input from the start
    full = texts.join(placed.hint("merge"), (texts["digest"] == placed["digest"]) & texts["key"].eqNullSafe(placed["rep"])).drop(texts["digest"])
    dealt = full.select("digest", "copies", "grp", "text", "blocks", "block", other.alias("other")).select(
        "digest", "copies", "grp", "text", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("grp"), F.lit(bins))).otherwise(F.col("grp")).alias("place"),
        F.concat_ws("-", "blocks", F.least("block", "other"), F.greatest("block", "other")).alias("pair"),
        F.when((F.col("block") > F.col("other")), 1).otherwise(0).cast("int").alias("side"), (F.col("blocks") > 1).alias("big"))
    dealt = dealt.withColumn("pair", F.when(F.col("big"), F.col("pair")).otherwise("-"))
    checked = cut(dealt.groupBy("place", "pair").applyInArrow(lambda t: _verify(t, words, threshold), "digest string, links long, root string"), "ngram-verified")
    joined = connected(checked.where("digest != root").select(F.col("digest").alias("u"), F.col("root").alias("v")).distinct(), "ngram-groups")
    labelled = (classes.select("digest", "rep", "copies").join(checked.groupBy("digest").agg(F.sum("links").alias("links")), "digest", "left")
                .join(joined.withColumnsRenamed({"node": "digest"}), "digest", "left").withColumn("label", F.coalesce("label", "digest")))
    first = labelled.groupBy("label").agg(F.min("rep").alias("class_id"))
    final = labelled.join(first, "label").select(F.col("digest"), "class_id", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "rep")
    wordless = ~F.col("worded")
    return rows.select("key", "digest", "worded").join(final, "digest", "left").select(
        F.col("key").alias(key), "digest", F.when(wordless, F.col("key")).otherwise(F.col("class_id")).alias("class_id"), F.when(wordless, F.lit(1)).otherwise(F.col("copies")).alias("copies"),
        F.when(wordless, F.lit(0)).otherwise(F.col("n_links")).alias("n_links"), (wordless | F.col("key").eqNullSafe(F.col("class_id"))).alias("kept"))


def one_of_each(df: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``df`` without near duplicates: of each group the row with the least key stays.

    Rows without a word all stay.  Of rows equal in key and text one stays.
    """
    found = near_duplicates(df, text, key, **options)
    kept = cut(found.where("kept").groupBy(F.col(key).alias("__key"), F.col("digest").alias("__digest")).agg(F.count(F.lit(1)).alias("__n")), "ngram-kept")
    own = df.withColumn("__own", F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    meet = (F.col("__own") == F.col("__digest")) & F.col(key).eqNullSafe(F.col("__key"))
    once = own.join(kept.where("__n = 1").hint("merge"), meet, "left_semi").drop("__own")
    several = kept.where("__n > 1")
    if several.isEmpty():  # keys tell rows apart: texts are exchanged once
        return once
    worded = F.coalesce(F.col(text).rlike(HAS_WORD), F.lit(False))
    rank = F.when(worded, F.lit(0)).otherwise(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    again = own.join(several, meet, "left_semi").withColumn("__rank", rank).dropDuplicates(["__own", key, "__rank"]).drop("__own", "__rank")
    return once.unionByName(again)
