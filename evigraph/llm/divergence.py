"""Audit of how sources of a language diverge: term counts by sorting token-start pointers, then exact divergences.

1. A task gathers texts into slices.  A slice is one byte buffer with a pointer to the start of every
   term; pointers are sorted by multikey quicksort with characters of eight bytes: sort by the next
   eight bytes, go on inside the runs that are still equal.  Documents stand in the buffer by
   (lang, source), so an equal run falls into one stretch per source, and each stretch gives the
   term's occurrences and the number of documents that hold it.
2. Spark adds the slices up: once per (lang, source, term), then per (lang, term).  A term stays if
   enough documents of its language hold it.
3. Each source's chance of a term is smoothed and scaled to an integer; the same for the language.
   A source's own terms are ranked against its language.
4. Sources are compared with each other in tiles of ``TILE`` x ``TILE`` sources of a language: a task gets the terms of one
   shard that occur in a tile, and sums the divergence over them; what neither source holds
   is added by number.  Rows per term are its sources times the tiles, never the pairs of its sources.

All numbers are integers: 64-bit, where counts are multiplied decimals.

Defined results: null text, language and source count as empty strings; sources without a term are compared too;
repeated rows are documents of their own; a language in which no term stays has divergences of 0 and no
term rows; an empty table gives no rows; other columns are not carried, as a row stands for a source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evigraph.llm import flat
from evigraph.session import cut

SLICE_BYTES, LONG_TERM = 4 << 20, 64
TILE, SHARD_ROWS, BLOCK = 128, 500_000, 2048
SCALE, FLOOR = 1_000_000_000, 2
COUNTED = "lang string, source string, term string, n long, docs long"
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def pointer_sort(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the terms by their bytes, equal ones by place, and whether each place in this order starts a new term.

    ``buf`` goes on for eight bytes behind the last term.  Terms hold no zero byte, so zeros stand for their end.
    """
    chars = np.ndarray((max(0, len(buf) - 7),), ">u8", buf, strides=(1,))
    length = ends - starts
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)

    def char(term: np.ndarray, depth: int) -> np.ndarray:
        rest = np.clip(length[term] - depth, 0, 8)
        keep = np.where(rest == 0, np.uint64(0), ones << (np.uint64(8) * (8 - np.maximum(rest, 1)).astype(np.uint64)))
        return chars[np.minimum(starts[term] + depth, len(chars) - 1)].astype(np.uint64) & keep

    n = len(starts)
    order, new = np.arange(n), np.zeros(n, bool)
    new[:1] = True
    place, group = np.arange(n), np.zeros(n, np.int64)  # places whose run is not settled, and their run
    for depth in range(0, LONG_TERM, 8):
        if not len(place):
            return order, new
        term = order[place]
        key = char(term, depth)
        by = np.argsort(key, kind="stable") if depth == 0 else np.lexsort((key, group))
        order[place], key = term[by], key[by]
        first = np.append(True, (group[1:] != group[:-1]) | (key[1:] != key[:-1]))
        new[place] |= first
        run = np.cumsum(first) - 1
        open_run = (np.bincount(run) > 1) & (np.maximum.reduceat(length[order[place]], np.flatnonzero(first)) > depth + 8)
        go_on = open_run[run]
        place, group = place[go_on], run[go_on]
    raw = buf.tobytes()
    edge = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else []
    for a, b in zip(edge, [*edge[1:], len(group)], strict=True):  # the few equal beginnings of this length
        texts = sorted((raw[starts[t] : ends[t]], t) for t in order[place[a:b]])
        order[place[a:b]] = [t for _, t in texts]
        new[place[a + 1 : b]] = [x[0] != y[0] for x, y in zip(texts[1:], texts[:-1], strict=True)]
    return order, new


def counted_slice(langs: pa.Array, sources: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
    """Per (lang, source, term) of a slice occurrences and documents, and with a null term its documents."""
    names = [x.dictionary_encode() for x in (langs, sources)]
    codes = names[0].indices.to_numpy().astype(np.int64) * max(1, len(names[1].dictionary)) + names[1].indices.to_numpy()
    groups, group = np.unique(codes, return_inverse=True)
    order = np.argsort(group, kind="stable")
    group = group[order]
    buf, offsets = flat.flat(texts.take(pa.array(order)))
    buf = np.concatenate([buf, np.zeros(16, np.uint8)])
    buf[(buf >= 0x41) & (buf <= 0x5A)] += 32
    starts, ends = flat.runs(LETTER[buf])
    by, new = pointer_sort(buf, starts, ends)
    doc = np.searchsorted(offsets, starts, "right")[by] - 1
    first = new | (group[doc] != np.append(-1, group[doc[:-1]])) if len(by) else new
    at = np.flatnonzero(first)
    n = np.diff(np.append(at, len(by)))
    docs = np.add.reduceat((first | (doc != np.append(-1, doc[:-1]))).astype(np.int64), at) if len(at) else n
    term = by[at]
    size = ends[term] - starts[term]
    until = np.concatenate([[0], np.cumsum(size)])
    data = buf[np.repeat(starts[term] - until[:-1], size) + np.arange(until[-1])]
    words = pa.LargeStringArray.from_buffers(len(term), pa.py_buffer(until.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
    held = np.bincount(group, minlength=len(groups))
    code = groups[np.concatenate([group[doc[at]], np.arange(len(groups))])]
    lang, source = np.divmod(code, max(1, len(names[1].dictionary)))
    yield pa.record_batch({
        "lang": names[0].dictionary.take(pa.array(lang)), "source": names[1].dictionary.take(pa.array(source)), "term": pa.concat_arrays([words, pa.nulls(len(groups), pa.string())]),
        "n": np.concatenate([n, np.zeros(len(groups), np.int64)]), "docs": np.concatenate([docs, held])})


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of whole texts of about ``SLICE_BYTES``."""
    waiting, size = [], 0
    for batch in batches:
        for at, part in flat.chunks(batch.column(2), SLICE_BYTES):
            waiting.append(batch.slice(at, len(part)))
            size += pc.sum(pc.binary_length(part)).as_py() or 0
            if size >= SLICE_BYTES:
                yield from counted_slice(*pa.Table.from_batches(waiting).combine_chunks().to_batches()[0].columns)
                waiting, size = [], 0
    if sum(len(b) for b in waiting):
        yield from counted_slice(*pa.Table.from_batches(waiting).combine_chunks().to_batches()[0].columns)


def chance(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + FLOOR) / (total + FLOOR * terms)), exact for counts beyond 64 bits of product."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (n + FLOOR).cast("decimal(20,0)")
    return F.call_function("div", above, F.greatest(total + FLOOR * terms, F.lit(1)).cast("decimal(20,0)")) + 1


def compared(entries: pa.Table, sources: pa.Table) -> pa.Table:
    """Sums over one shard's terms for every ordered pair of sources of two tiles: (s, t, value, terms)."""
    number, none = sources["member"].to_numpy(), sources["absent"].to_numpy()
    by = np.argsort(number)
    number, none, tile = number[by], none[by], sources["tile"].to_numpy()[by]
    terms, row = np.unique(entries["term"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False) if len(entries) else np.zeros(0, np.int64), return_inverse=True)
    column, p = np.searchsorted(number, entries["number"].to_numpy()), entries["p"].to_numpy()
    order = np.argsort(row, kind="stable")
    row, column, p = row[order], column[order], p[order]
    left, right = (np.flatnonzero(tile == x) for x in (tile.min(), tile.max()))
    total = np.zeros((len(left), len(right)), np.int64)
    for a in range(0, len(terms), BLOCK):
        low, high = np.searchsorted(row, [a, a + BLOCK])
        block = np.repeat(none[:, None], min(BLOCK, len(terms) - a), axis=1)
        block[column[low:high], row[low:high] - a] = p[low:high]
        for i, s in enumerate(left):
            gap, both = block[right] - block[s], block[right] + block[s]
            total[i] += (gap * gap // both).sum(axis=1)
    s, t = np.repeat(number[left], len(right)), np.tile(number[right], len(left))
    gap, both = np.repeat(none[left], len(right)) - np.tile(none[right], len(left)), np.repeat(none[left], len(right)) + np.tile(none[right], len(left))
    value, rest = total.reshape(-1), gap * gap // both
    if tile.min() != tile.max():
        s, t, value, rest = np.concatenate([s, t]), np.concatenate([t, s]), np.tile(value, 2), np.tile(rest, 2)
    own = s != t
    return pa.table({"s": s[own], "t": t[own], "value": value[own], "rest": rest[own], "terms": np.full(own.sum(), len(terms), np.int64)})


def audit(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has the divergence from each other source, part ``term`` the ``top`` terms that set a source apart from its language."""
    flat.small_batches(df.sparkSession)
    own = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    counted = cut(own.mapInArrow(_count, COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "audit-terms")
    kept = counted.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    held = cut(counted.where("term is not null").select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "audit-kept")
    langs = counted.select("lang").distinct().join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total")), "lang", "left").na.fill(0)
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counted.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").na.fill(0, ["total"]).join(langs, "lang")
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = cut(groups.withColumn("number", number).withColumn("tile", (F.col("number") / TILE).cast("int")).withColumn("absent", chance(F.lit(0), F.col("total"), F.col("terms"))), "audit-groups")
    scored = held.join(groups, ["lang", "source"]).select("*", chance(F.col("n"), F.col("total"), F.col("terms")).alias("p"), chance(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"))
    gap, both = F.col("p") - F.col("q"), F.col("p") + F.col("q")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = scored.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return _pairs(scored, groups, held.count() // SHARD_ROWS + 1).withColumn("rank", F.row_number().over(best)).unionByName(terms)


def _pairs(scored: DataFrame, groups: DataFrame, shards: int) -> DataFrame:
    tiles = groups.groupBy("lang").agg(F.max("tile").alias("last"))
    ends = F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other")
    shard = F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int").alias("shard")
    sides = [F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b")]
    entries = scored.select("lang", "term", "number", "p", "tile", shard).join(tiles, "lang").select("*", ends).select("lang", *sides, "shard", "term", "number", "p")
    members = groups.join(tiles, "lang").select("lang", "number", "absent", "tile", ends).select("lang", *sides, F.col("number").alias("member"), "absent", "tile").select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    keys = ["lang", "a", "b", "shard"]

    def work(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found = compared(left, right)
        return found.add_column(0, "lang", pa.repeat(key[0].cast(pa.string()), len(found)))

    sums = entries.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInArrow(work, "lang string, s int, t int, value long, rest long, terms long")
    sums = sums.groupBy("lang", "s", "t").agg(F.sum("value").alias("value"), F.first("rest").alias("rest"), F.sum("terms").alias("seen"))
    named = lambda n, c: groups.select("lang", F.col("number").alias(n), F.col("source").alias(c), F.col("terms").alias(f"{c}_terms"))
    joined = sums.join(named("s", "source"), ["lang", "s"]).join(named("t", "item").drop("item_terms"), ["lang", "t"])
    value = F.col("value") + (F.col("source_terms") - F.col("seen")) * F.when(F.col("source_terms") > 0, F.col("rest")).otherwise(0)
    return joined.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
