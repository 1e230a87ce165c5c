"""Exact substring deduplication: suffix pointers ordered by deep-shallow sorting.

A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a document with a smaller key,
or further ahead in the same one.  All suffixes of all texts would be far more than the texts,
so pointers are first cut down and dealt out by content:

1. Texts are dealt into slices by a hash of key and text; that exchange is the only one of texts, and all
   steps read it.  Every string of ``length`` bytes has one anchor: among its runs of ``GRAM`` bytes the one with
   the least hash (the first of equals).  Equal strings have equal anchors at equal places, and some 35 neighbouring
   strings share one.  A slice sends each of its anchors' hashes once, with a count.
2. Hashes met more than once go back to their slices.  All strings without such an anchor are unique.
3. A slice sorts pointers to the remaining strings.  Multikey quicksort, with characters of eight bytes, orders
   them to a depth of ``SHALLOW`` bytes; what is still equal there goes through blind tries: a group's
   first pointer is the trie's path, every other one is held against it once, and leaves it at the byte where they
   differ; those that leave at the same byte by the same branch form the next group.  Of an equal run all but the first
   pointer are repeats, whatever other slices hold.  Only firsts go on, as neighbouring strings with
   the bytes they cover.
4. Firsts meet by anchor and are sorted in the same way.  Anchors that occur more than ``hot`` times
   are no key: their strings meet by their own hash of 128 bits, first within one of ``SALTS`` parts of the slices, then all.
   So a passage, line or phrase that very many texts hold is spread out.
5. Places of repeats go back to the slices, where the union of the strings they start is taken out.

Tasks hold a slice, or a bin of about its size; pointers are sorted in pieces of whole anchors, so that equal strings meet; only
hot anchors may be cut between pieces, as all their firsts go on.

Defined results: null counts as empty; texts shorter than ``length`` keep all; the key is an integer,
null sorts last as the largest number; rows equal in key stand in the order of a hash of their text; rows equal in
key and text are one document and get equal answers; an empty table gives no rows; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm import flat

SLICE_BYTES, BLOCK, PIECE = 4 << 20, 1 << 17, 1 << 20
GRAM, SHALLOW, HOT, SALTS = 32, 24, 2048, 64
LAST = np.iinfo(np.int64).max
ANCHORS = "bin int, slice long, hashes array<long>, counts array<int>"
KNOWN = "slice long, hashes array<long>, kinds array<int>"
HERE, ELSEWHERE, SPREAD = 1, 2, 3  # an anchor recurs in its slice only, in others too, or is hot (in one slice or several)
PACK = "bin int, kind int, slice array<long>, hash array<long>, more array<long>, ord array<long>, tie array<long>, start array<long>, n array<int>, data binary"
MARKS, STRINGS, WINDOWS = 0, 1, 2
COLUMNS = ("slice", "hash", "more", "ord", "tie", "start", "n")


def _chars(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number that sorts like them; ``buf`` is at least eight long."""
    return np.ndarray((len(buf) - 7,), ">u8", buf, strides=(1,))


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... ``sizes[0]`` times, then the next."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Where a new run of equal keys starts."""
    first = np.zeros(len(keys[0]), bool)
    first[:1] = True
    for k in keys:
        first[1:] |= k[1:] != k[:-1]
    return first


def repeats(buf: np.ndarray, pointers: np.ndarray, length: int) -> np.ndarray:
    """Whether the string of ``length`` bytes at each pointer also stands at a smaller one of the pointers.

    ``buf`` goes on for eight bytes behind the last string.
    """
    chars, found = _chars(buf), np.zeros(len(pointers), bool)
    place, group = np.arange(len(pointers)), np.zeros(len(pointers), np.int64)
    for depth in range(0, SHALLOW, 8):
        key = chars[pointers[place] + depth].astype(np.uint64)
        by = np.argsort(key) if depth == 0 else np.lexsort((key, group))
        run = np.cumsum(_groups(group[by], key[by])) - 1
        more = (np.bincount(run, minlength=1) > 1)[run]
        place, group = place[by][more], run[more]
    depths = [*range(SHALLOW, length - 8, 8), length - 8]
    while len(place):  # one round compares every pointer with its trie's path; common beginnings grow, so rounds are at most ``length``
        first = _groups(group)
        path = np.minimum.reduceat(pointers[place], np.flatnonzero(first))[np.cumsum(first) - 1]
        own, left, branch = pointers[place], np.arange(len(place)), np.zeros(len(place), np.int64)
        for depth in depths:
            a = chars[own[left] + depth].astype(np.uint64)
            x = a ^ chars[path[left] + depth].astype(np.uint64)
            off = x != 0
            top = x[off]
            top = np.log2((top & ~(top >> np.uint64(1))).astype(np.float64)).astype(np.int64) >> 3  # highest byte that differs
            byte = (a[off] >> (top.astype(np.uint64) << np.uint64(3))) & np.uint64(255)
            branch[left[off]] = 1 + (depth + 7 - top) * 256 + byte.astype(np.int64)
            left = left[~off]
        found[place[left]] = own[left] != path[left]
        apart = np.flatnonzero(branch)
        key = group[apart] * ((length + 1) * 256) + branch[apart]
        by = np.argsort(key)
        run = np.cumsum(_groups(key[by])) - 1
        more = (np.bincount(run, minlength=1) > 1)[run]
        place, group = place[apart][by][more], run[more]
    return found


def anchors(buf: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first string, number of strings, anchor's hash) of each run of strings with one anchor; no string crosses an offset.

    ``buf`` goes on for ``GRAM`` bytes behind the last text.  Blocks bound the memory; a run may be cut by their ends.
    """
    size, width = np.diff(offsets), length - GRAM + 1
    own = np.flatnonzero(size >= length)
    begins, ends = offsets[own], offsets[own] + size[own] - length + 1
    chars = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
    mask = np.uint64((1 << 18) - 1)
    for a in range(0, int(offsets[-1]), BLOCK):
        b = min(a + BLOCK, int(offsets[-1]))
        low, high = np.searchsorted(ends, a, "right"), np.searchsorted(begins, b)
        if low >= high:
            continue
        at = _spread(np.maximum(begins[low:high], a) - a, np.minimum(ends[low:high], b) - np.maximum(begins[low:high], a))
        n = min(b + width - 1, len(buf) - GRAM) - a
        h = np.zeros(n, np.uint64)
        for j in range(0, GRAM, 8):
            h = h * flat.ROOT + chars[a + j : a + j + n]
        h = flat.mix(h)
        least, span = (h & ~mask) | np.arange(n, dtype=np.uint64), 1
        while 2 * span <= width:
            least, span = np.minimum(least[:-span], least[span:]), 2 * span
        spot = (np.minimum(least[at], least[at + width - span]) & mask).astype(np.int64)
        first = _groups(spot, at - np.arange(len(at)))
        run = np.flatnonzero(first)
        yield at[run] + a, np.diff(np.append(run, len(at))), h[spot[run]]


def _documents(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different documents of a slice in order, all bytes with room behind them, offsets, and the key and tie of each."""
    ord_ = table["key"].fill_null(LAST).to_numpy()
    tie = table["tie"].to_numpy()
    by = np.lexsort((tie, ord_))
    by = by[_groups(ord_[by], tie[by])]
    texts = table["text"].combine_chunks().take(pa.array(by)) if len(by) else pa.array([], pa.string())
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    buf, offsets = flat.flat(texts, 0)
    return table, np.concatenate([buf, np.zeros(128, np.uint8)]), offsets, ord_[by], tie[by]


def sent_anchors(table: pa.Table, length: int, bins: int) -> pa.Table:
    """Step 1 for one slice: its anchors' hashes by bin."""
    _, buf, offsets, _, _ = _documents(table)
    seen = [h for _, _, h in anchors(buf, offsets, length)]
    hashes, counts = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    to = (flat.mix(hashes) % np.uint64(bins)).astype(np.int64)
    by = np.argsort(to, kind="stable")
    at = np.flatnonzero(_groups(to[by]))
    ends = pa.array(np.append(at, len(by)), pa.int32())
    return pa.table({"bin": pa.array(to[by][at], pa.int32()), "slice": pa.array(np.full(len(at), table["slice"][0].as_py()), pa.int64()),
                     "hashes": pa.ListArray.from_arrays(ends, pa.array(hashes[by].view(np.int64))), "counts": pa.ListArray.from_arrays(ends, pa.array(counts[by], pa.int32()))})


def known_anchors(table: pa.Table, hot: int) -> pa.Table:
    """Step 2 for one bin: the hashes met more than once, for each slice that sent them."""
    lists = table["hashes"].combine_chunks()
    hashes, counts = (np.asarray(table[c].combine_chunks().flatten()) for c in ("hashes", "counts"))
    owner = np.asarray(lists.value_parent_indices())
    by = np.argsort(hashes, kind="stable")
    first = _groups(hashes[by])
    run = np.cumsum(first) - 1
    at = np.flatnonzero(first)
    total = np.add.reduceat(counts[by].astype(np.int64), at)[run] if len(at) else run
    shared = np.bincount(run, minlength=1)[run] > 1
    kind = np.where(total > hot, SPREAD, np.where(shared, ELSEWHERE, HERE))
    keep = total > 1
    by, kind = by[keep], kind[keep]
    back = np.argsort(owner[by], kind="stable")
    by, kind = by[back], kind[back]
    at = np.flatnonzero(_groups(owner[by]))
    ends = pa.array(np.append(at, len(by)), pa.int32())
    return pa.table({"slice": table["slice"].combine_chunks().take(pa.array(owner[by][at])), "hashes": pa.ListArray.from_arrays(ends, pa.array(hashes[by])), "kinds": pa.ListArray.from_arrays(ends, pa.array(kind, pa.int32()))})


def _packed(bins: np.ndarray, kind: int, columns: dict[str, np.ndarray], data: tuple[np.ndarray, np.ndarray] | None = None) -> pa.Table:
    """One row per bin; ``data`` is all bytes and the size of each entry's part."""
    by = np.argsort(bins, kind="stable")
    at = np.flatnonzero(_groups(bins[by]))
    ends = np.append(at, len(by))
    lists = {c: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(columns[c][by].astype(np.int32 if c == "n" else np.int64))) if c in columns else pa.nulls(len(at), pa.list_(pa.int32() if c == "n" else pa.int64())) for c in COLUMNS}
    packs = pa.nulls(len(at), pa.binary())
    if data is not None:
        whole, size = data
        until = np.concatenate([[0], np.cumsum(size[by])])[ends]
        moved = whole[_spread((np.cumsum(size) - size)[by], size[by])]
        packs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(until.astype(np.int64)), pa.py_buffer(moved)]).cast(pa.binary())
    return pa.table({"bin": pa.array(bins[by][at], pa.int32()), "kind": pa.array(np.full(len(at), kind), pa.int32()), **lists, "data": packs})


def _unpacked(table: pa.Table, kind: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The entries of one kind, and all their bytes."""
    own = table.filter(pa.compute.equal(table["kind"], kind)).combine_chunks()
    columns = {c: np.asarray(pa.concat_arrays([x.flatten() for x in own[c].chunks]) if own[c].num_chunks else pa.array([], pa.int64())) for c in COLUMNS}
    return columns, np.frombuffer(b"".join(own["data"].to_pylist()), np.uint8) if kind == STRINGS else np.zeros(0, np.uint8)


def _marked(slices: np.ndarray, ord_: np.ndarray, tie: np.ndarray, start: np.ndarray, bins: int) -> pa.Table:
    """Repeats as runs of neighbouring starts, given in order of document and start."""
    first = np.flatnonzero(_groups(ord_, tie, start - np.arange(len(start))))
    n = np.diff(np.append(first, len(start)))
    return _packed(slices[first] % bins, MARKS, {"slice": slices[first], "ord": ord_[first], "tie": tie[first], "start": start[first], "n": n})


def window_hashes(buf: np.ndarray, pointers: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the string at each pointer."""
    chars = _chars(buf)
    h, g = np.full(len(pointers), length, np.uint64), np.full(len(pointers), ~np.uint64(length))
    for depth in [*range(0, length - 8, 8), length - 8]:
        c = chars[pointers + depth].astype(np.uint64)
        h, g = flat.mix((h ^ c) * flat.ROOT), flat.mix(g * flat.ROOT ^ (c + np.uint64(depth)))
    return h, g


def settled_slice(table: pa.Table, known: pa.Table, length: int, bins: int) -> Iterator[pa.Table]:
    """Step 3 for one slice."""
    if not len(known) or not len(table):
        return
    _, buf, offsets, ord_, tie = _documents(table)
    slice_ = table["slice"][0].as_py()
    hashes, kinds = (np.asarray(pa.concat_arrays([x.flatten() for x in known[c].chunks])) for c in ("hashes", "kinds"))
    by = np.argsort(hashes.view(np.uint64))
    hashes, kinds = hashes.view(np.uint64)[by], kinds[by]

    def recurring() -> Iterator[tuple[np.ndarray, ...]]:
        runs = []
        for first, n, h in anchors(buf, offsets, length):
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = hashes[at] == h
            runs.append((first[hit], n[hit], h[hit], kinds[at[hit]]))
        if not runs:
            return
        first, n, h, kind = (np.concatenate(x) for x in zip(*runs, strict=True))
        by = np.lexsort((first, h))
        first, n, h, kind = first[by], n[by], h[by], kind[by]
        whole = _groups(np.where(kind == SPREAD, np.arange(len(h), dtype=np.uint64), h), kind)  # runs of a hot anchor may part
        edge = np.append(np.flatnonzero(whole), len(h))
        weight = np.concatenate([[0], np.cumsum(n)])
        low = 0
        while low < len(edge) - 1:
            high = max(low + 1, int(np.searchsorted(weight[edge], weight[edge[low]] + PIECE, "right")) - 1)
            piece = slice(edge[low], edge[high])
            yield first[piece], n[piece], h[piece], kind[piece]
            low = high

    for first, n, h, kind in recurring():
        pointers, anchor = _spread(first, n), np.repeat(np.arange(len(n)), n)
        again = repeats(buf, pointers, length)
        doc = np.searchsorted(offsets, pointers, "right") - 1
        by = np.argsort(pointers[again])
        p, d = pointers[again][by], doc[again][by]
        if len(p):
            yield _marked(np.full(len(p), slice_), ord_[d], tie[d], p - offsets[d], bins)
        go_on = ~again & (kind[anchor] == ELSEWHERE)
        p, d, a = pointers[go_on], doc[go_on], anchor[go_on]
        if len(p):
            run = np.flatnonzero(_groups(a, p - np.arange(len(p))))
            count = np.diff(np.append(run, len(p)))
            p, d, key = p[run], d[run], h[a[run]]
            data = buf[_spread(p, count + length - 1)]
            yield _packed((flat.mix(key) % np.uint64(bins)).astype(np.int64), STRINGS, {"slice": np.full(len(p), slice_), "hash": key.view(np.int64), "ord": ord_[d], "tie": tie[d], "start": p - offsets[d], "n": count}, (data, count + length - 1))
        hot = ~again & (kind[anchor] == SPREAD)
        p, d = pointers[hot], doc[hot]
        if len(p):
            key, more = window_hashes(buf, p, length)
            to = flat.mix(key + np.uint64(slice_ % SALTS)) % np.uint64(bins)
            yield _packed(to.astype(np.int64), WINDOWS, {"slice": np.full(len(p), slice_), "hash": key.view(np.int64), "more": more.view(np.int64), "ord": ord_[d], "tie": tie[d], "start": p - offsets[d]})


def settled_bin(table: pa.Table, length: int, bins: int, final: bool) -> Iterator[pa.Table]:
    """Step 4 for one bin: strings by their bytes, windows of hot anchors by their hashes; marks pass."""
    marks = table.filter(pa.compute.equal(table["kind"], MARKS))
    if len(marks):
        yield marks
    e, data = _unpacked(table, STRINGS)
    if len(e["hash"]):
        size = e["n"].astype(np.int64) + length - 1
        at = np.cumsum(size) - size
        by = np.lexsort((e["start"], e["tie"], e["ord"], e["hash"]))
        edge = np.append(np.flatnonzero(_groups(e["hash"][by])), len(by))
        weight = np.concatenate([[0], np.cumsum(e["n"][by].astype(np.int64))])
        low = 0
        while low < len(edge) - 1:  # whole anchors up to a piece
            high = max(low + 1, int(np.searchsorted(weight[edge], weight[edge[low]] + PIECE, "right")) - 1)
            part = by[edge[low] : edge[high]]
            part = part[np.lexsort((e["start"][part], e["tie"][part], e["ord"][part]))]
            low = high
            buf = np.concatenate([data[_spread(at[part], size[part])], np.zeros(16, np.uint8)])
            begin, n = np.cumsum(size[part]) - size[part], e["n"][part].astype(np.int64)
            again = repeats(buf, _spread(begin, n), length)
            if again.any():
                own = np.repeat(part, n)[again]
                yield _marked(e["slice"][own], e["ord"][own], e["tie"][own], (_spread(e["start"][part], n))[again], bins)
    w, _ = _unpacked(table, WINDOWS)
    if len(w["hash"]):
        by = np.lexsort((w["start"], w["tie"], w["ord"], w["more"], w["hash"]))
        first = _groups(w["hash"][by], w["more"][by])
        same = by[~first]
        same = same[np.lexsort((w["start"][same], w["tie"][same], w["ord"][same]))]
        if len(same):
            yield _marked(w["slice"][same], w["ord"][same], w["tie"][same], w["start"][same], bins)
        if not final:
            own = by[first]
            yield _packed((flat.mix(w["hash"][own].view(np.uint64)) % np.uint64(bins)).astype(np.int64), WINDOWS, {c: w[c][own] for c in ("slice", "hash", "more", "ord", "tie", "start")})


def kept_bytes(table: pa.Table, marks: pa.Table, length: int) -> pa.Table:
    """Step 5 for one slice: what is left of each text."""
    _, buf, offsets, ord_, tie = _documents(table)
    m, _ = _unpacked(marks, MARKS) if len(marks) else ({c: np.zeros(0, np.int64) for c in COLUMNS}, None)
    place = {d: i for i, d in enumerate(zip(ord_.tolist(), tie.tolist(), strict=True))}
    number = lambda a, b: np.array([place[d] for d in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
    begin = offsets[number(m["ord"], m["tie"])] + m["start"]
    step = np.zeros(int(offsets[-1]) + 1, np.int32)
    np.add.at(step, begin, 1)
    np.add.at(step, begin + m["n"] + length - 1, -1)
    gone = np.cumsum(step)[:-1] > 0
    start, _ = flat.runs(gone)
    start = np.unique(np.concatenate([start, offsets[:-1][np.diff(offsets) > 0][gone[offsets[:-1][np.diff(offsets) > 0]]]]))  # a run of one document ends with it
    spans = np.bincount(np.searchsorted(offsets, start, "right") - 1, minlength=len(ord_))
    removed = np.concatenate([[0], np.cumsum(gone)])
    removed = removed[offsets[1:]] - removed[offsets[:-1]]
    size = np.diff(offsets)
    until = np.concatenate([[0], np.cumsum(size - removed)]).astype(np.int64)
    kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ord_), [None, pa.py_buffer(until), pa.py_buffer(buf[: len(gone)][~gone])]).cast(pa.binary())
    row = pa.array(number(table["key"].fill_null(LAST).to_numpy(), table["tie"].to_numpy()))
    take = lambda x: pa.array(x, pa.int64()).take(row)
    return pa.table({"key": table["key"].combine_chunks(), "n_bytes": take(size), "n_removed": take(removed), "n_spans": take(spans), "kept": kept.take(row)})


def deduplicated(df: DataFrame, text: str = "text", key: str = "doc_id", length: int = 100, slice_bytes: int = SLICE_BYTES, hot: int = HOT) -> DataFrame:
    """One row per row of ``df``: key, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and ``kept``, the bytes that stay."""
    if length < GRAM + 8:
        raise ValueError(f"length must be at least {GRAM + 8}")
    flat.small_batches(df.sparkSession)
    own = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    bins = total // slice_bytes + 1
    texts = own.select("key", F.xxhash64("text").alias("tie"), "text").select("*", F.pmod(F.xxhash64("key", "tie"), F.lit(bins)).alias("slice"))
    sent = texts.groupBy("slice").applyInArrow(lambda t: sent_anchors(t, length, bins // 4 + 1), ANCHORS)
    known = sent.groupBy("bin").applyInArrow(lambda t: known_anchors(t, hot), KNOWN)

    def joined(tables: Iterator[pa.Table]) -> pa.Table:
        schema = None
        parts = list(tables)
        for p in parts:
            schema = schema or p.schema
        return pa.concat_tables([p.cast(schema) for p in parts]) if parts else _packed(np.zeros(0, np.int64), MARKS, {})

    firsts = texts.groupBy("slice").cogroup(known.groupBy("slice")).applyInArrow(lambda t, k: joined(settled_slice(t, k, length, bins)), PACK)
    near = firsts.groupBy("bin").applyInArrow(lambda t: joined(settled_bin(t, length, bins, False)), PACK)
    far = near.groupBy("bin").applyInArrow(lambda t: joined(settled_bin(t, length, bins, True)), PACK)
    marks = far.where(F.col("kind") == MARKS)
    marks = marks.select(F.explode(F.arrays_zip("slice", "ord", "tie", "start", "n")).alias("m")).select("m.*")
    packed = marks.groupBy("slice").agg(*[F.collect_list(c).alias(c) for c in ("ord", "tie", "start", "n")])
    marks = packed.select(F.col("slice").alias("to"), F.lit(0).alias("bin"), F.lit(MARKS).alias("kind"), *[F.lit(None).cast("array<long>").alias(c) for c in ("slice", "hash", "more")], "ord", "tie", "start", "n", F.lit(None).cast("binary").alias("data"))
    left = texts.groupBy("slice").cogroup(marks.groupBy("to")).applyInArrow(lambda t, m: kept_bytes(t, m, length), "key long, n_bytes long, n_removed long, n_spans long, kept binary")
    return left.select(F.col("key").cast(df.schema[key].dataType).alias(key), "n_bytes", "n_removed", "n_spans", "kept")
