"""Language identification by prediction by partial matching.

For each language a tree of byte contexts up to ``order`` bytes deep holds how
often each byte followed each context in a bounded training sample.  The
statistics are then frozen.  A text's code length under a language is the exact
sum over its bytes of -log2 P(byte | longest known context), where a byte that a
context has not seen costs that context's escape (escape count = number of
distinct followers) and is looked up one byte shorter, down to a uniform byte.
The language with the shortest code wins.

The cost of a byte depends only on the ``order`` bytes before it, so costs are
looked up per window of ``order + 1`` bytes and remembered in a fixed-size table;
lengths are summed as integers (1/65536 bit), hence exact and independent of how
Spark batches the rows.

Defined results: a null text or one without a letter is ``und`` with score 0; if
nothing can be learned (no labelled row) every text is ``und``; equal lengths go to the
language that sorts first; repeated rows get equal answers; an empty table gives
no rows; other columns pass through (the added names replace equal ones).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evigraph.llm import flat

UNKNOWN = "und"
UNIT = 1 << 16
SLOTS_BITS = 20


class Model:
    """Frozen follower counts: for each depth sorted (context, byte) keys and a count per language."""

    def __init__(self, langs: list[str], order: int, table: pa.Table):
        self.langs, self.order, self.keys, self.counts, self.contexts, self.seen, self.kinds = langs, order, [], [], [], [], []
        number = {x: i for i, x in enumerate(langs)}
        lang = np.array([number[x] for x in table["lang"].to_pylist()], np.int64)
        depth, key, n = (table[c].to_numpy() for c in ("depth", "key", "n"))
        for d in range(order + 1):
            at = depth == d
            keys, row = np.unique(key[at].astype(np.uint64), return_inverse=True)
            counts = np.zeros((len(keys), len(langs)), np.int64)
            np.add.at(counts, (row, lang[at]), n[at])
            contexts, row = np.unique(keys >> np.uint64(8), return_inverse=True)
            seen, kinds = (np.zeros((len(contexts), len(langs)), np.int64) for _ in range(2))
            np.add.at(seen, row, counts)
            np.add.at(kinds, row, counts > 0)
            for store, value in ((self.keys, keys), (self.counts, counts), (self.contexts, contexts), (self.seen, seen), (self.kinds, kinds)):
                store.append(value)

    def costs(self, windows: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each window under each language, in 1/65536 bit."""
        shape = len(windows), len(self.langs)
        bits, left = np.zeros(shape), np.ones(shape, bool)
        for d in range(self.order, -1, -1):
            part = windows & np.uint64((1 << 8 * (d + 1)) - 1)
            count = _rows(self.keys[d], self.counts[d], part)
            seen, kinds = (_rows(self.contexts[d], x, part >> np.uint64(8)) for x in (self.seen[d], self.kinds[d]))
            with np.errstate(divide="ignore", invalid="ignore"):
                hit, miss = left & (count > 0), left & (count == 0) & (seen > 0)
                bits += np.where(hit, np.log2(seen + kinds) - np.log2(count), 0) + np.where(miss, np.log2(seen + kinds) - np.log2(kinds), 0)
            left &= ~hit
        return np.rint((bits + 8 * left) * UNIT).astype(np.int32)


def _rows(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The row of each wanted key, zeros where there is none."""
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return values[at] * (keys[at] == wanted)[:, None] if len(keys) else np.zeros((len(wanted), values.shape[1]), values.dtype)


class Scorer:
    """Sums code lengths of texts; remembers window costs in a table of fixed size."""

    def __init__(self, model: Model):
        self.model = model
        self.held = np.full(1 << SLOTS_BITS, np.iinfo(np.uint64).max)
        self.cost = np.zeros((1 << SLOTS_BITS, len(model.langs)), np.int32)

    def _costs(self, windows: np.ndarray) -> np.ndarray:
        slot = ((windows * flat.ROOT) >> np.uint64(64 - SLOTS_BITS)).astype(np.int64)
        out, miss = self.cost[slot], np.flatnonzero(self.held[slot] != windows)
        if len(miss):
            new, row = np.unique(windows[miss], return_inverse=True)
            cost = self.model.costs(new)
            out[miss] = cost[row]
            place, first = np.unique(((new * flat.ROOT) >> np.uint64(64 - SLOTS_BITS)).astype(np.int64), return_index=True)
            self.held[place], self.cost[place] = new[first], cost[first]
        return out

    def lengths(self, texts: pa.Array, step: int = 1 << 18) -> np.ndarray:
        """(texts, languages) code lengths."""
        k, out = self.model.order, []
        for _, part in flat.chunks(texts):
            buf, offsets = flat.flat(part, k)
            total = np.zeros((len(part), len(self.model.langs)), np.int64)
            for a in range(k, len(buf), step):  # long texts in steps; integer sums do not depend on where they are cut
                b = min(len(buf), a + step)
                cost = self._costs(windows_of(buf, a, b, k))
                low, high = np.searchsorted(offsets, a, "right") - 1, np.searchsorted(offsets, b, "left")
                begin = np.maximum(offsets[low:high], a) - a
                for j in range(k):  # the line breaks in front of a text are context, not content
                    pads = offsets[low:high] + j - a
                    cost[pads[(pads >= 0) & (pads < b - a)]] = 0
                total[low:high] += np.add.reduceat(cost, begin, axis=0, dtype=np.int64)
            out.append(total)
        return np.concatenate(out) if out else np.zeros((0, len(self.model.langs)), np.int64)


def windows_of(buf: np.ndarray, a: int, b: int, k: int) -> np.ndarray:
    """Bytes i-k .. i of each position a <= i < b, packed into one number (a >= k)."""
    out = np.zeros(b - a, np.uint64)
    for j in range(k, -1, -1):
        out = (out << np.uint64(8)) | buf[a - j : b - j].astype(np.uint64)
    return out


def _count(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, texts = batch.column(0).dictionary_encode(), batch.column(1)
        for i, lang in enumerate(langs.dictionary):
            own = texts.filter(pa.compute.equal(langs.indices, i))
            for _, part in flat.chunks(own):
                buf, offsets = flat.flat(part, order)
                content = np.ones(len(buf), bool)
                for j in range(order):
                    content[offsets[:-1] + j] = False
                windows = windows_of(buf, order, len(buf), order)[content[order:]]
                for d in range(order + 1):
                    key, n = np.unique(windows & np.uint64((1 << 8 * (d + 1)) - 1), return_counts=True)
                    yield pa.record_batch({"lang": pa.array([lang.as_py()] * len(key), pa.string()), "depth": np.full(len(key), d, np.int32), "key": key.astype(np.int64), "n": n.astype(np.int64)})


def training_sample(df: DataFrame, text: str, lang: str, key: str, rows: int, longest: int) -> DataFrame:
    """At most ``rows`` rows of each language, chosen by a hash of key and text; of a longer text one stretch of ``longest`` characters at a place drawn by the hash.

    Counts come first, so only a share of each language that is expected to hold
    twice ``rows`` reaches the ranking.
    """
    own = df.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("h")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    totals = own.groupBy("lang").agg(F.count(F.lit(1)).alias("total"))
    # one row per language, of which there are as few as in the model that every worker holds: sent to all, so that other rows' texts stay where they are
    share = own.join(F.broadcast(totals), "lang").where((F.col("h") / F.lit(2.0**64) + 0.5) * F.col("total") < 2 * rows)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    begin = F.pmod(F.col("h"), F.greatest(F.length("text") - longest + 1, F.lit(1))).cast("int") + 1
    return share.withColumn("rank", rank).where(F.col("rank") <= rows).select("lang", F.substr("text", begin, F.lit(longest)).alias("text"))


def train(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", order: int = 4, rows: int = 256, longest: int = 20_000) -> Model:
    """Fit on a bounded sample: ``rows`` texts per language, ``longest`` characters of each at most.  Every language with a labelled text is learned.

    The counts are summed by Spark; what comes to the driver is bounded by the
    sample, not by ``df``.
    """
    if not 1 <= order <= 6:
        raise ValueError("order must be 1 to 6: a window of 7 bytes fits the number format")
    flat.small_batches(df.sparkSession)
    sample = training_sample(df, text, lang, key, rows, longest)
    counted = sample.mapInArrow(lambda batches: _count(batches, order), "lang string, depth int, key long, n long")
    table = counted.groupBy("lang", "depth", "key").agg(F.sum("n").alias("n")).toArrow()
    return Model(sorted(set(table["lang"].to_pylist())), order, table)


_scorers: dict[str, Scorer] = {}


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score``, the posterior of the winner under equal priors."""
    if not model.langs:
        return df.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    flat.small_batches(df.sparkSession)
    shared, name = df.sparkSession.sparkContext.broadcast(model), f"m{id(model)}-{np.random.default_rng().integers(1 << 60)}"

    @F.arrow_udf("struct<lang: string, score: double>")
    def guess(texts: pa.Array) -> pa.Array:
        if name not in _scorers:  # one table of window costs per Python worker
            _scorers.clear()
            _scorers[name] = Scorer(shared.value)
        lengths = _scorers[name].lengths(texts) / UNIT
        best = lengths.argmin(axis=1) if len(lengths) else np.zeros(0, np.int64)
        gap = lengths - lengths.min(axis=1, keepdims=True) if len(lengths) else lengths
        score = 1 / np.exp2(-np.minimum(gap, 1000)).sum(axis=1)
        return pa.StructArray.from_arrays([pa.array([shared.value.langs[i] for i in best], pa.string()), pa.array(score)], ["lang", "score"])

    known = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("lang_pred", "score")]
    return df.select(*kept, known.alias("__known"), guess(F.col(text)).alias("__guess")).select(
        *kept, F.when(F.col("__known"), F.col("__guess.lang")).otherwise(UNKNOWN).alias("lang_pred"), F.when(F.col("__known"), F.col("__guess.score")).otherwise(0.0).alias("score"))
