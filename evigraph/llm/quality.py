"""Quality rules as a short-circuit cascade.

Each rule names the measures it needs and the texts it rejects.  On a bounded sample
every rule is timed alone and its rejections are counted; rules then run in order
of rejections per second, each only on the texts that all rules before it let pass.
The order changes the cost, never the verdict, which is the conjunction of all rules.

Defined results: null counts as empty; a text without words has zero measures and fails
``few_words``; repeated rows get equal answers; an empty table gives no rows and leaves the
rules in their given order; other columns pass through (added names replace equal ones).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm import flat

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


class Measures:
    """Measures of a run of texts, each computed when first asked for."""

    def __init__(self, texts: pa.Array):
        self.buf, self.offsets = flat.flat(texts)

    def _sums(self, marks: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])[self.offsets if at is None else at])

    @cached_property
    def _words(self):
        return flat.words(self.buf, self.offsets)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self._words[2])

    @cached_property
    def word_chars(self) -> np.ndarray:
        return self._sums(~flat.SPACE[self.buf] & ((self.buf & 0xC0) != 0x80))

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self._sums(SYMBOLS[self.buf])

    @cached_property
    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Text of each line with a word, and whether an equal one came before."""
        starts = np.flatnonzero(self.buf == 10) + 1  # the line break in front of a text starts its first line
        ends = np.append(starts[1:] - 1, len(self.buf)) if len(starts) else starts
        filled = np.concatenate([[0], np.cumsum(~flat.SPACE[self.buf])])
        some = filled[ends] > filled[starts]
        own = np.searchsorted(self.offsets, starts[some] - 1, "right") - 1
        return own, _repeated(flat.range_hashes(self.buf, starts[some], ends[some]), own, first=False)

    @cached_property
    def n_lines(self) -> np.ndarray:
        return np.bincount(self._lines[0], minlength=len(self.offsets) - 1)

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        own, again = self._lines
        return np.bincount(own[again], minlength=len(self.offsets) - 1)

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        starts, ends, first = self._words
        hashes = flat.window_hashes(flat.range_hashes(self.buf, starts, ends), 3)
        own = np.repeat(np.arange(len(first) - 1), np.diff(first))
        inside = np.flatnonzero(own[: len(hashes)] == own[2:]) if len(hashes) else np.zeros(0, np.int64)
        twice = inside[_repeated(hashes[inside], own[inside], first=True)]
        covered = np.zeros(len(starts), bool)
        for j in range(3):
            covered[twice + j] = True
        return self._sums(covered, first)


def _repeated(hashes: np.ndarray, own: np.ndarray, first: bool) -> np.ndarray:
    """Which entries occur again in their text: all of them, or all but the first."""
    key = flat.mix(hashes + own.astype(np.uint64) * flat.ROOT)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    if first:
        out[order[:-1][same]] = True
    return out


Rule = tuple[str, Callable[[Measures], np.ndarray]]
#: A rule gives the texts it rejects.
RULES: tuple[Rule, ...] = (
    ("few_words", lambda m: m.n_words < 50),
    ("repeats", lambda m: 100 * m.n_repeat_words > 50 * m.n_words),
    ("symbols", lambda m: m.n_symbols > m.n_words),
    ("dup_lines", lambda m: 10 * m.n_dup_lines > 5 * m.n_lines),
    ("word_length", lambda m: (m.word_chars < 2 * m.n_words) | (m.word_chars > 15 * m.n_words)),
)
BASE = ("few_words", "repeats")


def _timed(batches: Iterator[pa.RecordBatch], rules: tuple[Rule, ...]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, part in flat.chunks(batch.column(0)):
            for k, (_, rejects) in enumerate(rules):
                began = time.thread_time()
                n = int(rejects(Measures(part)).sum())
                yield pa.record_batch({"rule": np.array([k], np.int32), "seconds": np.array([time.thread_time() - began]), "rejected": np.array([n], np.int64)})


def estimated_order(df: DataFrame, text: str = "text", key: str = "doc_id", rules: tuple[Rule, ...] = RULES, rows: int = 2000) -> list[Rule]:
    """Rules by rejections per second on about ``rows`` rows, chosen by a hash of ``key`` against the table's size.

    The sampled rows are timed where they lie; per rule two sums come back.
    """
    flat.small_batches(df.sparkSession)
    share = max(1, df.count() // rows)
    sample = df.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(share)) == 0).select(F.col(text).alias("text"))
    found = {r["rule"]: r for r in sample.mapInArrow(lambda b: _timed(b, rules), "rule int, seconds double, rejected long").groupBy("rule").agg(F.sum("seconds").alias("s"), F.sum("rejected").alias("n")).collect()}
    gain = {k: r["n"] / max(r["s"], 1e-9) for k, r in found.items()}
    return [rules[k] for k in sorted(range(len(rules)), key=lambda k: (-gain.get(k, 0.0), k))]


def cascade(texts: pa.Array, rules: list[Rule]) -> np.ndarray:
    """Position of the first rule that rejects each text, -1 if none does."""
    out = np.full(len(texts), -1, np.int32)
    for at, part in flat.chunks(texts):
        left, measures = np.arange(len(part)), Measures(part)
        for k, (_, rejects) in enumerate(rules):
            bad = rejects(measures)
            if bad.any():
                out[at + left[bad]] = k
                left = left[~bad]
                if not len(left):
                    break
                measures = Measures(part.take(pa.array(left)))
    return out


MEASURED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the measures of every text."""

    @F.arrow_udf("struct<" + ", ".join(f"{c}: long" for c in MEASURED) + ">")
    def measure(texts: pa.Array) -> pa.Array:
        parts = [Measures(part) for _, part in flat.chunks(texts)]
        return pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *(getattr(m, c) for m in parts)])) for c in MEASURED], list(MEASURED))

    flat.small_batches(df.sparkSession)
    kept = [F.col(f"`{c}`") for c in df.columns if c not in MEASURED]
    return df.select(*kept, measure(F.col(text)).alias("__m")).select(*kept, *(F.col(f"__m.{c}").alias(c) for c in MEASURED))


def judged(df: DataFrame, order: list[Rule], text: str = "text") -> DataFrame:
    """Adds ``failed_rule`` (name of the first rule in ``order`` that rejects the text) and ``kept``."""
    names = [n for n, _ in order]

    @F.arrow_udf("string")
    def first(texts: pa.Array) -> pa.Array:
        return pa.array([names[k] if k >= 0 else None for k in cascade(texts, order)], pa.string())

    flat.small_batches(df.sparkSession)
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("failed_rule", "kept")]
    return df.select(*kept, first(F.col(text)).alias("failed_rule")).withColumn("kept", F.col("failed_rule").isNull())
