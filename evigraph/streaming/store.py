"""A table of merged rows that micro-batches add to without rewriting it.

Each batch writes its own combined rows as one run, a folder ``r<first>-<last>`` of batch
numbers.  Whenever the number of batches is a multiple of a power of ``FAN``, the runs of that many
last batches are merged into one before the next batch is added, so a row is rewritten once per level:
what a batch costs follows from its own size and, summed over batches, from the logarithm of their
number, never from the size of the table.  Only listings of folders reach the driver.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from evigraph.session import children, remove

#: Runs of one level that are merged into one of the next.
FAN = 4
_RUN = re.compile(r"/r(\d+)-(\d+)/?$")

Merge = Callable[[DataFrame], DataFrame]
Schema = T.StructType | str


def _complete(spark: SparkSession, store: str) -> list[tuple[int, int]]:
    """Runs that were written to their end, as (first batch, last batch)."""
    found = [(m, p) for p in children(spark, store) if (m := _RUN.search(p))]
    return sorted((int(m[1]), int(m[2])) for m, p in found if any(c.endswith("/_SUCCESS") for c in children(spark, p)))


def live_runs(spark: SparkSession, store: str) -> list[tuple[int, int]]:
    """Complete runs that no longer run covers: together each batch once, whatever a crash left behind."""
    runs = _complete(spark, store)
    return [r for r in runs if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in runs)]


def _read(spark: SparkSession, store: str, runs: list[tuple[int, int]], schema: Schema) -> DataFrame:
    if not runs:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{store}/r{first}-{last}" for first, last in runs])


def _write(rows: DataFrame, store: str, run: tuple[int, int]) -> None:
    rows.write.mode("overwrite").parquet(f"{store}/r{run[0]}-{run[1]}")


def compact(spark: SparkSession, store: str, batches: int, merge: Merge, schema: Schema, fan: int = FAN) -> None:
    """Merge what is due after batches ``0`` to ``batches - 1``; inputs go once the merged run is complete."""
    size = 1
    while batches and batches % (size * fan) == 0:
        size *= fan
    due = [r for r in live_runs(spark, store) if r[0] >= batches - size and r[1] < batches]
    if size > 1 and len(due) > 1:
        _write(merge(_read(spark, store, due, schema)), store, (due[0][0], due[-1][1]))
    kept = live_runs(spark, store)
    for first, last in _complete(spark, store):
        if (first, last) not in kept:
            remove(spark, f"{store}/r{first}-{last}")


def add_batch(rows: DataFrame, store: str, batch_id: int, merge: Merge, fan: int = FAN) -> None:
    """Add a batch of partial rows.  ``merge`` combines rows of equal keys and is associative.

    Batches before this one are committed, so only they are merged; a repeated batch replaces its own run.
    """
    spark = rows.sparkSession
    compact(spark, store, batch_id, merge, rows.schema, fan)
    _write(merge(rows), store, (batch_id, batch_id))


def stored(spark: SparkSession, store: str, merge: Merge, schema: Schema) -> DataFrame:
    """The merged table of all batches so far; its few runs are combined while they are read."""
    return merge(_read(spark, store, live_runs(spark, store), schema))
