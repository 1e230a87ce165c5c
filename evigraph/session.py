"""Session settings, shared scratch folder and lineage cuts.

Every intermediate table is a plain parquet table in the folder the cluster
names in ``spark.checkpoint.dir``.  A lost executor therefore costs a re-read,
never a recomputation from the sources, and the files carry the sizes that
adaptive execution needs to choose its joins.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split hot join partitions even when that costs one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # two headers that differ only in case: the later one is kept
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.ansi.enabled": "false",
    # HotSpot never compiles methods above 8000 bytes: wide projections run
    # faster as several smaller generated methods
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # an exchange is read by the job that made it; its files go with that job and not with the driver's next garbage collection
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}

#: Bytes up to which a table is broadcast on an estimate.  Staged tables are zstd, and sums, unfolded arrays and hashed ids
#: come after the scan, so a table may hold over a hundred times what its files let expect, and all of it passes the driver.
ESTIMATED_BROADCAST = 256 * 1024


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings all operators rely on.

    Up to the session's own limit tables are broadcast only once an exchange has measured them; a limit below ``ESTIMATED_BROADCAST``,
    or one set for adaptive execution, stays as it is.
    """
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    limit = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    if limit > ESTIMATED_BROADCAST:
        if spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None:
            spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", limit)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", ESTIMATED_BROADCAST)
    return spark


def share_package(spark: SparkSession) -> None:
    """Let Python workers on this machine, or on one with the same folders, import the package from where the driver did.

    Elsewhere the package is installed or shipped with ``spark.submit.pyFiles``; this adds nothing then.
    """
    root = str(Path(__file__).resolve().parents[1])
    held = spark.sparkContext.environment
    paths = [p for p in held.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        held["PYTHONPATH"] = os.pathsep.join([root, *paths])


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and staged tables."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="evigraph-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder; never reused, so never overwritten."""
    return f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def children(spark: SparkSession, path: str) -> list[str]:
    """Entries of a folder in any file system; none if it does not exist."""
    fs, place = _folder(spark, path)
    return [f.getPath().toString() for f in fs.listStatus(place)] if fs.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, place = _folder(spark, path)
    fs.delete(place, True)


def put_marker(spark: SparkSession, path: str) -> None:
    """Create an empty file that must not exist yet, and the folders above it."""
    fs, place = _folder(spark, path)
    fs.create(place, False).close()


_staged: list[str] = []


def staged_tables() -> list[str]:
    """Paths of the tables that operators have staged so far."""
    return list(_staged)


def drop_staged(spark: SparkSession, but: list[str] | tuple[str, ...] = ()) -> int:
    """Delete the tables that operators have staged so far, except those named, once their results are written."""
    gone = [path for path in _staged if path not in set(but)]
    for path in gone:
        _staged.remove(path)
        remove(spark, path)
    return len(gone)


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once and continue from the written table, until ``drop_staged``."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    _staged.append(path)
    df.write.option("compression", "zstd").parquet(path)  # ids and digests are hex, which other codecs hardly shorten
    return spark.read.schema(df.schema).parquet(path)
