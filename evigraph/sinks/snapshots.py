"""Investigation snapshots: case-isolated graph and record tables, and their catalogue.

A save writes its three tables into folders of a new version and then one empty commit file, whose
name holds the number of the commit and the version.  Readers list the commits and read the tables of the newest one, so they see
all tables of one save or all of the save before, whenever they look and wherever a writer stops.
Files are only added; ``expire_versions`` deletes what is no longer wanted.
"""

from __future__ import annotations

import uuid
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.operators.graph import EvidenceGraph
from evigraph.session import children, put_marker, remove

TABLES = ("nodes", "edges", "records")
BUILT_IN = ("default",)


def _folder(name: str) -> str:
    """An investigation id as the name of a folder."""
    return f"i={quote(name, safe='')}"


def _commits(spark: SparkSession, base: str, investigation_id: str) -> list[tuple[int, str]]:
    """(number, version) of the commits of an investigation, oldest first; of equal numbers the greater version counts as later."""
    names = [p.rsplit("/", 1)[1] for p in children(spark, f"{base}/commits/{_folder(investigation_id)}")]
    return sorted((int(n), v) for n, _, v in (x.partition(".") for x in names) if n.isdigit())


def _table(base: str, name: str, investigation_id: str, version: str) -> str:
    return f"{base}/{name}/{_folder(investigation_id)}/{version}"


def write_version(g: EvidenceGraph, records: DataFrame, base: str, investigation_id: str) -> str:
    """Write the tables of a version that no reader sees yet."""
    version = uuid.uuid4().hex
    for name, df in zip(TABLES, (g.nodes, g.edges, records), strict=True):
        df.withColumn("investigation_id", F.lit(investigation_id)).write.option("compression", "zstd").parquet(_table(base, name, investigation_id, version))
    return version


def commit_version(spark: SparkSession, base: str, investigation_id: str, version: str) -> int:
    """Make a written version the current one: a single file is created, which every file system does at once or not at all."""
    done = _commits(spark, base, investigation_id)
    number = done[-1][0] + 1 if done else 1
    put_marker(spark, f"{base}/commits/{_folder(investigation_id)}/{number:012d}.{version}")
    return number


def save_snapshot(g: EvidenceGraph, records: DataFrame, base: str, investigation_id: str) -> int:
    """Replace one investigation in one commit and return its number; other investigations are not touched."""
    return commit_version(records.sparkSession, base, investigation_id, write_version(g, records, base, investigation_id))


def snapshot_versions(spark: SparkSession, base: str, investigation_id: str) -> list[int]:
    return [number for number, _ in _commits(spark, base, investigation_id)]


def _current(spark: SparkSession, base: str, investigation_id: str, default_id: str | None, number: int | None) -> tuple[str, str]:
    for name in (investigation_id, default_id):
        found = [] if name is None else [c for c in _commits(spark, base, name) if number in (None, c[0])]
        if found:
            return name, found[-1][1]
    raise LookupError(f"no snapshot of {investigation_id!r}" + ("" if number is None else f" with number {number}"))


def load_snapshot(spark: SparkSession, base: str, investigation_id: str, default_id: str | None = None, number: int | None = None) -> EvidenceGraph:
    """Nodes and edges of the newest commit, or of commit ``number``; an unknown investigation falls back to the default."""
    name, version = _current(spark, base, investigation_id, default_id, number)
    nodes, edges = (spark.read.parquet(_table(base, t, name, version)).drop("investigation_id") for t in TABLES[:2])
    return EvidenceGraph(nodes, edges, True)


def load_records(spark: SparkSession, base: str, investigation_id: str, default_id: str | None = None, number: int | None = None) -> DataFrame:
    name, version = _current(spark, base, investigation_id, default_id, number)
    return spark.read.parquet(_table(base, TABLES[2], name, version)).drop("investigation_id")


def snapshot_ids(spark: SparkSession, base: str) -> list[str]:
    """Investigations with a commit, in order of their ids."""
    names = [p.rstrip("/").rsplit("/", 1)[1] for p in children(spark, f"{base}/commits")]
    return sorted(i for i in (unquote(n[2:]) for n in names if n.startswith("i=")) if _commits(spark, base, i))


def all_snapshots(spark: SparkSession, base: str, table: str) -> DataFrame | None:
    """One of the three tables over the current versions of all investigations, with ``investigation_id``; None if there is none."""
    if table not in TABLES:
        raise ValueError(f"no table {table!r}")
    paths = [_table(base, table, i, _commits(spark, base, i)[-1][1]) for i in snapshot_ids(spark, base)]
    return spark.read.parquet(*paths) if paths else None


def expire_versions(spark: SparkSession, base: str, investigation_id: str, keep: int = 1) -> int:
    """Delete all but the newest ``keep`` versions, and what unfinished saves left; returns the number of commits that went.

    Call it when no reader of an old version and no save is running.  Commit files go first, oldest before newer ones.
    """
    commits = _commits(spark, base, investigation_id)
    gone = commits[: max(0, len(commits) - keep)]
    for number, version in gone:
        remove(spark, f"{base}/commits/{_folder(investigation_id)}/{number:012d}.{version}")
    held = {version for _, version in commits[len(gone):]}
    for table in TABLES:
        for path in children(spark, f"{base}/{table}/{_folder(investigation_id)}"):
            if path.rstrip("/").rsplit("/", 1)[1] not in held:
                remove(spark, path)
    return len(gone)


def drop_snapshot(spark: SparkSession, base: str, investigation_id: str) -> None:
    """Delete one investigation with all versions; built-ins are protected."""
    if investigation_id in BUILT_IN:
        raise ValueError("a built-in investigation cannot be deleted")
    expire_versions(spark, base, investigation_id, keep=0)


def snapshot_exists(spark: SparkSession, base: str, investigation_id: str) -> bool:
    return bool(_commits(spark, base, investigation_id))


def catalogue_state(events: DataFrame, default_id: str = "default") -> DataFrame:
    """Current catalogue from its event log (id, action, at, name).

    Actions are save, activate and delete.  An id exists while its newest save or
    delete is a save.  The newest activation of an existing id wins; without one
    the default is active.  Exactly one row is active.
    """
    kept = events.filter(F.col("action").isin("save", "delete"))
    newest = kept.groupBy("id").agg(F.max_by(F.struct("action", "name"), "at").alias("last"), F.max("at").alias("created_at"))
    alive = newest.filter("last.action = 'save'").select("id", F.col("last.name").alias("name"), "created_at", F.lit(False).alias("built_in"))
    default = alive.sparkSession.range(1).select(F.lit(default_id).alias("id"), F.lit("built-in investigation").alias("name"),
                                                 F.lit(None).cast(alive.schema["created_at"].dataType).alias("created_at"), F.lit(True).alias("built_in"))
    items = alive.filter(F.col("id") != default_id).unionByName(default)
    chosen = events.filter("action = 'activate'").join(items.select("id"), "id", "left_semi").agg(F.max_by("id", "at").alias("chosen"))
    return items.join(F.broadcast(chosen)).withColumn("active", F.col("id") == F.coalesce("chosen", F.lit(default_id))).drop("chosen")
