"""Files of any size, looked at line by line: size, lines, guards and a tree digest.

Spark's text source cuts a file into ranges, so no file is one value or one task; a line must fit
in a row.  Spark does not list empty files, so they are no part of a result.  A source is a file, or any set of files that ``source`` maps to one name, in order of their paths.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.functions import rules
from evigraph.operators.ranking import numbered
from evigraph.session import cut

#: The byte-order mark that the text source takes off the first line of a file.
MARK_BYTES = 3


def _suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, row, raw): the bytes of every line without its line feed; (start, row) ascend within a file."""
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                        F.monotonically_increasing_id().alias("row"), F.col("value").cast("binary").alias("raw"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, modified_at) of all files that are not empty; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select(F.col("_metadata.file_path").alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified_at"))


def guard_scan(lines: DataFrame, files: DataFrame) -> DataFrame:
    """(file, bytes, modified_at, lines, reason): the guards of ``readers.guard_files`` over files of any size.

    ``reason`` is null for an accepted file.  Every byte is looked at; per file only flags and sums are exchanged.
    """
    raw = F.col("raw")
    first = F.when(F.col("start") == 0, F.struct("row", F.hex(F.substring("raw", 1, 4)).alias("head")))
    text = F.lower(F.decode(F.when(_suffix(F.col("file")) == "xml", raw), "ISO-8859-1"))
    seen = lines.groupBy("file").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length("raw")).alias("held"), F.min(first)["head"].alias("head"),
        F.bool_or(F.contains(raw, F.lit(b"\0"))).alias("nul"), F.bool_or(text.contains("<!doctype") | text.contains("<!entity")).alias("declared"))
    scanned = files.join(seen, "file", "left").withColumn("lines", F.coalesce("lines", F.lit(0)))
    marked = F.col("bytes") - F.col("held") - (F.col("lines") - 1) >= MARK_BYTES
    magic = reduce(lambda a, b: a | b, [F.col("head").startswith(m) for m in rules.EXECUTABLE_MAGIC])
    reason = (F.when(~_suffix(F.col("file")).isin(*rules.ACCEPTED_SUFFIXES), "unsupported format")
              .when(magic & ~marked, "executable or archive content").when(F.col("nul"), "binary content")
              .when(F.col("declared"), "document type or entity declaration"))
    return scanned.select("file", "bytes", "modified_at", "lines", reason.alias("reason"))


def tree_digests(lines: DataFrame, source: Column | None = None, block: int = 1024) -> DataFrame:
    """(source, lines, root): a tree of SHA-256 over the lines of each source, ``block`` to a node.

    Leaves hash the bytes of a line; a node hashes the hex digits of its children, one behind the other; one entry alone is
    the root.  Lines are numbered by range slices and nodes of a level are hashed in parallel, so a source of
    any size is shared out; the driver reads one counter.  How a source is cut into files or splits has no influence.
    """
    leaves = lines.select((F.col("file") if source is None else source).alias("source"), "file", "start", "row", F.unhex(F.sha2("raw", 256)).alias("h"))
    level = cut(numbered(leaves, ["source"], ["file", "start", "row"], "n").select("source", "n", "h"), "leaves")
    totals = level.groupBy("source").agg(F.max("n").alias("lines"))
    most = totals.agg(F.max("lines")).first()[0] or 0
    while most > 1:
        place = F.floor((F.col("n") - 1) / block)
        nodes = level.groupBy("source", place.alias("place")).agg(F.array_sort(F.collect_list(F.struct("n", "h"))).alias("items"))
        joined = F.sha2(F.array_join(F.transform("items", lambda i: F.lower(F.hex(i["h"]))), ""), 256)
        alone = (F.col("place") == 0) & (F.size("items") == 1)  # a first node of one entry is all there is
        level = nodes.select("source", (F.col("place") + 1).alias("n"), F.when(alone, F.col("items")[0]["h"]).otherwise(F.unhex(joined)).alias("h"))
        most = -(-most // block)
    return totals.join(level.select("source", F.lower(F.hex("h")).alias("root")), "source")


def source_digests(spark: SparkSession, path: str, source: Column | None = None, block: int = 1024) -> DataFrame:
    """(source, bytes, lines, digest, reason) of every source below ``path``.

    The digest covers size, number of lines and tree root, so it also tells a final line feed and a byte-order mark.  A source
    is rejected with the least reason of its files; one with nothing but byte-order marks has the digest of no bytes as root.
    """
    lines, name = read_lines(spark, path), F.col("file") if source is None else source
    found = guard_scan(lines, list_files(spark, path)).groupBy(name.alias("source")).agg(F.sum("bytes").alias("bytes"), F.sum("lines").alias("lines"), F.min("reason").alias("reason"))
    roots = tree_digests(lines, source, block).select("source", "root")
    root = F.coalesce("root", F.sha2(F.lit(b""), 256))
    return found.join(roots, "source", "left").select("source", "bytes", "lines", F.sha2(F.concat_ws(":", "bytes", "lines", root), 256).alias("digest"), "reason")


def guard_source_records(records: DataFrame, source: str, max_records: int = rules.MAX_RECORDS) -> DataFrame:
    """(source, records, reason): sources with more records than allowed are rejected as a whole."""
    counted = records.groupBy(source).agg(F.count(F.lit(1)).alias("records"))
    return counted.withColumn("reason", F.when(F.col("records") > max_records, "too many records"))
