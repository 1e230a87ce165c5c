"""Files to records.  A record is (seq, fields MAP<STRING,STRING>)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigraph.functions import rules
from evigraph.functions import scalars as S
from evigraph.operators.graph import EvidenceGraph
from evigraph.operators.ranking import numbered
from evigraph.session import cut

RECORD_LIST = "array<map<string,string>>"


def _sequenced(df: DataFrame, key: str | None) -> DataFrame:
    """Attach the source order: a key of the data, or (file, place in the file) as dense numbers.

    Spark packs file splits by size, so the order comes from the file's path, the split's
    start and the row's place in its split, never from the partition number alone.
    """
    if key is not None:
        return df.drop("_metadata").withColumn("seq", F.col(key).cast("bigint"))
    kept = [c for c in df.columns if c != "_metadata"]
    placed = df.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row"))
    return numbered(placed, [], ["_path", "_start", "_row"], "seq").select(*[F.col(f"`{c}`") for c in kept], (F.col("seq") - 1).alias("seq"))


def _filled(fields: Column) -> Column:
    return F.transform_values(fields, lambda k, v: F.coalesce(v, F.lit("")))


def read_csv_records(spark: SparkSession, path: str, key: str | None = None, limit: int | None = None, quoted_lines: bool = True) -> DataFrame:
    """CSV with a header per file; every cell text, missing cells empty, byte-order mark dropped.

    Columns go by the name in the file's own header, so files may order or name them
    differently.  ``quoted_lines`` allows line breaks inside quotes, for which Spark reads
    a file in one task; without it files are split between tasks.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"), "value")
    heads = lines.filter("start = 0").groupBy("file").agg(F.min_by("value", "row").alias("head")).groupBy("head").agg(F.collect_list("file").alias("files"))
    parts = []
    for found in heads.collect():  # one entry per distinct header, with the files Spark has listed anyway
        raw = spark.read.csv(sorted(found["files"]), header=True, inferSchema=False, quote='"', escape='"', encoding="UTF-8", multiLine=quoted_lines)
        names = [c.lstrip("\ufeff") for c in raw.columns]
        pairs = [x for old, new in zip(raw.columns, names, strict=True) for x in (F.lit(new), F.coalesce(F.col(f"`{old}`"), F.lit("")))]
        parts.append(raw.select(F.create_map(*pairs).alias("fields"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row")))
    if not parts:
        return spark.createDataFrame([], "seq bigint, fields map<string,string>")
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    if key is not None:
        out = rows.select(F.col("fields")[key].cast("bigint").alias("seq"), "fields")
    else:
        out = numbered(rows, [], ["_path", "_start", "_row"], "seq").select((F.col("seq") - 1).alias("seq"), "fields")
    return out.orderBy("seq").limit(limit) if limit else out


def _split_parsed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    good = rows.filter("fields IS NOT NULL").select("seq", _filled(F.col("fields")).alias("fields"))
    return good, rows.filter("fields IS NULL").select("seq", "file", F.col("value").alias("text"), F.lit("malformed JSON").alias("reason"))


def split_json_records(spark: SparkSession, path: str, root: str = "records") -> tuple[DataFrame, DataFrame]:
    """JSON documents: a root array, or an object holding the array under ``root``; and what could not be read.

    Returns records and a quarantine table (seq, file, text, reason).  A document is one value,
    so one task parses it.  Use ``split_json_lines`` for large data.
    """
    docs = spark.read.text(path, wholetext=True)
    listed = F.when(F.ltrim("value").startswith("["), F.col("value")).otherwise(F.get_json_object("value", f"$.{root}"))
    rows = docs.select(F.col("_metadata.file_path").alias("file"), "value", F.from_json(listed, RECORD_LIST).alias("list"))
    rows = rows.select("file", F.when(F.col("list").isNull(), F.col("value")).alias("value"), F.posexplode_outer("list").alias("place", "fields")).filter("fields IS NOT NULL OR value IS NOT NULL")
    return _split_parsed(numbered(rows, [], ["file", "place"], "seq").withColumn("seq", F.col("seq") - 1))


def read_json_records(spark: SparkSession, path: str, root: str = "records") -> DataFrame:
    return split_json_records(spark, path, root)[0]


def split_json_lines(spark: SparkSession, path: str, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """One JSON object per line, files split between tasks; and the lines that are none, as (seq, file, text, reason)."""
    lines = spark.read.text(path)
    rows = lines.select(F.col("_metadata.file_path").alias("file"), "value", F.from_json("value", "map<string,string>").alias("fields"), "_metadata").filter(F.trim("value") != "")
    rows = rows.withColumn("fields", F.when(F.size(F.coalesce("fields", F.create_map().cast("map<string,string>"))) > 0, F.col("fields")))
    if key is not None:
        return _split_parsed(rows.withColumn("seq", F.col("fields")[key].cast("bigint")))
    placed = rows.select("file", "value", "fields", F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row"))
    return _split_parsed(numbered(placed, [], ["file", "_start", "_row"], "seq").withColumn("seq", F.col("seq") - 1))


def read_json_lines(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    return split_json_lines(spark, path, key)[0]


def read_narratives(spark: SparkSession, path: str, delimiter: str = "---") -> DataFrame:
    """(doc_id, block_idx, text): blocks split on delimiter lines or blank lines.

    In a file with case numbers only the blocks that mention one are kept; in a file without
    all are.  The delimiter is the line separator of the scan, so one large file is shared out.
    """
    chunks = spark.read.text(path, lineSep=f"\n{delimiter}\n").select(F.col("_metadata.file_name").alias("doc_id"), "value", F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row"))
    parts = F.filter(F.transform(F.split("value", r"\n\s*" + delimiter + r"\s*\n|\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"^\s+|\s+$", ""))), lambda p: p != "")
    blocks = chunks.select("doc_id", "_start", "_row", F.posexplode_outer(parts).alias("_part", "text")).filter("text IS NOT NULL")
    blocks = cut(numbered(blocks, ["doc_id"], ["_start", "_row", "_part"], "block_idx").select("doc_id", (F.col("block_idx") - 1).alias("block_idx"), "text"), "blocks")
    case = F.col("text").rlike(r"(?i)\bCase Number\b")
    known = blocks.groupBy("doc_id").agg(F.coalesce(F.bool_or(case), F.lit(False)).alias("known"))
    return blocks.join(known, "doc_id").filter(~F.col("known") | case).select("doc_id", "block_idx", "text")


def _leaves(column: Column, data_type: T.DataType, name: str):
    """(name, column) of every leaf; a repeated leaf yields its last element."""
    if isinstance(data_type, T.ArrayType):
        yield from _leaves(F.element_at(column, -1), data_type.elementType, name)
    elif isinstance(data_type, T.StructType):
        for f in data_type.fields:
            if f.name == "_VALUE":
                yield name, column.getField("_VALUE")
            elif not f.name.startswith("_"):
                yield from _leaves(column.getField(f.name), f.dataType, f.name)
    else:
        yield name, column


def read_xml_records(spark: SparkSession, path: str, row_tag: str, key: str | None = None) -> DataFrame:
    """Each ``row_tag`` element is a record; its leaf tags, without namespace, are the fields."""
    raw = spark.read.format("xml").option("rowTag", row_tag).option("inferSchema", "false").option("ignoreNamespace", "true").load(path)
    found = {}
    for field in raw.schema.fields:
        if not field.name.startswith("_"):
            for name, column in _leaves(F.col(f"`{field.name}`"), field.dataType, field.name):
                found[name] = column
    pairs = [x for name, column in found.items() for x in (F.lit(name), F.trim(column.cast("string")))]
    rows = raw.select(F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull() & (v != "")).alias("fields"), F.col("_metadata"))
    if key is not None:
        return rows.select(F.col("fields")[key].cast("bigint").alias("seq"), "fields")
    return _sequenced(rows.filter(F.size("fields") > 0), None)


def ontology_summary(spark: SparkSession, path: str) -> DataFrame:
    """Counts of typed statements, classes and properties, and every label, as (kind, label, n)."""
    lines = spark.read.text(path)
    counts = {
        "typed-statements": r"\brdf:type\b|\ba\s+(?:owl|crime):", "classes": r"rdf:type\s+owl:Class",
        "object-properties": r"rdf:type\s+owl:ObjectProperty", "data-properties": r"rdf:type\s+owl:DatatypeProperty",
    }
    sums = lines.agg(*[F.coalesce(F.sum(F.regexp_count("value", F.lit(p))), F.lit(0)).alias(k) for k, p in counts.items()])
    totals = sums.select(F.explode(F.create_map(*[x for k in counts for x in (F.lit(k), F.col(f"`{k}`"))])).alias("kind", "n"))
    labels = lines.select(F.explode_outer(F.regexp_extract_all("value", F.lit(r'rdfs:label\s+"([^"]+)"'), 1)).alias("label")).filter("label IS NOT NULL")
    upper = F.substring("label", 1, 1).rlike(r"\p{Lu}")
    named = labels.groupBy(F.when(upper, "class-label").otherwise("property-label").alias("kind"), "label").agg(F.count(F.lit(1)).alias("n"))
    return named.unionByName(totals.select("kind", F.lit("").alias("label"), "n"))


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def file_manifest(files: DataFrame, roles: dict[str, str] | None = None) -> DataFrame:
    """name, bytes, SHA-256, modification time and role of each file."""
    name = F.element_at(F.split("path", "/"), -1)
    role = F.lit("source data")
    if roles:
        role = F.coalesce(F.create_map(*[F.lit(x) for p in roles.items() for x in p])[name], role)
    return files.select(name.alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"),
                        F.col("modificationTime").alias("modified_at"), role.alias("role"))


def read_node_link(spark: SparkSession, path: str, lines: bool = False) -> EvidenceGraph:
    """Node-link documents: nodes with id, label, type and edges with source, target, relationship.

    A file is one document, or with ``lines`` each line is one, and files are split between tasks.
    """
    schema = "struct<nodes:array<struct<id:string,label:string,type:string>>,edges:array<struct<source:string,target:string,relationship:string>>>"
    docs = spark.read.text(path, wholetext=not lines).select(F.from_json("value", schema).alias("d"))
    nodes = docs.select(F.explode_outer("d.nodes").alias("n")).filter("n IS NOT NULL").select("n.*")
    edges = docs.select(F.explode_outer("d.edges").alias("e")).filter("e IS NOT NULL").select("e.*")
    return EvidenceGraph(nodes, edges)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    schema = "array<struct<node1:string,node2:string,relationship:string,link_probability:double,predicted_link:int>>"
    docs = spark.read.text(path, wholetext=True)
    return docs.select(F.explode_outer(F.from_json("value", schema)).alias("p")).filter("p IS NOT NULL").select("p.*")


def call_records(index: DataFrame, phone_pool: int = 4000, place_pool: int = 256) -> DataFrame:
    """Call records from a column ``i``: modular phone and tower pools."""
    i = F.col("i")
    day, hour, minute = (i % 28) + 1, i % 24, (i * 7) % 60
    fields = F.create_map(
        F.lit("call_id"), F.format_string("BENCH-%07d", i),
        F.lit("timestamp"), F.format_string("2026-08-%02d %02d:%02d:00", day, hour, minute),
        F.lit("record_type"), F.lit("synthetic benchmark cdr"),
        F.lit("caller_number"), F.format_string("+91-BENCH-%05d", i % phone_pool),
        F.lit("callee_number"), F.format_string("+91-BENCH-%05d", (i * 37 + 11) % phone_pool),
        F.lit("tower_location"), F.format_string("Synthetic Tower %03d", i % place_pool),
        F.lit("signal"), F.lit("synthetic scale benchmark"))
    return index.select(i.cast("bigint").alias("seq"), fields.alias("fields"))


def generate_calls(spark: SparkSession, n: int, phone_pool: int = 4000, place_pool: int = 256) -> DataFrame:
    return call_records(spark.range(n).withColumnRenamed("id", "i"), phone_pool, place_pool)


# -- guards ------------------------------------------------------------------------------

def guard_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted files, and rejected ones with the reason; the whole content is looked at."""
    head = F.hex(F.substring("content", 1, 4))
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    text = F.lower(F.decode("content", "ISO-8859-1"))
    magic = reduce(lambda a, b: a | b, [head.startswith(m) for m in rules.EXECUTABLE_MAGIC])
    nul = F.instr(F.decode("content", "ISO-8859-1"), "\u0000") > 0
    reason = (F.when(~suffix.isin(*rules.ACCEPTED_SUFFIXES), "unsupported format")
              .when(magic, "executable or archive content").when(nul, "binary content")
              .when((suffix == "xml") & (text.contains("<!doctype") | text.contains("<!entity")), "document type or entity declaration"))
    judged = files.withColumn("reason", reason)
    return judged.filter("reason IS NULL").drop("reason"), judged.filter("reason IS NOT NULL")


def guard_records(records: DataFrame, max_columns: int = rules.MAX_COLUMNS, max_cell: int = rules.MAX_CELL) -> tuple[DataFrame, DataFrame]:
    """Accepted records, and rejected ones with the reason."""
    longest = F.coalesce(F.array_max(F.transform(F.map_values("fields"), lambda v: F.length(v))), F.lit(0))
    reason = F.when(F.size("fields") > max_columns, "too many columns").when(longest > max_cell, "oversized field")
    judged = records.withColumn("reason", reason)
    return judged.filter("reason IS NULL").drop("reason"), judged.filter("reason IS NOT NULL")


def profile_source(files: DataFrame, records: DataFrame) -> DataFrame:
    """One row: format, files, bytes, digest over the file digests, records, columns."""
    manifest = file_manifest(files)
    part = F.conv(F.substring("sha256", 1, 15), 16, 10).cast("decimal(20,0)")
    one = manifest.agg(F.min(F.upper(F.regexp_extract("name", r"\.([^.]+)$", 1))).alias("format"), F.count(F.lit(1)).alias("files"),
                       F.sum("bytes").alias("bytes"), F.sha2(F.sum(part).cast("string"), 256).alias("digest"))
    counted = records.agg(F.count(F.lit(1)).alias("records"), F.max(F.size("fields")).alias("columns"))
    return one.join(F.broadcast(counted))


# -- narrative extraction ------------------------------------------------------------------

def extract_incident(texts: DataFrame, text_col: str = "text", patterns: dict = rules.STRICT_PATTERNS) -> DataFrame:
    """The 17 incident columns from report text, by pattern table; other columns are kept."""
    t = F.col(text_col)
    loose = patterns is rules.LOOSE_PATTERNS
    cols = {name: S.extract(t, p) for name, p in patterns.items()}
    if loose:
        cols["primary_type"] = F.upper(cols["primary_type"])
        cols["location_description"] = F.upper(cols["location_description"])
    stamp = F.concat_ws(" ", F.regexp_extract(t, rules.INCIDENT_TIME_PATTERN, 1), F.regexp_extract(t, rules.INCIDENT_TIME_PATTERN, 2))
    when = F.try_to_timestamp(stamp, F.lit("MM/dd/yyyy HH:mm"))
    shown = F.date_format(when, "yyyy-MM-dd HH:mm:ss")
    cols["date"] = F.coalesce(shown, F.nullif(F.trim(stamp), F.lit(""))) if loose else shown
    cols["year"] = F.year(when).cast("string")
    cols["arrest"] = F.when(t.rlike(rules.ARREST_PATTERN), "true").otherwise("false")
    cols["domestic"] = F.when(t.rlike(rules.DOMESTIC_PATTERN), "true").otherwise("false")
    return texts.select(*[c for c in texts.columns if c != text_col], *[cols[c].alias(c) for c in rules.CRIME_COLUMNS])
