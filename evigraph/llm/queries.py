"""Named queries of the pipeline operators over the driver tables, each over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm import chat, divergence, fim, langid, mixing, ngram_join, pieces, pii, quality, secrets, suffixes, topk, warc
from evigraph.llm.oracles import ORACLES  # noqa: F401
from evigraph.llm.spans import listed
from evigraph.session import cut, scratch_path



def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the three quarters that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~held_out()))
    return langid.predict(docs.select("doc_id", "text", held_out().alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op2_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest codes of every vector whose id is divisible by 100, against all vectors."""
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10).withColumnRenamed("id", "vec_id")


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document, and a digest of where its shards place them."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    places = F.array_join(F.transform("copies", lambda c: F.concat_ws(":", c["shard"], c["pass"], c["place"])), ",")
    return mixed.select("doc_id", "size", F.col("source_size").cast("long"), "target", (F.col("size") * F.size("copies")).alias("taken"), F.md5(places.cast("binary")).alias("places_md5"))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text they decode to."""
    coded = pieces.tokenized(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    ids = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def _span_columns(spans: str, base: tuple[str, ...]) -> list[Column]:
    own = F.filter(spans, lambda s: s["kind"].isin(*base))
    return [F.sha2(listed(own).cast("binary"), 256).alias("base_sha256"), listed(F.col(spans)).alias("spans")]


def _kinds(spans: str, kinds: tuple[str, ...]) -> list[Column]:
    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return [count(k) for k in kinds]


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scanned(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *_kinds("secrets", secrets.KINDS[:3]), *_span_columns("secrets", secrets.KINDS[:3]))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate group and number of links of every document."""
    found = ngram_join.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", F.col("copies").cast("long"), F.col("n_links").cast("long"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations read back from their formatted windows; a conversation's digest needs its whole text in one row."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))
    windows = chat.formatted(rows.unionByName(extra))
    turns = chat.read_turns(F.col("formatted"), F.col("repeats"))
    read = windows.select("conv_id", "window", turns.alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("loss"), F.length("formatted").alias("n"))
    plain = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = read.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", plain.alias("plain"), "loss"))).alias("w"), F.sum(F.size("turns")).alias("n_turns"), F.sum("n").alias("formatted_chars"))
    whole, loss = (F.array_join(F.col(f"w.{c}"), "") for c in ("plain", "loss"))
    return parts.select("conv_id", "n_turns", F.sha2(whole.cast("binary"), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.found(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *_kinds("pii", pii.BASE), *_span_columns("pii", pii.BASE))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of every document and the cascade's verdict."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.judged(quality.measured(docs), quality.estimated_order(docs))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", *quality.MEASURED, failed.alias("base_failed"), "kept")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as archives, read back and assembled."""
    path = scratch_path(spark, "warc")
    warc.write(_table(spark, sf_dir, "pages"), path)
    captures = warc.assembled(warc.read(spark, path, payloads=False)).select("record_id", "type", "refers_to", "payload_bytes", "payload_digest", F.col("note")["page-id"].cast("long").alias("page_id"), "rows")
    captures = cut(captures, "captures")  # ids and digests only; a revisit looks up what it refers to
    stored = captures.where("type = 'response'").select(F.col("record_id").alias("stored"), F.col("page_id").alias("stored_page"), F.col("payload_bytes").alias("stored_bytes"), F.col("payload_digest").alias("stored_digest"))
    joined = captures.join(stored, F.col("refers_to") == F.col("stored"), "left")
    own = lambda a, b: F.when(F.col("type") == "revisit", F.col(b)).otherwise(F.col(a)).alias(a)
    return joined.select("page_id", own("payload_bytes", "stored_bytes"), own("payload_digest", "stored_digest"), F.col("type").alias("record_type"), F.col("stored_page").alias("refers_to"), F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("n")).drop("n")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without the 100-byte strings that start earlier somewhere."""
    left = suffixes.deduplicated(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergences between the sources of each language, and the terms that set each source apart."""
    return divergence.audit(_table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's transformed text and of what is restored from it."""
    moved = fim.transformed(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return moved.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(fim.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_language, op2_hamming_topk, op3_mix, op4_pieces, op5_secrets, op6_near_duplicates, op7_chat, op8_pii, op9_quality, op10_warc, op11_suffix_dedup, op12_source_divergence, op13_fill_in_middle, pipeline)}
