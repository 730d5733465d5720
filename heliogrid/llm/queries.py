"""The registered corpus queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard, langid, lm, mixing, nearvec, packing, quality, sharding, urltree, warc
from .storage import written


#: Arrow batches: texts are long, so Spark's default of 10,000 rows takes much memory.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def bounded_batches(spark: SparkSession) -> None:
    for key, value in BATCHES.items():
        spark.conf.set(key, value)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(_table(spark, sf_dir, "documents"))
    return scored.withColumn("log_score", F.round("log_score", 6))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearvec.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltree.judge(_table(spark, sf_dir, "pages"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    cut = packing.pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    placed = packing.pack(cut.withColumn("ids_crc32", F.crc32("ids")), carry=("ids_crc32",))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "part_bound", "certified")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = langid.train(docs, ~held_out)
    found = langid.identify(docs, model, keep=["doc_id"])
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs = warc.write_arc(_table(spark, sf_dir, "pages"))
    return warc.read_warc(warc.convert(arcs)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = written(mixing.mix(_table(spark, sf_dir, "documents"), keep=["doc_id"]), "mix")  # the range sort reads it twice
    order = mixing.ranked(mixing.training_order(mixed, ties=["mix_row"], absent=True))
    out = mixing.per_document(order, ["doc_id"])
    return out.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"), F.round("mix_position", 6).alias("position"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    out = quality.judge(docs, model, keep=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_quality")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens", "unit")


QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_embedding_near_dedup, op3_url_filter, op4_ngram_jaccard, op5_best_fit_packing, op6_language_id, op7_warc, op8_mixing, op9_quality_rules, op10_sharding)}
