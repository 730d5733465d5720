"""The corpus pipeline: five operators, each working on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``.  Nulls, empty texts, repeated rows and empty tables are treated as
the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliogrid.llm import jaccard, langid, mixing, packing, quality
from heliogrid.llm.queries import bounded_batches, documents
from heliogrid.llm.storage import written

MIN_LANGUAGE_SCORE = 0.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the classifier trained on ``labels``."""
    bounded_batches(spark)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judge(docs, model).filter("kept").select(docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the training rows hold; ``und`` and undecided ones go."""
    bounded_batches(spark)
    model = langid.train(docs, F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    found = langid.identify(docs, model)
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id, then text hash.

    Rows are told apart by id and text, so rows that share an id are judged one by one; a null
    id comes last.  Rows equal in both become one.
    """
    bounded_batches(spark)
    hidden = "__row"
    while hidden in docs.columns:
        hidden += "_"
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("text"))
    keyed = docs.withColumn(hidden, row)
    found = jaccard.jaccard_components(keyed.select(hidden, "text"), id_col=hidden)
    first = found.filter(F.col(hidden) == F.col("component_id")).select(hidden).distinct()
    stay = keyed.join(written(first, "pipeline-first"), hidden, "left_semi")
    return stay.dropDuplicates(["doc_id", "text"]).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The curriculum's occurrences of documents, in training order."""
    return mixing.training_order(mixing.mix(docs)).select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all occurrences, placed into sequences."""
    import public_tokenizers

    bounded_batches(spark)
    cut = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(cut.withColumn("ids_crc32", F.crc32("ids")), carry=("ids_crc32",))


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("n-gram Jaccard join", ngram_jaccard),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", best_fit_packing),
]

#: SQL cannot express the trained stages; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; what each one returns is a written table."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
