"""Corpus preparation: five stages, each on all rows that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns the columns of ``docs``; only the last
one returns shard assignments. A stage changes nothing but the rows it drops: columns beyond
those it reads (doc_id, text, lang, source) are carried, whatever their names. A null id or
text never crashes a stage: a null text has no words and goes in the first stage, rows
without an id are judged like others. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.decontaminate import contamination
from panelwright.llm.mixing import mixed_sample
from panelwright.llm.neardup import near_duplicates
from panelwright.llm.quality import quality_verdicts
from panelwright.llm.queries import MIX, SHARDS
from panelwright.llm.shards import balanced_shards, text_size
from panelwright.operators.staging import staged

SMALL_KEYS = 1_000_000  # decisions sent to every executor at most


def _without(docs: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """``docs`` less the rows whose key stands in ``dropped``.

    The keys are counted first: few go to every executor, more meet the texts by a
    shuffled join.
    """
    dropped = staged(dropped.select(key).distinct(), "dropped")
    few = dropped.count() <= SMALL_KEYS
    return docs.join(F.broadcast(dropped) if few else dropped, key, "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base rule or lie far from their language."""
    judged = quality_verdicts(docs, carry=[F.struct(*docs.columns)])
    return judged.where("kept").select("_carry0.*")


def _row_digest() -> Column:
    """Digest of id and text, which tells rows apart that share an id or have none."""
    return F.sha2(
        F.concat(
            F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"),
            F.coalesce("text", F.lit("")),
        ),
        256,
    )


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group, that with the smallest id.

    Ids are counted first. Rows whose id is null or stands in several rows are named by a
    hash of id and text instead, above all usual ids: so each of their texts is judged on its
    own, and equal rows stay once.
    """
    repeated = staged(
        docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").select("doc_id"), "repeated"
    )
    if repeated.isEmpty():
        return _without(docs, near_duplicates(docs).where("not kept"), "doc_id").select(docs.columns)
    high = F.xxhash64("doc_id", _row_digest()).bitwiseAND(F.lit(2**62 - 1)).bitwiseOR(F.lit(2**62))
    odd = F.col("odd") | F.col("doc_id").isNull()
    marks = repeated.where("doc_id is not null").withColumn("odd", F.lit(True))
    rows = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "text").join(marks, "doc_id", "left")
    rows = rows.withColumn("odd", F.coalesce(odd, F.lit(False))).select(
        "doc", "text", "odd", F.when(F.col("odd"), high).otherwise(F.col("doc_id")).alias("row")
    )
    kept = _without(rows, near_duplicates(rows, id_column="row").where("not kept"), "row")
    single = kept.where("odd").dropDuplicates(["row"])
    return kept.where("not odd").unionByName(single).select("doc.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold benchmark passages.

    Rows are told apart by a digest of id and text, so rows without an id are judged too.
    """
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), "text", _row_digest().alias("row"))
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    judged = contamination(keyed, benchmark, id_column="row")
    return _without(keyed, judged.where("contaminated"), "row").select("doc.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw documents so that sources, languages and topics reach their target shares."""
    drawn = mixed_sample(docs, MIX, carry=[F.struct(*docs.columns)])
    return drawn.where("sampled").select("_carry0.*")


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every remaining document."""
    sized = docs.select("doc_id", text_size(F.col("text")).alias("size"))
    return balanced_shards(sized, SHARDS, F.col("size")).select("doc_id", "size", "shard", "slot")


STAGES = [
    ("quality rules", quality_stage),
    ("near-duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]
ORACLE_SQL = None  # raking and sampling have no SQL form; tests hold run() against plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
