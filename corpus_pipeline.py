"""From raw documents to sharded training data: five stages, each an operator of ``rhythmspan.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the
shared folder and reads it back as the next stage's docs, so a lost executor costs one stage at
most. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rhythmspan.llm import decontamination, mixing, quality, sharding, similar
from rhythmspan.llm._common import staged, table

SHARDS = 40
#: Words in a shingle of the near-dedup stage, which links from a Jaccard of 0.8.
SHINGLE = 5
DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier rejects (score below its threshold) go.

    The verdict is on the row: of a repeated id only the rejected rows go, and rows of a null id
    are judged like any other.
    """
    scores = quality.quality_scores(docs, table(spark, sf_dir, "labels"), carry=DOCUMENTS)
    return scores.where("predicted = 1").select(*DOCUMENTS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked, directly or by others, by a Jaccard of five-word shingles of 0.8 or more, one row stays.

    It is the one of the least id (null ids last; of equal ids the least text hash); of rows of the
    same id and text one. Rows of one id whose texts are not linked all stay.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = similar.groups(docs, SHINGLE).groupBy("component").agg(F.min(order).alias("k")).select(F.col("k.doc_id").alias("__id"), F.col("k.text_hash").alias("__first"))
    hashed = docs.select(*DOCUMENTS, similar.text_hash().alias("__hash"))
    kept = hashed.join(first, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__first")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__hash"]).select(*DOCUMENTS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark passage go.

    The verdict goes by the hash of the text: other rows of the same id stay, and rows of a null
    id go if their text does.
    """
    hashed = docs.select(*DOCUMENTS, similar.text_hash().alias("__hash"))
    texts = hashed.select(F.col("__hash").alias("doc_id"), "text")
    found = decontamination.matches(texts, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__hash")).distinct()
    return hashed.join(found, "__hash", "left_anti").select(*DOCUMENTS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the curriculum, as often as the mix takes them (its words over theirs, rounded).

    Each pass over a document stands at its own position. Documents of which the mix takes less
    than half a pass go, and so do texts without a word. Null sources are a source of their own;
    repeated rows are documents of their own.
    """
    mixed = mixing.mix(docs.select(*DOCUMENTS), ordered=False)
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    passes = F.slice("positions", F.lit(1), times)
    return mixed.select(*DOCUMENTS, F.explode(passes).alias("__at")).orderBy("__at", F.col("doc_id").asc_nulls_last()).select(*DOCUMENTS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, size, text_crc32, shard, grown_shard, slot, law, text, lang, source`` of every row, by consistent hashing of the id.

    Within a shard, slots follow the order of the files that ``docs`` was read from and of the rows
    in them, which is that of the curriculum. Rows of a null id go where 0 goes; null texts are
    empty; repeated rows get slots of their own.
    """
    place = F.col("_metadata")
    rows = sharding.with_size(docs.select("doc_id", "text", "lang", "source", place["file_path"].alias("__file"), place["row_index"].alias("__row")))
    placed = sharding.assign_shards(rows, SHARDS, within=("__file", "__row"))
    return placed.withColumn("law", F.lit("key")).select("doc_id", "size", "text_crc32", "shard", "grown_shard", "slot", "law", "text", "lang", "source")


STAGES = [
    ("quality classifier", keep_quality),
    ("simhash near-dedup", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources", mix_sources),
    ("sharding", shard),
]

#: The classifier, the trees and the latent space are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
