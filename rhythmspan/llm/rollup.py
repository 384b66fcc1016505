"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are sums of signed deltas. A batch is aggregated
to one row a group, written to a folder of its own and then named in a log, by one small file: a
driver or executor lost before that leaves the totals as they were. Of the commits of a batch id the
last one named counts, so a replay changes nothing.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import WORD

KEYS = ("source", "lang", "tokenizer")
#: Tokenizer versions: a token is a match of the pattern.
TOKENIZERS = {"words-1": WORD, "pieces-2": r"\p{L}+|[0-9]|[^\p{L}0-9\x20\x09-\x0D]+"}


def count_tokens(docs: DataFrame, tokenizers: dict[str, str] = TOKENIZERS, text: str = "text") -> DataFrame:
    """``doc_id, source, lang, tokenizer, tokens``: one row a document and tokenizer version.

    Null and empty texts have 0 tokens; null sources and languages stay null groups.
    """
    counts = [F.struct(F.lit(name).alias("tokenizer"), F.coalesce(F.regexp_count(F.col(text), F.lit(pattern)), F.lit(0)).cast("long").alias("tokens")) for name, pattern in tokenizers.items()]
    return docs.select("doc_id", "source", "lang", F.explode(F.array(*counts)).alias("c")).select("doc_id", "source", "lang", "c.tokenizer", "c.tokens")


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).cast("long").alias("docs"), "tokens")


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("docs"), (-F.col("tokens")).alias("tokens"))


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """The old counts leave and the new ones enter, whatever group either is in."""
    return deletes(before).unionByName(inserts(after))


class TokenRollup:
    """Totals under a folder that driver and executors share. One job commits at a time.

    Null sources, languages and tokenizers are groups of their own. Repeated delta rows add up. Other
    columns of the deltas are ignored. A batch without rows counts as committed and adds nothing; before
    any commit there are no totals.
    """

    deltas = "source string, lang string, tokenizer string, docs long, tokens long, commit string"
    log = "batch string, commit string, seq long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, schema: str, folder: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{folder}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def write(self, batch: str, *deltas: DataFrame) -> str:
        """Write signed deltas, summed by group, where no reader looks yet; returns the commit's name."""
        if not batch.replace("-", "").isalnum():
            raise ValueError(f"batch ids are letters, digits and dashes: {batch!r}")
        whole = reduce(DataFrame.unionByName, (d.select(*KEYS, "docs", "tokens") for d in deltas))
        # a hot source is summed map-side first; one row a group is left
        sums = whole.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        commit = f"{batch}-{uuid.uuid4().hex}"
        sums.write.parquet(f"{self.path}/deltas/commit={commit}")
        return commit

    def publish(self, batch: str, commit: str) -> None:
        """From now on the batch is what this commit wrote."""
        seq = (self._read(self.log, "log").agg(F.max("seq")).first()[0] or 0) + 1
        self.spark.createDataFrame([(batch, commit, seq)], self.log).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def commit(self, batch: str, *deltas: DataFrame) -> None:
        """Commit signed deltas under a batch id; a repeat of the id replaces it, so each id counts once."""
        self.publish(batch, self.write(batch, *deltas))

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, docs, tokens`` of all groups that still have documents or tokens."""
        last = Window.partitionBy("batch").orderBy(F.desc("seq"))
        counts = self._read(self.log, "log").withColumn("at", F.row_number().over(last)).where("at = 1").select("commit")
        rows = self._read(self.deltas, "deltas").join(counts, "commit", "left_semi")
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")
