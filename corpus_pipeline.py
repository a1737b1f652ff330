"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs. All
but the last return the columns of documents. Rows of one doc_id stay or go together, but for mixing, which deals each row.

In every stage: no rows in, no rows out; very long texts are worked on whole; columns besides doc_id, text and source pass
through whatever their names, and none of the stages' own columns stays.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.common import materialize
from pointloom.llm.mixing import mix
from pointloom.llm.ngram_join import near_duplicates, without
from pointloom.llm.packing import pack, pieces
from pointloom.llm.pii import redact
from pointloom.llm.queries import digested, toxicity_held_out
from pointloom.llm.toxicity import THRESHOLD, fit, score


def _beside(docs: DataFrame, own: set[str], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """stage(docs), of which the columns of docs are kept. Those that are called as one of the stage's own, or by names that need
    quotes, stand aside meanwhile."""
    free = (n for k in count() if (n := f"aside_{k}") not in docs.columns)
    aside = {c: next(free) for c in docs.columns if c.lower() in own or "." in c or "`" in c}
    return stage(docs.withColumnsRenamed(aside)).select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold; one exactly at it goes. Null and empty texts stay, as texts without words
    do; repeated rows score alike; null doc_ids are scored but never trained on."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs.select("doc_id", "text"), labels, toxicity_held_out())
    return _beside(docs, {"toxicity"}, lambda d: score(d, model).filter(F.col("toxicity") < THRESHOLD))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest doc_id: all its rows, if they repeat. Null and empty texts
    and rows of null doc_id stay."""
    groups = materialize(near_duplicates(docs), "pipeline-groups")
    others = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    return _beside(docs, set(), lambda d: without(d, others))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced; n_chars follows the text. Null and empty texts stay as they are, repeated rows
    change alike."""
    n_chars = {"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {}
    return _beside(docs, set(), lambda d: redact(d).withColumns(n_chars))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of its shards. Null and empty texts have size 0 and go with
    their block; a null source is a source; repeated rows are taken each; a mix of no words takes nothing."""
    return _beside(docs, {"copy", "shard", "pos"}, lambda d: mix(d).repartition("shard").sortWithinPartitions("shard", "pos"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in training sequences. Null and empty texts are a piece of the end id alone;
    repeated rows and null doc_ids have pieces of their own."""
    return digested(pack(pieces(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")))


STAGES = [("toxicity", toxicity), ("ngram_join", ngram_join), ("pii", pii), ("mixing", mixing), ("packing", packing)]

#: SQL can express neither a trained classifier nor a tokenizer; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
