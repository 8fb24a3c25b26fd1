"""From raw documents to a mixed training set: toxicity, near-dedup, decontamination, personal data, mixing.

Every stage takes the documents its predecessor left and returns those it keeps, with the columns of documents; the last
adds how much of each document the mix takes.

Defined results: rows with a null doc_id go through as documents of their own; of rows that share a doc_id, near copies of
each other leave one, the one with the smallest hash of its text, and rows with other texts stay; null and empty texts are
kept by all stages but the mix, which takes no words of them; an empty table, and a stage that keeps nothing, give an
empty result; columns of any other name pass through, but the mix replaces columns named size, source_size, target and
taken. Helper columns get names that the table doesn't have.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerscope.llm import decontamination, mixing, near_dedup, pii, toxicity
from peerscope.llm.common import join_small, read, shared_dir, unused

#: The toxicity model has no SQL form. Its features and scores are tested against plain loops, the operators of the other
#: stages against brute force or reference SQL, and the stages against the operators.
ORACLE_SQL = None
#: Score from which a document is rejected as toxic.
TOXIC = 0.5


def named(columns: list[str]) -> list:
    return [F.col(f"`{c}`") for c in columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the labelled ones, scores below TOXIC."""
    model, score = toxicity.fit(docs, read(spark, sf_dir, "labels")), unused(docs, "toxic_score")
    return toxicity.score(docs, model, score).filter(F.col(score) < TOXIC).select(*named(docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id; of rows that share it, one."""
    judged = near_dedup.near_duplicates(docs, inner=True).filter("doc_id is not null")
    row = ["doc_id", "text_hash"]
    # Rows that are kept with others of their id and component: the text of smallest hash stays, once.
    again = judged.filter("kept").groupBy("doc_id", "node").agg(F.count("*").alias("n"), F.min("text_hash").alias("stays")).filter("n > 1").select("doc_id", "node", "stays")
    again = judged.join(again.withColumnRenamed("doc_id", "i").withColumnRenamed("node", "g"), F.col("doc_id").eqNullSafe(F.col("i")) & F.col("node").eqNullSafe(F.col("g")))
    gone = judged.filter("not kept").select(*row).unionByName(again.filter("text_hash != stays").select(*row)).distinct()
    once = again.filter("text_hash = stays").select(*row).distinct()
    at, text = unused(docs, "row_id"), unused(docs, "row_text")
    rename = lambda df: df.select(F.col("doc_id").alias(at), F.col("text_hash").alias(text))
    rows = docs.withColumns({at: F.col("doc_id").cast("long"), text: F.xxhash64("text")})
    out = join_small(rows, rename(gone), [at, text], "left_anti")
    if not once.isEmpty():
        out = join_small(out, rename(once), [at, text], "left_anti").unionByName(join_small(out, rename(once), [at, text], "left_semi").dropDuplicates([at, text]))
    return out.select(*named(docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    mark = unused(docs, "contaminated")
    return decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark"), mark=mark).filter(~F.col(mark)).select(*named(docs.columns))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and secrets replaced by their kind; n_chars follows the text where that changed."""
    was = unused(docs, "text_was")
    out = pii.redact(docs.withColumn(was, F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text") != F.col(was), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*named(docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words of, with size, source_size, target and taken."""
    own = [c for c in docs.columns if c.lower() not in ("size", "source_size", "target", "taken")]
    return mixing.mix(docs, carry=own, shards=False).filter("taken > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, base = read(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
