"""The opN_ queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, hard_negatives, lm_scoring, mixing, near_dedup, periodic_runs, pii, quality_gam, quality_rules, reference_sql, token_counts, toxicity, warc
from .common import WORD, body, held_out, let, read, shared_dir


def _classified(spark: SparkSession, sf_dir: str, model, threshold: float) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = model.score(docs, model.fit(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, quality_gam, 0.3)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_pages(read(spark, sf_dir, "pages"), path)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(-?[0-9]+)>$', 1) as bigint)")
    found = warc.read_warc(spark, path, payload=False)
    return found.select(number("record_id").alias("page_id"), "payload_bytes", F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read(spark, sf_dir, "documents").select("doc_id", body().alias("text")))
    base = F.filter("pii", lambda s: s["kind"].isin(*pii.BASE))
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in pii.BASE], F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("pii")).alias("spans"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), token_counts.read_pieces(spark, f"file://{token_counts.VOCABULARY}"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), shards=False)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scoring.score(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", "n_words", F.round("log_score", 3).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark")).drop("text", "items")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, toxicity, 0.5)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select(F.col("vec_id").alias("id"), label.alias("label"), hard_negatives.quantise(F.col("embedding")).alias("vector"))
    return hard_negatives.mine(rows, F.col("id") % 100 == 0)


def _planted_period(h: Column, words: Column) -> Column:
    """The words, of which those from a = g % n on repeat with period 1 + (n - a) // (3 + g % 8), for g = h // 10."""
    g, n = F.floor(h / 10), F.size(words)
    ends = F.struct((g % n).cast("int").alias("a"), (F.lit(1) + F.floor((n - g % n) / (g % 8 + 3))).cast("int").alias("p"))
    return let(ends, lambda e: F.transform(words, lambda w, i: F.when(i < e["a"], w).otherwise(F.get(words, e["a"] + (i - e["a"]) % e["p"]))))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    repeated = let(F.regexp_extract_all(body(), F.lit(WORD), F.lit(0)), lambda words: F.when(F.size(words) > 0, F.array_join(_planted_period(h, words), " ")).otherwise(""))
    docs = read(spark, sf_dir, "documents").select("doc_id", F.when(h % 10 == 0, repeated).otherwise(F.col("text")).alias("text"))
    found = periodic_runs.find_runs(docs)
    more = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda best, r: F.when(more(r, best), r).otherwise(best))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    made = chat.format_conversations(turns)
    listed = F.transform(chat.read_back(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    made = made.select("conv_id", "formatted", listed.alias("listed"), chat.learned_text(F.col("formatted"), F.col("loss_spans")).alias("learned"))
    return made.select("conv_id", F.size("listed").cast("long").alias("n_turns"), F.sha2(F.array_join("listed", ""), 256).alias("turns_sha256"), F.char_length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_warc": op2_warc,
    "op3_pii": op3_pii,
    "op4_near_dedup": op4_near_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_mixing": op6_mixing,
    "op7_quality_rules": op7_quality_rules,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_decontamination": op9_decontamination,
    "op10_toxicity": op10_toxicity,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_chat_formatting": op13_chat_formatting,
}
SQL = reference_sql.SQL
