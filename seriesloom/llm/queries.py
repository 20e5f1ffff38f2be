"""Each operator applied to its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, feistel, lines, mixing, negatives, periodic, quality, simhash, substrings, toxicity, unigram, vptree, warc
from .oracles import ORACLES


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=4, max_bits=4)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measures(read(spark, sf_dir, "documents"))


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    # 49407 is the vocabulary's end-of-text id.
    return feistel.write_training_order(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=49407)


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, factor=1.0)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The table has no fetch date; every response gets the same one.
    records = warc.responses(read(spark, sf_dir, "pages"), date="2024-01-01T00:00:00Z")
    made = warc.derivatives(records)
    return made.withColumn("record_sha256", F.sha2("data", 256)).drop("data")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = lines.dedup_lines(read(spark, sf_dir, "documents"), shingle=5, similarity=0.8)
    return left.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_copies(read(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substrings.remove_repeated(read(spark, sf_dir, "documents"), window=13)
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: the words of one document in ten are made to repeat from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))

    def repeat(w):
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(F.slice(w, F.lit(1), a), F.slice(tail, F.lit(1), n - a)), " ")

    # A list of one holds the words, which are then found once for all their uses.
    made = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeat(w)).otherwise(F.lit("")))[0]
    return docs.select("doc_id", F.when(h % 10 == 0, made).otherwise(F.col("text")).alias("text"))


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(with_planted_periods(read(spark, sf_dir, "documents")), least=12)
    # Longest first, then by start and period: the runs come in the order of the latter two.
    top = F.array_sort(
        F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period")))
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.withColumn("top", F.get(top, F.lit(0)))
    length = -F.col("top.shorter")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top.start").alias("start"),
        length.alias("length"),
        F.col("top.period").alias("period"),
        F.floor(1000 * length / F.col("top.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("kept", 256).alias("collapsed_sha256"),
    )


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = toxicity.fit(docs, labels, ~held_out)
    scored = toxicity.score_documents(docs, model, threshold=0.7)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", shifted), F.col("vec_id") % 100 == 0, positives=5, negatives=10, low=30, high=90)


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_bpe": op2_bpe,
    "op3_quality": op3_quality,
    "op4_training_order": op4_training_order,
    "op5_nearest": op5_nearest,
    "op6_warc": op6_warc,
    "op7_token_counts": op7_token_counts,
    "op8_lines": op8_lines,
    "op9_mixing": op9_mixing,
    "op10_substrings": op10_substrings,
    "op11_periodic": op11_periodic,
    "op12_toxicity": op12_toxicity,
    "op13_negatives": op13_negatives,
}

__all__ = ["ORACLES", "QUERIES"]
