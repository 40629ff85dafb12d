"""The queries of this subpackage: ``opN_<name>`` applies operator N to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscape.llm import (
    decontaminate,
    language,
    line_field,
    mixing,
    near_dups,
    quality,
    quotes,
    repair,
    repeats,
    token_files,
    toxicity,
    walsh,
    warc,
)
from corpuscape.llm.common import NO_ID, crc_rest, table
from corpuscape.runtime import scratch_path

END_ID = 2
OP5_SHINGLE = 4


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    measured = quality.measured_rows(table(spark, sf, "documents"))
    cuts = quality.cutoffs(measured, table(spark, sf, "labels"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return quality.judge(measured, cuts).select(
        "doc_id", *[F.col(f"m.{c}").alias(c) for c in counts], "base_failed", "kept"
    )


def op2_token_files(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_files.encode_files(table(spark, sf, "documents"), path, tokenizer_file(), END_ID)
    return token_files.digests(spark, path)


def op3_repeats(spark: SparkSession, sf: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf, "documents"), keep_bytes=False)
    return found.withColumn("kept", F.col("kept").cast("string")).withColumnRenamed("kept", "kept_sha256")


def op4_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    held_out = crc_rest(F.col("doc_id"), 4) == 2
    learned = language.samples(docs, ~held_out)
    found = language.identify(docs, learned, "found")
    return found.select(
        "doc_id", held_out.alias("held_out"), F.col("found.lang").alias("lang_pred"), "found.score"
    )


def op5_near_dups(spark: SparkSession, sf: str) -> DataFrame:
    found = near_dups.find_components(table(spark, sf, "documents"), OP5_SHINGLE)
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return found.select(
        real("id").alias("doc_id"),
        "n_shingles",
        real("component").alias("component_id"),
        (F.col("id") == F.col("component")).alias("kept"),
    )


def op6_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    held_out = crc_rest(F.col("doc_id"), 5) == 0
    machine = toxicity.learn(docs, table(spark, sf, "labels"), ~held_out)
    scored = docs.select("doc_id", held_out.alias("held_out"), toxicity.score(docs, machine).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = decontaminate.find_items(docs, table(spark, sf, "benchmark"), "found")
    return found.select(
        "doc_id",
        "found.n_words",
        decontaminate.hit_words("found").alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("found.starts") > 0).alias("contaminated"),
    )


def op8_warc(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "archive")
    warc.write_archive(table(spark, sf, "pages"), path)
    return warc.read_archive(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op9_quote_links(spark: SparkSession, sf: str) -> DataFrame:
    return quotes.link_quotes(table(spark, sf, "conversations"))


def op10_mixing(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix(docs, mixing.plain_share(F.col("text")))
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


def op11_centroids(spark: SparkSession, sf: str) -> DataFrame:
    rows = walsh.scaled(table(spark, sf, "embeddings"))
    return walsh.described(*walsh.cluster(rows))


def op12_line_field(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    held_out = crc_rest(F.col("doc_id"), 4) == 2
    field = line_field.learn(docs, table(spark, sf, "labels"), ~held_out)
    scored = docs.select("doc_id", held_out.alias("held_out"), line_field.score(docs, field).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op13_repair(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    ordered, found = repair.repair(repair.damaged(rows))
    hashes = repair.digests(ordered, found.select("conv_id", "audit"))
    named = lambda df, name: df.withColumnRenamed("conv_id", name)
    joined = rows.select("conv_id").distinct().join(named(found, "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left")
    joined = joined.join(named(hashes, "h"), F.col("conv_id").eqNullSafe(F.col("h")), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    # A conversation without rows after the damage.
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return joined.select(
        F.col("conv_id"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"),
    )


OPERATORS = (
    op1_quality_rules,
    op2_token_files,
    op3_repeats,
    op4_language,
    op5_near_dups,
    op6_toxicity,
    op7_decontaminate,
    op8_warc,
    op9_quote_links,
    op10_mixing,
    op11_centroids,
    op12_line_field,
    op13_repair,
)
QUERIES = {
    f.__name__: f for f in OPERATORS
}
