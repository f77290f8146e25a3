"""One query per operator, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm import collocations, decontaminate, license_scan, line_dedup, merkle, packing, pii, projected_search, quality, sharding, simhash_dedup, token_counts, vector_dedup
from bitloom.llm.registry import QUERIES, SQL, query
from bitloom.sources.tables import read_table

__all__ = ["QUERIES", "SQL"]


@query("op1_simhash_dedup")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_dedup.near_copies(read_table(spark, folder, "documents"))


@query("op2_license_scan")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.license_notices(read_table(spark, folder, "documents"))


@query("op3_line_dedup", line_dedup.SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    left = line_dedup.dedup_lines(read_table(spark, folder, "documents"))
    return left.select(
        "doc.doc_id",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.size("dropped").cast("long").alias("n_dropped"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


@query("op4_importance_resampling")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    drawn = quality.resample(docs, read_table(spark, folder, "labels"))
    return drawn.select("doc.doc_id", "log_weight")


@query("op5_personal_data")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.personal_data(read_table(spark, folder, "documents"))
    plain = F.filter("spans", lambda s: ~s["disguised"])

    def joined(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

    def count(kind):
        return F.size(F.filter(plain, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *(count(kind) for kind in pii.KINDS),
        F.sha2(joined(plain), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


@query("op6_benchmark_leaks")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return decontaminate.leaks(docs, read_table(spark, folder, "benchmark")).drop("digest")


@query("op7_minimax_shards")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    sharded = sharding.minimax_shards(read_table(spark, folder, "documents"))
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return sharded.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)


@query("op8_mixture_packing")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(read_table(spark, folder, "documents"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source"
    )


@query("op9_vector_dedup", vector_dedup.SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return vector_dedup.near_vectors(read_table(spark, folder, "embeddings"))


@query("op10_token_counts")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, folder, "documents"))


@query("op11_projected_search")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return projected_search.nearest(read_table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op12_collocations", collocations.SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(read_table(spark, folder, "documents"))


def merkle_rows(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents``, of which a third has been tampered with: A-Z lower-cased."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    now = {"text": F.when(hit, lower).otherwise(F.col("text"))}
    return merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], now=now).drop("proof")


@query("op13_merkle_manifest", merkle.SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return merkle_rows(read_table(spark, folder, "documents"))
