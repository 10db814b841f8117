"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, jaccard, media, ngramlm, packing, pii, quality, secretscan, toxicity, warc
from tessera.llm.common import table


def tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _joined(spans, only_base: bool):
    kept = F.filter(spans, lambda s: s["base"]) if only_base else spans
    return F.concat_ws(",", F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def _span_digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    spans = F.col("spans")
    count = lambda k: F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == k))).cast("bigint").alias(f"n_{k}")
    return found.select("doc_id", *map(count, kinds), F.sha2(_joined(spans, True), 256).alias("base_sha256"), _joined(spans, False).alias("spans"))


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramlm.score(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.judge(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))
    return made.withColumn("block", F.col("block").cast("string"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digest(secretscan.scan(table(spark, sf_dir, "documents")), ("assign", "access", "hex"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.transcode(table(spark, sf_dir, "documents"), tokenizer())
    return coded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = media.read_images(media.store_as_png(table(spark, sf_dir, "documents")))
    payload = F.col("payload")
    return read.select(
        "doc_id", "n_bytes", F.length(payload).cast("bigint").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -64, 64)).alias("tail_crc32"), F.length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digest(pii.scan(table(spark, sf_dir, "documents")), ("email", "ip", "card", "phone"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_lm_score, op2_packing, op3_jaccard_join, op4_toxicity, op5_warc, op6_quality, op7_secrets, op8_bpe, op9_media, op10_pii)
}
ORACLES: dict[str, str] = {}
