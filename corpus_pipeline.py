"""A corpus pipeline: quality rules, toxicity, near-duplicates, personal data, packing.

Each stage takes what its predecessor kept, whole; all but the last return the columns of documents,
whatever else these are.  No stage changes the order or number of what it keeps but by its verdict.
An empty table goes through all stages and packs into nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard, packing, pii, quality, toxicity
from tessera.llm.common import table
from tessera.llm.queries import tokenizer
from tessera.storage import keep


def _kept(judged: DataFrame, verdict: str, columns: list[str]) -> DataFrame:
    return judged.where(verdict).select(*[f"`{c}`" for c in columns])


def _apart(docs: DataFrame, outputs: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """The documents with columns named like an operator's outputs renamed, and the names to go back to."""
    back = {f"__own_{c}": c for c in docs.columns if c in outputs}
    return docs.withColumnsRenamed({c: k for k, c in back.items()}), back


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules and trees keep.

    Null and empty texts fail the rules and go.  Texts of any length are judged whole.  Repeated rows
    stay or go together; a probability at the model's cut stays.  Without labels of both kinds among
    the documents the rules decide alone.  Columns named like a verdict are kept as they are.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    frame, back = _apart(docs, ("kept", "p_quality", "base_failed", *quality.COUNTS))
    return _kept(quality.judge(frame, model, keep=frame.columns), "kept", frame.columns).withColumnsRenamed(back)


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity chain doesn't reject.

    Null and empty texts have no toxic feature and are judged by the base rate.  Texts of any length are
    read whole.  Repeated rows stay or go together; a probability at the model's cut goes.  Without
    labels of both kinds nothing goes.  Columns named like a verdict are kept as they are.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    names = model.names if model else toxicity.names_of()
    frame, back = _apart(docs, ("toxic", *(f"p_{n}" for n in names)))
    return _kept(toxicity.judge(frame, model, keep=frame.columns), "not toxic", frame.columns).withColumnsRenamed(back)


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word windows, a similarity of 0.8 or more.

    The least id stays, null ids last; of rows with the same id and text any one.  Texts without words,
    null and empty ones all stay.  Texts of any length are compared whole; a tie at the bound links.
    """
    return jaccard.keep_one(docs, n=5, num=80, den=100)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked, and their new lengths where they have a column n_chars.

    Null stays null, empty empty; all rows stay, repeated ones too.  Overlapping spans are masked as one.
    """
    masked = pii.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else masked


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens, a row per piece.

    Null and empty texts are the end token alone; long texts are cut into pieces; repeated rows are packed
    each for itself; of equal lengths the first comes first.
    """
    # one worker runs all stages, so the last one keeps fewer words than it would alone
    pieces = packing.pack(docs, tokenizer(), most_cached=300_000)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality_rules", good), ("toxicity", civil), ("jaccard_join", single), ("pii", private), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what a stage kept is written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained models and tokenisation can't be written in SQL.
ORACLE_SQL = None
