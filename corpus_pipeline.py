"""The corpus pipeline: five stages over the documents table.

Every stage takes rows with null ids, null, empty and very long texts, repeated rows and an
empty table; columns other than those of documents are dropped. What becomes of each case is
stated at the stage.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granula.llm import mixing, near_dedup, quality_rules, secret_scan, sentence_pieces
from granula.llm.base import stored, text_of, words_of

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the policy v1 of the rule ledger accepts; a null or empty text has no words and is rejected."""
    return quality_rules.ledger(docs).where(~quality_rules.rejected("v1")).select(*COLUMNS)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with __row, a name of each row that stays the same: its file and place there; other than files are written first."""
    try:
        return docs.select("*", F.concat_ws(":", "_metadata.file_path", "_metadata.row_index").alias("__row"))
    except AnalysisException:  # not read from files
        return numbered(stored(docs, name), name)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group (5 words, 0.8): the least doc_id, null ids last, then the first row by name.

    Rows without words stay, each of them. Repeated rows are copies: one stays. Rows are
    told apart by file and place, so null and repeated ids do not bring a dropped row back.
    """
    rows = numbered(docs, "pipeline-docs")
    found = near_dedup.near_duplicates(rows.select("doc_id", "text", "__row"), width=5, percent=80, name="pipeline-near", extra=["__row"])
    found = stored(found.select("doc_id", "__row", "component"), "pipeline-near-found")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row"))["__row"]
    keep = found.where("component is not null").groupBy("component").agg(first.alias("__row")).select("__row")
    keep = keep.union(found.where("component is null").select("__row"))
    return rows.join(keep, "__row", "left_semi").select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with credentials and their linked parts replaced by [SECRET]; a null text stays null and keeps its n_chars."""
    found = secret_scan.redacted(secret_scan.scanned(docs))
    return found.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; a fraction is its first words as one more row, joined by blanks; rows without words go."""
    size = F.size(words_of(text_of())).cast("long")
    rows = mixing.mixed(docs, size, name="pipeline-mix").where("taken > 0")  # texts are written once and not shuffled
    whole = F.floor(F.col("taken") / F.col("size")).cast("int")
    part = (F.col("taken") - whole * F.col("size")).cast("int")
    copies = F.array_repeat(F.lit(0), whole)
    rows = rows.withColumn("__n", F.explode(F.when(part > 0, F.concat(copies, F.array(part))).otherwise(copies)))
    cut = F.array_join(F.slice(words_of(text_of()), F.lit(1), F.col("__n")), " ")
    rows = rows.withColumn("text", F.when(F.col("__n") > 0, cut).otherwise(F.col("text")))
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text and the digests of ids and decoded text; a null text is empty."""
    rows = sentence_pieces.encoded(docs, sentence_pieces.model_bytes())
    return rows.select("doc_id", "lang", "source", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256")


STAGES = [("quality rules", quality), ("near duplicates", dedup), ("secret scan", secrets), ("mixing", mix), ("sentence pieces", pieces)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what a stage returns is written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs


#: Near-duplicate links, exact piece encoding and chained writes have no SQL; tested against plain Python.
ORACLE_SQL = None
