"""From raw documents to token ids: quality rules, near-duplicates, personal data, mixing, byte-pair encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the shared folder and reads
it back as the next stage's docs; what a stage staged on the way is deleted then, and its own input with it. All stages but
the last return the columns of documents.

Edge cases, in every stage: null text is empty (it fails the quality rules, so later stages rarely see any); a row without
doc_id is judged, never linked, and drawn by its text in mixing; repeated rows of one doc_id and text leave near-dedup
once, other rows of that doc_id stay; ties of near-duplicates go to the smallest doc_id; an empty table gives an empty
result; columns that clash with names used inside stay as they are. encode drops all columns but doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, minhash, mixing, pii, rules
from quire.llm.queries import tokenizer
from quire.llm.shared import discard, staged, stages, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.filtered(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicated(docs)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.masked(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, table(spark, sf_dir, "labels"), low=0.0, spare_clean=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = bpe.encode(docs, tokenizer())
    return out.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality_rules), ("near-dedup", near_dedup), ("pii", mask_pii), ("mixing", mix), ("encode", encode)]

#: The stages hold fitted models and tokenizers, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        with stages() as made:
            after = staged(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        discard(*(m for m in made if m is not after), *([docs] if i else []))
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
