"""The corpus pipeline: documents pass the stages in order.

1. language_id: documents in which no language is found go (no text, no letter,
   or hardly an n-gram of any learned language; where no row is labelled, only those
   without a letter).
2. line_dedup: later copies of repeated line runs are cut out of the texts;
   documents of which no word is left go.
3. near_dedup: one document of each class of near duplicates stays.
4. secrets: every span found is replaced by a placeholder.
5. packing: the texts that are left, in training sequences.

Each stage takes (spark, docs, sf_dir) and all but the last return the columns
of ``docs``; where there is a column ``n_chars``, it follows the text.  Nulls,
repeated rows and empty tables are handled as the operators say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardstat.llm.common import cut, read_table, small_batches
from wardstat.llm.language_id import UNKNOWN, learn_profiles, predicted
from wardstat.llm.line_dedup import dedup_lines
from wardstat.llm.order_minhash import near_classes
from wardstat.llm.packing import packed_digests
from wardstat.llm.secrets import redact_secrets

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
MIN_SCORE = 0.1


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    profiles = learn_profiles(docs)
    if not profiles.langs:      # nothing to tell languages by
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = "found"
    while found in docs.columns:
        found += "_"
    # beside the columns: a row waits for its prediction with its text once
    scored = docs.withColumn(found, predicted(F.col("text"), profiles))
    return scored.where((F.col(f"{found}.lang_pred") != UNKNOWN)
                        & (F.col(f"{found}.score") >= MIN_SCORE)).drop(found)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = dedup_lines(docs, blanks_break=False)
    return _counted(cleaned.where((F.size("removed") == 0) | F.col("row.text").rlike(r"\S"))
                    .select("row.*"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row = "row"
    while row in docs.columns:
        row += "_"
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    kept = near_classes(numbered, row_col=row).where("kept").select(F.col("row").alias(row))
    return numbered.join(kept.hint("merge"), row, "left_semi").select(
        *[F.col(f"`{c}`") for c in docs.columns])


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(redact_secrets(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed_digests(docs, TOKENIZER)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("secrets", secrets), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The stages are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None
