"""Exact dedup by progressive refinement: length, then a hash of the prefix,
then the full hash, which is read only for rows that may have an equal.

1. Every row gets its text's length and the hash of its first characters.
   Rows are counted by (length, prefix hash); a row alone in its group is
   unique and its text is not hashed in full.
2. Which groups have two rows or more goes back to the scan as a sieve: the
   groups' keys are hashed into a fixed number of slots, so the sieve has a
   proven bound whatever the size of the table, and no text is shuffled.
   Rows that only share a slot are hashed too; that costs time, not results.
3. Rows that passed are grouped by (length, prefix hash, full hash).

Only DataFrame functions are used.  Sizes of groups are partial counts before
any shuffle, and the join back is one that Spark can split for a hot group.

Null texts count as empty.  Of equal texts the row with the largest id stays;
among rows with the same id, one of them; rows with a null id stay only where
no row of the group has one.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardstat.llm.common import cut, text_of

PREFIX_CHARS = 256
SIEVE_SLOTS = 1 << 20   # bound of the broadcast sieve, in rows of one integer


def _slot(*key: Column) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(SIEVE_SLOTS)).cast("int")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                digests: Sequence[Column] = ()) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, and the columns
    of ``digests`` (expressions over a column ``text``)."""
    text = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       text_of(f"`{text_col}`").alias("text"))
    keyed = text.select("doc_id", "text", F.length("text").cast("int").alias("_len"),
                        F.xxhash64(F.substring("text", 1, PREFIX_CHARS)).alias("_prefix"))
    # lengths that occur once are settled by the length alone
    by_prefix = keyed.groupBy("_len", "_prefix").agg(F.count(F.lit(1)).alias("n"))
    sieve = (by_prefix.where("n > 1").select(_slot(F.col("_len"), F.col("_prefix")).alias("_slot"))
             .distinct().withColumn("_again", F.lit(True)))
    marked = (keyed.withColumn("_slot", _slot(F.col("_len"), F.col("_prefix")))
              .join(F.broadcast(sieve), "_slot", "left"))
    # The row number breaks ties of the id; the table is written down before
    # it is used twice.
    rows = cut(marked.select(
        "doc_id", "_len", "_prefix",
        F.when(F.col("_again"), F.unhex(F.sha2("text", 256))).alias("_full"),
        F.monotonically_increasing_id().alias("_row"), *digests))
    key = ["_len", "_prefix", "_full"]
    # written down as well: both sides of the join then have a shuffle of their
    # own, whose hot partitions Spark can split
    groups = cut(rows.where(F.col("_full").isNotNull()).groupBy(*key)
              .agg(F.count(F.lit(1)).alias("group_size"),
                   F.max(F.struct(F.col("doc_id"), F.col("_row"))).alias("keep"))
              .where("group_size > 1"))
    own = [c for c in rows.columns if not c.startswith("_") and c != "doc_id"]
    return (rows.join(groups, key, "left").select(
        "doc_id",
        F.when(F.col("keep").isNotNull(), F.col("keep.doc_id")).otherwise(F.col("doc_id"))
        .alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("keep._row") == F.col("_row"), F.lit(True)).alias("kept"), *own))
