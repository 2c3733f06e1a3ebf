"""Merkle fixity audit of replicas of an archive of WARC records.

Records lie in files, one after the other.  A leaf hashes a record's bytes
with the range of offsets it covers; an inner node hashes up to ``FAN_OUT``
children in order with the range that they cover together.  Above the files,
nodes gather them by the digits of a hash of their names, up to one root.
Two replicas with equal roots are equal.  Otherwise the audit descends: at
each level only children of nodes that differ are compared, so what is read
follows the number of damaged places, not the size of the archive.

Levels are built by partial grouping on (file, record number / FAN_OUT**k), so
a file that holds a large share of the records is spread over its subtrees,
and no group has more than FAN_OUT members (of the gathered files: about as
many in expectation).  Only DataFrame functions are used.

Null payloads are empty records.  Repeated pages are records of their own, in
the order of a hash of their content.  Pages without an id share a file
that is named so.  Other columns are ignored; two empty replicas are equal,
and all records of a replica are missing if the other is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardstat.llm.common import cut

FAN_OUT = 16
FILE_PAGES = 1024       # page ids of one file of ``warc_files``
LEAF = ["file", "ordinal", "start", "length", "digest"]


def warc_record(url: Column, html: Column) -> Column:
    """Bytes of a WARC/1.0 response record."""
    body = F.encode(F.coalesce(html.cast("string"), F.lit("")), "UTF-8")
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "),
                    F.coalesce(url.cast("string"), F.lit("")), F.lit("\r\nContent-Length: "),
                    F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def warc_records(pages: DataFrame) -> DataFrame:
    """(page_id, file, ordinal, record): pages in files by ranges of their ids."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"),
                        warc_record(F.col("url"), F.col("html")).alias("record"))
    name = F.coalesce(F.format_string("pages-%08d.warc", F.floor(F.col("page_id") / FILE_PAGES)),
                      F.lit("pages-none.warc"))
    order = Window.partitionBy("file").orderBy("page_id", F.xxhash64("record"))
    return rows.withColumn("file", name).select(
        "page_id", "file", (F.row_number().over(order) - 1).cast("long").alias("ordinal"), "record")


def leaves(records: DataFrame) -> DataFrame:
    """Records as leaves: file, ordinal, start (offset in the file), length,
    digest of the record's bytes; other columns but ``record`` are kept."""
    rows = records.withColumn("length", F.octet_length("record").cast("long")).withColumn(
        "digest", F.unhex(F.sha2("record", 256))).drop("record")
    before = Window.partitionBy("file").orderBy("ordinal").rowsBetween(
        Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum("length").over(before), F.lit(0)))


def _node(children: DataFrame, *key: str) -> DataFrame:
    """Nodes over children (start, end, digest, place), grouped by ``key``."""
    parts = F.array_sort(F.collect_list(F.struct("place", "start", "end", "digest")))
    text = F.concat_ws(";", F.transform("parts", lambda x: F.concat_ws(
        ":", x["place"].cast("string"), x["start"].cast("string"), x["end"].cast("string"),
        F.hex(x["digest"]))))
    grouped = children.groupBy(*key).agg(parts.alias("parts"), F.min("start").alias("start"),
                                         F.max("end").alias("end"))
    return grouped.withColumn("digest", F.unhex(F.sha2(text, 256))).drop("parts")


def merkle_levels(replicas: DataFrame, fan_out: int = FAN_OUT) -> list[DataFrame]:
    """Levels of the trees of all replicas, leaves first: replica, node (its name),
    parent, start, end, digest.  ``replicas``: leaves with a column ``replica``."""
    size = replicas.agg(F.max("ordinal").alias("last"),
                        F.count_distinct("file").alias("files")).first()
    now = replicas.select("replica", "file", F.col("ordinal").alias("place"), "start",
                          (F.col("start") + F.col("length")).alias("end"),
                          F.sha2(F.concat_ws(":", F.hex("digest"), "start", "length"), 256)
                          .alias("digest")).withColumn("digest", F.unhex("digest"))
    levels, last, height = [], size["last"] or 0, 0
    while True:
        named = now.withColumn("node", F.concat_ws("/", F.lit(str(height)), "file", "place"))
        up = F.floor(F.col("place") / fan_out)
        if last == 0:
            digits = 0
            while fan_out ** digits < (size["files"] or 1):
                digits += 1
            prefix = F.substring(F.md5("file"), 1, digits) if digits else F.lit("")
            levels.append(cut(named.withColumn("parent", F.concat_ws("/", F.lit("files"), prefix))))
            break
        height += 1
        levels.append(cut(named.withColumn("parent", F.concat_ws("/", F.lit(str(height)), "file",
                                                                 up))))
        now = cut(_node(levels[-1].withColumn("up", up), "replica", "file", "up")
                  .withColumnRenamed("up", "place"))
        last //= fan_out
    # files by more and more of the digits of their names' hashes
    now = levels[-1].select("replica", F.col("parent").alias("node"), F.col("file").alias("place"),
                            "start", "end", "digest")
    while True:
        now = cut(_node(now, "replica", "node").withColumn(
            "digits", F.substring_index("node", "/", -1)))
        parent = F.concat_ws("/", F.lit("files"), F.expr("left(digits, length(digits) - 1)"))
        levels.append(now.withColumn("parent", parent).drop("digits"))
        if digits == 0:
            return levels
        now = now.select("replica", parent.alias("node"), F.col("digits").alias("place"), "start",
                         "end", "digest")
        digits -= 1


def audit(replica_a: DataFrame, replica_b: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """Records in which the replicas (``LEAF`` columns) differ: file, ordinal,
    status, start_a, length_a, start_b, length_b.  Status: ``missing`` (only in
    a), ``extra`` (only in b), ``moved`` (equal bytes at another offset),
    ``corrupt`` (other bytes)."""
    both = cut(replica_a.select(*LEAF).withColumn("replica", F.lit("a")).unionByName(
        replica_b.select(*LEAF).withColumn("replica", F.lit("b"))))
    levels = merkle_levels(both, fan_out)
    differ = None
    for level in reversed(levels):
        if differ is not None:
            level = level.join(differ.withColumnRenamed("node", "parent"), "parent", "left_semi")
        side = lambda r: F.max(F.when(F.col("replica") == r, F.col("digest")))
        differ = cut(level.groupBy("node").agg(side("a").alias("a"), side("b").alias("b"))
                     .where(~F.col("a").eqNullSafe(F.col("b"))).select("node"))
        if differ.isEmpty():
            break
    name = F.concat_ws("/", F.lit("0"), "file", "ordinal")
    found = both.withColumn("node", name).join(differ, "node", "left_semi")
    pick = lambda r, c: F.max(F.when(F.col("replica") == r, F.col(c)))
    sides = found.groupBy("file", "ordinal").agg(*[pick(r, c).alias(f"{c}_{r}") for r in "ab"
                                                   for c in ("start", "length", "digest")])
    status = (F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "extra")
              .when(F.col("digest_a") == F.col("digest_b"), "moved").otherwise("corrupt"))
    return sides.select("file", "ordinal", status.alias("status"), "start_a", "length_a",
                        "start_b", "length_b")


def damaged_replica(records: DataFrame) -> DataFrame:
    """A replica with damage by fixed rules on the page id, for audits over given
    pages: one byte changed (id % 997 = 13), a record grown by a byte, which
    moves those after it (id % 1999 = 7), and files cut off after record 699
    (file number % 17 = 5)."""
    record = (F.when(F.col("page_id") % 997 == 13,
                     F.concat(F.encode(F.lit("w"), "UTF-8"),
                              F.substring("record", F.lit(2), F.octet_length("record"))))
              .when(F.col("page_id") % 1999 == 7,
                    F.concat("record", F.encode(F.lit("\n"), "UTF-8")))
              .otherwise(F.col("record")))
    lost = (F.floor(F.col("page_id") / FILE_PAGES) % 17 == 5) & (F.col("ordinal") >= 700)
    return records.where(~F.coalesce(lost, F.lit(False))).withColumn("record", record)


def audited_pages(pages: DataFrame) -> DataFrame:
    """Audit of the pages' archive against its damaged replica, with page ids."""
    records = warc_records(pages)
    original = cut(leaves(records))
    found = audit(original, leaves(damaged_replica(records)))
    return found.join(original.select("file", "ordinal", "page_id"), ["file", "ordinal"], "left")


AUDIT_SQL = """
WITH rec AS (
    SELECT page_id, page_id // 1024 AS f,
           row_number() OVER (PARTITION BY page_id // 1024 ORDER BY page_id) - 1 AS ordinal,
           strlen('WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10)
                  || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
                  || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10)
                  || chr(13) || chr(10)) + strlen(coalesce(html, '')) + 4 AS length_a
    FROM pages),
damaged AS (
    SELECT *, f % 17 = 5 AND ordinal >= 700 AS lost, page_id % 997 = 13 AS flipped,
           page_id % 997 <> 13 AND page_id % 1999 = 7 AS grown
    FROM rec),
placed AS (
    SELECT *, length_a + grown::INT AS length_b0,
           coalesce(sum(length_a) OVER w, 0) AS start_a,
           coalesce(sum(length_a + grown::INT) OVER w, 0) AS start_b0
    FROM damaged
    WINDOW w AS (PARTITION BY f ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT printf('pages-%08d.warc', f) AS file, ordinal,
       CASE WHEN lost THEN 'missing' WHEN flipped OR grown THEN 'corrupt' ELSE 'moved' END AS status,
       start_a::BIGINT AS start_a, length_a::BIGINT AS length_a,
       CASE WHEN NOT lost THEN start_b0 END::BIGINT AS start_b,
       CASE WHEN NOT lost THEN length_b0 END::BIGINT AS length_b, page_id
FROM placed WHERE lost OR flipped OR grown OR start_a <> start_b0"""
