"""Merkle manifest of a dataset: one root over all rows, a subroot per group, and
for each row the siblings that prove it.

A node is H of its children: the lowercase hex sha256 of their concatenation,
digests as hex text.  The leaves of a group are ordered by id; every two
consecutive nodes become their parent (the last run may be a single node, which
is hashed too) until one node remains, the group's subroot.  The subroots, in
the order of their groups, give the root in the same way.

A level of an aligned block of ``BLOCK`` nodes is one string, its digests side by
side.  A parent hashes a fixed-width substring of 128 characters of the level below,
the last one of 64 or 128; a node's sibling is the 64 characters beside it.
The blocks' top nodes are the nodes of the next, smaller table of the same form,
up to one node per group, so no group of rows is larger than a block, however
many rows one group holds.

Rows are placed by a sort by ranges on (group, id, leaf) and counted per
partition; only totals of partitions meet in one task.  Only DataFrame and SQL
functions are used.

A null group comes first; groups are in the order of their UTF-8 bytes.  Null
ids come first in a group.  Rows with the same id are in the order of their
leaves; equal rows are leaves of their own.  Null fields are ``-`` in a leaf.  Other
columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardstat.llm.common import cut

BLOCK = 256             # a power of two
WIDTH = 64              # characters of a digest
NODE = ["grp", "pos", "size"]


def leaf_digest(*fields: Column) -> Column:
    """H of the fields, each as its UTF-8 length, a colon and its text, or ``-``."""
    def framed(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text),
                          F.lit("-"))

    return F.sha2(F.concat(*[framed(c) for c in fields]), 256)


def placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` (with ``grp``) and their place ``pos`` in their group in the order of
    ``order``, and the group's ``size``.  Rows are sorted by ranges; the window is
    over totals, a row per partition and group in it."""
    by = ["grp", *order]
    mid = F.monotonically_increasing_id()
    ranged = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by)
                 .withColumns({"_part": F.shiftright(mid, 33),
                               "_at": mid.bitwiseAND(F.lit((1 << 33) - 1))}))
    totals = ranged.groupBy("grp", "_part").agg(F.min("_at").alias("_first"),
                                                F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy("grp")
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("grp").alias("_grp"), F.col("_part").alias("_p"), "_first",
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                           F.sum("_n").over(group).alias("size"))
    same = (F.col("_part") == F.col("_p")) & F.col("grp").eqNullSafe(F.col("_grp"))
    return ranged.join(starts, same).select(
        *[F.col(f"`{c}`") for c in rows.columns],
        (F.col("_at") - F.col("_first") + F.col("_before")).alias("pos"), "size")


def _parents(level: Column) -> Column:
    """The level above a level: its digests hashed in pairs."""
    pair = 2 * WIDTH
    runs = F.floor((F.length(level) + pair - 1) / pair)
    return F.array_join(F.transform(
        F.sequence(F.lit(0).cast("long"), runs - 1),
        lambda k: F.sha2(F.substring(level, (k * pair + 1).cast("int"), F.lit(pair)), 256)), "")


def _heights(size: Column, block: int) -> Column:
    """Levels of hashing in a block of a group of ``size`` nodes: all of the block's in a
    group of several blocks, else until one node remains."""
    return F.ceil(F.log2(F.least(size, F.lit(block)).cast("double"))).cast("int")


def _tier(nodes: DataFrame, block: int) -> DataFrame:
    """Aligned blocks of ``nodes`` (grp, pos, size, digest): grp, block, blocks of the
    group, levels (strings, from the nodes up), top digest."""
    number = F.floor(F.col("pos") / block)
    level = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest"))),
                                     lambda x: x["digest"]), "")
    grouped = nodes.groupBy("grp", "size", number.alias("block")).agg(level.alias("level"))
    climb = F.aggregate(
        F.sequence(F.lit(1), F.lit(block.bit_length() - 1)), F.array("level"),
        lambda acc, k: F.when(k <= _heights(F.col("size"), block),
                              F.concat(acc, F.array(_parents(F.element_at(acc, -1)))))
        .otherwise(acc))
    # another name: in a lambda, an alias of the same select would hide the column
    return grouped.select("grp", "block", climb.alias("levels"),
                          F.floor((F.col("size") + block - 1) / block).alias("blocks")
                          ).withColumn("top", F.element_at("levels", -1))


def _siblings(at: Column, levels: Column) -> Column:
    """For the node at ``at`` of a block: at each level below the top the digests left
    and right of its way up, empty where there is none."""
    def beside(level: Column, k: Column) -> Column:
        index = F.call_function("shiftright", at.cast("int"), k)
        odd = index.bitwiseAND(F.lit(1)) == 1
        near = F.substring(level, F.when(odd, index - 1).otherwise(index + 1) * WIDTH + 1,
                           F.lit(WIDTH))
        return F.struct(F.when(odd, near).otherwise("").alias("left"),
                        F.when(odd, "").otherwise(near).alias("right"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), beside)


def _ways(nodes: DataFrame, block: int) -> DataFrame:
    """(grp, pos, top, way): of each of the ``nodes`` (grp, pos, size, digest) the
    siblings on its way to its group's top node."""
    blocks = cut(_tier(nodes, block))
    if blocks.where("blocks > 1").isEmpty():
        upper = blocks.select(F.col("grp").alias("g"), F.col("block").alias("b"),
                              F.col("top").alias("above"),
                              F.expr("cast(array() as array<struct<left:string,right:string>>)")
                              .alias("up"))
    else:
        upper = _ways(blocks.select("grp", F.col("block").alias("pos"),
                                    F.col("blocks").alias("size"), F.col("top").alias("digest")), block).select(
            F.col("grp").alias("g"), F.col("pos").alias("b"), F.col("top").alias("above"),
            F.col("way").alias("up"))
    whole = blocks.join(upper, F.col("grp").eqNullSafe(F.col("g")) & (F.col("block") == F.col("b")))
    count = F.floor(F.length(F.element_at("levels", 1)) / WIDTH)
    each = F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda k: F.struct(
        (F.col("block") * block + k).alias("pos"),
        F.concat(_siblings(k, F.col("levels")), F.col("up")).alias("way")))
    return whole.select("grp", F.col("above").alias("top"), F.explode(each).alias("x")).select(
        "grp", "x.pos", "top", "x.way")


def folded(leaf: Column, way: Column) -> Column:
    """The top node that a leaf and the siblings on its way give."""
    return F.aggregate(way, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def manifest(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """The manifest of ``rows`` (grp, id, leaf and any other columns): the same rows with
    ``subroot``, ``root`` and ``way``, the (left, right) siblings from the leaf to the
    root, empty text where there is none."""
    if block < 2 or block & (block - 1):
        raise ValueError("block must be a power of two, 2 at least")
    leaves = cut(placed(cut(rows), ["id", "leaf"]))
    ways = cut(_ways(leaves.select(*NODE, F.col("leaf").alias("digest")), block))
    # one row a group; the groups are the leaves of the tree above
    tops = cut(ways.where("pos = 0").select("grp", "top"))
    groups = placed(tops.select(F.lit(0).alias("grp"), F.col("grp").alias("id"),
                                F.col("top").alias("leaf")), ["id"])
    groups = cut(groups)
    above = _ways(groups.select(*NODE, F.col("leaf").alias("digest")), block)
    upper = cut(groups.join(above.drop("grp"), "pos").select(
        F.col("id").alias("g"), F.col("leaf").alias("subroot"), F.col("top").alias("root"),
        F.col("way").alias("up")))
    return (leaves.alias("l").join(ways.alias("w"), F.col("l.grp").eqNullSafe(F.col("w.grp"))
                                   & (F.col("l.pos") == F.col("w.pos")))
            .join(upper, F.col("l.grp").eqNullSafe(F.col("g")))
            .select(*[F.col(f"l.`{c}`") for c in rows.columns], "subroot", "root",
                    F.concat("w.way", "up").alias("way")))


def document_leaves(docs: DataFrame) -> DataFrame:
    """(grp, id, leaf, tampered) of a table of documents: ``tampered`` is the leaf after 1
    is added to n_chars in rows whose id's crc32 is a multiple of 7, else null."""
    long = {c: F.col(f"`{c}`").cast("long") for c in ("doc_id", "n_chars")}
    text = {c: F.col(f"`{c}`").cast("string") for c in ("source", "lang", "text")}

    def leaf(n_chars: Column) -> Column:
        return leaf_digest(long["doc_id"], text["source"], text["lang"], n_chars, text["text"])

    hit = F.pmod(F.crc32(long["doc_id"].cast("string")), F.lit(7)) == 0
    return docs.select(text["lang"].alias("grp"), long["doc_id"].alias("id"),
                       leaf(long["n_chars"]).alias("leaf"),
                       F.when(hit & long["n_chars"].isNotNull(), leaf(long["n_chars"] + 1))
                       .alias("tampered"))


def verified_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256 (H of the siblings
    from the leaf up), folded_root (of the tampered leaf, else of the leaf) and
    whether it is the root."""
    found = manifest(document_leaves(docs)).withColumn(
        "folded_root", folded(F.coalesce("tampered", "leaf"), F.col("way")))
    proof = F.array_join(F.transform("way", lambda s: F.concat(s["left"], s["right"])), "")
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root",
                        F.sha2(proof, 256).alias("proof_sha256"), "folded_root",
                        (F.col("folded_root") == F.col("root")).alias("verified"))


MANIFEST_SQL = """
WITH RECURSIVE doc AS (
    SELECT doc_id, lang,
           [coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'),
            coalesce(strlen(source) || ':' || source, '-'),
            coalesce(strlen(lang) || ':' || lang, '-')] AS head,
           coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS n,
           coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS n1,
           coalesce(strlen(text) || ':' || text, '-') AS body,
           xor(4294967295, list_reduce(
               list_prepend(4294967295::BIGINT, list_transform(
                   range(1, strlen(doc_id::VARCHAR) + 1),
                   lambda i: ord(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
               lambda c, b: list_reduce(
                   list_prepend(xor(c, b), range(8)),
                   lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)))
           ) AS crc
    FROM documents),
leaf AS (
    SELECT doc_id, lang, sha256(array_to_string(head, '') || n || body) AS leaf,
           CASE WHEN crc % 7 = 0 THEN sha256(array_to_string(head, '') || n1 || body) END AS changed
    FROM doc),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
           dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS grp
    FROM leaf),
tree AS (
    SELECT grp, 0 AS lvl, pos AS idx, leaf AS h, count(*) OVER (PARTITION BY grp) AS n FROM placed
    UNION ALL
    SELECT grp, lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2
    FROM tree WHERE n > 1 GROUP BY grp, lvl, idx // 2, n),
tops AS (SELECT grp, h AS subroot FROM tree WHERE n = 1),
crown AS (
    SELECT 0 AS lvl, grp AS idx, subroot AS h, count(*) OVER () AS n FROM tops
    UNION ALL
    SELECT lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2
    FROM crown WHERE n > 1 GROUP BY lvl, idx // 2, n),
steps AS (
    SELECT p.grp, p.pos, t.lvl, (p.pos >> t.lvl) % 2 = 1 AS odd, s.h
    FROM placed p JOIN (SELECT DISTINCT grp, lvl FROM tree WHERE n > 1) t USING (grp)
    LEFT JOIN tree s ON s.grp = p.grp AND s.lvl = t.lvl AND s.idx = xor(p.pos >> t.lvl, 1)
    UNION ALL
    SELECT p.grp, p.pos, 1000 + t.lvl, (p.grp >> t.lvl) % 2 = 1, s.h
    FROM placed p CROSS JOIN (SELECT DISTINCT lvl FROM crown WHERE n > 1) t
    LEFT JOIN crown s ON s.lvl = t.lvl AND s.idx = xor(p.grp >> t.lvl, 1)),
ways AS (
    SELECT grp, pos, list({'odd': odd, 'h': coalesce(h, '')} ORDER BY lvl) AS way,
           string_agg(coalesce(h, ''), '' ORDER BY lvl) AS proof
    FROM steps GROUP BY grp, pos),
fold AS (
    SELECT p.grp, p.pos, 1 AS k, coalesce(changed, leaf) AS h, way
    FROM placed p LEFT JOIN ways w ON w.grp = p.grp AND w.pos = p.pos
    UNION ALL
    SELECT grp, pos, k + 1,
           sha256(CASE WHEN way[k].odd THEN way[k].h || h ELSE h || way[k].h END), way
    FROM fold WHERE k <= coalesce(len(way), 0))
SELECT p.doc_id, p.leaf, t.subroot, (SELECT h FROM crown WHERE n = 1) AS root,
       sha256(coalesce(w.proof, '')) AS proof_sha256, f.h AS folded_root,
       f.h = (SELECT h FROM crown WHERE n = 1) AS verified
FROM placed p JOIN tops t USING (grp)
LEFT JOIN ways w ON w.grp = p.grp AND w.pos = p.pos
JOIN fold f ON f.grp = p.grp AND f.pos = p.pos AND f.k = coalesce(len(f.way), 0) + 1"""
