"""One query per operator over the driver's tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from wardstat.llm.chunk_bpe import encoded_digests
from wardstat.llm.common import read_table
from wardstat.llm.exact_dedup import exact_dedup
from wardstat.llm.fingerprints import edited_fingerprints
from wardstat.llm.language_id import identify, learn_profiles
from wardstat.llm.line_dedup import line_report
from wardstat.llm.lm_score import score_documents
from wardstat.llm.merkle_manifest import MANIFEST_SQL, verified_documents
from wardstat.llm.order_minhash import near_classes
from wardstat.llm.packing import packed_digests
from wardstat.llm.periodic_runs import planted, run_report
from wardstat.llm.rotated_codes import nearest
from wardstat.llm.secrets import scan_secrets
from wardstat.llm.warc_fixity import AUDIT_SQL, audited_pages

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def crc_remainder(divisor: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(divisor))


def op1_packing(spark, sf_dir):
    return packed_digests(read_table(spark, sf_dir, "documents"), TOKENIZER)


def op2_line_dedup(spark, sf_dir):
    return line_report(read_table(spark, sf_dir, "documents"))


def op3_warc_fixity(spark, sf_dir):
    return audited_pages(read_table(spark, sf_dir, "pages"))


def op4_bpe(spark, sf_dir):
    return encoded_digests(read_table(spark, sf_dir, "documents"), TOKENIZER)


def op5_exact_dedup(spark, sf_dir):
    return exact_dedup(read_table(spark, sf_dir, "documents"),
                       digests=[F.sha2("text", 256).alias("text_sha256")])


def op6_language_id(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    held_out = crc_remainder(4) == 2
    learned = identify(docs, learn_profiles(docs.where(~held_out)))
    return learned.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_lm_score(spark, sf_dir):
    scored = score_documents(read_table(spark, sf_dir, "documents"), TOKENIZER,
                             crc_remainder(7) != 2)
    return scored.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known",
                         "train_tokens", "base_score", "score")


def op8_secrets(spark, sf_dir):
    return scan_secrets(read_table(spark, sf_dir, "documents"))


def op9_fingerprints(spark, sf_dir):
    return edited_fingerprints(read_table(spark, sf_dir, "documents"))


def op10_order_minhash(spark, sf_dir):
    return near_classes(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "class_id", "class_size", "kept")


def op11_merkle_manifest(spark, sf_dir):
    return verified_documents(read_table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark, sf_dir):
    return run_report(planted(read_table(spark, sf_dir, "documents")))


def op13_nearest(spark, sf_dir):
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {
    "op1_packing": op1_packing,
    "op2_line_dedup": op2_line_dedup,
    "op3_warc_fixity": op3_warc_fixity,
    "op4_bpe": op4_bpe,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_language_id": op6_language_id,
    "op7_lm_score": op7_lm_score,
    "op8_secrets": op8_secrets,
    "op9_fingerprints": op9_fingerprints,
    "op10_order_minhash": op10_order_minhash,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_nearest": op13_nearest,
}

ORACLE_SQL = {
    "op11_merkle_manifest": MANIFEST_SQL,
    "op3_warc_fixity": AUDIT_SQL,
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        WINDOW w AS (PARTITION BY t)""",
}
QUERIES["pipeline"] = corpus_pipeline.run
