"""The queries of this subpackage: opN_<name>(spark, sf_dir), and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard, langid, neighbours, packing, quotes, rans, repeats, sharding, warc
from .common import Scratch, table

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit on rows that are not held out, predict every row."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()).select("doc_id", "text", "lang"))
    found = langid.predict(docs, model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write an archive of all pages, then read every record back."""
    files = warc.write(table(spark, sf_dir, "pages"), Scratch(spark, "op2"))
    return warc.read(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(table(spark, sf_dir, "documents"), Scratch(spark, "op3"))


def op4_rans_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents into an archive, then read every document back from its files."""
    folder, files = rans.write_archive(table(spark, sf_dir, "documents"), tokenizer_path(), 2, Scratch(spark, "op4"))
    return rans.read_archive(files, folder)


def op5_jaccard_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"), Scratch(spark, "op5"))


def op6_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, Scratch(spark, "op6"))


def op7_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), 0, Scratch(spark, "op7"))


def op8_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark, "op8"))


def op9_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, in order of replies and without quotations, in parts of a bounded number of messages."""
    return quotes.conversations(table(spark, sf_dir, "conversations"), Scratch(spark, "op9"))


def op10_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(table(spark, sf_dir, "documents"), 8, Scratch(spark, "op10"))
    return rows.selectExpr("doc_id", "size", "text_crc32", "'rows' AS law", "shard", "slot", "CAST(NULL AS INT) AS grown_shard", "row")


def queries() -> dict:
    return {f.__name__: f for f in (op1_language_spans, op2_warc_archive, op3_repeat_removal, op4_rans_archive, op5_jaccard_classes, op6_posting_lists, op7_vector_packing, op8_template_decontamination, op9_quotation_links, op10_feistel_shards)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc_archive": f"""
            WITH p AS (SELECT CAST(page_id AS BIGINT) AS page_id, coalesce(html, '') AS html FROM pages),
            g AS (SELECT html, max(page_id) AS top FROM p WHERE strlen(html) >= {warc.REVISIT_BYTES} GROUP BY html)
            SELECT page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
              CASE WHEN top IS NULL OR top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
              CASE WHEN top <> page_id THEN top END AS refers_to
            FROM p LEFT JOIN g ON p.html = g.html""",
    }
