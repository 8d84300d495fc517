"""Registered queries: each operator over its whole intended table, with
production parameters, reduced to the digest columns of its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom_search import search
from .common import documents, shared_path
from .conversation_repair import damage, repair_parts, summaries
from .ctw import ctw_scores
from .exact_dedup import exact_dedup
from .mixing import mix
from .packing import pack_documents
from .piece_merges import encode
from .quality_rules import quality_rules
from .secret_scan import secret_spans
from .simhash import simhash_classes
from .suffix_dedup import suffix_dedup
from .token_files import id_kind, read_token_files, write_token_files
from .token_count import token_counts
from .tokens import default_path


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(documents(spark, sf_dir))
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"] != "literal")

    def count(kind):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    def text(a):
        return F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
        count("hex").alias("n_hex"), F.sha2(text(base), 256).alias("base_sha256"),
        text(spans).alias("spans"), count("literal").alias("n_literal"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    shards = write_token_files(docs, shared_path(spark, "token-files"), default_path(), end_id=2)
    return read_token_files(spark, shards, id_kind(docs))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_classes(documents(spark, sf_dir)).select(
        "doc_id", "fingerprint", "component_id", "class_size")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), default_path(), end_id=0, window=1024).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw_scores(documents(spark, sf_dir)).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_piece_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    return encode(documents(spark, sf_dir), path, decoded=True, check=True).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
        F.col("agrees").alias("library_agrees"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, copies = damage(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return summaries(repair_parts(rows, copies=copies)).withColumnRenamed("conv", "conv_id")


def op13_bloom_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {f.__name__: f for f in (
    op1_secret_scan, op2_token_files, op3_mixing, op4_simhash, op5_quality_rules, op6_token_counts,
    op7_packing, op8_context_tree, op9_exact_dedup, op10_suffix_dedup,
    op11_piece_merges, op12_conversation_repair, op13_bloom_search)}

_TERMS = (r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")

ORACLES = {
    "op13_bloom_search": f"""
        WITH terms AS (
            SELECT r, doc_id, unnest({_TERMS}) AS term
            FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
        counts AS (SELECT r, doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
        docs AS (SELECT r, sum(tf)::BIGINT AS n FROM counts GROUP BY r),
        total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM docs),
        wanted AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
        weights AS (
            SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w
            FROM counts, total WHERE term IN (SELECT term FROM wanted) GROUP BY term, n_docs),
        scores AS (
            SELECT item_id, r, doc_id,
                   sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
            FROM wanted JOIN weights USING (term) JOIN counts USING (term) JOIN docs USING (r), total
            GROUP BY item_id, r, doc_id),
        ranked AS (
            SELECT item_id, doc_id, score,
                   row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank
            FROM scores WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
    """,
    "op9_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS n_cp,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
            FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm ORDER BY n_cp DESC, doc_id)
    """,
}
