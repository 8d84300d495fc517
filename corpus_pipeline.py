"""Corpus pipeline over `documents`: five stages, each by one operator of
``auric.llm``. Every stage takes (spark, docs, sf_dir) and returns a DataFrame;
:func:`run` writes it as Parquet to the shared folder and reads it back.

Rows are identified by ``doc_id``. Defined results: the first stage gives a
row without an id one of its own (negative, from a hash of the row), and the
exact dedup gives different texts with one id ids of their own (the longest
keeps it; the others' are negative, from a hash). Null texts count as empty and go
in the first stage (no words). Extra columns are kept whatever their names; an
empty table passes through every stage. The result has the token ids of every piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auric.llm.common import documents, stage, text_of
from auric.llm.exact_dedup import SPACE_CLASS, exact_dedup
from auric.llm.mixing import cut_copies, mix
from auric.llm.packing import pack_documents
from auric.llm.quality_rules import quality_rules
from auric.llm.simhash import simhash_classes
from auric.llm.tokens import default_path

# Production parameters.
WINDOW = 1024
END_ID = 0
SIMHASH = {"shingle_words": 3, "radius": 2}


def _unused(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    while name in df.columns:
        name += "_"
    return name


def _row_key() -> Column:
    """Equal for rows with the same id, text, language and source."""
    return F.sha2(F.to_json(F.struct("doc_id", "text", "lang", "source")), 256)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go. The verdict depends on the row's text, language
    and source only, so it is joined back by them."""
    key = _unused(docs, "row_key")
    keyed = docs.withColumn(key, _row_key())
    verdict = stage(quality_rules(keyed, id_col=key), "pipeline-quality")
    kept = verdict.where("kept").select(key).distinct()
    new_id = -1 - F.shiftrightunsigned(F.xxhash64(key), 2)
    return keyed.join(kept, key, "left_semi").withColumn("doc_id", F.coalesce("doc_id", new_id)).select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays. Of different texts with
    one id the longest keeps it; the others get ids of their own."""
    sha, n, first = (_unused(docs, c) for c in ("text_sha", "row_no", "is_first"))
    kept = stage(exact_dedup(docs), "pipeline-exact").where("kept").select(
        "doc_id", F.col("text_sha256").alias(sha)).distinct()
    norm = F.regexp_replace(text_of("text"), SPACE_CLASS + "+", "")
    rows = docs.withColumn(sha, F.sha2(norm, 256)).join(kept, ["doc_id", sha], "left_semi")
    order = [F.length("text").desc(), F.col("text")]
    rows = rows.withColumn(n, F.row_number().over(W.partitionBy("doc_id", sha).orderBy(*order))).where(F.col(n) == 1)
    longest = F.row_number().over(W.partitionBy("doc_id").orderBy(*order)) == 1
    new_id = -1 - F.shiftrightunsigned(F.xxhash64("doc_id", sha), 2)
    return rows.withColumn(first, longest).withColumn(
        "doc_id", F.when(F.col(first), F.col("doc_id")).otherwise(new_id)).select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each SimHash class stays."""
    classes = stage(simhash_classes(docs, **SIMHASH), "pipeline-near")
    kept = classes.where("doc_id = component_id").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi").select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: copy k of a document holds the words
    taken at least k times; n_chars is that of the copy."""
    cuts = _unused(docs, "cuts")
    taken = stage(mix(docs), "pipeline-mix").where("taken > 0").select("doc_id", F.col("cuts").alias(cuts))
    return cut_copies(docs.join(taken, "doc_id"), docs.schema, cuts)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in sequences, with their token ids."""
    return pack_documents(docs, default_path(), end_id=END_ID, window=WINDOW).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [("quality", quality), ("exact_dedup", exact), ("simhash_dedup", near), ("mixing", mixing),
          ("packing", packing)]

#: SimHash, the MCD estimates and BM25 have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}-out")
    return docs
