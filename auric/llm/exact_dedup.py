"""Exact dedup by progressive refinement (operator 9), JVM-side only.

Texts are equal when identical after deleting white space. Three levels, each
keeping only what the one before could not tell apart:

1. byte length of the normalised text (one small row per document);
2. length and hash of the first ``prefix_chars`` characters;
3. SHA-256 of the whole normalised text, for rows of surviving groups only.

Every level is an aggregate with map-side combine followed by a join of two
plain scans, so a group that holds a third of all rows is pre-aggregated
before the shuffle and split by AQE in the join. No row is joined by its id,
so repeated or null ids change nothing.

Defined results: ids are integers, or cast to them; null text is the empty text, and all empty texts are one
group; of a group the row with the most code points in the original text
stays, then the smallest id, null ids last. Rows that repeat a kept id with
the same text carry ``kept = true`` like the row itself (the id is what
stays); an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, stage, text_of


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                prefix_chars: int = 256) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (of every
    normalised text, as an output) and digest (the same, but only for rows that
    survived the first two levels; the grouping uses this one)."""
    norm = docs.select(
        F.col(id_col).alias("id"), F.length(text_of(text_col)).alias("n_cp"),
        F.regexp_replace(text_of(text_col), SPACE_CLASS + "+", "").alias("norm"))
    heads = stage(norm.select(
        "id", "n_cp", F.octet_length("norm").alias("len"),
        F.xxhash64(F.substring("norm", 1, prefix_chars)).alias("head")), "dedup-heads")
    lens = stage(heads.groupBy("len").count().where("count > 1").select("len"), "dedup-lens")
    pairs = stage(
        heads.join(lens, "len", "left_semi").groupBy("len", "head").count()
        .where("count > 1").select("len", "head", F.lit(True).alias("alike")), "dedup-pairs")

    rows = norm.select(
        "id", "n_cp", F.octet_length("norm").alias("len"),
        F.xxhash64(F.substring("norm", 1, prefix_chars)).alias("head"),
        F.sha2("norm", 256).alias("full"))
    rows = stage(rows.join(pairs, ["len", "head"], "left")
                 .withColumn("digest", F.when(F.col("alike"), F.col("full"))), "dedup-rows")
    best = F.max(F.struct("n_cp", F.col("id").isNotNull().alias("known"),
                          F.bitwise_not("id").alias("inv")))
    groups = stage(
        rows.where("alike").groupBy("digest").agg(F.count(F.lit(1)).alias("size"), best.alias("best"))
        .where("size > 1")
        .select("digest", "size", F.bitwise_not(F.col("best.inv")).alias("keep")), "dedup-groups")
    # Rows that no level could match skip the join (their null digests would meet in one task).
    out = (rows.where("alike").join(groups, "digest", "left")
           .unionByName(rows.where("alike IS NULL"), allowMissingColumns=True))
    keep_id = F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep"))
    return out.select(
        F.col("id").alias(id_col), keep_id.alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep_id).alias("kept"),
        F.col("full").alias("text_sha256"), "digest")
