"""SimHash near-dedup with covering locality-sensitive hashing (operator 4).

A fingerprint bit is 1 if it is set in more than half of the 64-bit hashes of
the text's word shingles. Fingerprints link at ``radius`` or fewer differing
bits; the classes are the connected components.

*Covering tables.* Every bit i gets a nonzero vector m(i) of radius + 1 bits.
Table v (one for each nonzero v) keeps the bits with <m(i), v> = 1 and hides
the others. At most ``radius`` differing bits span fewer than radius + 1
dimensions, so some v is orthogonal to all of them: their table hides every
difference and the pair shares its key there. No pair within the radius is
lost (2^(radius+1) - 1 tables; radius 2: seven).

*Hot buckets.* Only distinct fingerprints enter the tables, so copies cost
nothing. In a bucket of up to ``pair_limit`` fingerprints candidate pairs are
compared. A larger bucket emits, for each fingerprint, all values within
radius // 2 flips of hidden bits (radius 2: one flip): two fingerprints within
the radius share such a value, and for an even radius two that share one are
within the radius. Linking all of a value's fingerprints to its smallest one
gives the same components without listing pairs, however large the bucket.

Defined results: null text is empty; a text without words has fingerprint 0
and links like any other; repeated rows and ids are members of one class;
null ids are carried, ``component_id`` is the smallest non-null id of the
class. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kind_of, map_batches, stage, text_of, to_bytes
from .components import components

BITS = 64
SEED = 42
BLOCK = 1 << 16  # hashes turned into bits at a time


def fingerprint(text: str | None, shingle_words: int = 3) -> int:
    """SimHash of a whole text as an unsigned 64-bit integer."""
    words = to_bytes(text).lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle_words + 1)
    last = min(shingle_words, len(words)) - 1
    h = xxhash.xxh64_intdigest
    spans = list(zip(starts[:n].tolist(), ends[last:last + n].tolist()))
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, BLOCK):
        got = np.fromiter((h(joined[a:b], SEED) for a, b in spans[i:i + BLOCK]), np.uint64)
        bits = np.unpackbits(got.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle_words: int = 3) -> DataFrame:
    """Columns id and fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle_words) for t in b.column(1)),
                             np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return map_batches(rows, run, f"id {kind_of(rows, 'id')}, fp long")


def masks(radius: int) -> list[int]:
    """Bits that each covering table keeps, as signed 64-bit masks."""
    n = 1 << (radius + 1)
    out = []
    for v in range(1, n):
        keep = sum(1 << i for i in range(BITS) if bin((i % (n - 1) + 1) & v).count("1") & 1)
        out.append(keep - (1 << 64) if keep >> 63 else keep)
    return out


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(fps: DataFrame, radius: int = 2, pair_limit: int = 32) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components are the
    classes. ``fps`` has one row per distinct fingerprint, column fp."""
    if radius % 2:
        raise ValueError("the exact way for large buckets needs an even radius")
    tables = F.array(*[F.struct(F.lit(k).alias("t"), F.lit(m).cast("long").alias("mask"))
                       for k, m in enumerate(masks(radius))])
    keyed = fps.select("fp", F.explode(tables).alias("x")).select(
        "fp", F.col("x.t").alias("t"), F.col("x.mask").alias("mask"),
        F.col("fp").bitwiseAND(F.col("x.mask")).alias("key"))
    sizes = keyed.groupBy("t", "key").count().where("count > 1")
    shared = stage(keyed.join(stage(sizes, "simhash-buckets"), ["t", "key"]), "simhash-shared")

    few = shared.where(F.col("count") <= pair_limit)
    pairs = (few.select("t", "key", F.col("fp").alias("a"))
             .join(few.select("t", "key", F.col("fp").alias("b")), ["t", "key"])
             .where((F.col("a") < F.col("b")) & (_distance("a", "b") <= radius)).select("a", "b"))

    near = F.array(F.col("fp"))
    bit = F.array(*[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(BITS)])
    many = shared.where(F.col("count") > pair_limit).select(
        "fp", "t", F.filter(bit, lambda x: x.bitwiseAND(F.col("mask")) == 0).alias("hidden"))
    for _ in range(radius // 2):
        near = F.flatten(F.transform(near, lambda x: F.concat(
            F.array(x), F.transform(F.col("hidden"), lambda h: x.bitwiseXOR(h)))))
    hubs = many.select("fp", F.explode(F.array_distinct(near)).alias("hub")).distinct()
    least = hubs.groupBy("hub").agg(F.min("fp").alias("least"), F.max("fp").alias("most"))
    least = stage(least.where("least < most").select("hub", "least"), "simhash-hubs")
    stars = hubs.join(least, "hub").where("fp > least").select(
        F.col("least").alias("a"), F.col("fp").alias("b"))
    return pairs.union(stars).distinct()


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle_words: int = 3, radius: int = 2, pair_limit: int = 32) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id and
    class_size (rows in the class)."""
    docs_fp = stage(fingerprints(docs, id_col, text_col, shingle_words), "simhash-fps")
    reps = stage(docs_fp.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")),
                 "simhash-reps")
    roots = components(links(reps.select("fp"), radius, pair_limit))
    roots = reps.join(roots, reps.fp == roots.node, "left").select(
        "fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    roots = stage(roots, "simhash-roots")
    least = stage(roots.groupBy("root").agg(F.min("first").alias("component_id"),
                                            F.sum("n").alias("class_size")), "simhash-least")
    named = stage(roots.join(least, "root").select("fp", "component_id", "class_size"), "simhash-names")
    return docs_fp.join(named, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id", "class_size")
