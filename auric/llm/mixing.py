"""Mixing sources to target weights by Sainte-Lague apportionment (operator 3).

* *Targets.* Sources in code-point order (null last) weigh 5, 2, 1, repeating,
  and share all words by weight; a target stops at ``max_epochs`` times its
  source's size and the excess is shared again by weight.
* *Quotas.* The mix is cut into equal blocks, no larger than a 64th of the least
  target, which go to sources by highest quotient target / (2 s + 1); a source's
  quota never exceeds ``max_epochs`` times its size. A source then has blocks of its
  own of ``block_words`` words, or of a 32nd of its target if that is less, so a
  source of any size comes near its target. Its quota in these blocks (a block that
  a shard's end cuts short counts by its words) goes in the same way to groups of
  shards and from each group to its shards: integer quotas.
* *Selection.* A shard's documents, in seeded order, are one stream of words
  cut into blocks. A quota of q over n blocks takes every block q // n times
  and q % n seeded blocks once more. A document's share is the overlap of its
  words with the blocks, so it is never above ``max_epochs`` times its size.

What one task holds is small numbers only: one row per source for the targets, a
row per group of a source or per shard of a group (``GROUP`` shards, so a group is
some two million rows) for the quotas, and the sizes of one shard's documents
(about ``shard_docs``) for the selection. A source that holds most rows has more
shards; texts are never moved.

Defined results: null and empty texts have size 0 and nothing is taken from
them (a source without words has target 0); repeated rows are documents of
their own; a null id is carried; ties go by source or shard; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import kind_of, map_batches, stage, text_of, to_bytes

WEIGHTS = (5, 2, 1)  # fixed values
GROUP = 4096  # shards in a group
UNIT_SHARE, BLOCK_SHARE = 64, 32  # a block against the least target, and against its source's


def targets(sizes: list[int], max_epochs: int) -> list[float]:
    """Targets of sources, in their order, by water filling."""
    weights = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sizes))]
    total, got = sum(sizes), [0.0] * len(sizes)
    free = [i for i, s in enumerate(sizes) if s > 0]
    rest = float(total)
    while free:
        unit = rest / sum(weights[i] for i in free)
        full = [i for i in free if weights[i] * unit >= max_epochs * sizes[i]]
        if not full:
            for i in free:
                got[i] = weights[i] * unit
            break
        for i in full:
            got[i] = float(max_epochs * sizes[i])
            rest -= got[i]
        free = [i for i in free if i not in set(full)]
    return got


def apportion(weights: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Sainte-Lague: seats by highest quotient weight / (2 s + 1), at most
    ``most`` each, ties to the first. The quotient of the last seat is found by
    bisection."""
    weights, most = np.asarray(weights, float), np.asarray(most, np.int64)
    seats = int(min(seats, most[weights > 0].sum()))
    if seats <= 0:
        return np.zeros(len(weights), np.int64)

    def above(q: float) -> np.ndarray:
        """Seats whose quotient is greater than q."""
        return np.where(weights > 0, np.clip(np.ceil((weights / q - 1) / 2), 0, most), 0).astype(np.int64)

    low, high = 0.0, float(weights.max()) * 2
    for _ in range(2000):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        if above(mid).sum() >= seats:
            low = mid
        else:
            high = mid
    got = above(high * (1 + 1e-9))  # clear of rounding; the few seats left go one by one
    heap = [(-weights[i] / (2 * got[i] + 1), i) for i in np.flatnonzero((got < most) & (weights > 0)).tolist()]
    heapq.heapify(heap)
    for _ in range(seats - int(got.sum())):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(heap, (-weights[i] / (2 * got[i] + 1), i))
    return got


def word_counts(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """id, source, size and a seeded order key of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [to_bytes(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("source"), pa.array([len(d.split()) for d in data], pa.int64())],
                ["id", "source", "size"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                       text_of(text_col).alias("text"))
    return map_batches(rows, run, f"id {kind_of(rows, 'id')}, source string, size long")


def _source_quotas(sources: DataFrame, max_epochs: int, block_words: int) -> DataFrame:
    """One row per source: target, quota in words, and the words of its own blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))
        if rows.empty:
            return
        key = rows.source.map(lambda s: (s is None, s or ""))
        rows = rows.iloc[sorted(range(len(rows)), key=lambda i: key.iloc[i])].reset_index(drop=True)
        size = rows.source_size.to_numpy()
        target = np.array(targets([int(s) for s in size], max_epochs))
        least = target[target > 0].min() if (target > 0).any() else 0
        unit = int(max(1, min(block_words, least // UNIT_SHARE)))
        quota = apportion(target, round(target.sum() / unit), -(-max_epochs * size // unit))
        own = np.clip(target // BLOCK_SHARE, 1, block_words).astype(np.int64)
        yield pd.DataFrame({"source": rows.source, "source_size": size, "target": target,
                            "source_words": np.minimum(quota * unit, max_epochs * size), "block": own})

    schema = "source string, source_size long, target double, source_words long, block long"
    return sources.coalesce(1).mapInPandas(run, schema)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        seed: int = 17, max_epochs: int = 3, block_words: int = 64, shard_docs: int = 512) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, taken and
    cuts, the copies taken along the document as runs of (words, copies)."""
    rows = stage(word_counts(docs, id_col, text_col, source_col), "mix-sizes")
    shards_of = F.ceil(F.count(F.lit(1)) / shard_docs).cast("long")
    per_source = stage(rows.groupBy("source").agg(shards_of.alias("n_shards"), F.sum("size").alias("source_size")),
                       "mix-sources")
    same = rows.source.eqNullSafe(per_source.source)
    sharded = rows.join(per_source.select("source", "n_shards"), same).select(
        "id", rows.source, "size",
        F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(seed)), "n_shards")
        .alias("shard"))
    sharded = stage(sharded, "mix-shards")
    shards = stage(sharded.groupBy("source", "shard").agg(F.sum("size").alias("words")), "mix-shard-sizes")
    sources = shards.groupBy("source").agg(F.sum("words").alias("source_size"))
    quotas = stage(_source_quotas(sources, max_epochs, block_words), "mix-targets")
    cut = shards.join(quotas, shards.source.eqNullSafe(quotas.source)).select(
        shards.source, "shard", F.floor(F.col("shard") / GROUP).alias("part"), "block",
        F.ceil(F.col("words") / F.col("block")).cast("long").alias("n_blocks"), "source_words", "source_size", "target")

    def share(of: str):
        """Deal a quota in blocks to rows by their blocks, in the order of ``of``."""
        def deal(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(of)
            n = pdf.n_blocks.to_numpy()
            pdf["quota"] = apportion(n, int(pdf.whole.iloc[0]), max_epochs * n)
            return pdf.drop(columns=["n_blocks", "whole"] if of == "part" else ["whole"])
        return deal

    # A source's words as blocks: of n blocks over its size, each block stands for size / n words.
    parts = cut.groupBy("source", "part").agg(F.sum("n_blocks").alias("n_blocks"), F.max("source_words").alias("words"),
                                              F.max("source_size").alias("size"))
    blocks = parts.groupBy("source").agg(F.sum("n_blocks").alias("all_blocks"), F.max("words").alias("words"), F.max("size").alias("size"))
    whole = F.coalesce(F.round(F.try_divide(F.col("words").cast("decimal(20,0)") * F.col("all_blocks"), F.col("size"))), F.lit(0))
    blocks = blocks.select(F.col("source").alias("of"), whole.cast("long").alias("whole"))
    parts = parts.join(blocks, parts.source.eqNullSafe(blocks.of)).select("source", "part", "n_blocks", "whole")
    of_part = parts.groupBy("source").applyInPandas(share("part"), "source string, part long, quota long")
    of_part = of_part.select(F.col("source").alias("of"), F.col("part").alias("of_part"), F.col("quota").alias("whole"))
    shard_quotas = cut.join(of_part, cut.source.eqNullSafe(of_part.of) & (cut.part == of_part.of_part)).select(
        "source", "part", "shard", "block", "n_blocks", "source_size", "target", "whole")
    shard_quotas = stage(shard_quotas.groupBy("source", "part").applyInPandas(
        share("shard"), "source string, part long, shard long, block long, n_blocks long, source_size long, target double, "
                        "quota long"), "mix-quotas")

    def select(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, sort_keys=[("order", "ascending"), ("id", "ascending"), ("size", "ascending")]))
        size = t.column("size").to_numpy()
        n, quota, block = (t.column(c)[0].as_py() for c in ("n_blocks", "quota", "block"))
        end = size.cumsum()
        begin = end - size
        copies = np.zeros(n, np.int64)
        if n:
            copies += quota // n
            name = f"{seed}/{t.column('source')[0]}/{t.column('shard')[0]}"
            chosen = np.random.default_rng(zlib.crc32(name.encode())).permutation(n)[:quota % n]
            copies[chosen] += 1
        upto = np.concatenate(([0], np.cumsum(copies * block)))

        def taken(x: np.ndarray) -> np.ndarray:
            """Words taken of the stream's first x words."""
            k = x // block
            extra = np.where(k < n, copies[np.minimum(k, n - 1)] * (x - k * block), 0) if n else 0
            return upto[np.minimum(k, n)] + extra

        cuts = []
        for a, z in zip(begin.tolist(), end.tolist()):
            runs = []
            while a < z:
                stop = min(z, (a // block + 1) * block)
                c = int(copies[a // block])
                if runs and runs[-1][1] == c:
                    runs[-1] = (runs[-1][0] + stop - a, c)
                else:
                    runs.append((stop - a, c))
                a = stop
            cuts.append([{"words": w, "copies": c} for w, c in runs])
        runs_kind = pa.list_(pa.struct([("words", pa.int64()), ("copies", pa.int64())]))
        return t.select(["id", "source", "size", "source_size", "target"]).append_column(
            "taken", pa.array(taken(end) - taken(begin), pa.int64())).append_column("cuts", pa.array(cuts, runs_kind))

    q = shard_quotas
    placed = sharded.join(q, sharded.source.eqNullSafe(q.source) & (sharded.shard == q.shard)).select(
        "id", sharded.source, sharded.shard, "size", "quota", "n_blocks", "block", "source_size", "target",
        F.xxhash64(F.col("id").cast("string"), F.lit(seed + 1)).alias("order"))
    kind = kind_of(rows, "id")
    out = placed.groupBy("source", "shard").applyInArrow(
        select, f"id {kind}, source string, size long, source_size long, target double, taken long, "
                "cuts array<struct<words:bigint,copies:bigint>>")
    return out.withColumnRenamed("id", id_col)


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def copies_of(text: str, cuts: list[dict]) -> list[str]:
    """The copies of a text that the mix takes: copy k has the words taken k
    times or more; words that follow each other keep the space between them."""
    data = to_bytes(text)
    if len({c["copies"] for c in cuts}) == 1:
        return [text] * cuts[0]["copies"]
    spans = [m.span() for m in _WORD.finditer(data)]
    out = []
    for k in range(1, max(c["copies"] for c in cuts) + 1):
        parts, at, begin = [], 0, None
        for c in [*cuts, {"words": 0, "copies": 0}]:
            if c["copies"] >= k and begin is None:
                begin = at
            elif c["copies"] < k and begin is not None:
                parts.append(data[spans[begin][0]:spans[at - 1][1]])
                begin = None
            at += c["words"]
        out.append(b"\n".join(parts).decode("utf-8", "surrogatepass"))
    return out


def cut_copies(docs: DataFrame, schema: StructType, cuts_col: str = "cuts") -> DataFrame:
    """Rows of documents with ``cuts_col`` -> one row per copy, columns of ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, texts = [], []
            for i, (t, c) in enumerate(zip(b.column("text"), b.column(cuts_col))):
                for x in copies_of(t.as_py() or "", c.as_py()):
                    owner.append(i)
                    texts.append(x)
            for lo in range(0, len(owner), 1000):
                part = b.take(pa.array(owner[lo:lo + 1000], pa.int64()))
                got = texts[lo:lo + 1000]
                new = {"text": pa.array(got, pa.string()), "n_chars": pa.array([len(x) for x in got], pa.int64())}
                yield pa.RecordBatch.from_arrays(
                    [new[f.name].cast(part.schema.field(f.name).type) if f.name in new else part.column(f.name)
                     for f in schema], [f.name for f in schema])

    return map_batches(docs.select(*schema.names, cuts_col), run, schema)
