"""Removal of repeated byte strings (operator 10).

Every byte covered by a string of ``threshold`` bytes that also starts earlier
(smaller id, or same document and earlier start) is removed.

This is not the dealt prefix doubling of every position (see the README for why):
there is no global sort of rank pairs. *Anchors* chosen by content stand for the
windows of ``threshold`` bytes, and 64-bit names of growing contexts round an
anchor (its core, its reach, a side, the window) take the place of ranks; two
independent names are compared wherever a result depends on one. As with ranks, an
anchor leaves as soon as its name is unique, and the contexts grow to the threshold.

Of the ``core``-byte strings inside a window the one with the least name (the
leftmost, if equal) is its anchor. Equal windows choose equal anchors at equal
places, so no repeat is lost, and each window is decided by its one anchor.

Rounds between documents, each an aggregate with map-side combine and a join:

1. *Core.* Rank anchors by core name. Unique: its windows are unique, gone.
2. *Reach.* Pair the core with the name of its reach, all bytes of all windows
   that chose it (threshold + up to threshold - core bytes). Where a reach
   has occurred earlier, all the anchor's windows are repeats. Where a core
   has only one reach, its first anchor is unique. Left are the first anchors
   of several reaches round one core: the edges of repeated passages.
3. *Sides.* Such an anchor's windows reach ``half`` bytes or more to the left
   of the core or to its right; pair the core with either side. A side with a
   unique rank takes its windows with it.
4. *Windows.* The windows left are ranked at the full threshold; every one but
   the first is a repeat.

Within a document, repeats of a reach or a window are found before the
shuffle, so that a rank has a document at most once and "earlier" is the least
id. A rank shared by a third of all rows is a row per task after the
map-side combine, and its join back is split by AQE.

Defined results: ids are integers, or cast to them; null text is empty; rows that
repeat an id and its text are one document for the order, neither being earlier,
and each is reported; different texts with one id are documents of their own, in
the order of their hash; rows without an id are documents of their own before all others, in the order
of their text's hash; texts shorter than the threshold keep every byte; an
empty table gives an empty result; other columns are not read. Texts are
handled in blocks of ``BLOCK`` bytes, in memory linear in their length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, kind_of, map_batches, stage, text_of, to_bytes

BLOCK = 1 << 16  # bytes handled at a time: short texts together, long ones in parts
U = np.uint64


def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Name of two strings side by side, from their names."""
    x = left * U(0x9E3779B97F4A7C15)
    x += right * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


_BYTES = np.random.default_rng(20240229).integers(0, 1 << 63, 256, np.uint64)


class Names:
    """Names of the strings of 1, 2, 4, ... bytes at every position of a block."""

    def __init__(self, data: np.ndarray, most: int):
        now, size, self.by = _BYTES[data], 1, {}
        while size <= most and len(now):
            self.by[size] = now
            now = pair(now[:-size], now[size:]) if len(now) > size else now[:0]
            size *= 2

    def of(self, start: np.ndarray, length: int) -> np.ndarray:
        """Names of the strings of one length at some positions: two overlapping powers of two."""
        size = 1 << (length.bit_length() - 1)
        first = self.by[size][start]
        return first if size == length else pair(first, self.by[size][start + (length - size)])


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values, by doubling."""
    size, now = 1, key
    while 2 * size <= width:
        now = np.minimum(now[:-size], now[size:])
        size *= 2
    rest = width - size
    return np.minimum(now[:len(now) - rest], now[rest:]) if rest else now


class Shape:
    """Lengths that follow from threshold and core."""

    def __init__(self, threshold: int, core: int):
        self.threshold, self.core = threshold, core
        self.width = threshold - core + 1       # cores in a window
        self.half = (threshold - core + 1) // 2  # a window has this much on one side of its core


class Block:
    """Texts, or parts of texts, end to end. ``part`` lists where each begins
    here, the text it is of and its place there; windows across two are left out."""

    def __init__(self, parts: list[tuple[int, int, np.ndarray]], s: Shape):
        self.data = np.concatenate([d for _, _, d in parts])
        size = np.array([len(d) for _, _, d in parts])
        self.begin = np.cumsum(size) - size
        self.owner = np.array([i for i, _, _ in parts])
        self.at = np.array([a for _, a, _ in parts])
        edge = np.zeros(len(self.data) + 1, np.int8)
        edge[self.begin] += 1
        edge[self.begin + size - s.threshold + 1] -= 1
        self.starts = np.flatnonzero(np.cumsum(edge[:-1]))
        self.names = Names(self.data, s.threshold)

    def part_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, place, "right") - 1


def blocks(texts: list[np.ndarray], s: Shape) -> Iterator[Block]:
    """Blocks that hold each window start of each text once, in order."""
    held, size = [], 0
    for i, data in enumerate(texts):
        for at in range(0, len(data) - s.threshold + 1, BLOCK):
            held.append((i, at, data[at:at + BLOCK + s.threshold - 1]))
            size += len(held[-1][2])
            if size >= BLOCK:
                yield Block(held, s)
                held, size = [], 0
    if held:
        yield Block(held, s)


def anchors(b: Block, s: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a block: their place and the first and last window start that chose them."""
    core = b.names.of(np.arange(len(b.data) - s.core + 1), s.core)
    key = (core & U(0xFFFFFFFF00000000)) | np.arange(len(core), dtype=U)
    chosen = (_least(key, s.width) & U(0xFFFFFFFF)).astype(np.int64)[b.starts]
    new = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (np.diff(b.starts) != 1))))
    return chosen[new], b.starts[new], b.starts[np.append(new[1:], len(chosen)) - 1]


def reach_names(names: Names, place: np.ndarray, first: np.ndarray, last: np.ndarray, s: Shape) -> np.ndarray:
    """Name of all bytes of an anchor's windows, with its place in them."""
    size = 1 << (s.threshold.bit_length() - 1)
    end = last + s.threshold - size
    x = pair(names.by[size][first], names.by[size][end])
    x = pair(x, names.by[size][(first + end) // 2])
    return pair(x, ((place - first).astype(U) << U(32)) | (last - first).astype(U))


def _texts(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(to_bytes(t.as_py()), np.uint8) for t in column]


def find_anchors(docs: DataFrame, s: Shape) -> DataFrame:
    """(id, text) -> id, core, reach, first, before, span, again: the anchor's
    first window starts at ``first``, its place is ``before`` bytes on, its last
    window ``span`` on. ``again`` marks a reach that occurs earlier in the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for b in blocks(_texts(batch.column("text")), s):
                place, first, last = anchors(b, s)
                part = b.part_of(first)
                got.append((b.owner[part], b.names.of(place, s.core), reach_names(b.names, place, first, last, s),
                            first - b.begin[part] + b.at[part], place - first, last - first))
            if not got:
                continue
            owner, core, reach, first, before, span = (np.concatenate(c) for c in zip(*got))
            again = np.ones(len(owner), bool)
            again[np.unique(pair(pair(core, reach), owner.astype(U)), return_index=True)[1]] = False
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(owner)), pa.array(core.view(np.int64)),
                 pa.array(reach.view(np.int64)), pa.array(first), pa.array(before.astype(np.int16)),
                 pa.array(span.astype(np.int16)), pa.array(again)],
                ["id", "core", "reach", "first", "before", "span", "again"])

    return map_batches(docs, run, f"id {kind_of(docs, 'id')}, core long, reach long, first long, before short, "
                                  "span short, again boolean")


def find_sides(docs: DataFrame, edges: DataFrame, s: Shape) -> DataFrame:
    """Texts joined with their undecided anchors -> per anchor and side with
    windows: id, core, side name, and the names of its windows by start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column("edges")
            owner = np.repeat(np.arange(batch.num_rows), marks.value_lengths().to_numpy(zero_copy_only=False))
            m = marks.flatten()
            mark = [m.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("first", "before", "span")]
            order = np.lexsort((mark[0], owner))
            owner, (first, before, span) = owner[order], (x[order] for x in mark)
            for b in blocks(_texts(batch.column("text")), s):
                # The marks of this block: by text and, in a long one, by place.
                lo = np.searchsorted(owner, b.owner[0]) if len(b.owner) else 0
                hi = np.searchsorted(owner, b.owner[-1], "right")
                part = np.searchsorted(b.owner, owner[lo:hi])
                begin = first[lo:hi] - b.at[part] + b.begin[part]
                here = np.flatnonzero((first[lo:hi] >= b.at[part]) & (first[lo:hi] < b.at[part] + BLOCK)
                                      & (b.owner[part] == owner[lo:hi]))
                if not len(here):
                    continue
                f = begin[here]
                p, z = f + before[lo:hi][here], f + span[lo:hi][here]
                mid = p - s.half  # windows that start here or before have their half on the left
                both = [(0, f, np.minimum(z, mid), p - s.half), (1, np.maximum(f, mid + 1), z, p)]
                for side, low, high, left in both:
                    k = np.flatnonzero(low <= high)
                    if not len(k):
                        continue
                    n = high[k] - low[k] + 1
                    ends = np.cumsum(n)
                    w = np.repeat(low[k] - (ends - n), n) + np.arange(ends[-1])
                    windows = pair(b.names.of(w, s.threshold), (np.repeat(p[k], n) - w).astype(U))
                    name = b.names.of(left[k], s.core + s.half) ^ U(side)
                    core = b.names.of(p[k], s.core)
                    start = first[lo:hi][here][k] + (low[k] - f[k])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id").take(pa.array(owner[lo:hi][here][k])), pa.array(core.view(np.int64)),
                         pa.array(name.view(np.int64)), pa.array(start),
                         pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)),
                                                  pa.array(windows.view(np.int64)))],
                        ["id", "core", "side", "start", "windows"])

    marked = docs.join(edges, docs.id == edges.of).select("id", "text", "edges")
    return map_batches(marked, run, f"id {kind_of(docs, 'id')}, core long, side long, start long, "
                                    "windows array<bigint>")


def cut(data: bytes, spans: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal runs covered by the spans, and the bytes outside them."""
    runs: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if runs and a <= runs[-1][1]:
            if z > runs[-1][1]:
                runs[-1] = (runs[-1][0], z)
        else:
            runs.append((a, z))
    kept, at = [], 0
    for a, z in runs:
        kept.append(data[at:a])
        at = z
    return runs, b"".join(kept) + data[at:]


def _one_text_per_id(named: DataFrame) -> DataFrame:
    """Where an id has several texts, every (id, text) is a document of its own, in
    that order: ids become places in the order of (id, hash of the text)."""
    clash = named.groupBy("id").agg((F.min(F.xxhash64("text")) != F.max(F.xxhash64("text"))).alias("several"))
    if clash.where("several").isEmpty():
        return named
    keyed = named.withColumn("sha", F.sha2("text", 256))
    order = keyed.select("id", "sha").distinct().repartitionByRange("id", "sha").sortWithinPartitions("id", "sha")
    order = stage(order.withColumn("place", F.monotonically_increasing_id()), "suffix-ids")
    return keyed.join(order, ["id", "sha"]).select("out_id", F.col("place").alias("id"), "text")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 100,
                 core: int = 40) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, spans (removed
    runs as (start, end) in bytes) and kept_sha256 (of the bytes that stay)."""
    s = Shape(threshold, core)
    # Rows without an id come first, each text as a document of its own.
    nameless = F.lit(-(1 << 63)).cast("long") + F.pmod(F.xxhash64(text_of(text_col)), F.lit(1 << 61))
    named = docs.select(F.col(id_col).alias("out_id"), F.coalesce(F.col(id_col).cast("long"), nameless).alias("id"),
                        text_of(text_col).alias("text"))
    named = _one_text_per_id(named)
    texts = named.select("id", "text")
    span = [F.col("first").alias("start"), (F.col("first") + F.col("span") + threshold).alias("end")]
    found = stage(find_anchors(texts, s), "suffix-anchors")
    fresh = found.where("NOT again").drop("again")
    repeats = stage(found.where("again").select("id", *span), "suffix-again")

    cores = fresh.groupBy("core").agg(
        F.count(F.lit(1)).alias("n"), F.min("reach").alias("low"), F.max("reach").alias("high"),
        F.min("id").alias("first_id"))
    cores = stage(cores.where("n > 1").select(
        "core", "first_id", (F.col("low") != F.col("high")).alias("several")), "suffix-cores")
    shared = stage(fresh.join(cores.hint("shuffle_hash"), "core"), "suffix-shared")
    drop_stage(found)
    drop_stage(cores)
    repeats = repeats.union(shared.where("NOT several AND id > first_id").select("id", *span))
    several = shared.where("several").drop("several", "first_id")
    reaches = stage(several.groupBy("core", "reach").agg(F.min("id").alias("first_id")), "suffix-reaches")
    placed = stage(several.join(reaches.hint("shuffle_hash"), ["core", "reach"]).select(
        "id", "first", "before", "span", (F.col("id") > F.col("first_id")).alias("later")), "suffix-placed")
    repeats = repeats.union(placed.where("later").select("id", *span))

    edges = (placed.where("NOT later").groupBy("id")
             .agg(F.collect_list(F.struct("first", "before", "span")).alias("edges")).withColumnRenamed("id", "of"))
    sides = stage(find_sides(texts, edges, s), "suffix-sides")
    common = sides.groupBy("core", "side").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core", "side")
    left = sides.join(stage(common, "suffix-common").hint("shuffle_hash"), ["core", "side"], "left_semi")
    windows = stage(left.select("id", "core", "start", F.posexplode("windows").alias("k", "window")).select(
        "id", "core", (F.col("start") + F.col("k")).alias("start"), "window"), "suffix-windows")
    drop_stage(sides)
    firsts = windows.groupBy("core", "window").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "start")).alias("least"))
    firsts = stage(firsts.where("n > 1").drop("n"), "suffix-firsts")
    later = windows.join(firsts.hint("shuffle_hash"), ["core", "window"]).where(
        F.struct("id", "start") > F.col("least")).select("id", "start", (F.col("start") + threshold).alias("end"))
    repeats = repeats.union(stage(later, "suffix-later"))
    drop_stage(windows)
    spans = (repeats.groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
             .withColumnRenamed("id", "of"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            rows = []
            for t, marks in zip(b.column("text"), b.column("spans")):
                data = to_bytes(t.as_py())
                m = marks.values
                got = [] if m is None else list(zip(m.field("start").to_pylist(), m.field("end").to_pylist()))
                runs, kept = cut(data, got)
                rows.append((len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(),
                             [{"start": a, "end": z} for a, z in runs]))
            n, gone, k, sha, runs = zip(*rows) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [b.column("out_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(k, pa.int64()),
                 pa.array(sha, pa.string()), pa.array(runs, kind)],
                ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    marked = named.join(spans, named.id == spans.of, "left").select("out_id", "text", "spans")
    out = map_batches(marked, run, f"id {kind_of(named, 'out_id')}, n_bytes long, n_removed long, n_spans long, "
                                   "kept_sha256 string, spans array<struct<start:bigint,end:bigint>>")
    return out.withColumnRenamed("id", id_col)
