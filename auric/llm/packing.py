"""Lexical retrieval packing (operator 7).

Every document is encoded once. What fills whole windows is cut off as
windows of its own; the rest (the *unit*, less than a window) is packed with
lexically similar units:

1. One pass encodes, and counts per token id the units that hold it. These
   document frequencies, the number of units and their total length are summed
   over the whole corpus (rows by token id: bounded by the vocabulary).
2. Units are dealt by range of (min-hash of their token pairs, id), so that
   similar units meet, and however many share a min-hash they spread.
3. A task cuts its stream into index shards of ``shard_units`` units. Each
   shard is a BM25 index: one posting row of weights per term. A seed opens a
   window and scores all unused units by its terms; the best neighbours fill
   the window in order. The neighbour that overflows is cut, and what is left
   of it seeds the next window.

Windows run on from shard to shard, so only the last window of a task can be
short: that is the only padding. Memory per task is one shard and its index.

Defined results: a null or empty text is its end id alone; repeated rows and
ids are packed each on its own; null ids are carried; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kind_of, map_batches, stage, text_of
from .tokens import encoder

SEQUENCE_BITS = 36  # sequence_id = task number above, count in the task below


def _route(ids: np.ndarray) -> int:
    """Min-hash of the token pairs of a unit."""
    wide = ids.astype(np.uint64)
    if len(wide) > 1:
        wide = wide[:-1] * np.uint64(0x9E3779B97F4A7C15) + wide[1:]
    wide *= np.uint64(0xBF58476D1CE4E5B9)
    return int(wide.min() >> np.uint64(1))


def encode_units(docs: DataFrame, tokenizer_path: str, end_id: int, window: int,
                 id_col: str, text_col: str) -> DataFrame:
    """Rows of documents (id, ids, route) and, one per task, of document
    frequencies (df as 64-bit counts by token id, units, unit_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        df = np.zeros(enc.size, np.int64)
        last = np.zeros(enc.size, np.int64)
        place = np.arange(window)
        units = size = 0
        none = None
        for b in batches:
            none = pa.nulls(1, b.column(0).type)
            data, routes = [], []
            for ids in enc.encode_all(b.column(1), end_id):
                data.append(ids.tobytes())
                unit = ids[len(ids) - len(ids) % window:]
                routes.append(_route(unit if len(unit) else ids[-window:]))
                if len(unit):
                    # One place of each distinct id of the unit: the one written last.
                    at = place[:len(unit)]
                    last[unit] = at
                    df[unit[last[unit] == at]] += 1
                    units += 1
                    size += len(unit)
            n = len(data)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(data, pa.binary()), pa.array(routes, pa.int64()),
                 pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())],
                ["id", "ids", "route", "df", "units", "unit_tokens"])
        if none is not None:
            yield pa.RecordBatch.from_arrays(
                [none, pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([df.tobytes()], pa.binary()),
                 pa.array([units], pa.int64()), pa.array([size], pa.int64())],
                ["id", "ids", "route", "df", "units", "unit_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return map_batches(rows, run, f"id {kind_of(rows, 'id')}, ids binary, route long, "
                                  "df binary, units long, unit_tokens long")


def frequencies(encoded: DataFrame) -> tuple[dict[int, int], int, int]:
    """Document frequency by token id (at most one entry per vocabulary entry),
    number of units and their tokens, over the whole corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray | int] = {"df": 0}
        for b in batches:
            for d in b.column(0):
                total["df"] = total["df"] + np.frombuffer(d.as_py(), np.int64)
        if not isinstance(total["df"], int):
            at = np.flatnonzero(total["df"])
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total["df"][at])], ["token", "n"])

    parts = encoded.where("df IS NOT NULL")
    df = map_batches(parts.select("df"), run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    units, size = parts.agg(F.coalesce(F.sum("units"), F.lit(0)), F.coalesce(F.sum("unit_tokens"), F.lit(0))).first()
    return {r.token: r.n for r in df.collect()}, units, size


class _Index:
    """BM25 posting rows of one shard: weight of every unit, by term."""

    def __init__(self, units: list[np.ndarray], idf: np.ndarray, mean: float, k1: float, b: float):
        lengths = np.array([len(u) for u in units])
        owner = np.repeat(np.arange(len(units), dtype=np.int64), lengths)
        code, tf = np.unique(owner << 32 | np.concatenate(units).astype(np.int64), return_counts=True)
        unit, token = code >> 32, code & 0xFFFFFFFF
        self.terms, self.row = np.unique(token, return_inverse=True)
        self.at = np.searchsorted(unit, np.arange(len(units) + 1))  # each unit's part of row
        weight = idf[token] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[unit] / mean))
        self.rows = np.zeros((len(self.terms), len(units)), np.float32)
        self.rows[self.row, unit] = weight

    def like_unit(self, k: int) -> np.ndarray:
        """BM25 score of every unit of the shard for the terms of unit k."""
        return self.rows[self.row[self.at[k]:self.at[k + 1]]].sum(axis=0)

    def like(self, seed: np.ndarray) -> np.ndarray:
        """The same for the terms of a unit of another shard."""
        terms = np.unique(seed)
        at = np.searchsorted(self.terms, terms)
        at = at[(at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == terms)]
        return self.rows[at].sum(axis=0)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, window: int = 1024,
                   id_col: str = "doc_id", text_col: str = "text", shard_units: int = 512,
                   k1: float = 1.2, b: float = 0.75, with_ids: bool = True) -> DataFrame:
    """One row per piece: id, start, length, ids (little-endian bytes of the
    encoder's width; null unless ``with_ids``), ids_crc32, doc_tokens,
    sequence_id, offset."""
    spark = docs.sparkSession
    encoded = stage(encode_units(docs, tokenizer_path, end_id, window, id_col, text_col), "packing-units")
    df, units, size = frequencies(encoded)
    stats = spark.sparkContext.broadcast(df)  # at most one entry per vocabulary entry
    mean = size / units if units else 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        idf = np.zeros(enc.size)
        at = np.fromiter(stats.value.keys(), np.int64, len(stats.value))
        n = np.fromiter(stats.value.values(), np.float64, len(stats.value))
        idf[at] = np.log1p((units - n + 0.5) / (n + 0.5))
        packer = _Packer(window, with_ids, idf, mean, k1, b)
        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(data.as_py(), enc.dtype)
                packer.document(doc, ids)
                if len(packer.units) >= shard_units:
                    packer.shard()
            if packer.out:
                yield packer.take(batch.column(0).type)
            kind = batch.column(0).type
        packer.shard()
        packer.flush()
        if packer.out:
            yield packer.take(kind)

    rows = encoded.where("ids IS NOT NULL").select("id", "ids", "route")
    rows = rows.repartitionByRange("route", "id").sortWithinPartitions("route", "id").select("id", "ids")
    kind = kind_of(rows, "id")
    out = map_batches(rows, run, f"id {kind}, start long, length long, ids binary, ids_crc32 long, "
                                 "doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)


class _Packer:
    def __init__(self, window: int, with_ids: bool, *bm25):
        self.window, self.with_ids, self.bm25 = window, with_ids, bm25
        self.units: list[tuple] = []   # (doc, ids, start, doc_tokens) of the shard
        self.open: list[tuple] = []    # pieces of the window being filled
        self.filled = 0
        self.out: list[tuple] = []
        self.next = TaskContext.get().partitionId() << SEQUENCE_BITS

    def document(self, doc, ids: np.ndarray) -> None:
        n, w = len(ids), self.window
        whole = n - n % w
        for at in range(0, whole, w):
            self._emit([(doc, ids[at:at + w], at, n)])
        if whole < n:
            self.units.append((doc, ids[whole:], whole, n))

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, ids, start, n in pieces:
            self.out.append((doc, start, len(ids), ids.tobytes() if self.with_ids else None, zlib.crc32(ids.astype("<u4").tobytes()),
                             n, self.next, offset))
            offset += len(ids)
        self.next += 1

    def _place(self, unit: tuple) -> tuple | None:
        """Put a unit into the open window; what overflows comes back."""
        doc, ids, start, n = unit
        room = self.window - self.filled
        self.open.append((doc, ids[:room], start, n))
        self.filled += min(room, len(ids))
        if self.filled == self.window:
            self.flush()
        return (doc, ids[room:], start + room, n) if len(ids) > room else None

    def flush(self) -> None:
        if self.open:
            self._emit(self.open)
        self.open, self.filled = [], 0

    def shard(self) -> None:
        """Pack all units of the shard."""
        if not self.units:
            return
        index = _Index([u[1] for u in self.units], *self.bm25)
        unused = np.ones(len(self.units), bool)
        first = 0
        # A window left open by the shard before goes on with its own seed.
        scores = index.like(self.open[0][1]) if self.open else None
        while True:
            if scores is None:
                while first < len(unused) and not unused[first]:
                    first += 1
                if first == len(unused):
                    break
                unused[first] = False
                self._place(self.units[first])
                if not self.open:
                    continue
                scores = index.like_unit(first)
            left = None
            free = np.flatnonzero(unused)
            for k in free[np.argsort(-scores[free], kind="stable")].tolist():
                unused[k] = False
                left = self._place(self.units[k])
                if not self.open:
                    break
            else:
                break  # every unit is placed; the open window goes on in the next shard
            scores = None
            if left is not None:  # the cut neighbour seeds the next window
                scores = index.like_unit(k)
                self._place(left)
        self.units = []

    def take(self, kind: pa.DataType) -> pa.RecordBatch:
        cols = list(zip(*self.out))
        self.out = []
        types = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        names = ["id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)
