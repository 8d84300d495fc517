"""Token-id output in Arrow stream files (operator 2).

Documents go by range of id to tasks that sort and encode them; each task
writes one shard, two Arrow streams in the shared output folder:

* ``part-N.tokens.arrows``: the shard's ids end to end, cut into sequences of
  ``seq_len``. Batches hold a fixed number of rows of two fixed-size lists,
  ``ids`` and ``mask`` (false for padding of the last sequence), so sequence i
  is a slice at a computed place: memory-mapped, it is read without a copy.
* ``part-N.docs.arrows``: id and number of tokens of each document, in order.

Ids take two bytes where the vocabulary allows it. A file is written under a
name of its attempt and moved into place, so a retried or doubled task leaves
the same file. Shard order is id order; the offset of a shard is the sum of
the tokens of the shards before it (one small row per shard).

Defined results: a null or empty text is its end id alone; null ids come
first; rows of the same id are ordered by text; an empty table gives no file
and an empty result; other columns are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import kind_of, map_batches, stage, text_of
from .tokens import encoder


def open_folder(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")


class _Shard:
    """Writer of one shard."""

    def __init__(self, base: str, dtype: np.dtype, id_type: pa.DataType, seq_len: int, rows: int):
        self.fs, self.base = open_folder(base)
        self.fs.create_dir(os.path.dirname(self.base))
        self.seq_len, self.room, self.dtype = seq_len, rows * seq_len, dtype
        schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), seq_len)),
                            ("mask", pa.list_(pa.bool_(), seq_len))])
        index = pa.schema([("doc_id", id_type), ("n_tokens", pa.int64())])
        self.names = [f"{self.base}.{n}.arrows" for n in ("tokens", "docs")]
        self.mark = f".{TaskContext.get().taskAttemptId()}.tmp"
        self.sinks = [self.fs.open_output_stream(n + self.mark) for n in self.names]
        self.tokens, self.docs = (pa.ipc.new_stream(s, k) for s, k in zip(self.sinks, (schema, index)))
        self.held: list[bytes] = []
        self.size = self.n_docs = self.n_tokens = 0

    def add(self, ids: pa.Array, texts: list[bytes]) -> None:
        width = self.dtype.itemsize
        counts = [len(t) // width for t in texts]
        self.docs.write_batch(pa.RecordBatch.from_arrays(
            [ids, pa.array(counts, pa.int64())], schema=pa.schema([("doc_id", ids.type), ("n_tokens", pa.int64())])))
        self.held += texts
        self.size += sum(counts)
        self.n_docs += len(texts)
        self.n_tokens += sum(counts)
        if self.size >= self.room:
            flat = np.frombuffer(b"".join(self.held), self.dtype)
            full = self.size - self.size % self.room
            for i in range(0, full, self.room):
                self._write(flat[i:i + self.room], self.room)
            self.held, self.size = [flat[full:].tobytes()], self.size - full

    def _write(self, flat: np.ndarray, real: int) -> None:
        ids = pa.FixedSizeListArray.from_arrays(pa.array(flat), self.seq_len)
        mask = pa.FixedSizeListArray.from_arrays(pa.array(np.arange(len(flat)) < real), self.seq_len)
        self.tokens.write_batch(pa.RecordBatch.from_arrays([ids, mask], ["ids", "mask"]))

    def close(self) -> None:
        if self.size:
            flat = np.frombuffer(b"".join(self.held), self.dtype)
            padded = np.zeros(-(-self.size // self.seq_len) * self.seq_len, self.dtype)
            padded[:self.size] = flat
            self._write(padded, self.size)
        for w, s, n in zip((self.tokens, self.docs), self.sinks, self.names):
            w.close()
            s.close()
            self.fs.move(n + self.mark, n)


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int,
                      id_col: str = "doc_id", text_col: str = "text", seq_len: int = 1024,
                      batch_rows: int = 256) -> DataFrame:
    """Write the shards; one row per shard: shard, base (path without suffix),
    n_docs, n_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(tokenizer_path), None
        k = TaskContext.get().partitionId()
        base = f"{folder}/part-{k:06d}"
        for b in batches:
            if shard is None:
                shard = _Shard(base, enc.dtype, b.column(0).type, seq_len, batch_rows)
            shard.add(b.column(0), [x.tobytes() for x in enc.encode_all(b.column(1), end_id)])
        if shard is not None:
            shard.close()
            yield pa.RecordBatch.from_pydict(
                {"shard": pa.array([k], pa.int64()), "base": [base],
                 "n_docs": pa.array([shard.n_docs], pa.int64()), "n_tokens": pa.array([shard.n_tokens], pa.int64())})

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    rows = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    return stage(map_batches(rows, run, "shard long, base string, n_docs long, n_tokens long"), "token-shards")


class TokenFile:
    """Random access to the sequences of a shard."""

    def __init__(self, base: str):
        fs, path = open_folder(base)
        local = isinstance(fs, pyarrow.fs.LocalFileSystem)
        # Memory-mapped batches are views of the file, not copies.
        self._open = (lambda p: pa.memory_map(p)) if local else fs.open_input_file
        self.path = path
        self.batches = list(pa.ipc.open_stream(self._open(f"{path}.tokens.arrows")))
        self.seq_len = self.batches[0].schema.field("ids").type.list_size if self.batches else 0
        self.rows = self.batches[0].num_rows if self.batches else 1

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids (a view of the file) and mask of sequence i."""
        b, r = self.batches[i // self.rows], i % self.rows
        a, n = r * self.seq_len, self.seq_len
        return (b.column("ids").values.slice(a, n).to_numpy(zero_copy_only=True),
                b.column("mask").values.slice(a, n))

    def documents(self) -> Iterator[tuple[object, int, int, np.ndarray]]:
        """(doc_id, start in the shard, n_tokens, ids) of every document, in order."""
        flat = [b.column("ids").values.to_numpy(zero_copy_only=True) for b in self.batches]
        room = self.rows * self.seq_len
        at = 0
        for b in pa.ipc.open_stream(self._open(f"{self.path}.docs.arrows")):
            for doc, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                first, last = at // room, (at + n - 1) // room
                if first == last:
                    ids = flat[first][at % room:at % room + n]
                else:
                    ids = np.concatenate([flat[k][max(0, at - k * room):at + n - k * room]
                                          for k in range(first, last + 1)])
                yield doc, at, n, ids
                at += n


def read_token_files(spark: SparkSession, shards: DataFrame, id_type: str) -> DataFrame:
    """Every document of the shards, from the files: doc_id, start (ids of all
    documents before it), n_tokens, ids_crc32 (of little-endian 32-bit ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for base, first in zip(b.column("base").to_pylist(), b.column("first").to_pylist()):
                rows, size = [], 0
                for doc, at, n, ids in TokenFile(base).documents():
                    rows.append((doc, first + at, n, zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) == 10_000:
                        yield _table(rows, schema)
                        rows = []
                if rows:
                    yield _table(rows, schema)

    kind = spark.createDataFrame([], f"id {id_type}").schema
    from pyspark.sql.pandas.types import to_arrow_type
    schema = pa.schema([("doc_id", to_arrow_type(kind[0].dataType)), ("start", pa.int64()),
                        ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    before = F.sum("n_tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    placed = shards.withColumn("first", F.coalesce(before, F.lit(0)))
    n = max(1, shards.count())
    return map_batches(placed.select("shard", "base", "first").repartition(n, "shard"), run,
                       f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def id_kind(docs: DataFrame, id_col: str = "doc_id") -> str:
    return kind_of(docs, id_col)
