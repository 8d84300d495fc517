"""Ranked lexical search over bit-sliced Bloom signatures (operator 13).

*Index.* Documents with alike numbers of distinct terms share a block, and a block
keeps one Bloom signature per document, turned over: slice b is the bitmap of
the block's documents whose signature has bit b. A term enters a signature once
for every level j with 2**j <= its occurrences, so the bitmaps also tell how often
a term may occur at most. A signature has at least BITS_PER_KEY bits a key.

*Bounds.* The bitmaps of a query term are the ANDs of its slices; they show every
document that has the term (that often), and a few others. A document's bound is
the sum, over the item's terms, of the weight times the score at the highest
count that its levels allow: never less than the score.

*Search.* (1) One pass over the slices takes, per item, the RESCORED documents of
highest bound; their exact scores give a threshold: the k-th best document scores
that much at least. (2) A second pass computes the bounds again and rescores
exactly, from the whole texts, every document whose bound reaches the threshold of
some item. All others are provably excluded, so the result is that of scoring
every document.

Queries are taken in blocks of about ITEMS items; only a block's terms, weights
and thresholds go to the tasks. Tasks keep the k best of what they see per item
(ties by id), so copies of a document cost no more than others.

Terms are maximal runs of ASCII letters (A-Z lower-cased) and digits and of
characters beyond ASCII; the formula is in :func:`part` and :func:`weight`.
Defined results: null texts and texts without a term match nothing; equal rows of
the queries are one item, rows of one id with different texts are items of their
own; every row of the documents is a document, also rows that repeat; ties go by
ascending id, null last; an item that no document matches has no rows; empty
tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_stage, kind_of, map_batches, stage, text_of, to_bytes

# What is part of a term, as a table for bytes.translate.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
                   for c in range(256))

BITS_PER_KEY = 10
HASHES = 3
BLOCK_DOCS, BLOCK_CHARS, BLOCK_CELLS = 512, 1 << 19, 1 << 23
ITEMS = 256
RESCORED = 32
CELLS = 1 << 22  # cells of a table that is summed at a time


def terms_of(text: str | None) -> list[bytes]:
    return to_bytes(text).translate(TERM_BYTES).split()


def part(tf, m):
    """What a term with weight 1 adds to the score."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def length_factor(n, n_docs: int, n_terms: int):
    return 10 + (90 * n * n_docs) // n_terms


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def hashes(terms: Iterable[bytes], count: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, terms), np.uint64, count)


def bits_of(h: np.ndarray, level: int, n_bits: int) -> np.ndarray:
    """The HASHES bits of each term at a level: one row per term."""
    x = (h + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    low, high = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
    steps = np.arange(HASHES, dtype=np.uint64)
    return ((low[:, None] + steps * high[:, None]) % np.uint64(n_bits)).astype(np.int64)


def signature_bits(n_keys: int) -> tuple[int, int]:
    """Size class of a document with so many (term, level) keys, and its signature's bits."""
    c = max(0, math.ceil(2 * math.log2(max(1, n_keys) * BITS_PER_KEY / 64)))
    return c, math.ceil(64 * 2 ** (c / 2))


class _Block:
    """Documents of one size class, gathered until the block is full."""

    def __init__(self, n_bits: int):
        self.n_bits, self.levels, self.chars = n_bits, 1, 0
        self.ids, self.lengths, self.texts, self.places = [], [], [], []

    def add(self, doc_id, text: str, counts: Counter) -> None:
        tf = np.fromiter(counts.values(), np.int64, len(counts))
        h = hashes(counts.keys(), len(counts))
        places, level = [], 0
        while len(h):
            places.append(bits_of(h, level, self.n_bits).ravel())
            level += 1
            often = tf >= 1 << level
            h, tf = h[often], tf[often]
        self.levels = max(self.levels, level)
        self.ids.append(doc_id)
        self.lengths.append(counts.total())
        self.texts.append(text)
        self.places.append(np.concatenate(places))
        self.chars += len(text)

    def full(self) -> bool:
        n = len(self.ids)
        return n >= BLOCK_DOCS or self.chars >= BLOCK_CHARS or n * self.n_bits >= BLOCK_CELLS

    def row(self, number: int) -> dict:
        cells = np.zeros((self.n_bits, len(self.ids)), np.uint8)
        for column, places in enumerate(self.places):
            cells[places, column] = 1
        return {"block": number, "n_bits": self.n_bits, "levels": self.levels, "ids": self.ids, "lengths": self.lengths,
                "slices": np.packbits(cells, axis=1).tobytes(), "texts": self.texts}


def signature_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per block: block, n_bits, levels, ids, lengths (terms with repeats),
    slices (n_bits bitmaps) and texts. Documents without a term are left out."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = kind_of(rows, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        open_blocks: dict[int, _Block] = {}
        schema = None

        def made(block: _Block) -> pa.RecordBatch:
            nonlocal number
            number += 1
            return pa.RecordBatch.from_pylist([block.row(number)], schema=schema)

        for b in batches:
            schema = schema or pa.schema([
                ("block", pa.int64()), ("n_bits", pa.int64()), ("levels", pa.int32()),
                ("ids", pa.list_(b.schema.field(0).type)), ("lengths", pa.list_(pa.int64())),
                ("slices", pa.binary()), ("texts", pa.list_(pa.string()))])
            for doc_id, text in zip(b.column(0), b.column(1)):
                text = text.as_py()
                counts = Counter(terms_of(text))
                if not counts:
                    continue
                keys = sum(tf.bit_length() for tf in counts.values())
                c, n_bits = signature_bits(keys)
                block = open_blocks.setdefault(c, _Block(n_bits))
                block.add(doc_id.as_py(), text, counts)
                if block.full():
                    yield made(open_blocks.pop(c))
        for block in open_blocks.values():
            yield made(block)

    return map_batches(rows, run, f"block long, n_bits long, levels int, ids array<{kind}>, lengths array<long>, "
                                  "slices binary, texts array<string>")


@dataclass
class Queries:
    """A block of items: their distinct terms, and for each item the places of its terms."""

    ids: list
    terms: list[bytes]
    item_terms: np.ndarray  # places in terms, item by item
    starts: np.ndarray  # where an item begins there; one more at the end
    weights: np.ndarray | None = None
    n_docs: int = 0
    n_terms: int = 0
    least: np.ndarray | None = None  # a document below that is not among an item's best

    @classmethod
    def of(cls, items: list[tuple[object, list[bytes]]]) -> "Queries":
        terms = sorted({t for _, ts in items for t in ts})
        place = {t: i for i, t in enumerate(terms)}
        flat = [place[t] for _, ts in items for t in ts]
        return cls([i for i, _ in items], terms, np.array(flat, np.int64),
                   np.cumsum([0, *(len(ts) for _, ts in items)]))

    def sums(self, values: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Weighted sums per item (rows) and document (columns). ``values`` has a
        row for each of the terms at ``places``; other terms count nothing."""
        at = np.full(len(self.terms), -1)
        at[places] = np.arange(len(places))
        values = values * self.weights[places][:, None]
        out = np.zeros((len(self.ids), values.shape[1]), np.int64)
        found = at[self.item_terms]
        before = np.append(0, np.cumsum(found >= 0))[self.starts]
        rows = found[found >= 0]
        step = max(1, CELLS // max(1, values.shape[1]))
        lo = 0
        while lo < len(self.ids):  # as many items at a time as the cells allow, one at least
            hi = max(lo + 1, int(np.searchsorted(before, before[lo] + step, "right")) - 1)
            some = np.nonzero(before[lo + 1:hi + 1] > before[lo:hi])[0]
            if len(some):
                table = values[rows[before[lo]:before[hi]]]
                out[lo + some] = np.add.reduceat(table, before[lo + some] - before[lo], axis=0)
            lo = hi
        return out

    def bounds(self, block: dict, term_hashes: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores of a block's documents: items x documents."""
        lengths = np.array(block["lengths"], np.int64)
        m = length_factor(lengths, self.n_docs, self.n_terms)
        n_bits, width = block["n_bits"], (len(lengths) + 7) // 8
        slices = np.frombuffer(block["slices"], np.uint8).reshape(n_bits, width)
        values, at, maps, below = None, np.arange(len(self.terms)), None, np.zeros(len(lengths), np.int64)
        first = at
        for level in range(block["levels"]):
            own = bits_of(term_hashes[at], level, n_bits)
            found = slices[own[:, 0]]
            for k in range(1, HASHES):
                found &= slices[own[:, k]]
            if maps is not None:
                found &= maps  # who has a term 2**j times has it half as often
            alive = found.any(axis=1)
            at, maps = at[alive], found[alive]
            if values is None:
                first, values = at, np.zeros((len(at), len(lengths)), np.int64)
            if not len(at):
                break
            highest = part(np.minimum((2 << level) - 1, lengths), m)
            rows = np.searchsorted(first, at)
            values[rows] += np.unpackbits(maps, axis=1, count=len(lengths)) * (highest - below)
            below = highest
        return self.sums(values, first)

    def scores(self, texts: list[str], lengths: np.ndarray) -> np.ndarray:
        """Exact scores of whole texts: items x texts."""
        place = self._places()
        at, column, tf = [], [], []
        for i, text in enumerate(texts):
            counts = Counter(terms_of(text))
            for t in counts.keys() & place.keys():
                at.append(place[t])
                column.append(i)
                tf.append(counts[t])
        at, column, tf = (np.array(x, np.int64) for x in (at, column, tf))
        used = np.unique(at)
        values = np.zeros((len(used), len(texts)), np.int64)
        m = length_factor(lengths, self.n_docs, self.n_terms)
        values[np.searchsorted(used, at), column] = part(tf, m[column])
        return self.sums(values, used)

    def _places(self) -> dict[bytes, int]:
        if "_place" not in self.__dict__:
            self._place = {t: i for i, t in enumerate(self.terms)}
        return self._place


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def _query_blocks(queries: DataFrame, id_col: str, text_col: str, items: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Items with their distinct terms, in blocks of about ``items`` items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(set(terms_of(t.as_py()))) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.binary())), b.column(2)],
                                             ["id", "terms", "dealt"])

    rows = queries.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).distinct()
    rows = rows.withColumn("dealt", F.xxhash64("id", "text"))
    kind = kind_of(rows, "id")
    found = stage(map_batches(rows, run, f"id {kind}, terms array<binary>, dealt long").where("size(terms) > 0"),
                  "search-items")
    n = max(1, math.ceil(found.count() / items))
    for k in range(n):
        got = found.where(F.pmod("dealt", F.lit(n)) == k).orderBy("id", "dealt").collect()  # about ``items`` rows
        if got:
            yield [(r.id, [bytes(t) for t in r.terms]) for r in got]


def _document_counts(index: DataFrame, q: Queries) -> dict[bytes, int]:
    """Documents that hold each term of the items."""
    terms = frozenset(q.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for block in _blocks(batches):
            for text in block["texts"]:
                seen.update(terms.intersection(terms_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())],
                                         ["term", "df"])

    found = map_batches(index.select("texts"), run, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {bytes(r.term): r.df for r in found.collect()}  # the terms of one block of items


def _highest_bounds(index: DataFrame, q: Queries, rescored: int) -> DataFrame:
    """The documents of highest bound per item: block, picks (array of item and column)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = hashes(q.terms, len(q.terms))
        best = np.zeros((len(q.ids), 0), np.int64)
        where = np.zeros((2, len(q.ids), 0), np.int64)
        for block in _blocks(batches):
            bound = q.bounds(block, h)
            best = np.concatenate([best, bound], axis=1)
            own = np.stack([np.full(bound.shape, block["block"]), np.broadcast_to(np.arange(bound.shape[1]), bound.shape)])
            where = np.concatenate([where, own], axis=2)
            if best.shape[1] > rescored:
                top = np.argpartition(-best, rescored - 1, axis=1)[:, :rescored]
                best = np.take_along_axis(best, top, 1)
                where = np.take_along_axis(where, top[None], 2)
        item, place = np.nonzero(best)
        yield pa.RecordBatch.from_arrays(
            [pa.array(item), pa.array(where[0][item, place]), pa.array(where[1][item, place]), pa.array(best[item, place])],
            ["item", "block", "place", "bound"])

    rows = map_batches(index.select("block", "n_bits", "levels", "lengths", "slices"), run,
                       "item long, block long, place long, bound long")
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "block", "place")
    rows = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= rescored)
    return rows.groupBy("block").agg(F.collect_list(F.struct("item", "place")).alias("picks"))


def _thresholds(index: DataFrame, q: Queries, picked: DataFrame, k: int) -> np.ndarray:
    """For each item a score that its k-th best document reaches, 1 where fewer are known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            places = {p: i for i, p in enumerate(block["places"])}
            got = q.scores(block["texts"], np.array(block["lengths"], np.int64))
            item = [p["item"] for p in block["picks"]]
            score = got[item, [places[p["place"]] for p in block["picks"]]]
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(score)], ["item", "score"])

    # At most RESCORED picks for each of the block's items, so the side is small whatever the documents.
    both = index.select("block", "lengths", "texts").join(F.broadcast(picked), "block")
    places = F.array_distinct(F.transform("picks", lambda p: p["place"]))
    both = both.withColumn("places", places).select(
        "picks", "places",
        F.transform("places", lambda p: F.get("lengths", p.cast("int"))).alias("lengths"),
        F.transform("places", lambda p: F.get("texts", p.cast("int"))).alias("texts"))
    found: dict[int, list[int]] = {}
    for r in map_batches(both, run, "item long, score long").where("score > 0").collect():
        found.setdefault(r.item, []).append(r.score)
    return np.array([sorted(found.get(i, ()), reverse=True)[k - 1] if len(found.get(i, ())) >= k else 1
                     for i in range(len(q.ids))], np.int64)


def _order(pair: tuple) -> tuple:
    score, doc_id = pair
    return -score, doc_id is None, 0 if doc_id is None else doc_id


def _rescored(index: DataFrame, q: Queries, k: int) -> DataFrame:
    """Exact scores of all documents that are not provably excluded, the k best
    per item and task: item, doc_id, score."""
    kind = index.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = hashes(q.terms, len(q.terms))
        least = q.least.copy()
        best: list[list[tuple]] = [[] for _ in q.ids]
        id_type = None
        for b in batches:
            id_type = b.schema.field("ids").type.value_type
            for block in _blocks([b]):
                open_pairs = q.bounds(block, h) >= least[:, None]
                columns = np.nonzero(open_pairs.any(axis=0))[0]
                if not len(columns):
                    continue
                lengths = np.array(block["lengths"], np.int64)[columns]
                got = q.scores([block["texts"][c] for c in columns], lengths)
                good = open_pairs[:, columns] & (got >= least[:, None])
                for item in np.nonzero(good.any(axis=1))[0].tolist():
                    own = np.nonzero(good[item])[0].tolist()
                    pairs = [(int(got[item, c]), block["ids"][columns[c]]) for c in own]
                    best[item] = sorted(best[item] + pairs, key=_order)[:k]
                    if len(best[item]) == k:
                        least[item] = max(least[item], best[item][-1][0])
        if id_type is not None:
            flat = [(i, d, s) for i, pairs in enumerate(best) for s, d in pairs]
            item, ids, score = zip(*flat) if flat else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.int64()), pa.array(ids, id_type), pa.array(score, pa.int64())],
                ["item", "doc_id", "score"])

    return map_batches(index.drop("block"), run, f"item long, doc_id {kind}, score long")


def _ranked(index: DataFrame, q: Queries, k: int, rescored: int, item_kind: str) -> DataFrame:
    spark = index.sparkSession
    counts = index.select(F.explode("lengths").alias("n")).agg(F.count("n"), F.sum("n")).first()
    df = _document_counts(index, q)
    q = replace(q, n_docs=counts[0], n_terms=counts[1],
                weights=np.array([weight(df.get(t, 0), counts[0]) for t in q.terms], np.int64))
    q = replace(q, least=_thresholds(index, q, _highest_bounds(index, q, max(k, rescored)), k))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = _rescored(index, q, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(q.ids)), f"item long, item_id {item_kind}")
    return top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", query_col: str = "text", items: int = ITEMS, rescored: int = RESCORED) -> DataFrame:
    """The k best documents of each item with a score above 0: item_id, rank (int), doc_id, score."""
    spark: SparkSession = docs.sparkSession
    index = stage(signature_index(docs, id_col, text_col), "search-index")
    item_kind = kind_of(queries, item_col)
    schema = f"item_id {item_kind}, rank int, doc_id {kind_of(docs, id_col)}, score long"
    out = spark.createDataFrame([], schema)
    if not index.isEmpty():
        for items_of_block in _query_blocks(queries, item_col, query_col, items):
            found = _ranked(index, Queries.of(items_of_block), k, rescored, item_kind)
            out = out.union(stage(found, "search-found"))
        drop_stage(index)
    return out
