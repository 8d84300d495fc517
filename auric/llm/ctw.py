"""Language-model scores by context-tree weighting (operator 8).

A text is its bytes (A-Z lower-cased) and an end byte. Every byte is eight
binary choices, a path in the tree of bit prefixes; each prefix has a context
tree over the bytes before it, of every depth from 0 to ``depth``. A node with
a zeros and b ones has the Krichevsky-Trofimov probability

    Pe = Gamma(a + 1/2) Gamma(b + 1/2) / (pi Gamma(a + b + 1))

and the weighted one, Pw = Pe at full depth, else (Pe + product of Pw of its
children) / 2. Pe / (2 Pw) is then the weight of the node itself against all
deeper trees, and the probability of the next bit is the mixture of
(b + 1/2) / (a + b + 1) along the path of the context. The score of a text is
log10 of its probability under the tree learned from all training documents;
code length per byte in bits is -score * log2(10) / (bytes + 1).

How it scales:

* A string is a byte and its ``depth`` context bytes, as an integer with the
  nearest byte on top, so all strings below a node lie together when sorted.
* Documents go to blocks of about ``block_bytes`` by hash. A block counts its
  distinct strings and words, ``CHUNK`` bytes of text at a time (longer texts are cut);
  they go, packed in compressed arrays, to parts by a hash of the ``SPLIT`` nearest
  context bytes (of the word).
* A part has the whole tree below its contexts. It sums the blocks' counts and
  passes over them a slice at a time (slices end between contexts): bottom-up for
  Pw, which leaves sums per node of depth SPLIT - 1. These are bounded by the
  contexts of two bytes, 256**2 * 255 nodes, whatever the corpus; the few levels
  above are done at once and handed to all tasks.
* Each part then mixes top-down and hands every block its own strings with their
  values (36 bits of fraction); the block scores its documents. So a task holds a
  block's text and what occurs in it, or a part, whatever the size of the model.
  Strings that only held-out documents have take part with count 0, which changes
  no probability and gives their place in the tree.

Words are told apart by 64-bit hashes. ``base_score`` is the add-one unigram
model over words and one end token per text.

Defined results: null text is empty (an end only); a null id counts as the
empty string in the split (training); repeated rows are documents of their
own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import drop_stage, kind_of, stage, text_of, to_bytes

FOLDS, HELD = 7, 2  # fixed values of the split
CHUNK, CHUNK_TEXTS = 1 << 19, 256  # bytes and texts handled at a time
HELD_KEYS = 1 << 18  # counted keys that are held before they are summed
SLICE = 1 << 16  # strings of a part handled at a time
ROWS_OUT = 16  # blocks that a part answers at a time
SPLIT = 3
END = 0
LOG2, LOG_PI = math.log(2), math.log(math.pi)


# -- a block ------------------------------------------------------------------

def pieces(texts: Iterable[bytes], depth: int) -> Iterator[tuple[int, bytes]]:
    """Numbers of the texts and their bytes and end, cut to CHUNK of them, after the
    ``depth`` bytes before."""
    for i, t in enumerate(texts):
        t = bytes(depth) + t + bytes([END])
        for lo in range(0, len(t) - depth, CHUNK):
            yield i, t[lo:lo + CHUNK + depth]


def chunks(numbered: Iterable[tuple[int, bytes]]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Runs of texts or pieces of about CHUNK bytes, at most CHUNK_TEXTS, and their numbers."""
    numbers, now, size = [], [], 0
    for i, t in numbered:
        numbers.append(i)
        now.append(t)
        size += len(t)
        if size >= CHUNK or len(now) == CHUNK_TEXTS:
            yield numbers, now
            numbers, now, size = [], [], 0
    if now:
        yield numbers, now


def symbols(parts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Strings at every byte and end of the pieces: context bytes, nearest on top,
    then the byte; and the number of them in each piece."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(t) - depth for t in parts], np.int64)
    n = len(data) - depth
    key = data[depth:].astype(np.uint64)
    for d in range(1, depth + 1):
        before = data[depth - d:n + depth - d].astype(np.uint64)
        before <<= np.uint64(8 * (depth + 1 - d))
        key |= before
    # Positions that belong to a piece, not to the next one's context.
    inside = np.ones(n, bool)
    ends = np.cumsum(sizes + depth)[:-1]
    inside[(ends[:, None] - depth + np.arange(depth)).ravel()] = False
    return key[inside], sizes


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])) if len(sorted_keys) else np.zeros(0, np.int64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    order = np.argsort(keys)
    keys = keys[order]
    first = _runs(keys)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


class Tally:
    """Sums the counts of keys that come in any order; holds the distinct ones and up to
    a quarter as many (HELD_KEYS at least) still to be added."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.new, self.n_new = [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.new.append((keys, counts))
        self.n_new += len(keys)
        if self.n_new >= max(HELD_KEYS, len(self.keys) // 4):
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys in order and the sums of their counts."""
        if self.new:
            keys, counts = summed(*map(np.concatenate, zip(*self.new)))
            self.new, self.n_new = [], 0
            at = np.searchsorted(self.keys, keys)
            known = at < len(self.keys)
            known[known] = self.keys[at[known]] == keys[known]
            self.counts[at[known]] += counts[known]
            at = at[~known]
            self.keys = np.insert(self.keys, at, keys[~known])
            self.counts = np.insert(self.counts, at, counts[~known])
        return self.keys, self.counts


def count_strings(texts: Iterable[bytes], training: list[bool], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct strings, sorted, and how often training texts have them."""
    tally = Tally()
    for own, part in chunks(pieces(texts, depth)):
        key, sizes = symbols(part, depth)
        flag = np.repeat(np.array([training[i] for i in own], np.uint64), sizes)
        key <<= np.uint64(1)
        key |= flag
        key.sort()
        first = _runs(key)
        n = np.diff(np.append(first, len(key)))
        key = key[first]
        tally.add(key >> np.uint64(1), np.where(key & np.uint64(1), n, 0))
    return tally.total()


def word_hash(word: bytes) -> int:
    """64-bit name of a word; the end token is the empty word."""
    return xxhash.xxh3_64_intdigest(word)


class _Index(dict):
    """Numbers words in the order they are first met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def word_numbers(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words (and the end), the number of every token of the
    texts, and the number of tokens in each text."""
    index, parts, sizes = _Index(), [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        words = t.split()
        words.append(b"")
        sizes[i] = len(words)
        parts.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
    return np.fromiter(map(word_hash, index), np.uint64, len(index)), np.concatenate(parts), sizes


def count_words(texts: Iterable[bytes], training: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct words and the end, sorted, and how often training texts have them."""
    tally = Tally()
    for own, part in chunks(enumerate(texts)):
        words, numbers, sizes = word_numbers(part)
        flag = np.repeat(np.array([training[i] for i in own]), sizes)
        tally.add(words, np.bincount(numbers[flag], minlength=len(words)))
    return tally.total()


def part_of(keys: np.ndarray, n_parts: int) -> np.ndarray:
    x = (keys + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ x >> np.uint64(32)) % np.uint64(n_parts)).astype(np.int64)


def string_part(keys: np.ndarray, depth: int, n_parts: int) -> np.ndarray:
    """Strings with the same SPLIT nearest context bytes share a part."""
    return part_of(keys >> np.uint64(8 * (depth + 1 - min(SPLIT, depth))), n_parts)


def by_part(of: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Parts in order, and the places of their keys, which stay in order."""
    order = np.argsort(of, kind="stable")
    first = _runs(of[order])
    return list(zip(of[order[first]].tolist(), np.split(order, first[1:]) if len(first) else []))


CODEC = pa.Codec("zstd", compression_level=1)


def pack(a: np.ndarray, delta: bool = False) -> bytes:
    """An array as compressed byte planes, of the differences if it is sorted."""
    a = np.diff(a, prepend=a.dtype.type(0)) if delta else a
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T)
    return len(a).to_bytes(8, "little") + CODEC.compress(planes.tobytes(), asbytes=True)


def shortened(x: np.ndarray) -> np.ndarray:
    """Doubles rounded to 36 bits of fraction (1e-11 of their size), which pack into six bytes."""
    return ((x.view(np.uint64) + np.uint64(1 << 15)) >> np.uint64(16) << np.uint64(16)).view(np.float64)


def unpack(data: bytes, dtype: str, delta: bool = False) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(dtype).itemsize
    planes = CODEC.decompress(data[8:], n * size, asbytes=True)
    a = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, n).T).view(dtype).ravel()
    return np.cumsum(a, dtype=dtype) if delta else a


# -- a part -------------------------------------------------------------------

_N = np.arange(1, 1 << 16)
LGAMMA_HALF = np.append(0.0, np.cumsum(np.log(_N - 0.5))) + 0.5 * LOG_PI  # log Gamma(k + 1/2)
LGAMMA_ONE = np.append(0.0, np.cumsum(np.log(_N)))  # log Gamma(k + 1)


def _lgamma(k: np.ndarray, plus: float, table: np.ndarray) -> np.ndarray:
    """log Gamma(k + plus) of whole numbers; Stirling's series beyond the table."""
    small = k < len(table)
    out = table[np.where(small, k, 0)]
    if not small.all():
        z = k[~small] + plus
        out[~small] = (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3)
    return out


def _estimate(a: np.ndarray, b: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts and the children's sum of log Pw (none at full depth) -> log Pw, own
    weight, probability of a one."""
    pe = _lgamma(a, 0.5, LGAMMA_HALF) + _lgamma(b, 0.5, LGAMMA_HALF) - _lgamma(a + b, 1.0, LGAMMA_ONE) - LOG_PI
    kt = (b + 0.5) / (a + b + 1)
    if below is None:
        return pe, np.ones(len(pe)), kt
    pw = np.logaddexp(pe, below) - LOG2
    return pw, np.exp(pe - LOG2 - pw), kt


@dataclass
class Level:
    """One depth of a slice: its distinct (context, byte) keys and, for each of the
    eight bits, the nodes as runs of these keys."""

    keys: np.ndarray
    up: np.ndarray | None  # place of each key in the level above
    first: list  # by bit: a node's first key
    run: list  # by bit: the node of a key
    a: list
    b: list
    pw: list
    own: list
    kt: list


def levels(keys: np.ndarray, counts: np.ndarray, depth: int, top: int) -> list[Level]:
    """Bottom-up over sorted strings: the levels from ``depth`` to ``top``."""
    out: list[Level] = []
    for d in range(depth, top - 1, -1):
        if d < depth:
            above = keys >> np.uint64(16) << np.uint64(8) | keys & np.uint64(255)
            keys, up = np.unique(above, return_inverse=True)
            out[-1].up = up
            counts = np.bincount(up, counts, len(keys)).astype(np.int64)
        now = Level(keys, None, [], [], [], [], [], [], [])
        for j in range(8):
            head = keys >> np.uint64(8 - j)
            starts = np.append(True, head[1:] != head[:-1])
            first, run = np.flatnonzero(starts), (np.cumsum(starts) - 1).astype(np.int32)
            bit = (keys >> np.uint64(7 - j) & np.uint64(1)).astype(bool)
            b = np.add.reduceat(np.where(bit, counts, 0), first)
            a = np.add.reduceat(counts, first) - b
            below = None
            if d < depth:
                kids = out[-1]
                below = np.bincount(run[kids.up[kids.first[j]]], kids.pw[j], len(first))
            pw, own, kt = _estimate(a, b, below)
            for name, x in (("first", first), ("run", run), ("a", a), ("b", b), ("pw", pw), ("own", own), ("kt", kt)):
                getattr(now, name).append(x)
        out.append(now)
    return out


def slices(keys: np.ndarray, depth: int) -> Iterator[slice]:
    """Slices of about SLICE strings that end between contexts of SPLIT bytes."""
    first = np.append(_runs(keys >> np.uint64(8 * (depth + 1 - min(SPLIT, depth)))), len(keys))
    lo = 0
    while lo < len(keys):
        hi = int(first[np.searchsorted(first, min(lo + SLICE, len(keys)))])
        yield slice(lo, hi)
        lo = hi


def _prefix(keys: np.ndarray, j: int) -> np.ndarray:
    """Bit prefix (1 to 255) of the last byte before its bit j."""
    return (keys & np.uint64(255) | np.uint64(256)) >> np.uint64(8 - j)


def top_nodes(keys: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """Sums per node one level above the part's: node (context and bit prefix), zeros, ones, log Pw below."""
    top = min(SPLIT, depth)
    parts = [[np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
    for s in slices(keys, depth) if top else ():
        level = levels(keys[s], counts[s], depth, top)[-1]
        for j in range(8):
            at = level.keys[level.first[j]]
            parts[0].append(at >> np.uint64(16) << np.uint64(8) | _prefix(at, j))
            for k, x in enumerate((level.a[j], level.b[j], level.pw[j]), 1):
                parts[k].append(x)
    node, a, b, pw = map(np.concatenate, parts)
    nodes, at = np.unique(node, return_inverse=True)
    return (nodes, *(np.bincount(at, x, len(nodes)) for x in (a, b, pw)))


@dataclass
class Upper:
    """The levels above the parts: for the nodes of the lowest of them the probability
    of a one that is sure there, and the share left to deeper trees."""

    nodes: np.ndarray
    sure: np.ndarray
    open: np.ndarray


def upper(nodes: np.ndarray, a: np.ndarray, b: np.ndarray, below: np.ndarray, n_levels: int) -> Upper:
    """From the sums per node of depth ``n_levels`` - 1."""
    stack = []
    for k in range(n_levels):
        order = np.argsort(nodes)
        nodes, a, b, below = nodes[order], a[order], b[order], below[order]
        pw, own, kt = _estimate(a.astype(np.int64), b.astype(np.int64), below)
        up, at = np.unique(nodes >> np.uint64(16) << np.uint64(8) | nodes & np.uint64(255), return_inverse=True)
        stack.append((nodes, own, kt, at))
        nodes, a, b, below = up, *(np.bincount(at, x, len(up)) for x in (a, b, pw))
    sure = opened = None
    for nodes, own, kt, at in reversed(stack):
        if sure is None:
            sure, opened = own * kt, 1 - own
        else:
            parent = last_nodes.searchsorted(nodes >> np.uint64(16) << np.uint64(8) | nodes & np.uint64(255))
            sure, opened = sure[parent] + opened[parent] * own * kt, opened[parent] * (1 - own)
        last_nodes = nodes
    return Upper(last_nodes, sure, opened)


def values(keys: np.ndarray, counts: np.ndarray, depth: int, above: Upper | None) -> np.ndarray:
    """log10 of the probability of each string's byte after its context."""
    out = np.zeros(len(keys))
    top = min(SPLIT, depth)
    for s in slices(keys, depth):
        part = levels(keys[s], counts[s], depth, top)
        full, total = part[0], np.zeros(s.stop - s.start)
        for j in range(8):
            first = full.first[j]
            p = full.kt[j]
            at = first
            for level, deeper in zip(part[1:], part):
                at = deeper.up[at]
                node = level.run[j][at]
                own = level.own[j][node]
                p = own * level.kt[j][node] + (1 - own) * p
            # p is the mixture from the highest level of the part down; now the levels above.
            if above is not None:
                at = full.keys[first]
                node = above.nodes.searchsorted(
                    at >> np.uint64(8 * (depth + 2 - top)) << np.uint64(8) | _prefix(at, j))
                p = above.sure[node] + above.open[node] * p
            bit = (full.keys >> np.uint64(7 - j) & np.uint64(1)).astype(bool)
            total += np.where(bit, np.log10(p)[full.run[j]], np.log10(1 - p)[full.run[j]])
        out[s] = total
    return out


# -- the job ------------------------------------------------------------------

def _texts_of(t: pa.Table) -> Iterator[bytes]:
    """The texts one after the other, so that no second copy of a block is held."""
    return (to_bytes(x.as_py()).lower() for x in t.column("text"))


def _training(t: pa.Table) -> list[bool]:
    return [not h for h in t.column("held").to_pylist()]


def ctw_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 6,
               block_bytes: int = 1 << 24) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens,
    base_score, score, n_bytes, bits_per_byte (of bytes and end). ``depth`` is 6 at
    most: a string and a flag fit 64 bits."""
    spark = docs.sparkSession
    ship_package(spark)
    size = docs.agg(F.sum(F.octet_length(text_of(text_col)))).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    fold = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(FOLDS))
    rows = docs.select(
        F.col(id_col).alias("id"), text_of(text_col).alias("text"), (fold == HELD).alias("held"),
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(n_blocks)).cast("int").alias("block"))
    packed = ("strings", "counts", "words", "word_counts")

    def count(t: pa.Table) -> pa.Table:
        strings, n = count_strings(_texts_of(t), _training(t), depth)
        words, m = count_words(_texts_of(t), _training(t))
        places = dict(by_part(string_part(strings, depth, n_blocks)))
        word_places = dict(by_part(part_of(words, n_blocks)))
        none = np.zeros(0, np.int64)
        out = {c: [] for c in ("part", *packed)}
        for p in sorted(places.keys() | word_places.keys()):
            at, word_at = places.get(p, none), word_places.get(p, none)
            for c, x in zip(out, (p, pack(strings[at], True), pack(n[at]), pack(words[word_at], True), pack(m[word_at]))):
                out[c].append(x)
        return pa.table({"block": pa.array([t.column("block")[0].as_py()] * len(out["part"]), pa.int32()),
                         "part": pa.array(out["part"], pa.int32()),
                         **{c: pa.array(out[c], pa.binary()) for c in packed}})

    seen = stage(rows.groupBy("block").applyInArrow(
        count, "block int, part int, " + ", ".join(f"{c} binary" for c in packed)), "ctw-counts")

    def merged(t: pa.Table, what: str, n: str) -> tuple[np.ndarray, np.ndarray]:
        tally = Tally()
        for x, y in zip(t.column(what), t.column(n)):
            tally.add(unpack(x.as_py(), "<u8", True), unpack(y.as_py(), "<i8"))
        return tally.total()

    def sums(t: pa.Table) -> pa.Table:
        _, m = merged(t, "words", "word_counts")
        node, a, b, below = top_nodes(*merged(t, "strings", "counts"), depth)
        kind = pa.list_(pa.struct([("node", pa.int64()), ("a", pa.float64()), ("b", pa.float64()), ("below", pa.float64())]))
        cells = pa.StructArray.from_arrays([pa.array(node.view(np.int64)), pa.array(a), pa.array(b), pa.array(below)],
                                           ["node", "a", "b", "below"])
        return pa.table({"tokens": pa.array([int(m.sum())]), "distinct": pa.array([int((m > 0).sum())]),
                         "nodes": pa.ListArray.from_arrays(pa.array([0, len(node)], pa.int32()), cells).cast(kind)})

    parts = stage(seen.groupBy("part").applyInArrow(
        sums, "tokens long, distinct long, nodes array<struct<node:long,a:double,b:double,below:double>>"), "ctw-parts")
    n_train, n_distinct = parts.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    # Nodes of contexts of two bytes: bounded whatever the corpus.
    nodes = parts.select(F.explode("nodes").alias("n")).select("n.*").groupBy("node").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("below").alias("below")).toPandas()
    above = None
    if min(SPLIT, depth) and len(nodes):
        above = upper(nodes.node.to_numpy().view(np.uint64), *(nodes[c].to_numpy() for c in ("a", "b", "below")),
                      min(SPLIT, depth))
    shared = spark.sparkContext.broadcast(above)

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        strings, n = merged(t, "strings", "counts")
        words, m = merged(t, "words", "word_counts")
        v = shortened(values(strings, n, depth, shared.value))
        for r in t.select(["block", "part", "strings", "words"]).to_batches(max_chunksize=ROWS_OUT):
            own, known = [], []
            for x, w in zip(r.column("strings"), r.column("words")):
                own.append(pack(v[np.searchsorted(strings, unpack(x.as_py(), "<u8", True))]))
                known.append(pack(m[np.searchsorted(words, unpack(w.as_py(), "<u8", True))]))
            yield pa.RecordBatch.from_arrays(
                [r.column("block"), r.column("part"), r.column("strings"), pa.array(own, pa.binary()), pa.array(known, pa.binary())],
                ["block", "part", "strings", "values", "word_counts"])

    back = stage(seen.groupBy("part").applyInArrow(
        value, "block int, part int, strings binary, values binary, word_counts binary"), "ctw-values")
    drop_stage(parts)
    drop_stage(seen)
    under = math.log10(n_train + n_distinct + 1)

    def score(t: pa.Table, model: pa.Table) -> pa.Table:
        strings, v = (np.concatenate([unpack(x.as_py(), kind, kind == "<u8") for x in model.column(c)])
                      for c, kind in (("strings", "<u8"), ("values", "<f8")))
        order = np.argsort(strings)
        strings, v = strings[order], v[order]
        del order
        total, n_bytes = np.zeros(t.num_rows), np.full(t.num_rows, -1)
        for own, part in chunks(pieces(_texts_of(t), depth)):
            key, sizes = symbols(part, depth)
            at, own = slice(own[0], own[-1] + 1), np.array(own) - own[0]
            n_bytes[at] += np.bincount(own, sizes).astype(np.int64)
            # A string and the number of its piece in the chunk fit 64 bits; sorted, equal strings are one look-up.
            key <<= np.uint64(8)
            key |= np.repeat(np.arange(len(part), dtype=np.uint64), sizes)
            key.sort()
            owner = (key & np.uint64(255)).astype(np.int64)
            key >>= np.uint64(8)
            first = _runs(key)
            found = np.repeat(v[np.searchsorted(strings, key[first])], np.diff(np.append(first, len(key))))
            total[at] += np.bincount(own[owner], found)
        del strings, v

        tokens = [word_numbers(part) for _, part in chunks(enumerate(_texts_of(t)))]
        words = np.unique(np.concatenate([x for x, _, _ in tokens]))
        counts, places = np.zeros(len(words), np.int64), dict(by_part(part_of(words, n_blocks)))
        for p, m in zip(model.column("part").to_pylist(), model.column("word_counts")):
            if p in places:
                counts[places[p]] = unpack(m.as_py(), "<i8")
        n_tokens, n_known, base = [], [], []
        for x, numbers, sizes in tokens:
            own = counts[np.searchsorted(words, x)]
            first = np.cumsum(sizes) - sizes
            n_tokens.append(sizes)
            n_known.append(np.add.reduceat((own > 0)[numbers], first, dtype=np.int64))
            base.append(np.add.reduceat((np.log10(own + 1) - under)[numbers], first))
        n_tokens, n_known, base = map(np.concatenate, (n_tokens, n_known, base))
        return pa.table({
            "id": t.column("id"), "held_out": t.column("held"), "n_tokens": pa.array(n_tokens),
            "n_known": pa.array(n_known), "train_tokens": pa.array(np.full(t.num_rows, n_train), pa.int64()),
            "base_score": pa.array(base), "score": pa.array(total), "n_bytes": pa.array(n_bytes),
            "bits_per_byte": pa.array(-total * math.log2(10) / (n_bytes + 1))})

    out = rows.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(
        score, f"id {kind_of(rows, 'id')}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
               "base_score double, score double, n_bytes long, bits_per_byte double")
    return out.withColumnRenamed("id", id_col)
