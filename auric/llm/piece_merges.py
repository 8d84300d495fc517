"""SentencePiece encoding and decoding for merge-type vocabularies (operator 11).

*Agenda.* A text is normalised (spaces become ``▁``, one ``▁`` goes in front),
cut into characters, and every adjacent pair whose concatenation is a piece goes
on an agenda ordered by (score, highest first; place, leftmost first). The best
pair is merged, and the pairs with its two new neighbours enter the agenda. Short
segments keep the agenda as a list in text order, whose first least rank is the
best pair; long ones keep a heap, whose stale entries are skipped. What is left
maps to ids; a symbol that is no piece becomes its UTF-8 bytes' pieces, or, in a
vocabulary without those, one unknown id per run of such symbols.

*Cuts.* When no piece holds a ``▁`` after another character (checked when the
vocabulary is read), no merge crosses the place before such a ``▁``. The agenda
then runs on each segment alone, and a bounded table remembers the ids of short
segments (the older half is dropped when it is full). In other vocabularies it
runs on whole texts.

*Check.* With ``check=True`` the sentencepiece library encodes and decodes, Arrow
batch by Arrow batch, every segment that is not in the table (every text, where
texts are not cut); a column tells of each text whether all agree. :func:`decode`
checks every text's ids.

Vocabularies of this kind normalise by the identity with a leading ``▁``;
others are refused. Defined results: null is the empty text, which has no ids
and decodes to the empty text; a literal ``▁`` is a space and comes back as one;
repeated rows and ids give equal rows; ids of any type, null too, are carried; an
empty table gives an empty result; other columns are not read. A null array of
ids decodes to the empty text; bytes that are no UTF-8 decode to U+FFFD each.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kind_of, map_batches, text_of

# Fixed value: the character that stands for a space.
SPACE = "▁"
UNKNOWN_TEXT = " ⁇ "
IDS = np.dtype("<i4")
TEXTS = 256  # texts encoded or checked at a time
REMEMBERED = 64  # longest segment that the table keeps, in characters
SHORT = 48  # symbols of a segment whose agenda is a list
GONE = -2


class _Segments(dict):
    """Segment (without its first ``▁``) -> ids as bytes. Full, it starts anew beside the
    older half; ``met`` lists the segments encoded since it was cleared."""

    def __init__(self, vocab: "Vocabulary", rows: int):
        super().__init__()
        self.vocab, self.half, self.old, self.met = vocab, max(1, rows // 2), {}, []

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = np.array(self.vocab.segment_ids(SPACE + word), IDS).tobytes()
            self.met.append(word)
        if len(word) < REMEMBERED:
            if len(self) >= self.half:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Vocabulary:
    """A merge-type model file with its table of segments."""

    def __init__(self, path: str, table_rows: int = 1_600_000):
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        if lib.normalize(" a  ﬁ Å\t\n") != f"{SPACE}{SPACE}a{SPACE}{SPACE}ﬁ{SPACE}Å\t\n":
            raise ValueError("the vocabulary does not normalise by the identity with a leading space")
        n = lib.vocab_size()
        self.names = [lib.id_to_piece(i) for i in range(n)]
        self.unknown = lib.unk_id()
        plain = [i for i in range(n) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i))]
        self.bytes = {int(self.names[i][3:5], 16): i for i in range(n) if lib.is_byte(i)}
        self.separable = not any(re.search(f"[^{SPACE}]{SPACE}", self.names[i]) for i in plain)
        # Symbols by number: pieces have their ids; characters that only occur inside pieces come after them.
        self.symbol = {self.names[i]: i for i in plain}
        for c in sorted({c for i in plain for c in self.names[i]} - self.symbol.keys()):
            self.symbol[c] = n + len(self.symbol)
        self.base = max(self.symbol.values(), default=0) + 2  # so that a pair with no symbol (-1) is no key
        # Pairs of symbols that make a piece: left * base + right -> rank of its score, and its id.
        rank = {s: r for r, s in enumerate(sorted({-lib.get_score(i) for i in plain}))}
        self.none = len(rank)
        self.rank: dict[int, int] = {}
        self.made: dict[int, int] = {}
        for i in plain:
            name = self.names[i]
            for cut in range(1, len(name)):
                left, right = self.symbol.get(name[:cut]), self.symbol.get(name[cut:])
                if left is not None and right is not None:
                    pair = left * self.base + right
                    self.rank[pair], self.made[pair] = rank[-lib.get_score(i)], i
        self.pieces = set(plain)
        self.table = _Segments(self, table_rows)
        surfaces = [b""] * n
        for i in plain:
            surfaces[i] = self.names[i].replace(SPACE, " ").encode()
        for b, i in self.bytes.items():
            surfaces[i] = bytes([b])
        surfaces[self.unknown] = UNKNOWN_TEXT.encode()
        self.surfaces = surfaces
        self.control = {i for i in range(n) if lib.is_control(i)}
        self.byte_ids = {i: b for b, i in self.bytes.items()}

    # -- encoding ------------------------------------------------------------

    def merged(self, text: str) -> list[int]:
        """The symbols that the agenda leaves of a normalised text; -1 for a character that no piece has."""
        symbols = [self.symbol.get(c, -1) for c in text]
        return self._merge_short(symbols) if len(symbols) <= SHORT else self._merge_long(symbols)

    def _merge_short(self, symbols: list[int]) -> list[int]:
        rank, made_of, base, none = self.rank, self.made, self.base, self.none
        agenda = [rank.get(a * base + b, none) for a, b in zip(symbols, symbols[1:])]
        while agenda:
            best = min(agenda)
            if best == none:
                break
            at = agenda.index(best)
            made = made_of[symbols[at] * base + symbols[at + 1]]
            symbols[at:at + 2] = [made]
            del agenda[at]
            if at < len(agenda):
                agenda[at] = rank.get(made * base + symbols[at + 1], none)
            if at:
                agenda[at - 1] = rank.get(symbols[at - 1] * base + made, none)
        return symbols

    def _merge_long(self, symbols: list[int]) -> list[int]:
        rank, base = self.rank, self.base
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[int, int, int, int]] = []

        def offer(left: int, right: int) -> None:
            pair = symbols[left] * base + symbols[right]
            if pair in rank:
                heapq.heappush(agenda, (rank[pair], left, right, pair))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, left, right, pair = heapq.heappop(agenda)
            if after[left] != right or symbols[left] * base + symbols[right] != pair:
                continue  # one of the two has been merged meanwhile
            symbols[left] = self.made[pair]
            after[left] = nxt = after[right]
            after[right] = GONE
            if nxt >= 0:
                before[nxt] = left
                offer(left, nxt)
            if before[left] >= 0:
                offer(before[left], left)
        out, at = [], 0
        while at >= 0:
            out.append(symbols[at])
            at = after[at]
        return out

    def segment_ids(self, segment: str) -> list[int]:
        left = self.merged(segment)
        if self.pieces.issuperset(left):
            return left
        out, at = [], 0
        for i in left:
            if i in self.pieces:
                out.append(i)
                at += len(self.names[i])
                continue
            out.extend([self.bytes[b] for b in segment[at].encode()] if self.bytes else [self.unknown])
            at += 1
        return out

    def disagreeing(self, words: list[str]) -> set[str]:
        """Segments (without their first ``▁``) that the library encodes or decodes otherwise. As no
        merge crosses their borders, it takes them as one text; one by one only where that differs."""
        lib = self.library

        def same(some: list[str], ids: bytes) -> bool:
            text = " ".join(some).replace(SPACE, " ")
            theirs = lib.encode(text, num_threads=1)
            return np.array(theirs, IDS).tobytes() == ids and self.decode(theirs) == lib.decode(theirs) == text

        inner = [w for w in words if w.strip(SPACE)]  # spaces alone would join the segment after them
        if not inner or same(inner, b"".join([self.table[w] for w in inner])):
            words = [w for w in words if not w.strip(SPACE)]
        return {w for w in words if not same([w], np.array(self.segment_ids(SPACE + w), IDS).tobytes())}

    def cut(self, text: str) -> list[str]:
        """Segments of a text that is not empty, each without its first ``▁``."""
        plain = text.replace(SPACE, " ")
        if "  " in plain or plain[0] == " " or plain[-1] == " ":
            # A run of spaces belongs to the segment that follows it.
            return [s[1:].replace(" ", SPACE) for s in re.findall(r" +[^ ]*", " " + plain)]
        return plain.split(" ")

    def encode_all(self, texts: list[str | None], check: bool = False) -> tuple[list[np.ndarray], list[bool]]:
        """Ids of whole texts, and of each whether the library agrees (True where it is not asked)."""
        agree = [True] * len(texts)
        if self.separable:
            parts = [self.cut(t) if t else [] for t in texts]
            self.table.met.clear()
            ids = [np.frombuffer(b"".join(map(self.table.__getitem__, p)), IDS) for p in parts]
            wrong = self.disagreeing(self.table.met) if check else ()
            if wrong:
                agree = [wrong.isdisjoint(p) for p in parts]
                for w in wrong:  # to be met, and checked, again
                    self.table.pop(w, None)
                    self.table.old.pop(w, None)
        else:
            ids = [np.array(self.segment_ids(SPACE + t.replace(" ", SPACE)) if t else [], IDS) for t in texts]
        if not self.bytes:  # a run of unknown symbols is one id
            for k, x in enumerate(ids):
                ids[k] = x[np.append(True, ~((x[1:] == self.unknown) & (x[:-1] == self.unknown)))[:len(x)]]
        if check and not self.separable:
            theirs = self.library.encode([t or "" for t in texts], num_threads=1)
            agree = [x.tolist() == t for x, t in zip(ids, theirs)]
        return ids, agree

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0][0]

    # -- decoding ------------------------------------------------------------

    def decode(self, ids: list[int]) -> str:
        """The text of any ids of the vocabulary."""
        try:
            if not self.control.isdisjoint(ids):  # they part the bytes around them
                raise ValueError
            text = b"".join(map(self.surfaces.__getitem__, ids)).decode()
        except ValueError:
            text = self._decode_bytewise(ids)
        first = next((i for i in ids if i not in self.control), self.unknown)
        if first != self.unknown and first not in self.byte_ids and self.names[first].startswith(SPACE):
            text = text[1:]  # the space that encoding put in front
        return text

    def _decode_bytewise(self, ids: list[int]) -> str:
        """Each run of byte pieces on its own: U+FFFD stands for a byte that is no UTF-8."""
        out, run = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(run[at:at + size].decode())
                        at += size
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�")
                    at += 1
            run.clear()

        for i in ids:
            if i in self.byte_ids:
                run.append(self.byte_ids[i])
            else:
                flush()
                out.append(self.surfaces[i].decode())
        flush()
        return "".join(out)


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One vocabulary per worker process and file."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, TEXTS):
            yield b.slice(lo, TEXTS)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
           decoded: bool = False, check: bool = False) -> DataFrame:
    """One row per input row: id, ids (array<int>); with ``decoded`` also text, what
    :func:`decode` makes of the ids; with ``check`` also agrees (boolean): the
    sentencepiece library gives the same ids (and the same text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for b in _parts(batches):
            ids, same = vocab.encode_all(b.column(1).to_pylist(), check)
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, IDS), *ids])
            cols = {"id": b.column(0), "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))}
            if decoded:
                lists = [x.tolist() for x in ids]
                texts = [vocab.decode(x) for x in lists]
                cols["text"] = pa.array(texts, pa.string())
                if check and not vocab.separable:
                    same = [s and a == t for s, a, t in zip(same, texts, vocab.library.decode(lists))]
            if check:
                cols["agrees"] = pa.array(same, pa.bool_())
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = f"id {kind_of(rows, 'id')}, ids array<int>" + (", text string" if decoded else "") + (
        ", agrees boolean" if check else "")
    return map_batches(rows, run, kind).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids",
           check: bool = False) -> DataFrame:
    """One row per input row: id, ids, text, and with ``check`` agrees (boolean):
    the sentencepiece library's ``decode(ids)`` gives the same text."""
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for b in _parts(batches):
            ids = [x or [] for x in b.column(1).to_pylist()]
            texts = [vocab.decode(x) for x in ids]
            cols = [*b.columns, pa.array(texts, pa.string())]
            if check:
                cols.append(pa.array([a == t for a, t in zip(texts, vocab.library.decode(ids))], pa.bool_()))
            yield pa.RecordBatch.from_arrays(cols, ["id", "ids", "text", "agrees"][:len(cols)])

    kind = f"id {kind_of(rows, 'id')}, ids array<int>, text string" + (", agrees boolean" if check else "")
    return map_batches(rows, run, kind).withColumnRenamed("id", id_col).withColumnRenamed("ids", ids_col)
