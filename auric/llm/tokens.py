"""Token ids of whole texts under a tokenizer file of the tokenizers library.

A byte-level BPE splits a text at every space that follows a non-space
character before any merge is looked at. So the text is cut there, and the ids
of each distinct piece are looked up in a bounded table; the library's model
computes the ids of a piece when it is first met. The ids are those of
``Tokenizer.encode(text, add_special_tokens=False)`` (tested on whole tables).
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

# Fixed value: the splitting pattern of byte-level BPE.
PATTERN = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Characters on which the libraries' classes of letters, numbers and spaces agree.
PLAIN = regex.compile(r"[\n\x20-\x7e\xa1-ɏ]*")


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: visible Latin-1 characters stand for themselves, the
    other bytes take the code points from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


LETTERS = _byte_letters()
SPACE = LETTERS[32]
TEXTS = 500  # texts put in place at a time
MARKS = frozenset(".,;:!?")  # never part of the word before them


class _Pieces(dict):
    """Piece between two spaces -> ids as bytes; None where the cut after it is not safe."""

    def __init__(self, owner: "Encoder"):
        super().__init__()
        self.owner = owner

    def __missing__(self, piece: str) -> bytes | None:
        if len(self) >= self.owner.table_rows:
            self.clear()
        got = self[piece] = self.owner.piece_ids(piece)
        return got


def strings(pieces: pa.Array) -> list[str]:
    """The strings of an array in which none has a space: joined by spaces and split
    again, which costs a ninth of making them one by one."""
    if not len(pieces):
        return []
    row = pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces.cast(pa.large_string()))
    return pc.binary_join(row, pa.scalar(" ", pa.large_string()))[0].as_py().split(" ")


class Encoder:
    def __init__(self, path: str, table_rows: int = 1_200_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.code = self.dtype.char
        self.table_rows = table_rows
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces = _Pieces(self)
        pre = self.tokenizer.pre_tokenizer
        self.cuts = (self.tokenizer.normalizer is None and type(pre).__name__ == "ByteLevel"
                     and not pre.add_prefix_space and pre.use_regex)

    def piece_ids(self, piece: str) -> bytes | None:
        """Ids of a space and a piece; None where the cut after it is not safe."""
        if piece.isalpha():
            if piece.isascii():  # one word, its letters stand for themselves
                return self.word_ids(SPACE + piece)
        elif not piece or piece[-1].isspace():
            return None
        elif piece[-1] in MARKS and piece[:-1].isalpha() and PLAIN.fullmatch(piece):  # a word, then a mark
            return self.pieces[piece[:-1]] + self.word_ids(piece[-1])
        return self.ids_of(" " + piece)

    def word_ids(self, word: str) -> bytes:
        """Ids of one word in byte letters."""
        return array(self.code, [t.id for t in self.model.tokenize(word)]).tobytes()

    def ids_of(self, chunk: str) -> bytes:
        """Ids of a chunk that starts and ends at cuts."""
        if PLAIN.fullmatch(chunk):
            words = [w.encode().decode("latin-1").translate(LETTERS) for w in PATTERN.findall(chunk)]
        else:
            words = [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(chunk)]
        return b"".join(map(self.word_ids, words))

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text (null: empty) as little-endian bytes of ``dtype``."""
        if not text:
            return b""
        if not self.cuts or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        first, *rest = text.split(" ")
        if first and not first[-1].isspace():
            try:
                return self.ids_of(first) + b"".join(map(self.pieces.__getitem__, rest))
            except TypeError:  # a piece after which the cut is not safe
                pass
        out, chunk = [], first
        for piece in rest:
            if not chunk or chunk[-1].isspace():
                chunk += " " + piece
            else:
                out.append(self.ids_of(chunk))
                chunk = " " + piece
        return b"".join(out) + self.ids_of(chunk)

    def encode_all(self, texts: pa.Array, end_id: int) -> Iterator[np.ndarray]:
        """Ids of every text and an end id, in order. The pieces of all texts are
        first reduced to distinct ones, so a piece is looked up once per batch and
        put in place by array indexing."""
        parts = pc.split_pattern(texts, " ")
        at = parts.offsets.to_numpy().astype(np.int64)
        coded = parts.values.dictionary_encode()
        index = coded.indices.to_numpy().astype(np.int64)
        words = strings(coded.dictionary)
        entries = [self.pieces[w] for w in words]
        unsafe = np.array([e is None for e in entries], bool)
        slow = np.add.reduceat(unsafe[index], at[:-1]) > 0 if len(index) else np.zeros(0, bool)
        for s in self.special:
            slow |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        entries = [e or b"" for e in entries]
        base, none = len(entries), len(entries) + len(texts)
        for i, start in enumerate(at[:-1].tolist()):
            # What has no space before it, or a whole text that is not safe to cut, is an entry of its own.
            if slow[i] or not self.cuts:
                index[start:at[i + 1]] = none
                entries.append(self.encode(texts[i].as_py()))
            else:
                entries.append(self.ids_of(words[index[start]]))
            index[start] = base + i
        entries.append(b"")
        size = np.fromiter(map(len, entries), np.int64, len(entries)) // self.dtype.itemsize
        begin = np.cumsum(size) - size
        data = np.frombuffer(b"".join(entries), self.dtype)
        for lo in range(0, len(texts), TEXTS):
            hi = min(len(texts), lo + TEXTS)
            ix = index[at[lo]:at[hi]]
            n = size[ix]
            ends = np.cumsum(n)
            values = data[np.repeat(begin[ix] - (ends - n), n) + np.arange(ends[-1])]
            stop = np.append(0, ends)[at[lo + 1:hi + 1] - at[lo]] + np.arange(hi - lo)  # place of each end id
            out = np.insert(values, stop - np.arange(hi - lo), end_id)
            first = 0
            for z in (stop + 1).tolist():
                yield out[first:z]
                first = z


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_path() -> str:
    """The public 50k byte-level BPE file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
