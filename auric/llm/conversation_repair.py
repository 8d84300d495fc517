"""Conversation structure repair by scalar big-integer weights (operator 12).

The cheapest edits that give a conversation's role initials the form
``(s?(ua)+)?``: Keep (0), Rerole to user or assistant (3), Delete (4, the only
edit of blank and duplicate rows), Insert an empty user or assistant (3); a
truncated row that stays costs 3 more. Among the cheapest, the ASCII-least
string of edit initials wins.

*Weights.* An edit at place p of the edit string weighs
``cost * 8**L + letter * 8**(L - 1 - p)`` with L the most letters there can be
and D, I, K, R the digits 1 to 4: high digits carry the cost, fixed-width
positional low digits the letters, and what is not used at the end is zero. A
plain integer minimum over the graph of (row, state) decides cost and ties at
once. Of two paths of equal weight of cost to one node neither string begins the
other (the rest would be inserts, which cost), so the least prefix stays least.

*Hot conversations.* Equal rows of a turn are aggregated first. Rows are dealt by
range of (conversation, turn, role, text), so one conversation may spread over
many tasks, and a task cuts it into pieces of bounded size. A piece yields, for
each pair of states, its least weight; the tiny tables of a conversation's pieces
are then walked in order, settling a piece as soon as all live paths agree on it.
Only conversations that touch an end of a task's range, or exceed a piece, go
this way; the others are done where they lie. A conversation's hash is one
stream by definition: it reads the pieces of one conversation in order, in
bounded memory.

Defined results: null role and text are one space; null turns come first; rows of
one turn go by role, then text, in code point order; a role that is the empty
string has no legal initial. Null conversation ids are one conversation. A
repeated row is a duplicate. An empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kind_of, map_batches, stage

# The edits, their costs, their digits (in ASCII order), and the legal pairs of role initials.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
LETTERS = {"D": 1, "I": 2, "K": 3, "R": 4}
LEGAL = ("su", "ua", "au")
BLANKS = " \t\n\v\f\r"
STOPS = ".!?"

# States: nothing kept yet; after a system row; after a user row; after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
#: The row that may follow a state (beside a first system row), and the state after it.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: Inserts that end a conversation.
CLOSING = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
TO_DIGITS = str.maketrans({k: str(d) for k, d in LETTERS.items()})
TO_LETTERS = str.maketrans({str(d): k for k, d in LETTERS.items()})

PIECE_ROWS, PIECE_CHARS = 512, 1 << 20
BATCH = 200  # records in a batch that a task gives back


def kept_state(state: int, role: str) -> int | None:
    """The state after a row that keeps its role, None where it may not."""
    to = INITIAL.get(role[:1])
    if to == SYSTEM:
        return SYSTEM if state == START else None
    return to if to == NEXT[state] else None


# Rows inside a piece: (role, text, must_go, truncated, copies). Copies over one must go.
Row = tuple[str, str, bool, bool, int]


def least_weights(rows: list[Row], start: int) -> dict[int, tuple[int, str]]:
    """For each state that the rows can lead to from ``start``: cost and edit
    letters of the least weight."""
    width = sum(r[4] for r in rows) + len(rows)  # at most one insert before a row
    unit = 3 * width

    def weight(cost: int, letter: str, place: int) -> int:
        return (cost << unit) + (LETTERS[letter] << 3 * (width - 1 - place))

    def take(into: dict, state: int, value: int, place: int) -> None:
        if state not in into or value < into[state][0]:
            into[state] = value, place

    at = {start: (0, 0)}
    for role, _, must_go, truncated, copies in rows:
        after: dict[int, tuple[int, int]] = {}
        ones = ((1 << 3 * copies) - 1) // 7  # a letter D in each of the places
        for s, (v, p) in at.items():
            take(after, s, v + (DELETE * copies << unit) + (ones << 3 * (width - p - copies)), p + copies)
        if not must_go:
            ready = dict(at)
            for s, (v, p) in at.items():
                take(ready, NEXT[s], v + weight(INSERT, "I", p), p + 1)
            extra = TRUNCATED if truncated else 0
            for s, (v, p) in ready.items():
                to = kept_state(s, role)
                if to is not None:
                    take(after, to, v + weight(extra, "K", p), p + 1)
                take(after, NEXT[s], v + weight(REROLE + extra, "R", p), p + 1)
        at = after
    out = {}
    for s, (v, p) in at.items():
        low = (v & ((1 << unit) - 1)) >> 3 * (width - p)
        out[s] = v >> unit, f"{low:0{p}o}".translate(TO_LETTERS) if p else ""
    return out


def least_of(options: list[tuple]) -> tuple:
    """Of (cost, letters as an integer, number of letters, ...) the least weight, at the width of the longest."""
    width = max(o[2] for o in options)
    return min(options, key=lambda o: (o[0] << 3 * width) + (o[1] << 3 * (width - o[2])))


def closed(paths: dict[int, tuple[int, str]]) -> tuple[int, str]:
    """The cheapest way to end: cost and letters of the whole."""
    options = []
    for s, (cost, letters) in paths.items():
        whole = letters + CLOSING[s]
        options.append((cost + INSERT * len(CLOSING[s]), int(whole.translate(TO_DIGITS) or "0", 8), len(whole), whole))
    best = least_of(options)
    return best[0], best[3]


def apply_edits(rows: list[Row], audit: str, state: int) -> list[dict]:
    """The messages that the edits make of the rows, from ``state`` on."""
    out, left = [], iter(rows)
    gone = 0  # letters D that belong to the row taken last
    for letter in audit:
        if letter == "I":
            state = NEXT[state]
            out.append({"role": ROLE[state], "text": ""})
            continue
        if gone:
            gone -= 1
            continue
        role, text, _, _, copies = next(left)
        if letter == "D":
            gone = copies - 1
            continue
        if letter == "K":
            state = INITIAL[role[:1]]
        else:
            state = NEXT[state]
            role = ROLE[state]
        out.append({"role": role, "text": text})
    return out


class _Piece:
    """Rows of one conversation that follow each other, and what is counted of them."""

    def __init__(self, conv):
        self.conv = conv
        self.rows: list[Row] = []
        self.chars = 0
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.low_turn = self.high_turn = self.first_turn = self.last_turn = None
        self.first_initial = self.last_initial = None

    def add(self, turn: int | None, role: str, text: str, copies: int, first_seen: bool) -> None:
        body = text.strip(BLANKS)
        blank, truncated = not body, body[-1:] not in STOPS
        n = self.counts
        initial = role[:1]
        if not self.rows:
            self.first_turn, self.first_initial = turn, initial
        else:
            n["illegal"] += self.last_initial + initial not in LEGAL
        if turn is not None and (not self.rows or turn != self.last_turn):
            n["turns"] += 1
            self.low_turn = turn if self.low_turn is None else self.low_turn
            self.high_turn = turn
        n["illegal"] += copies - 1  # a copy follows a row of its own role
        if blank:
            n["blank"] += copies
            self.rows.append((role, text, True, False, copies))
        else:
            n["duplicate"] += copies - first_seen
            if first_seen:
                n["truncated"] += truncated
                self.rows.append((role, text, False, truncated, 1))
            if copies > first_seen:
                self.rows.append((role, text, True, False, copies - first_seen))
        self.last_turn, self.last_initial = turn, initial
        self.chars += len(role) + len(text)

    def full(self, most_rows: int) -> bool:
        return len(self.rows) >= most_rows or self.chars >= PIECE_CHARS

    def whole(self) -> dict:
        cost, audit = closed(least_weights(self.rows, START))
        return {"conv": self.conv, **self.counts, "low_turn": self.low_turn, "high_turn": self.high_turn,
                "cost": cost, "audit": audit, "messages": apply_edits(self.rows, audit, START)}

    def cut(self, number: int) -> dict:
        paths = [{"s": s, "t": t, "cost": c, "audit": a}
                 for s in STATES for t, (c, a) in least_weights(self.rows, s).items()]
        rows = [dict(zip(("role", "text", "must_go", "truncated", "copies"), r)) for r in self.rows]
        return {"conv": self.conv, "piece": number, **self.counts, "low_turn": self.low_turn,
                "high_turn": self.high_turn, "first_turn": self.first_turn, "last_turn": self.last_turn,
                "first_initial": self.first_initial, "last_initial": self.last_initial, "paths": paths, "rows": rows}


COUNTS = "blank long, duplicate long, truncated long, illegal long, turns long, low_turn long, high_turn long"
MESSAGES = "messages array<struct<role:string,text:string>>"
MESSAGES_ARROW = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
COUNTS_ARROW = [(c.split()[0], pa.int64()) for c in COUNTS.split(", ")]


def _batches(records: Iterable[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, chars = [], 0
    for r in records:
        held.append(r)
        chars += sum(len(m["text"]) for m in (r.get("messages") or r.get("rows") or ()))
        if len(held) >= BATCH or chars > PIECE_CHARS:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _records(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[dict]:
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield from b.slice(lo, rows).to_pylist()


def _pieces(sorted_rows: DataFrame, most_rows: int) -> DataFrame:
    """Conversations that lie inside one task's range as they are, the others in pieces."""
    conv = kind_of(sorted_rows, "conv")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        number = TaskContext.get().partitionId() << 33
        piece, at_end = None, True  # at_end: the piece is not known to be a whole conversation
        for r in _records(batches):
            if piece is None:
                piece = _Piece(r["conv"])
            elif r["conv"] != piece.conv:
                yield piece.cut(number) if at_end else piece.whole()
                number += 1
                piece, at_end = _Piece(r["conv"]), False
            elif piece.full(most_rows):
                yield piece.cut(number)
                number += 1
                piece, at_end = _Piece(r["conv"]), True
            if r["copies"]:
                piece.add(r["turn"], r["role"], r["text"], r["copies"], r["first_seen"])
        if piece is not None:
            yield piece.cut(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([
            ("conv", first.schema.field("conv").type), ("piece", pa.int64()), *COUNTS_ARROW,
            ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("first_initial", pa.string()),
            ("last_initial", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("messages", MESSAGES_ARROW),
            ("paths", pa.list_(pa.struct([("s", pa.int32()), ("t", pa.int32()), ("cost", pa.int64()),
                                          ("audit", pa.string())]))),
            ("rows", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("must_go", pa.bool_()),
                                         ("truncated", pa.bool_()), ("copies", pa.int64())])))])

        def all_batches():
            yield first
            yield from batches

        yield from _batches(found(all_batches()), schema)

    return map_batches(sorted_rows, run, (
        f"conv {conv}, piece long, {COUNTS}, first_turn long, last_turn long, first_initial string, "
        f"last_initial string, cost long, audit string, {MESSAGES}, "
        "paths array<struct<s:int,t:int,cost:long,audit:string>>, "
        "rows array<struct<role:string,text:string,must_go:boolean,truncated:boolean,copies:long>>"))


def settle(pieces: Iterable[dict]) -> Iterator[dict]:
    """Walk one conversation's pieces in order; for each piece the state it starts
    in, its cost and letters, and what its border with the piece before adds.

    A live path is (cost, letters as an integer, their number, states at the
    borders of the pieces not settled yet). Once all live paths pass one state,
    the pieces before it are settled and their letters leave the integers."""
    live = {START: (0, 0, 0, (START,))}
    open_pieces: list[tuple[dict, dict]] = []
    before = None

    def settled(piece: dict, table: dict, s: int, t: int, more: str = "") -> dict:
        cost, audit = table[s, t]
        return {"piece": piece["piece"], "start": s, "cost": cost + INSERT * len(more), "audit": audit + more,
                "illegal_more": piece["illegal_more"], "turns_less": piece["turns_less"]}

    for p in pieces:
        table = {(e["s"], e["t"]): (e["cost"], e["audit"]) for e in p["paths"]}
        coded = {k: (c, int(a.translate(TO_DIGITS) or "0", 8), len(a)) for k, (c, a) in table.items()}
        p = {**p, "illegal_more": 0, "turns_less": 0}
        if p["first_initial"] is not None:
            if before is not None:
                p["illegal_more"] = int(before["last_initial"] + p["first_initial"] not in LEGAL)
                p["turns_less"] = int(p["first_turn"] is not None and p["first_turn"] == before["last_turn"])
            before = p
        options: dict[int, list] = {}
        for s, (c, low, n, path) in live.items():
            for t in STATES:
                if (s, t) in coded:
                    c2, low2, n2 = coded[s, t]
                    options.setdefault(t, []).append((c + c2, low << 3 * n2 | low2, n + n2, (*path, t)))
        live = {t: least_of(o) for t, o in options.items()}
        open_pieces.append((p, table))
        while open_pieces and len({v[3][1] for v in live.values()}) == 1:
            first, its = open_pieces.pop(0)
            path = next(iter(live.values()))[3]
            cost, audit = its[path[0], path[1]]
            yield settled(first, its, path[0], path[1])
            live = {t: (c - cost, low & ((1 << 3 * (n - len(audit))) - 1), n - len(audit), way[1:])
                    for t, (c, low, n, way) in live.items()}
    ends = [(c + INSERT * len(CLOSING[t]), low << 3 * len(CLOSING[t]) | int(CLOSING[t].translate(TO_DIGITS) or "0", 8),
             n + len(CLOSING[t]), way, CLOSING[t]) for t, (c, low, n, way) in live.items()]
    _, _, _, way, more = least_of(ends)
    for i, (p, its) in enumerate(open_pieces):
        yield settled(p, its, way[i], way[i + 1], more if i == len(open_pieces) - 1 else "")
    if not open_pieces and more:  # all pieces were settled: the closing inserts stand alone
        yield {"piece": None, "start": way[0], "cost": INSERT * len(more), "audit": more,
               "illegal_more": 0, "turns_less": 0}


def _by_conversation(records: Iterator[dict]) -> Iterator[tuple[object, Iterator[dict]]]:
    """Runs of records of one conversation; a run must be read before the next one."""
    held = next(records, None)
    while held is not None:
        conv = held["conv"]

        def run():
            nonlocal held
            while held is not None and held["conv"] == conv:
                now, held = held, None
                yield now
                held = next(records, None)

        yield conv, run()


def _choices(cut: DataFrame) -> DataFrame:
    """For every piece the part that the whole conversation's least weight gives it."""
    narrow = cut.select("conv", "piece", "first_turn", "last_turn", "first_initial", "last_initial", "paths")
    narrow = narrow.repartition("conv").sortWithinPartitions("conv", "piece")
    conv = kind_of(cut, "conv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([
            ("piece", pa.int64()), ("closing_of", first.schema.field("conv").type), ("after", pa.int64()),
            ("start", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("illegal_more", pa.int64()),
            ("turns_less", pa.int64())])

        def all_batches():
            yield first
            yield from batches

        def records():
            for conv_id, pieces in _by_conversation(_records(all_batches())):
                last = None
                for c in settle(pieces):
                    last = last if c["piece"] is None else c["piece"]
                    yield {**c, "closing_of": conv_id, "after": last}

        yield from _batches(records(), schema)

    return map_batches(narrow, run, f"piece long, closing_of {conv}, after long, start int, cost long, audit string, "
                                    "illegal_more long, turns_less long")


def _edited(cut: DataFrame, choices: DataFrame) -> DataFrame:
    """The pieces with their part of the edits, as rows like those of whole conversations."""
    conv = kind_of(cut, "conv")
    own = choices.where("piece IS NOT NULL").drop("closing_of", "after")
    both = cut.drop("cost", "audit", "messages", "paths").join(own, "piece").select(
        "conv", F.col("piece").alias("part"), "blank", "duplicate", "truncated",
        (F.col("illegal") + F.col("illegal_more")).alias("illegal"),
        (F.col("turns") - F.col("turns_less")).alias("turns"), "low_turn", "high_turn", "cost", "audit", "start", "rows")
    # Closing inserts of conversations whose pieces were all settled before the end.
    zero = [F.lit(0).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "turns")]
    none = [F.lit(None).cast("long").alias(c) for c in ("low_turn", "high_turn")]
    ends = choices.where("piece IS NULL").select(
        F.col("closing_of").alias("conv"), (F.col("after") + 1).alias("part"), *zero, *none, "cost", "audit", "start",
        F.array().cast(both.schema["rows"].dataType).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            schema = pa.schema([*list(b.schema)[:-2], ("messages", MESSAGES_ARROW)])

            def records(b=b):
                for r in _records([b], 16):
                    rows, start = [tuple(x.values()) for x in r.pop("rows")], r.pop("start")
                    yield {**r, "messages": apply_edits(rows, r["audit"], start)}

            yield from _batches(records(), schema)

    return map_batches(both.unionByName(ends), run,
                       f"conv {conv}, part long, {COUNTS}, cost long, audit string, {MESSAGES}")


def repair_parts(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", copies: Column | None = None, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """The repaired conversations in parts of bounded size: conv, part (null: the
    whole conversation; else parts go in this order), the counts of its rows
    (additive over parts), cost, audit (the edits' initials) and messages (array
    of role and text). ``copies`` repeats a row adjacently (0: the row is not
    there, its conversation is)."""
    one = F.lit(1) if copies is None else copies

    def filled(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    rows = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                                filled(role_col).alias("role"), filled(text_col).alias("text"),
                                one.cast("long").alias("copies"))
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    rows = stage(rows.withColumn("same", F.unhex(F.sha2("text", 256))), "conversation-rows")
    seen = (rows.where("copies > 0").groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("same").alias("k"))
            .agg(F.max(F.col("turn").isNull()).alias("null_first"), F.min("turn").alias("least"),
                 F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    rows = rows.join(seen, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r"))
                     & (F.col("same") == F.col("k")), "left")
    first_seen = F.col("k").isNull() | F.col("turn").isNull() | (
        ~F.col("null_first") & (F.col("turn") == F.col("least")))
    rows = rows.select("conv", "turn", "role", "text", "copies", first_seen.alias("first_seen"))
    # Equal heads stay in one task, so the ranges agree with the order of whole texts.
    dealt = rows.repartitionByRange("conv", "turn", "role", F.substring("text", 1, 64))
    pieces = stage(_pieces(dealt.sortWithinPartitions("conv", "turn", "role", "text"), piece_rows),
                   "conversation-pieces")
    cut = pieces.where("piece IS NOT NULL")
    choices = stage(_choices(cut), "conversation-choices")
    whole = pieces.where("piece IS NULL").select(
        "conv", F.lit(None).cast("long").alias("part"), "blank", "duplicate", "truncated", "illegal", "turns",
        "low_turn", "high_turn", "cost", "audit", "messages")
    return whole.unionByName(_edited(cut, choices))


def summaries(parts: DataFrame) -> DataFrame:
    """One row per conversation: conv, gaps, blank, duplicate, truncated, illegal,
    cost, audit and repaired_sha256 (of the messages as ``role:text`` lines)."""
    conv = kind_of(parts, "conv")
    gaps = F.coalesce(F.col("high_turn") - F.col("low_turn") + 1 - F.col("turns"), F.lit(0).cast("long")).alias("gaps")
    out = ["conv", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    lines = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")
    whole = parts.where("part IS NULL").withColumn("repaired_sha256", F.sha2(lines, 256)).select(*out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([("conv", first.schema.field("conv").type), *COUNTS_ARROW, ("cost", pa.int64()),
                            ("audit", pa.string()), ("repaired_sha256", pa.string())])

        def all_batches():
            yield first
            yield from batches

        def records():
            for conv_id, its in _by_conversation(_records(all_batches(), 16)):
                total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns", "cost"), 0)
                low, high, audit, digest, any_yet = None, None, [], hashlib.sha256(), False
                for r in its:
                    for c in total:
                        total[c] += r[c]
                    low = min((x for x in (low, r["low_turn"]) if x is not None), default=None)
                    high = max((x for x in (high, r["high_turn"]) if x is not None), default=None)
                    audit.append(r["audit"])
                    for m in r["messages"]:
                        digest.update(("\n" if any_yet else "").encode() + f"{m['role']}:{m['text']}".encode())
                        any_yet = True
                yield {"conv": conv_id, **total, "low_turn": low, "high_turn": high, "audit": "".join(audit),
                       "repaired_sha256": digest.hexdigest()}

        yield from _batches(records(), schema)

    streamed = map_batches(parts.where("part IS NOT NULL").repartition("conv").sortWithinPartitions("conv", "part"), run,
                           f"conv {conv}, {COUNTS}, cost long, audit string, repaired_sha256 string")
    return whole.unionByName(streamed.select(*out))


def damage(conversations: DataFrame) -> tuple[DataFrame, Column]:
    """Fixed damage by crc32 of ``conv_id:turn``: the damaged rows and the column
    of their copies."""

    def filled(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fate = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.translate(filled("text"), STOPS, "")).otherwise(filled("text"))
    role = F.when(fate == 4, "user").otherwise(filled("role"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"),
                                F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).alias("copies"))
    return rows, F.col("copies")
