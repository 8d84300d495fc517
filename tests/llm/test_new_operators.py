"""Piece merges, conversation repair and Bloom search against the library, brute
force and SQL, and on odd rows."""
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest

from auric.llm import bloom_search, conversation_repair as cr
from auric.llm.bloom_search import Queries, search, signature_index
from auric.llm.common import documents
from auric.llm.piece_merges import Vocabulary, decode, encode
from auric.llm.queries import ORACLES, QUERIES

from .conftest import SF

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [(1, None, None, None), (2, "", "en", None), (3, " two  spaces ", "en", "s0"), (3, " two  spaces ", "en", "s0"),
       (None, "no id ▁ here", "en", "s1"), (5, "é日本😀 \x00\n\t<s><0x41>", None, "s1"), (6, "a" * 50_000, "de", "s1"),
       (7, "lorem ipsum dolor " * 30_000, "de", "s1")]


# -- operator 11 ---------------------------------------------------------------

@pytest.fixture(scope="module")
def vocab():
    return Vocabulary(MODEL)


def test_agenda_equals_the_library(vocab):
    rng = random.Random(11)
    bits = ["a", "b", " ", "  ", "▁", "the", "in", "\n", "\t", "é", "日", "😀", "\x00", "<s>", "<0x41>", "ee", "0", "tion"]
    for _ in range(5_000):
        s = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        ids = vocab.encode(s).tolist()
        assert ids == vocab.library.encode(s)
        assert vocab.decode(ids) == vocab.library.decode(ids)


def test_whole_text_agenda_equals_the_cut_one(vocab, texts):
    for t in list(texts.values())[:40]:
        whole = vocab.segment_ids("▁" + t.replace(" ", "▁")) if t else []
        assert whole == vocab.encode(t).tolist()


def test_both_agendas_agree(vocab):
    rng = random.Random(13)
    for _ in range(3_000):
        s = [vocab.symbol.get(c, -1) for c in "".join(rng.choice("▁▁▁aeiothns日é😀") for _ in range(rng.randint(1, 40)))]
        assert vocab._merge_short(list(s)) == vocab._merge_long(list(s))


def test_a_disagreement_is_told(monkeypatch):
    """A vocabulary whose agenda is wrong for one segment: its texts, and no others, are marked each time."""
    broken = Vocabulary(MODEL)
    right = broken.segment_ids
    monkeypatch.setattr(broken, "segment_ids", lambda s: right(s)[::-1] if s == "▁brokenly" else right(s))
    texts = ["all is well", "here it is brokenly", None, "and  here brokenly", "fine  "]
    for _ in range(2):
        assert broken.encode_all(texts, check=True)[1] == [True, False, True, False, True]


def test_any_ids_decode_as_in_the_library(vocab):
    rng = random.Random(12)
    for _ in range(5_000):
        ids = [rng.choice([0, 1, 2, 259, 28705, rng.randint(0, 31999), rng.randint(3, 258)]) for _ in range(rng.randint(0, 8))]
        assert vocab.decode(ids) == vocab.library.decode(ids)


def test_a_table_that_is_full_starts_anew(texts):
    small = Vocabulary(MODEL, table_rows=50)
    t = max((t for t in texts.values() if t), key=len)
    assert small.encode(t).tolist() == small.library.encode(t)
    assert len(small.table) + len(small.table.old) <= 50


def test_encode_and_decode_odd_rows(docs, vocab):
    at_once = encode(docs(ODD), MODEL, decoded=True, check=True)
    got = decode(encode(docs(ODD), MODEL, check=True), MODEL, check=True)
    assert got.columns == at_once.columns == ["doc_id", "ids", "text", "agrees"]
    rows = got.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in at_once.collect())
    assert len(rows) == len(ODD) and all(r.agrees for r in rows)
    want = Counter((d, tuple(vocab.library.encode(t or ""))) for d, t, *_ in ODD)
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows) == want
    back = {r.doc_id: r.text for r in rows}
    assert back[1] == back[2] == "" and back[3] == " two  spaces " and back[None] == "no id   here"
    assert decode(encode(docs([]), MODEL), MODEL).count() == 0


def test_null_ids_decode_to_the_empty_text(spark):
    rows = spark.createDataFrame([("x", None, 1), ("y", [259], 2)], "doc_id string, ids array<int>, text long")
    got = {r.doc_id: r.text for r in decode(rows, MODEL).collect()}
    assert got == {"x": "", "y": " "}


def test_op11_query(spark, texts, vocab):
    got = {r.doc_id: r for r in QUERIES["op11_piece_merges"](spark, SF).collect()}
    assert got.keys() == texts.keys()
    for d, t in texts.items():
        ids = vocab.library.encode(t or "")
        assert got[d].n_tokens == len(ids) and got[d].library_agrees
        assert got[d].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256(vocab.library.decode(ids).encode()).hexdigest()


# -- operator 12 ---------------------------------------------------------------

def sorted_rows(rows):
    """(turn, role, text) with nulls filled, in the operator's order."""
    filled = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(filled, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        body = text.strip(" \t\n\v\f\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else
                   "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def legal(roles):
    return re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r in roles)) is not None


def every_edit(rows):
    """Brute force: the least (cost, audit) and its messages over all edits with up to two inserts in a gap."""
    bad = faults(rows)
    gaps = [(), *itertools.product("ua"), *itertools.product("ua", repeat=2)]
    choices = []
    for (_, role, text), fault in zip(rows, bad):
        extra = 3 if fault == "truncated" else 0
        own = [("D", 4, None)]
        if fault not in ("blank", "duplicate"):
            own += [("K", extra, (role, text)), ("R", 3 + extra, ("user", text)), ("R", 3 + extra, ("assistant", text))]
        choices.append(own)
    best = None
    for filled in itertools.product(gaps, repeat=len(rows) + 1):
        for edits in itertools.product(*choices):
            cost = 3 * sum(map(len, filled)) + sum(e[1] for e in edits)
            if best is not None and cost > best[0]:
                continue
            audit, out = "", []
            for i, gap in enumerate(filled):
                audit += "I" * len(gap)
                out += [({"u": "user", "a": "assistant"}[g], "") for g in gap]
                if i < len(edits):
                    audit += edits[i][0]
                    out += [edits[i][2]] if edits[i][2] else []
            if legal([m[0] for m in out]) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, out
    return best


def least_edits(rows):
    """The same by a table over suffixes of (cost, audit, messages), for longer conversations."""
    bad = faults(rows)
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}
    after = {s: {"": (0, "", ()), "a": (0, "", ()), "u": (3, "I", (("assistant", ""),)),
                 "s": (6, "II", (("user", ""), ("assistant", "")))}[s] for s in follow}
    for (_, role, text), fault in reversed(list(zip(rows, bad))):
        now = {}
        for s in follow:
            options = [(after[s][0] + 4, "D" + after[s][1], after[s][2])]
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault == "truncated" else 0
                for inserts in range(2):
                    at = follow[s] if inserts else s
                    head = ((name[follow[s]], ""),) * inserts
                    c = role[:1]
                    if c == follow[at] or (c == "s" and at == ""):
                        a = after[c]
                        options.append((a[0] + extra + 3 * inserts, "I" * inserts + "K" + a[1], (*head, (role, text), *a[2])))
                    a = after[follow[at]]
                    options.append((a[0] + 3 + extra + 3 * inserts, "I" * inserts + "R" + a[1],
                                    (*head, (name[follow[at]], text), *a[2])))
            now[s] = min(options, key=lambda o: o[:2])
        after = now
    return after[""]


def expected(rows, edits):
    rows = sorted_rows(rows)
    cost, audit, messages = edits(rows)
    bad = Counter(faults(rows))
    turns = {t for t, _, _ in rows if t is not None}
    pairs = [(a[1][:1] + b[1][:1]) for a, b in zip(rows, rows[1:])]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, bad["blank"], bad["duplicate"], bad["truncated"],
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in messages).encode()).hexdigest())


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
TEXTS = ["Yes.", "Yes.", "No!", "cut off", "", " \n", "Why? ", "é日."]
ROLES = ["user", "user", "assistant", "assistant", "system", "tool", "", "u"]


def some_rows(rng, n):
    return [(rng.choice([None, 0, 1, 2, 3, 5, 8]), rng.choice([*ROLES, None]), rng.choice([*TEXTS, None])) for _ in range(n)]


def test_repair_equals_all_edits():
    rng = random.Random(3)
    for _ in range(60):
        rows = sorted_rows(some_rows(rng, rng.randint(0, 3)))
        assert least_edits(rows)[:2] == every_edit(rows)[:2]
        assert list(least_edits(rows)[2]) == every_edit(rows)[2]


@pytest.mark.parametrize("piece_rows", [1, 2, 512])
def test_repair_against_brute_force(spark, piece_rows):
    rng = random.Random(piece_rows)
    conversations = {c: some_rows(rng, rng.choice([0, 1, 2, 5, 9, 30])) for c in [None, *range(60)]}
    conversations[99] = some_rows(rng, 400)
    flat = [(c, t, r, x, "x") for c, rows in conversations.items() for t, r, x in rows]
    table = spark.createDataFrame(flat, "conv_id long, turn long, role string, text string, piece string")
    parts = cr.repair_parts(table, piece_rows=piece_rows)
    assert parts.where("conv = 99").count() > (100 if piece_rows < 512 else 0)  # pieces of few rows, the same results
    rows = {r.conv: tuple(r[f] for f in FIELDS) for r in cr.summaries(parts).collect()}
    assert rows == {c: expected(x, least_edits) for c, x in conversations.items() if x}


def test_a_hot_conversation_spreads_over_tasks(spark):
    """A third of all rows in one conversation, with few distinct turns: its rows lie in many ranges."""
    rng = random.Random(9)
    conversations = {c: some_rows(rng, 8) for c in range(300)}
    conversations[1000] = [(t, r, f"{x} {i}.") for i, (t, r, x) in enumerate(some_rows(rng, 1200))]
    flat = [(c, t, r, x) for c, rows in conversations.items() for t, r, x in rows]
    table = spark.createDataFrame(flat, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = cr.repair_parts(table)
        pieces = parts.where("conv = 1000").select(cr.F.shiftright("part", 33).alias("task")).distinct().count()
        rows = {r.conv: tuple(r[f] for f in FIELDS) for r in cr.summaries(parts).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert pieces >= 3
    assert rows == {c: expected(x, least_edits) for c, x in conversations.items()}


def test_pieces_compose_as_one():
    """Cutting rows anywhere and settling the pieces gives the whole's least weight."""
    rng = random.Random(5)
    for _ in range(300):
        rows = sorted_rows(some_rows(rng, rng.randint(0, 12)))
        cuts = sorted(rng.randint(0, len(rows)) for _ in range(rng.randint(0, 4)))
        seen, pieces = set(), []
        for k, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
            p = cr._Piece("c")
            for t, role, text in rows[lo:hi]:
                p.add(t, role, text, 1, (role, text) not in seen)
                seen.add((role, text))
            pieces.append(p.cut(k))
        got = list(cr.settle(pieces))
        cost, audit, messages = least_edits(rows)
        assert (sum(g["cost"] for g in got), "".join(g["audit"] for g in got)) == (cost, audit)
        by_number = {p["piece"]: [tuple(r.values()) for r in p["rows"]] for p in pieces}
        out = [m for g in got for m in cr.apply_edits(by_number.get(g["piece"], []), g["audit"], g["start"])]
        assert [(m["role"], m["text"]) for m in out] == list(messages)


def test_copies_of_one_row_are_one_step(spark):
    rows = [(1, 0, "user", "Hi.", 1), (1, 1, "assistant", "Same.", 20_000), (2, 0, "user", "gone", 0), (1, 2, "user", "Bye.", 1)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n long")
    got = {r.conv: r for r in cr.summaries(cr.repair_parts(table, copies=cr.F.col("n"))).collect()}
    assert got[1].duplicate == 19_999 and got[1].illegal == 19_999 and got[1].audit == "KK" + "D" * 19_999 + "KI"
    assert got[1].cost == 4 * 19_999 + 3 and got[1].gaps == 0
    empty = hashlib.sha256(b"").hexdigest()
    assert tuple(got[2][f] for f in FIELDS) == (0, 0, 0, 0, 0, 0, "", empty)


def test_parts_hold_the_repaired_messages(spark):
    table = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "cut")],
                                  "conv_id long, turn long, role string, text string")
    parts = cr.repair_parts(table).collect()
    assert [(m.role, m.text) for p in parts for m in p.messages] == [("user", "Hi."), ("assistant", "cut")]
    assert "".join(p.audit for p in parts) == "KR"


def test_empty_conversations(spark):
    table = spark.createDataFrame([], "conv_id string, turn long, role string, text string")
    assert cr.summaries(cr.repair_parts(table)).count() == 0


def test_op12_query(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    damaged = defaultdict(list)
    for r in table:
        own = damaged[r.conv_id]
        fate = zlib.crc32(f"{' ' if r.conv_id is None else r.conv_id}:{' ' if r.turn is None else r.turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (r.role, r.text))
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        own += [(r.turn, "user" if fate == 4 else role, text)] * {0: 0, 3: 2}.get(fate, 1)
    got = {r.conv_id: tuple(r[f] for f in FIELDS) for r in QUERIES["op12_conversation_repair"](spark, SF).collect()}
    assert got == {c: expected(x, least_edits) for c, x in damaged.items()}


# -- operator 13 ---------------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_search(docs, items, k=10):
    """Every document scored for every item, from the contract's words."""
    counts = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = set()
    for item, text in items:
        scored = []
        terms = sorted(set(TERM.findall((text or "").translate(LOWER))))
        for d, c in counts:
            m = 10 + (90 * c.total() * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in terms if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out |= {(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])}
    return out


def rows_of(df):
    return {(r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()}


def test_op13_query_equals_sql_and_brute_force(spark):
    got = rows_of(QUERIES["op13_bloom_search"](spark, SF))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert got == set(con.execute(ORACLES["op13_bloom_search"]).fetchall())
    both = [[tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(i, "text").collect()]
            for t, i in (("documents", "doc_id"), ("benchmark", "item_id"))]
    assert got == brute_search(*both)


def test_search_odd_rows(spark, docs):
    rows = [*ODD, (8, "Zebra zebra ZEBRA"), (9, "zebra, ünïcode 42"), (9, "zebra, ünïcode 42"), (10, "zebra"), (11, "zebra"),
            *((20 + i, f"filler word{i} common") for i in range(60)), *((100 + i, "one copy of many") for i in range(300))]
    items = [(1, "Zebra ünïcode"), (1, "Zebra ünïcode"), (2, None), (3, "!!"), (4, "absent-term"), (5, "copy many lorem"),
             (None, "common word7"), (6, "zebra")]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = brute_search([r[:2] for r in rows], dict.fromkeys(items))
    for block, rescored in ((256, 32), (2, 10)):
        assert rows_of(search(docs(rows), table, items=block, rescored=rescored)) == want
    assert search(docs([]), table).count() == 0
    assert search(docs(ODD), table.limit(0)).count() == 0
    assert search(docs([(1, None), (2, "?")]), table).count() == 0


def test_bounds_are_never_below_the_scores(spark):
    index = [r.asDict() for r in signature_index(documents(spark, SF)).collect()]
    items = [(r.item_id, sorted(set(bloom_search.terms_of(r.text)))) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    q = Queries.of(items)
    q.n_docs = sum(len(b["ids"]) for b in index)
    q.n_terms = sum(sum(b["lengths"]) for b in index)
    q.weights = np.full(len(q.terms), 1000)
    h = bloom_search.hashes(q.terms, len(q.terms))
    tight = []
    for b in index:
        bound, score = q.bounds(b, h), q.scores(b["texts"], np.array(b["lengths"]))
        assert (bound >= score).all()
        tight.append((score.sum(), bound.sum()))
    assert sum(s for s, _ in tight) > 0.7 * sum(b for _, b in tight)  # and not far above them
