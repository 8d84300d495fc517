"""The operators on Spark, against brute force on whole small tables and on
odd rows: nulls, empty and long texts, repeats, empty tables, clashing columns."""
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from auric.llm import ctw
from auric.llm.common import documents, shared_path, stage
from auric.llm.components import components
from auric.llm.exact_dedup import exact_dedup
from auric.llm.mixing import mix, targets
from auric.llm.packing import encode_units, frequencies, pack_documents
from auric.llm.quality_rules import BINS_PER_OCTAVE, FLOOR, mcd_estimates, quality_rules
from auric.llm.queries import QUERIES
from auric.llm.secret_scan import secret_spans
from auric.llm.simhash import fingerprint, links, simhash_classes
from auric.llm.suffix_dedup import cut, suffix_dedup
from auric.llm.token_count import token_counts
from auric.llm.token_files import TokenFile, read_token_files, write_token_files
from auric.llm.tokens import Encoder, default_path

from .conftest import SF

LONG = "lorem ipsum dolor " * 30_000
ODD = [(1, None, None, None), (2, "", "en", None), (3, "a b c", "en", "s0"), (3, "a b c", "en", "s0"),
       (4, " a\tb c\n", "en", "s0"), (None, "no id here", "en", "s1"), (5, "é日本 #", None, "s1"), (6, LONG, "de", "s1"),
       (7, LONG, "de", "s1")]


@pytest.fixture(scope="module")
def enc():
    return Encoder(default_path())


def ids_of(enc, text, end):
    return np.append(enc.tokenizer.encode(text or "", add_special_tokens=False).ids, end).astype("<u4")


def test_exact_dedup(docs):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(docs(ODD)).collect()}
    assert got == {(1, 1, 2, True), (2, 1, 2, False), (3, 4, 3, False), (4, 4, 3, True), (None, None, 1, True),
                   (5, 5, 1, True), (6, 6, 2, True), (7, 6, 2, False)}
    assert exact_dedup(docs([])).count() == 0


def test_exact_dedup_tells_texts_apart_at_every_level(docs):
    same = "x" * 300
    rows = [(1, same + "a"), (2, same + "b"), (3, same + "a "), (4, "y" * 301), (5, None), (6, same + " a")]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup(docs(rows)).collect()}
    assert got == {1: (3, 3), 2: (2, 1), 3: (3, 3), 4: (4, 1), 5: (5, 1), 6: (3, 3)}


def test_exact_dedup_runs_no_python(docs):
    plan = exact_dedup(docs(ODD))._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))


def brute_classes(fps, radius):
    """{id: smallest id reachable} for [(id, fp)]."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(fps):
        for j in range(i):
            if bin(a ^ fps[j][1]).count("1") <= radius:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(fps):
        least[find(i)].append(d)
    return {fps[i][0]: min(least[find(i)]) for i in range(len(fps))}


def test_simhash_classes(spark, texts, docs):
    want = brute_classes([(k, fingerprint(t)) for k, t in texts.items()], 2)
    got = simhash_classes(documents(spark, SF)).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.fingerprint == f"{fingerprint(texts[r.doc_id]):016x}" for r in got)
    odd = [(r.doc_id, r.component_id, r.class_size) for r in simhash_classes(docs(ODD)).collect()]
    assert len(odd) == len(ODD) and (1, 1, 2) in odd and (2, 1, 2) in odd and odd.count((3, 3, 3)) == 2
    assert (4, 3, 3) in odd and (7, 6, 2) in odd
    assert simhash_classes(docs([])).count() == 0


@pytest.mark.parametrize("pair_limit", [0, 3, 10_000])
def test_large_buckets_link_exactly(spark, pair_limit):
    r = np.random.default_rng(4)
    base = int(r.integers(0, 1 << 62))
    fps = {base}
    for _ in range(150):
        fps.add(int(sorted(fps)[int(r.integers(len(fps)))]) ^ (1 << int(r.integers(64))) ^ (1 << int(r.integers(8))))
    fps |= {int(x) for x in r.integers(0, 1 << 63, 40)}
    fps = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {x.node: x.root for x in components(links(df, 2, pair_limit)).collect()}
    want = brute_classes([(f, f % (1 << 64)) for f in fps], 2)
    assert {f: got.get(f, f) for f in fps} == want


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (900, 900)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 501: 500}


def test_quality_rules(docs):
    r = np.random.default_rng(6)
    words = ["".join(r.choice(list("etaoinsh"), int(r.integers(2, 8)))) for _ in range(400)]
    rows = [(i, " ".join(r.choice(words, int(r.integers(60, 200)))), "en", "s0") for i in range(300)]
    junk = [(1000 + i, " ".join(w + "###" for w in r.choice(words, 100)), "en", "s0") for i in range(20)]
    odd = [(2001, None, None, None), (2002, "", "en", "s0"), (2003, "too few words", "xx", None)]
    got = {x.doc_id: x for x in quality_rules(docs(rows + junk + odd)).collect()}
    assert len(got) == 323
    assert sum(got[i].kept for i in range(300)) >= 299
    assert not any(got[1000 + i].kept or got[1000 + i].base_failed for i in range(20))
    assert all(got[i].base_failed and not got[i].kept for i in (2001, 2002, 2003))


def test_quality_rules_small_groups_and_empty_table(docs):
    rows = [(i, f"some words that go on for a while number {i} and end here", "en", f"s{i}") for i in range(12)]
    assert all(r.kept for r in quality_rules(docs(rows)).collect())  # too few rows for any estimate
    assert quality_rules(docs([])).count() == 0


def test_quality_rules_null_source_is_a_group_of_its_own(docs):
    r = np.random.default_rng(8)
    words = ["".join(r.choice(list("etaoinsh"), int(r.integers(2, 8)))) for _ in range(400)]
    rows = [(i, " ".join(r.choice(words, int(r.integers(60, 200)))), "en", None) for i in range(150)]
    other = [(1000 + i, " ".join(w + "###" for w in r.choice(words, 100 + i % 99)), "en", "s0") for i in range(300)]

    def verdict(given):
        return {x.doc_id: (x.distance, x.kept) for x in quality_rules(docs(given)).collect() if x.doc_id < 1000}

    assert verdict(rows + other) == verdict(rows)


def brute_mcd(x, coverage):
    """Concentration steps from medians and MADs while the determinant falls: mean, determinant, steps."""
    floor = np.array(list(FLOOR.values()))
    m = np.median(x, axis=0)
    sd = np.maximum(floor, 1.4826 * np.median(abs(x - m), axis=0))
    prec, best, steps = np.diag(1 / sd ** 2), (None, np.inf), 0
    while True:
        d2 = np.einsum("ni,ij,nj->n", x - m, prec, x - m)
        bins = np.floor(np.log2(np.maximum(d2, 1e-9)) * BINS_PER_OCTAVE)
        near = x[bins <= np.sort(bins)[int(np.ceil(coverage * len(x))) - 1]]
        m, c = near.mean(axis=0), np.cov(near.T, bias=True) + np.diag(floor ** 2)
        prec, det, steps = np.linalg.inv(c), np.linalg.slogdet(c)[1], steps + 1
        if det >= best[1] - 1e-9:
            return *best, steps
        best = m, det


def test_mcd_steps_go_on_until_the_determinant_falls_no_more(spark):
    r = np.random.default_rng(0)
    mixed = np.vstack([r.normal(0, 1, (n, 7)) @ r.normal(0, 3, (7, 7)) + at for n, at in ((700, 0), (500, 6))])
    groups = {"mixed": mixed, "narrow": r.normal(0, 1, (200, 7)), "single": np.ones((1, 7))}
    groups = {k: np.round(v * 1000) for k, v in groups.items()}
    rows = [(k, *map(int, x)) for k, v in groups.items() for x in v]
    df = spark.createDataFrame(rows, "key string, " + ", ".join(f"x{i} long" for i in range(7)))
    got = {x.key: x for x in mcd_estimates(df, 0.75).collect()}
    want = {k: brute_mcd(v / 1000, 0.75) for k, v in groups.items() if len(v) > 1}
    assert want["mixed"][2] > 5
    for k, (mean, det, _) in want.items():
        assert np.allclose(got[k].mean, mean) and np.isclose(got[k].det, det) and got[k].n == len(groups[k])
    assert np.allclose(got["single"].mean, 1)


def test_quality_rules_every_group_has_its_own_estimate(docs):
    r = np.random.default_rng(9)
    words = ["".join(r.choice(list("etaoinsh"), int(r.integers(2, 8)))) for _ in range(400)]

    def text():
        return " ".join(r.choice(words, int(r.integers(60, 200))))

    sizes = [1, 5, 20, 60, 99, 101, 300]
    clean = [(1000 * i + k, text(), "en", f"s{i}") for i, n in enumerate(sizes) for k in range(n)]
    loud = [(20_000 + k, text().upper(), "en", "loud") for k in range(90)]  # ordinary in its own group
    junk = [(30_000 + i, " ".join(w + "###" for w in r.choice(words, 100)), "en", s)
            for i, s in enumerate([*(f"s{i}" for i in range(len(sizes))), "loud", "junk", "junk"])]
    got = {x.doc_id: x.kept for x in quality_rules(docs(clean + loud + junk)).collect()}
    assert sum(not got[x[0]] for x in clean) <= 2
    assert all(got[x[0]] for x in loud)
    assert not any(got[x[0]] for x in junk)


@pytest.mark.parametrize("near", [False, True])
def test_quality_rules_copies_do_not_reject_the_rest(docs, near):
    r = np.random.default_rng(7)
    words = ["".join(r.choice(list("etaoinsh"), int(r.integers(2, 8)))) for _ in range(400)]
    rows = [(i, " ".join(r.choice(words, int(r.integers(60, 200)))), "en", "s0") for i in range(200)]
    text = " ".join(r.choice(words, 700))
    copies = [(1000 + i, text + (f" {words[i % 400]}" if near else ""), "en", "s0") for i in range(800)]
    got = {x.doc_id: x.kept for x in quality_rules(docs(rows + copies)).collect()}
    assert sum(got[i] for i in range(200)) >= 199 and all(got[1000 + i] for i in range(800))


def test_token_files_round_trip(spark, docs, enc, texts):
    rows = [(k, t) for k, t in texts.items()]
    df = documents(spark, SF).repartition(7)
    folder = shared_path(spark, "test-tokens")
    shards = write_token_files(df, folder, default_path(), end_id=2, seq_len=64, batch_rows=4)
    got = sorted(read_token_files(spark, shards, "bigint").collect())
    at = 0
    for (k, t), r in zip(sorted(rows), got, strict=True):
        ids = ids_of(enc, t, 2)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (k, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    # Random access gives the same stream, without copies.
    stream = np.concatenate([ids_of(enc, t, 2) for _, t in sorted(rows)])
    at = 0
    for s in sorted(shards.collect()):
        f = TokenFile(s.base)
        for i in (0, s.n_tokens // 64, s.n_tokens // 128):
            ids, mask = f.sequence(i)
            real = min(64, s.n_tokens - i * 64)
            assert (ids[:real] == stream[at + i * 64:at + i * 64 + real]).all() and not ids.flags.owndata
            assert mask.to_pylist() == [True] * real + [False] * (64 - real)
        at += s.n_tokens


def test_token_files_odd_rows(spark, docs, enc):
    shards = write_token_files(docs(ODD), shared_path(spark, "test-tokens"), default_path(), end_id=2)
    got = sorted(read_token_files(spark, shards, "bigint").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 3, 4, 5, 6, 7]
    assert got[1].n_tokens == 1 and got[1].ids_crc32 == zlib.crc32(np.array([2], "<u4").tobytes())
    none = write_token_files(docs([]), shared_path(spark, "test-tokens"), default_path(), end_id=2)
    assert read_token_files(spark, none, "bigint").count() == 0


def check_pieces(rows, want):
    """Every id in exactly one piece; offsets gapless; returns sequence lengths."""
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for doc, ids in want.items():
        at = 0
        for r in sorted(by_doc.pop(doc), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert not by_doc
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    sizes = []
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        sizes.append(at)
    return sizes


def test_packing(spark, enc, texts):
    rows = pack_documents(documents(spark, SF), default_path(), shard_units=16).collect()
    sizes = check_pieces(rows, {k: ids_of(enc, t, 0) for k, t in texts.items()})
    assert all(zlib.crc32(np.frombuffer(r.ids, enc.dtype).astype("<u4").tobytes()) == r.ids_crc32 for r in rows)
    assert max(sizes) == 1024 and sum(s < 1024 for s in sizes) <= 8  # one for each task at most


def test_packing_counts_the_units_that_hold_a_token(docs, enc):
    rows = [(i, " ".join(f"w{j % (i + 2)} the" for j in range(40 * i))) for i in range(30)] + [(99, None)]
    got, n, size = frequencies(encode_units(docs(rows), default_path(), 0, 256, "doc_id", "text"))
    units = [x[len(x) - len(x) % 256:] for x in (ids_of(enc, t, 0) for _, t in rows)]
    units = [u for u in units if len(u)]
    assert got == Counter(k for u in units for k in np.unique(u).tolist())
    assert (n, size) == (len(units), sum(map(len, units)))


def test_packing_joins_similar_documents(docs):
    a, b = "red green blue " * 40, "one two three " * 40
    rows = [(i, a if i % 2 else b) for i in range(12)]
    got = pack_documents(docs(rows).coalesce(1), default_path(), window=512).collect()
    kinds = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        kinds[r.sequence_id].append(r.doc_id % 2)
    assert sum(len(set(k)) == 1 for k in kinds.values()) >= len(kinds) - 2


def test_packing_odd_rows(docs, enc):
    rows = pack_documents(docs(ODD), default_path()).collect()
    assert Counter(r.doc_id for r in rows if r.doc_id == 3)[3] == 2  # repeated rows are packed each
    one = [r for r in rows if r.doc_id == 1]
    assert len(one) == 1 and one[0].length == 1 and one[0].doc_tokens == 1
    check_pieces([r for r in pack_documents(docs([x for x in ODD if x[0] not in (None, 3)]), default_path()).collect()],
                 {x[0]: ids_of(enc, x[1], 0) for x in ODD if x[0] not in (None, 3)})
    assert pack_documents(docs([]), default_path()).count() == 0


def test_mixing(spark, docs, texts):
    got = mix(documents(spark, SF), block_words=16).collect()
    again = mix(documents(spark, SF).repartition(5), block_words=16).collect()
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in again}
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        assert r.size == len(texts[r.doc_id].encode().split()) and 0 <= r.taken <= 3 * r.size
        assert sum(c["words"] for c in r.cuts) == r.size
        assert sum(c["words"] * c["copies"] for c in r.cuts) == r.taken
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.source_size >= r.size
    names = sorted(size)
    assert [target[s] for s in names] == pytest.approx(targets([size[s] for s in names], 3))
    assert all(abs(taken[s] - target[s]) <= 64 + 0.02 * target[s] for s in names)


@pytest.mark.parametrize("group", [4096, 2])
def test_mixing_small_sources_come_near_their_targets(docs, monkeypatch, group):
    from auric.llm import mixing
    monkeypatch.setattr(mixing, "GROUP", group)  # two shards a group: quotas go through both levels
    rows, k = [], 0
    for n_words in (1, 2, 3, 5, 8, 13, 20, 26, 30, 64, 100, 30, 30):
        for part in range(0, n_words, 7):
            rows.append((k, "w " * min(7, n_words - part), "en", f"s{len({r[3] for r in rows if len(r) > 3}) if part == 0 else len({r[3] for r in rows}) - 1:02d}"))
            k += 1
    rows += [(k + i, "word " * (i % 90), "en", "z") for i in range(400)]
    got = mix(docs(rows), shard_docs=16).collect()
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and sum(c["words"] * c["copies"] for c in r.cuts) == r.taken
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert len(size) == 14 and size["s08"] == 30 and size["z"] > 15_000
    assert all(abs(taken[s] - target[s]) <= max(1, 0.04 * target[s]) for s in size), {s: (taken[s], target[s]) for s in size}


def test_mixing_odd_rows(docs):
    got = mix(docs(ODD)).collect()
    assert len(got) == len(ODD)
    assert all(r.taken == 0 and r.size == 0 for r in got if r.doc_id in (1, 2))
    assert all(r.taken <= 3 * r.size for r in got)
    assert mix(docs([])).count() == 0


def test_secret_spans(docs):
    rows = [*ODD, (8, 'api_key: "abcdefgh12"', "en", "s0")]
    got = [(r.doc_id, [tuple(s) for s in r.spans]) for r in secret_spans(docs(rows)).collect()]
    assert (8, [("assign", 0, 20)]) in got and (1, []) in got and len(got) == len(rows)
    assert secret_spans(docs([])).count() == 0


def test_token_counts(docs):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    got = {r.doc_id: r for r in token_counts(docs([*ODD, (9, "the the\x00 the")]), path).collect()}
    assert got[1].n_tokens == 0 and got[2].n_tokens == 0 and got[3].n_tokens == 3 and got[9].n_words == 3
    assert token_counts(docs([]), path).count() == 0


def brute_ctw(train, depth):
    """Sequentially updated context trees, the plain recursive definition."""
    counts = Counter()
    for t in train:
        data = bytes(depth) + t + b"\0"
        for i in range(depth, len(data)):
            for j in range(8):
                prefix, bit = (256 + data[i]) >> (8 - j), data[i] >> (7 - j) & 1
                for d in range(depth + 1):
                    counts[data[i - d:i], prefix, bit] += 1

    def kt(a, b):
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)

    children = defaultdict(set)
    for ctx, prefix, _ in counts:
        if ctx:
            children[ctx[1:], prefix].add(ctx)
    memo = {}

    def weighted(ctx, prefix):
        if (ctx, prefix) not in memo:
            pe = kt(counts[ctx, prefix, 0], counts[ctx, prefix, 1])
            if len(ctx) < depth:
                below = sum(weighted(c, prefix) for c in children[ctx, prefix])
                pe = max(pe, below) + math.log1p(math.exp(-abs(pe - below))) - math.log(2)
            memo[ctx, prefix] = pe
        return memo[ctx, prefix]

    def one(context, prefix, d=0):
        ctx = context[len(context) - d:]
        a, b = counts[ctx, prefix, 0], counts[ctx, prefix, 1]
        p = (b + .5) / (a + b + 1)
        if d == depth:
            return p
        own = math.exp(kt(a, b) - math.log(2) - weighted(ctx, prefix))
        return own * p + (1 - own) * one(context, prefix, d + 1)

    def score(t):
        data = bytes(depth) + t + b"\0"
        total = 0.0
        for i in range(depth, len(data)):
            for j in range(8):
                p = one(data[i - depth:i], (256 + data[i]) >> (8 - j))
                total += math.log10(p if data[i] >> (7 - j) & 1 else 1 - p)
        return total

    return score


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2


def test_context_tree_scores(spark, docs):
    rows = [(i, t) for i, t in enumerate(["abab abba", "aab b", "", None, "Abc é", "bab ab ab", "xyz", "aba\nab"] * 3)]
    want = brute_ctw([(t or "").encode().lower() for i, t in rows if not held(i)], 2)
    words = Counter()
    for i, t in rows:
        if not held(i):
            words.update([*(t or "").lower().split(), ""])
    n, v = sum(words.values()), len(words)
    got = ctw.ctw_scores(docs(rows), depth=2, block_bytes=20).collect()
    assert len(got) == len(rows)
    for r in got:
        t = rows[r.doc_id][1] or ""
        tokens = [*t.lower().split(), ""]
        assert r.score == pytest.approx(want(t.encode().lower()), rel=1e-9)
        assert r.base_score == pytest.approx(sum(math.log10((words[w] + 1) / (n + v + 1)) for w in tokens))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (
            held(r.doc_id), len(tokens), sum(words[w] > 0 for w in tokens), n)
    assert len(ctw.ctw_scores(docs(ODD)).collect()) == len(ODD)
    assert ctw.ctw_scores(docs([])).count() == 0


def test_context_tree_learns_six_bytes(docs):
    """A byte that only the context six before it decides."""
    rows = [(i, "xabcde1 yabcde2 " * 3) for i in range(8)]
    want = brute_ctw([t.encode() for i, t in rows if not held(i)], 6)
    got = ctw.ctw_scores(docs(rows)).collect()
    assert len(got) == 8 and all(abs(r.score - want(rows[0][1].encode())) < 1e-6 for r in got)


def test_context_tree_scores_long_texts(docs):
    """Texts beyond a chunk are cut; their scores are those of the whole tree in one piece."""
    r = random.Random(8)
    long = "".join(r.choices("abc ", k=ctw.CHUNK + 5000))
    rows = [(i, t) for i, t in enumerate(["ab c", long, None, long[::-1], "zz top", long[:700] + " é"])]
    texts = [(t or "").encode() for _, t in rows]
    training = [not held(i) for i, _ in rows]
    keys, counts = ctw.count_strings(texts, training, 6)
    above = ctw.upper(*ctw.top_nodes(keys, counts, 6), 3)
    value = ctw.values(keys, counts, 6, above)
    got = {x.doc_id: x for x in ctw.ctw_scores(docs(rows)).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(texts):
        data = np.frombuffer(bytes(6) + t + b"\0", np.uint8).astype(np.uint64)
        key = sum((data[6 - d:len(data) - d] << np.uint64(8 * (7 - d)) for d in range(1, 7)), data[6:])
        assert got[i].score == pytest.approx(value[np.searchsorted(keys, key)].sum(), rel=1e-9)
        assert got[i].n_bytes == len(t) and got[i].n_tokens == len(t.split()) + 1


def brute_removed(rows, threshold):
    seen, out = set(), {}
    for k, t in sorted(rows):
        data = (t or "").encode()
        spans = []
        for p in range(len(data) - threshold + 1):
            w = data[p:p + threshold]
            if w in seen:
                spans.append((p, p + threshold))
            seen.add(w)
        runs, kept = cut(data, spans)
        out[k] = (len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(spark, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in suffix_dedup(documents(spark, SF)).collect()}
    assert got == brute_removed(texts.items(), 100)


def test_suffix_dedup_on_dense_repeats(docs, monkeypatch):
    """Few letters, short threshold: repeats of every kind, within and between texts."""
    r = np.random.default_rng(8)
    parts = ["".join(r.choice(list("ab"), int(r.integers(3, 40)))) for _ in range(12)]
    rows = [(i, "".join(r.choice(parts, int(r.integers(0, 9))))) for i in range(60)]
    rows += [(70, "a" * 300), (71, "ab" * 100), (72, "b" + "a" * 50), (73, None), (74, "")]
    for threshold, core in ((20, 8), (12, 5)):
        got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256)
               for x in suffix_dedup(docs(rows), threshold=threshold, core=core).collect()}
        assert got == brute_removed(rows, threshold)


def test_suffix_dedup_odd_rows(docs):
    got = [(x.doc_id, x.n_bytes, x.n_removed) for x in suffix_dedup(docs(ODD)).collect()]
    n = len(LONG)  # one period of 18 bytes stays of the first long text, and what starts no repeat
    assert sorted(got, key=str) == sorted(
        [(1, 0, 0), (2, 0, 0), (3, 5, 0), (3, 5, 0), (4, 7, 0), (None, 10, 0), (5, 10, 0), (6, n, n - 18),
         (7, n, n)], key=str)
    assert suffix_dedup(docs([])).count() == 0


def test_queries_have_one_entry_per_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


def test_stage_leaves_no_setting_behind(spark):
    before = dict(spark.sparkContext.getConf().getAll())
    assert stage(spark.range(3), "test").count() == 3
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") in ("false", None)
    assert dict(spark.sparkContext.getConf().getAll()) == before


def brute_base(text):
    """The base patterns by the contract's words, position by position where that is plain."""
    import re
    text = text or ""
    spans = []
    for kind, pattern, group, least in (
            ("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|"""
                       r"""[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
            ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32)):
        at = 0
        while m := re.compile(pattern).search(text, at):
            if len(m.group(group)) >= least:
                spans.append((m.start(), ("assign", "access", "hex").index(kind), kind, m.end()))
            at = m.end()
    return sorted(spans)


def test_base_patterns_on_documents(spark, texts):
    got = {r.doc_id: r for r in QUERIES["op1_secret_scan"](spark, SF).collect()}
    assert got.keys() == texts.keys()
    for d, t in texts.items():
        want = brute_base(t)
        assert got[d].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{e}" for a, _, k, e in want).encode()).hexdigest()
        assert (got[d].n_assign, got[d].n_access, got[d].n_hex) == tuple(
            sum(x[2] == k for x in want) for k in ("assign", "access", "hex"))


def test_suffix_dedup_of_texts_that_share_an_id(docs):
    r = np.random.default_rng(4)
    a, b, c = ("".join(r.choice(list("abcdefgh"), 300)) for _ in range(3))
    rows = [(0, a), (1, a), (1, b), (1, b), (2, b + c), (3, c), (None, c)]
    got = sorted((str(x.doc_id), x.n_bytes, x.n_removed) for x in suffix_dedup(docs(rows)).collect())
    assert got == sorted([("0", 300, 0), ("1", 300, 300), ("1", 300, 0), ("1", 300, 0), ("2", 600, 600), ("3", 300, 300),
                          ("None", 300, 0)])
