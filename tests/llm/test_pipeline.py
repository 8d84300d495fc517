"""The corpus pipeline, stage by stage, against brute force; and on odd rows."""
import zlib
from collections import defaultdict

import numpy as np

import corpus_pipeline as cp
from auric.llm.common import documents, stage
from auric.llm.exact_dedup import exact_dedup
from auric.llm.mixing import mix
from auric.llm.quality_rules import quality_rules
from auric.llm.simhash import fingerprint
from auric.llm.tokens import Encoder, default_path

from .conftest import SF
from .test_operators import ODD, brute_classes, check_pieces, ids_of

SPACE = " \t\n\v\f\r"


def squeeze(text):
    return "".join(c for c in text or "" if c not in SPACE)


def test_stages_against_brute_force(spark):
    docs = documents(spark, SF)
    assert [n for n, _ in cp.STAGES] == ["quality", "exact_dedup", "simhash_dedup", "mixing", "packing"]
    before = {r.doc_id: r for r in docs.collect()}

    docs = stage(cp.quality(spark, docs, SF), "t")
    assert docs.columns == documents(spark, SF).columns
    verdict = {r.doc_id: r.kept for r in quality_rules(documents(spark, SF)).collect()}
    rows = {r.doc_id: r for r in docs.collect()}
    assert rows == {k: r for k, r in before.items() if verdict[k]} and 0 < len(rows) < len(before)

    docs = stage(cp.exact(spark, docs, SF), "t")
    groups = defaultdict(list)
    for r in rows.values():
        groups[squeeze(r.text)].append(r)
    want = {min(g, key=lambda r: (-len(r.text), r.doc_id)).doc_id for g in groups.values()}
    rows = {r.doc_id: r for r in docs.collect()}
    assert set(rows) == want and docs.columns == documents(spark, SF).columns

    docs = stage(cp.near(spark, docs, SF), "t")
    classes = brute_classes([(k, fingerprint(r.text)) for k, r in rows.items()], 2)
    rows = {r.doc_id: r for r in docs.collect()}
    assert set(rows) == set(classes.values())

    taken = {r.doc_id: r for r in mix(docs).collect()}
    docs = stage(cp.mixing(spark, docs, SF), "t")
    assert docs.columns == documents(spark, SF).columns
    words = defaultdict(int)
    for r in docs.collect():
        assert r.n_chars == len(r.text) and (r.lang, r.source) == (rows[r.doc_id].lang, rows[r.doc_id].source)
        if taken[r.doc_id].taken % taken[r.doc_id].size == 0 and len(taken[r.doc_id].cuts) == 1:
            assert r.text == rows[r.doc_id].text
        words[r.doc_id] += len(r.text.encode().split())
    assert words == {k: r.taken for k, r in taken.items() if r.taken}

    enc = Encoder(default_path())
    mixed = [ids_of(enc, r.text, 0) for r in docs.collect()]
    pieces = cp.packing(spark, docs, SF).collect()
    assert sum(p.length for p in pieces) == sum(map(len, mixed))
    seqs = defaultdict(int)
    for p in pieces:
        seqs[p.sequence_id] += p.length
    assert max(seqs.values()) == 1024 and sum(n < 1024 for n in seqs.values()) <= 8


def test_run_gives_the_packing_of_all_stages(spark):
    got = cp.run(spark, SF)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    assert all(zlib.crc32(np.frombuffer(r.ids, "<u2").astype("<u4").tobytes()) == r.ids_crc32 for r in got.collect())
    assert got.count() > 0 and cp.ORACLE_SQL is None


def test_odd_rows_and_empty_tables(spark, docs):
    good = [(100 + i, f"text number {i} has some words of its own to pass, {'x' * i} and {i * i}", "en", "s0")
            for i in range(15)]
    rows = [*ODD, *good, good[0], (None, "a row without an id but with words enough to stay in the corpus", None, None)]
    now = docs(rows)
    cols = now.columns
    for name, step in cp.STAGES[:-1]:
        now = stage(step(spark, now, ""), "t")
        assert now.columns == cols, name
        ids = [r.doc_id for r in now.collect()]
        assert None not in ids
        if name == "exact_dedup":
            assert sorted(i for i in ids if i >= 100) == [100 + i for i in range(15)]
            assert len([i for i in ids if i < 0]) == 1
    assert cp.packing(spark, now, "").count() > 0
    now = docs([])
    for name, step in cp.STAGES:
        now = stage(step(spark, now, ""), "t")
        assert now.count() == 0


def test_exact_keeps_different_texts_with_one_id(spark, docs):
    rows = [(1, "one text"), (1, "another text, longer"), (2, "another  text,  longer "), (3, "third")]
    got = stage(cp.exact(spark, docs(rows), ""), "t").collect()
    assert sorted(r.text for r in got) == ["another  text,  longer ", "one text", "third"]
    rows = [(1, "one text"), (1, "another text, longer")]
    got = {r.text: r.doc_id for r in stage(cp.exact(spark, docs(rows), ""), "t").collect()}
    assert got["another text, longer"] == 1 and got["one text"] < 0


def test_columns_with_the_names_of_helpers(spark):
    docs = documents(spark, SF).limit(120)
    names = ["cuts", "row_key", "text_sha", "row_no", "is_first", "kept", "size", "fingerprint"]
    odd = docs.withColumns({n: cp.F.concat(cp.F.lit(n), cp.F.col("doc_id").cast("string")) for n in names})
    for _, step in cp.STAGES[:-1]:
        docs, odd = stage(step(spark, docs, SF), "t"), stage(step(spark, odd, SF), "t")
        assert sorted(map(str, odd.select(docs.columns).collect())) == sorted(map(str, docs.collect()))
        assert all(r[n] == n + str(r.doc_id) for r in odd.collect() for n in names if r.doc_id >= 0)
    out = cp.packing(spark, odd, SF).collect()
    enc = Encoder(default_path())
    assert all(len(r.ids) == r.length * enc.dtype.itemsize for r in out)
