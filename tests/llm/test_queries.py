"""Every registered query runs over whole tables; those with SQL give the SQL's rows, the others a brute force's."""
import base64
import collections
import hashlib
import os
import re
import struct
import zlib

import duckdb
import public_tokenizers as tokens
import pytest
import tiktoken

import __spark_entry__ as entry
from waymesh.llm import bpe, queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


@pytest.fixture(scope="module")
def docs(duck):
    return duck.execute("select doc_id, text, lang, source from documents").fetchall()


def run(spark, name):
    df = entry.queries()[name](spark, DATA)
    return df.columns, [tuple(r) for r in df.collect()]


def test_all_are_registered():
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in queries.queries()}
    assert "pipeline" in entry.queries() and set(queries.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, duck, name):
    columns, got = run(spark, name)
    sql = duck.execute(queries.oracle_sql()[name])
    names = [x[0] for x in sql.description]
    assert sorted(names) == sorted(columns)
    want = [tuple(row[names.index(c)] for c in columns) for row in sql.fetchall()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and got


def test_op1(spark, docs):
    columns, got = run(spark, "op1_language_id")
    at = columns.index
    assert len(got) == len(docs)
    lang = {d[0]: d[2] for d in docs}
    held = [r for r in got if r[at("held_out")]]
    assert all(r[at("held_out")] == (zlib.crc32(str(r[0]).encode()) % 4 == 2) for r in got)
    assert sum(r[at("lang_pred")] == lang[r[0]] for r in held) >= 0.97 * len(held)


def test_op2(spark, docs):
    columns, got = run(spark, "op2_byte_bpe")
    with open(tokens.path(queries.VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(x): int(y) for x, y in (line.split() for line in lines)}
    whole = tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for doc, text, _, _ in docs:
        ids = whole.encode_ordinary(text or "")
        want[doc] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    at = columns.index
    assert {r[0]: (r[at("n_tokens")], r[at("ids_sha256")], r[at("decoded_sha256")]) for r in got} == want


def test_op4(spark, docs):
    columns, got = run(spark, "op4_suffix_dedup")
    seen, want = set(), {}
    for doc, text, _, _ in sorted(docs):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            piece = raw[i : i + 100]
            if piece in seen:
                gone[i : i + 100] = b"\x01" * 100
            seen.add(piece)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        want[doc] = (len(raw), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    at = columns.index
    assert {r[0]: tuple(r[at(c)] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in got} == want


def test_op5(spark, docs):
    columns, got = run(spark, "op5_source_mix")
    at = columns.index
    size = {d[0]: len(WORD.findall(d[1] or "")) for d in docs}
    of = {d[0]: d[3] for d in docs}
    total = collections.Counter()
    for d in docs:
        total[d[3]] += size[d[0]]
    sources = sorted(total, key=lambda s: (s is None, s or ""))
    weight, left, target = {s: k % 3 + 1 for k, s in enumerate(sources)}, sum(total.values()), {}
    open_ = set(sources)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * total[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * total[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    taken = collections.Counter()
    for r in got:
        assert r[at("size")] == size[r[0]] and r[at("source_size")] == total[of[r[0]]] and 0 <= r[at("taken")] <= 3 * size[r[0]]
        assert r[at("target")] == pytest.approx(target[of[r[0]]])
        taken[of[r[0]]] += r[at("taken")]
    # whole documents, ten in a source here: one of them is half of its source
    assert len(got) == len(docs) and all(abs(taken[s] - target[s]) <= 0.05 * target[s] for s in sources)


KINDS = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)), ("access", re.compile("AKIA[A-Z0-9]+")), ("hex", re.compile("[0-9a-f]+"))]


def test_op7(spark, docs):
    columns, got = run(spark, "op7_secrets")
    at, want = columns.index, {}
    for doc, text, _, _ in docs:
        found = []
        for k, (kind, pattern) in enumerate(KINDS):
            for m in pattern.finditer(text or ""):
                if (len(m[2]) >= 6) if kind == "assign" else len(m[0]) >= (20 if kind == "access" else 24):
                    found.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
        n = collections.Counter(k for _, k, _ in found)
        want[doc] = (n[0], n[1], n[2], hashlib.sha256(",".join(x for _, _, x in sorted(found)).encode()).hexdigest())
    assert {r[0]: tuple(r[at(c)] for c in ("n_assign", "n_access", "n_hex", "base_sha256")) for r in got} == want


def test_op10(spark, docs):
    columns, got = run(spark, "op10_token_counts")
    encoder = bpe.Encoder(tokens.path(queries.VOCABULARY), tokens.PATTERN)
    sizes = collections.Counter(len(encoder.encode(d[1] or "")) // 4 for d in docs)
    at = columns.index
    assert {r[at("n_tokens")]: r[at("n_docs")] for r in got} == dict(sizes)


def test_op12(spark, duck, docs):
    columns, got = run(spark, "op12_quality_classifier")
    at = columns.index
    quality = dict(duck.execute("select doc_id, quality from labels where quality is not null").fetchall())
    assert len(got) == len(docs) and all(0 <= r[at("score")] <= 1 and r[at("predicted")] == int(r[at("score")] >= 0.3) for r in got)
    held = [r for r in got if r[at("held_out")] and r[0] in quality]
    assert held and sum(r[at("predicted")] == quality[r[0]] for r in held) >= 0.9 * len(held)
