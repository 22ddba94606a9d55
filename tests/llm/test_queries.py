"""The registered queries on the smallest tables: columns, flags and laws of their results."""

import hashlib
import math
import os
import re
import zlib
from collections import defaultdict

import pytest

from grainfield.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name, columns):
    found = queries.queries()[name](spark, SF)
    assert [(c, k) for c, k in found.dtypes][: len(columns)] == columns
    return found.collect()


def crc(k):
    return zlib.crc32(str(k).encode())


def test_quality(spark, texts):
    rows = run(spark, "op1_quality", [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")])
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(r.held_out == (crc(r.doc_id) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_secrets(spark, texts):
    rows = run(spark, "op2_secrets", [("doc_id", "bigint"), ("n_assign", "bigint"), ("n_access", "bigint"), ("n_hex", "bigint"), ("base_sha256", "string"), ("spans", "string")])
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()
        kinds = [x.split(":")[0] for x in r.spans.split(",") if x]
        assert [kinds.count(k) for k in ("assign", "access", "hex")] == [r.n_assign, r.n_access, r.n_hex]


def test_language(spark, texts):
    rows = run(spark, "op3_language", [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")])
    known = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts) and all(r.held_out == (crc(r.doc_id) % 4 == 2) for r in rows)
    assert {r.lang_pred for r in rows} <= {*known.values(), "und"}
    held = [r for r in rows if r.held_out and known[r.doc_id] and any(c.isalpha() for c in texts[r.doc_id] or "")]
    assert sum(r.lang_pred == known[r.doc_id] for r in held) >= 0.95 * len(held)


def test_top_k(spark):
    rows = run(spark, "op4_topk", [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")])
    vectors = {r.vec_id: [math.floor(64 * x) for x in r.embedding] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    got = defaultdict(list)
    for r in rows:
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == {k for k in vectors if k % 20 == 0}
    for q in sorted(got)[:5]:
        best = sorted((-sum(a * b for a, b in zip(vectors[q], v, strict=True)), k) for k, v in vectors.items() if k != q)[:20]
        assert sorted(got[q]) == [(n + 1, k, -s) for n, (s, k) in enumerate(best)]


def test_decontaminate(spark, texts):
    rows = run(spark, "op5_decontaminate", [("doc_id", "bigint"), ("n_words", "bigint"), ("n_hit", "bigint"), ("n_items", "bigint"), ("items_sha256", "string"), ("contaminated", "boolean")])
    for r in rows:
        assert r.n_words == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[r.doc_id] or "")))
        assert r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words)
    assert any(r.contaminated for r in rows)


def test_lines(spark, texts):
    rows = queries.op6_linededup(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        old = texts[r.doc_id]
        assert r.n_lines == (len(old.split("\n")) if old is not None else 0)
        assert old is None or r.n_removed == r.n_lines or len(r.text.split("\n")) == r.n_lines - r.n_removed


def test_simhash(spark, texts):
    rows = run(spark, "op7_simhash", [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")])
    assert sorted(r.doc_id for r in rows) == sorted(texts) and all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) for r in rows)
    prints = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    root = {k: k for k in prints}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    assert {r.doc_id: r.component_id for r in rows} == {k: top(k) for k in ids}


def test_pieces(spark, texts):
    rows = queries.op8_sentencepiece(spark, SF).collect()
    assert len(rows) == len(texts) and all(r.round_trip and r.decoded == texts[r.doc_id] for r in rows)


def test_model(spark, texts):
    rows = run(spark, "op9_lm", [("doc_id", "bigint"), ("held_out", "boolean"), ("n_tokens", "bigint"), ("n_known", "bigint"), ("train_tokens", "bigint"), ("base_score", "double"), ("score", "double")])
    words = {k: [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x] + ["\0end"] for k, t in texts.items()}
    counts = defaultdict(int)
    for k, w in words.items():
        for x in w if crc(k) % 7 != 2 else ():
            counts[x] += 1
    total, kinds = sum(counts.values()), len(counts)
    for r in rows:
        w = words[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(r.doc_id) % 7 == 2, len(w), sum(x in counts for x in w), total)
        base = sum(math.log10((counts.get(x, 0) + 1) / (total + kinds + 1)) for x in w)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0


def test_sharding(spark, texts):
    rows = run(spark, "op10_sharding", [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")])
    loads, places = defaultdict(int), defaultdict(list)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        loads[r.shard] += r["size"]
        places[r.shard].append(r.slot)
    assert sorted(r.doc_id for r in rows) == sorted(texts) and all(sorted(x) == list(range(len(x))) for x in places.values())
    largest = max(r["size"] for r in rows)
    assert max(loads.values()) - min(loads.get(k, 0) for k in range(40)) <= largest and set(places) <= set(range(40))
