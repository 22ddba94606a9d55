"""The pipeline's near-copy stage against brute force on five-word sets."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from grainfield.llm import shingles


def words_of(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()


def brute(rows, hashes):
    """Rows that stay: of each component of similar texts the one with the smallest (id, text hash), null ids last."""
    sets = []
    for _, t in rows:
        w = words_of(t)
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or both and 5 * both >= 4 * len(sets[a] | sets[b]):
                group[root(a)] = root(b)
    best = {}
    for k, (i, t) in enumerate(rows):
        key = (i is None, i or 0, hashes[t])
        if root(k) not in best or key < best[root(k)][0]:
            best[root(k)] = (key, (i, t))
    return sorted((v for _, v in best.values()), key=str)


def test_near_copies_against_brute_force(spark):
    rng = random.Random(12)
    base = [[f"w{rng.randrange(300)}" for _ in range(rng.randint(1, 200))] for _ in range(60)]
    rows = [(k, " ".join(w)) for k, w in enumerate(base)]
    for k in range(200):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 8])):
            w[rng.randrange(len(w))] = f"v{rng.randrange(5000)}"
        rows.append((1000 + k, rng.choice([" ", "\n", "  "]).join(w).replace("w1", "W1")))
    boiler = " ".join(f"b{k}" for k in range(30))
    rows += [(2000 + k, f"{boiler} " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.choice([3, 40])))) for k in range(60)]
    rows += [(5000, None), (5001, ""), (5002, " \t"), (None, rows[3][1]), (None, "only here"), (7, rows[8][1]), (7, rows[8][1]), (5003, "a b c"), (5004, "A b  c")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int").repartition(3)
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    want = brute(rows, hashes)
    assert len(want) < len(rows) - 60
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == want
    few = shingles.representatives(docs, buckets=512)
    assert sorted(((r.doc_id, r.text) for r in few.collect()), key=str) == want
    assert shingles.representatives(docs.limit(0)).count() == 0


def test_stage_links_fingerprints(spark, monkeypatch):
    """Fingerprints of five-word shingles are linked by deletion variants, and what is linked is held against whole sets."""
    entries = spark.createDataFrame([(5, 0b1011), (3, 0b1011), (9, 0b1000), (7, 0b111 << 40)], "h long, fp long")
    assert sorted(tuple(r) for r in shingles.fingerprint_pairs(entries).collect()) == [(3, 5), (3, 9)]
    asked = []
    monkeypatch.setattr(shingles, "links", lambda fps, links=shingles.links: asked.append(fps.count()) or links(fps))
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(400)) for _ in range(6)]
    rows = list(enumerate([*texts, *(t.replace(" w1", " v1", 2) for t in texts), texts[0], None]))
    docs = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 13]
    assert asked and asked[0] >= 7


def test_sketches_leave_whole_sets_to_pairs_that_may_be_similar(spark, monkeypatch):
    rng = random.Random(5)
    rows = []  # (h, set): sizes on both sides of a sketch's steps, and differences on both sides of the limit
    for n in (1, 3, 4, 10, 60, 63, 64, 65, 70, 130, 256, 257, 300, 1000):
        base = [rng.getrandbits(64) for _ in range(n)]
        for gone, new in ((0, 0), (n // 9, n // 9), (n // 5, 0), (0, n // 4), (n // 4, n // 4), (n // 2, n // 2), (n, n)):
            rows.append(base[gone:] + [rng.getrandbits(64) for _ in range(new)])
    rows = [(h, np.unique(np.array(x, np.uint64))) for h, x in enumerate(rows) if x]
    table = [(h, len(s), shingles.sketch(s).tolist()) for h, s in rows]
    sketches = spark.createDataFrame(table, "h long, n int, sketch array<long>")
    every = [(a, b) for a, _ in rows for b, _ in rows if a < b]
    sets = {h: set(s.tolist()) for h, s in rows}
    similar = {(a, b) for a, b in every if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    found = {(r.a, r.b) for r in shingles.alike(spark.createDataFrame(every, "a long, b long"), sketches).collect()}
    assert similar <= found and len(found) < 2 * len(similar)

    # 40 texts with one rare passage in common: each pair has a first shared shingle, and none is similar
    asked, verified = [], shingles._verified

    def counted(pairs, sets):
        asked.append(pairs.count())
        return verified(pairs, sets)

    monkeypatch.setattr(shingles, "_verified", counted)
    texts = [" ".join(["one rare passage of several words", *(f"u{rng.randrange(10**9)}" for _ in range(80))]) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert corpus_pipeline.near_duplicate_stage(spark, docs, "").count() == 40
    assert sum(asked) == 0
