"""Each corpus operator against brute force on small tables with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainfield.llm import decontaminate, langid, linededup, lm, pieces, quality, secrets, sharding, shingles, simhash, topk
from grainfield.llm.shared import crc_mod

DOCS = "doc_id long, text string, lang string, fp long, n_lines int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau".split()


def rows(seed=1, n=60):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        lines = [" ".join(rng.choices(WORDS, k=rng.randint(1, 30))) for _ in range(rng.randint(1, 5))]
        out.append((k, "\n".join(lines), rng.choice(["en", "de", None]), 7, 3))
    texts = [r[1] for r in out]
    out += [(100, None, "en", 1, 1), (101, "", None, 1, 1), (102, " \t\n ", "en", 1, 1), (103, texts[3], "en", 1, 1), (103, texts[3], "en", 1, 1)]
    out += [(104, texts[5].replace("alpha", "Alpha "), "de", 1, 1), (None, texts[7] + " one more", "en", 1, 1), (105, " ".join(rng.choices(WORDS, k=20_000)), "en", 1, 1)]
    out += [(106, "über straße 😀 " * 5, "de", 1, 1), (1, "another text of the same id", "en", 1, 1)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def key(id, text):
    return (str(id), text or "")


def test_sharding(spark, docs, none):
    found = sharding.shard(docs, 7).collect()
    assert len(found) == docs.count()
    by = defaultdict(list)
    for r in found:
        by[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    sizes = sorted((r.size, r.text_crc32) for r in found)
    assert sizes == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t, *_ in rows())
    assert sharding.shard(none, 7).count() == 0


@pytest.mark.parametrize("id", [5, None])
def test_sharding_of_one_id(spark, id):
    table = spark.createDataFrame([(id, "the same text " * 70)] * 400 + [(k, f"text {k} " * 30) for k in range(500)], "size long, shard string")
    found = sharding.shard(table, 8, "size", "shard").collect() if id is None else sharding.shard(table.toDF("doc_id", "text"), 8).collect()
    loads, places = Counter(), defaultdict(list)
    for r in found:
        loads[r.shard] += r["size"] if id is not None else 1
        places[r.shard].append(r.slot)
    assert len(found) == 900 and all(sorted(x) == list(range(len(x))) for x in places.values())
    if id is not None:
        assert max(loads.values()) - min(loads.values()) <= 0.02 * sum(loads.values()) / 8


def test_own_columns_stay(spark):
    """Operators that return the columns of docs keep them, whatever their names."""
    derived = "score predicted stats n_words items n_hit spans hits contaminated n_lines n_removed gone th line_no h n prefix".split()
    data = [(k, f"line one of {k} and {k * 7}\nsecond {k} {k + 1} {k + 2}\nshared line of all the texts") + (7.0,) * len(derived) for k in range(30)]
    table = spark.createDataFrame(data, "doc_id long, text string, " + ", ".join(f"{c} double" for c in derived))
    bench = spark.createDataFrame([(1, "line one of 3 and 21")], "item_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(30)], "doc_id long, quality int")
    model, _ = quality.train(table, labels, held_out=None)
    for name, found in {
        "reject": quality.reject(table, model),
        "remove": decontaminate.remove(table, bench),
        "clean": linededup.clean(table, buckets=64),
        "representatives": shingles.representatives(table),
    }.items():
        assert found.columns == table.columns, name
        got = found.collect()
        assert got and all(r[c] == 7.0 for r in got for c in derived), name
    assert {r.doc_id for r in decontaminate.remove(table, bench).collect()} == set(range(30)) - {3}
    kept = {r.doc_id: r.text for r in linededup.clean(table, buckets=64).collect()}
    assert "shared" in kept[0] and not any("shared" in kept[k] for k in range(1, 30))


def test_slot_map_edits(spark):
    rng = random.Random(3)
    weights = [rng.randint(1, 1000) for _ in range(2000)]
    one = sharding.SlotMap.first(10, 2000)
    two = one.rebalanced(weights)
    loads = two.loads(weights)
    assert max(loads) - min(loads) <= 0.001 * sum(loads) / 10 + 1
    three = two.grown(weights)
    assert three.version == 3 and {three.of[s] for s in two.moved(three)} == {10}
    grown = three.loads(weights)
    assert max(grown) / (sum(grown) / 11) < 1.05
    path = sharding.save_map(spark, [one, two, three])
    assert sharding.load_map(spark, path) == three and sharding.load_map(spark, path, 1).of == one.of


def test_top_k(spark):
    rng = np.random.default_rng(5)
    data = [(k, [float(x) for x in rng.integers(-3, 4, 6) / 8]) for k in range(150)]
    data += [(k, [0.5] * 6) for k in range(150, 260)] + [(260, None), (261, [0.1, None, 0.2, 0.3, 0.1, 0.0]), (262, [math.nan] * 6), (263, [math.inf] * 6), (None, [0.1] * 6), (264, [0.1]), (180, [0.5] * 6)]
    table = spark.createDataFrame([(a, b, 1) for a, b in data], "vec_id long, embedding array<float>, score int").repartition(5)
    good = [(a, [math.floor(64 * np.float32(x)) for x in b]) for a, b in data if a is not None and b and len(b) == 6 and all(x is not None and math.isfinite(x) for x in b)]
    want = set()
    for q in {a for a, _ in good if a % 20 == 0}:
        v = next(b for a, b in good if a == q)
        best = sorted(((-sum(x * y for x, y in zip(v, b)), a) for a, b in good if a != q))[:20]
        want |= {(q, k + 1, a, -s) for k, (s, a) in enumerate(best)}
    for block in (4, 1000):
        found = [tuple(r) for r in topk.top_k(table, lambda c: c % 20 == 0, block=block).collect()]
        assert len(found) == len(set(found)) and set(found) == want
    assert topk.top_k(table.limit(0), lambda c: c % 20 == 0).count() == 0
    few = topk.top_k(table.where("vec_id < 5"), lambda c: c % 20 == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3, 4]


def test_decontamination(spark, docs, none):
    rng = random.Random(2)
    texts = [t for _, t, *_ in rows() if t]
    items = [("a", " ".join(texts[0].split()[:14])), ("b", " ".join(texts[9].split()[2:40])), ("c", "über STRASSE straße"), ("c", "kappa, kappa!"), (None, " ".join(texts[20].split()[:20])), ("d", ""), ("e", None), ("f", " ".join(rng.choices(WORDS, k=30)))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    for part_bytes in (1 << 20, 100):
        found = decontaminate.hits(docs, bench, part_bytes=part_bytes)
        assert found.columns[:3] == ["doc_id", "text", "lang"]
        for r in found.collect():
            w = decontaminate.words((r.text or "").encode())
            hit, names = set(), set()
            for name, t in items:
                i = decontaminate.words((t or "").encode())
                n = min(13, len(i))
                windows = {tuple(i[k : k + n]) for k in range(len(i) - n + 1)} if n else set()
                for p in range(len(w) - n + 1):
                    if tuple(w[p : p + n]) in windows:
                        hit |= set(range(p, p + n))
                        names |= {name} - {None}
            assert (r.n_words, r.n_hit, r.n_items) == (len(w), len(hit), len(names))
            assert r.items_sha256 == hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
            assert r.contaminated == (bool(hit) and 20 * len(hit) >= len(w))
    assert decontaminate.hits(none, bench).count() == 0
    assert decontaminate.hits(docs, bench.limit(0)).where("contaminated or n_hit > 0").count() == 0
    assert decontaminate.remove(docs, bench).columns == docs.columns


def test_longest_matches():
    s = decontaminate.suffixes([(1, "a b c d e f g h")], 3)
    sizes, found = decontaminate.matches([b"x b c d e f y", b"f g h"], s, 3)
    assert sizes == [7, 3]
    assert (0, 1, 5) in {(d, w, n) for d, w, _, n in found} and (1, 0, 3) in {(d, w, n) for d, w, _, n in found}


def test_simhash(spark, docs, none):
    found = simhash.near_duplicates(docs).collect()
    texts = [(i, t) for i, t, *_ in rows()]
    import xxhash

    def fp(t):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sh = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fp(t) for _, t in texts]
    group = list(range(len(fps)))
    for _ in range(len(fps)):
        for a in range(len(fps)):
            for b in range(len(fps)):
                if (fps[a] ^ fps[b]).bit_count() <= 2:
                    group[a] = min(group[a], group[b])
    least = {}
    for g, (i, _) in zip(group, texts):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    want = sorted((str(i), f"{x:016x}", least.get(g)) for (i, _), x, g in zip(texts, fps, group))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in found) == want
    kept = simhash.representatives(docs)
    assert kept.count() == len(set(group)) and kept.columns == docs.columns
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("hot", [2, 128])
def test_simhash_links(spark, hot):
    rng = random.Random(4)
    fps = set()
    for _ in range(20):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(30):
            fps.add(x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), hot=hot).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert found == want


def test_components_of_a_long_chain(spark):
    found = simhash.components(spark.range(60).selectExpr("id as a", "id + 1 as b")).collect()
    assert {r.node for r in found} == set(range(1, 61)) and {r.root for r in found} == {0}


def test_line_dedup(spark, docs, none):
    rng = random.Random(6)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.randint(1, 40))) for _ in range(60)]
    extra = []
    for k in range(200):
        lines = []
        for _ in range(rng.randint(1, 6)):
            w = rng.choice(base).split()
            for _ in range(rng.choice([0, 0, 1, 2, 8])):
                w[rng.randrange(len(w))] = f"v{rng.randrange(5000)}"
            lines.append(rng.choice(["", " ", "\t"]) + rng.choice([" ", "\r", "  "]).join(w).replace("w1", "F1"))
        extra.append((1000 + k, "\n".join(lines), None, 1, 1))
    table = docs.unionByName(spark.createDataFrame(extra, DOCS))
    all_rows = [(i, t) for i, t, *_ in rows() + extra]
    earlier, gone = [], set()
    from pyspark.sql.functions import xxhash64

    hashes = {r.text: r.h for r in table.select("text", xxhash64("text").alias("h")).collect()}
    order = sorted({(i is not None, i or 0, hashes[t], t) for i, t in all_rows if t is not None})
    for some, i, h, t in order:
        for k, line in enumerate(t.split("\n")):
            s = frozenset(re.sub(r"[\t\r\x0b\x0c]", " ", line.lower()).split(" ")) - {""}
            if s and any(5 * len(s & e) >= 4 * len(s | e) for e in earlier):
                gone.add((i if some else None, t, k))
            elif s:
                pass
            if s:
                earlier.append(s)
    for r in linededup.dedup(table.withColumn("old", F.col("text")), buckets=64).collect():
        if r.old is None:
            assert r.text is None and r.n_removed == 0
            continue
        lines = r.old.split("\n")
        assert r.text == "\n".join(x for k, x in enumerate(lines) if (r.doc_id, r.old, k) not in gone)
        assert r.n_lines == len(lines)
    assert linededup.dedup(none, buckets=64).count() == 0


def brute_secrets(t):
    rules = [
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
    ]
    found = sorted((m.start(), k, m.end()) for k, (_, p, fits) in enumerate(rules) for m in p.finditer(t or "") if fits(m))
    return ",".join(f"{rules[k][0]}:{a}:{b}" for a, k, b in found)


def test_secrets(spark, none):
    rng = random.Random(8)
    bits = ["password", "API_KEY", "apikey", "token", ": ", "=", "'", '"', "  ", "AKIA", "ABCDEFGH12345678", "deadbeef" * 4, "abc12345", "é😀", "\n", ".", "a", "0" * 31]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 40))) for _ in range(300)] + [None, "", "token=short", "x" * 5000 + "secret: abcdefgh"]
    table = spark.createDataFrame([(k, t, "p") for k, t in enumerate(texts + texts[:20])], "doc_id long, text string, blob string")
    ledger = None
    from grainfield.llm.shared import new_path

    ledger = new_path(spark, "test-ledger")
    first = secrets.scan(table.where("doc_id < 150"), ledger=ledger)
    assert first.count() == 150
    before = spark.read.parquet(ledger).count()
    found = secrets.scan(table, ledger=ledger).select("doc_id", secrets.spans(F.col("found")).alias("s")).collect()
    assert {r.doc_id: r.s for r in found} == {k: brute_secrets(t) for k, t in enumerate(texts + texts[:20])}
    after = spark.read.parquet(ledger)
    assert after.count() == len({t or "" for t in texts}) and before < after.count() and after.select("blob").distinct().count() == after.count()
    secrets.scan(table, ledger=ledger).count()
    assert spark.read.parquet(ledger).count() == after.count()  # nothing new, nothing scanned
    newer = (*secrets.RULES[:2], secrets.Rule("hex", "[0-9a-f]+", 0, 32, version=2))
    again = secrets.scan(table, ledger=ledger, rules=newer).select("doc_id", secrets.spans(F.col("found"), newer).alias("s")).collect()
    assert {r.doc_id: r.s for r in again} == {r.doc_id: r.s for r in found}
    for other in (newer[::-1], newer[1:]):  # another order, fewer rules: the same findings of the rules named
        left = {r.kind for r in other}
        want = {r.doc_id: ",".join(sorted((x for x in r.s.split(",") if x.split(":")[0] in left), key=lambda x: (int(x.split(":")[1]), [o.kind for o in other].index(x.split(":")[0])))) for r in found}
        some = secrets.scan(table, ledger=ledger, rules=other).select("doc_id", secrets.spans(F.col("found"), other).alias("s")).collect()
        assert {r.doc_id: r.s for r in some} == want
    assert secrets.scan(none).count() == 0


def test_language(spark, docs, none):
    rng = random.Random(9)
    langs = {"aa": "abcdefg", "bb": "efghijk", "cc": "klmnopé"}
    data = [(k, " ".join("".join(rng.choices(langs[x], k=rng.randint(2, 8))) for _ in range(60)), x) for k, x in enumerate(rng.choices(list(langs), k=300))]
    data += [(500, None, "aa"), (501, "12 34 ²½ !", "aa"), (502, "abc", None), (503, "", "bb")]
    table = spark.createDataFrame([(*r, 0.5) for r in data], "doc_id long, text string, lang string, score double")
    model = langid.train(table.where("doc_id % 4 <> 2"))
    assert model.langs == ["aa", "bb", "cc"]
    counts = {x: Counter(g for k, t, l in data if k % 4 != 2 and t and l == x for w in langid.words(t) for g in langid.grams(w)) for x in model.langs}
    totals = {(x, n): sum(v for g, v in c.items() if len(g) == n) for x, c in counts.items() for n in langid.ORDERS}
    often = {(x, g) for x, c in counts.items() for g, v in c.items() if v >= langid.LEAST_RATE * totals[x, len(g)]}
    for g in {g for c in counts.values() for g in c}:  # every language that contains an n-gram is named, others seldom
        assert all(model.mask(g) >> k & 1 for k, x in enumerate(model.langs) if (x, g) in often)
    extra = [model.mask(g) >> k & 1 for c in counts.values() for g in c for k, x in enumerate(model.langs) if (x, g) not in often]
    assert sum(extra) <= 0.02 * len(extra) + 2
    found = {r.doc_id: r for r in langid.predict(table, model).collect()}
    assert sum(found[k].lang_pred == x for k, _, x in data[:300] if k % 4 == 2) >= 0.98 * sum(k % 4 == 2 for k in range(300))
    assert [found[k].lang_pred for k in (500, 501, 503)] == ["und"] * 3 and found[500].score == 0
    assert all(0 <= r.score <= 1 for r in found.values())
    assert langid.predict(table, langid.train(none)).where("lang_pred <> 'und'").count() == 0
    many = langid.Filters.build([(f"l{k:03d}", g) for k in range(130) for g in (f"g{k}", "all")])
    assert many.mask("all").bit_count() == 130 and many.mask("g129") >> 129 & 1


def test_quality(spark, docs, none):
    rng = random.Random(10)
    data = []
    for k in range(600):
        good = k % 3 > 0
        w = [rng.choice(WORDS) if good else rng.choice(["###", "$$$", "A1!!", "|"]) for _ in range(rng.randint(5, 80))]
        data.append((k, " ".join(w), int(good)))
    table = spark.createDataFrame([(a, b, 0.0) for a, b, _ in data] + [(900, None, 0.0), (901, "", 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(a, c) for a, _, c in data] + [(None, 1), (3, None)], "doc_id long, quality int")
    model, stats = quality.train(table, labels)
    found = {r.doc_id: r for r in quality.score(stats, model).collect()}
    held = [k for k in range(600) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum(found[k].predicted == data[k][2] for k in held) >= 0.98 * len(held)
    assert len(found) == 602 and all(0 <= r.score <= 1 for r in found.values())
    kept = quality.reject(table, model)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {k for k, r in found.items() if r.predicted}
    flat, stats = quality.train(none, labels)
    assert quality.score(stats, flat).count() == 0 and flat.score(np.zeros((1, quality.N_STATS)))[0] == 0.5


def test_quality_against_numpy(spark):
    """Weights, calibration and scores against the same fit in one place: normal equations at once, levels by their definition."""
    rng = random.Random(12)
    data = [(k, " ".join(rng.choice(WORDS if rng.random() < 0.3 + 0.6 * (k % 2) else ["###", "$$", "A1!", "|"]) for _ in range(rng.randint(5, 60))), int(k % 2 if rng.random() < 0.8 else 1 - k % 2)) for k in range(400)]
    table = spark.createDataFrame([(a, b) for a, b, _ in data], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(a, c) for a, _, c in data], "doc_id long, quality int")
    model, stats = quality.train(table, labels, held_out=None)
    fold = {r.doc_id: r.f for r in table.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(quality.FOLDS)).alias("f")).collect()}
    x, y, fold = np.array([quality.statistics(t.encode()) for _, t, _ in data]), np.array([c for _, _, c in data], float), np.array([fold[k] for k, _, _ in data])
    scale = np.where(x.std(0) < 1e-9, 1.0, x.std(0))
    z = quality.fourier((x - x.mean(0)) / scale)
    solve = lambda m: np.linalg.solve(z[m].T @ z[m] + quality.RIDGE * np.eye(z.shape[1]), z[m].T @ y[m])
    whole = solve(np.ones(400, bool))
    assert np.allclose(z @ model.weights, z @ whole, atol=1e-5)
    left_out = {f: solve(fold != f) for f in set(fold.tolist())}
    raw = np.array([z[k] @ left_out[f] for k, f in enumerate(fold.tolist())])
    bins = np.clip(((raw - quality._LOW) / (quality._HIGH - quality._LOW) * quality.GRID).astype(int), 0, quality.GRID - 1)
    there = np.unique(bins)
    n, good = (np.array([(v * (bins == b)).sum() for b in there]) for v in (np.ones(400), y))
    mean = lambda a, b: good[a : b + 1].sum() / n[a : b + 1].sum()
    level = [max(min(mean(a, b) for b in range(i, len(there))) for a in range(i + 1)) for i in range(len(there))]
    assert len(model.values) == len(level) and np.allclose(model.values, level, atol=1e-6)
    found = {r.doc_id: r.score for r in quality.score(stats, model).collect()}
    assert np.allclose([found[k] for k, _, _ in data], model.score(x), atol=1e-6)


def test_pooling():
    assert quality.pooled(np.array([0.0, 1.0, 0.0, 1.0]), np.ones(4)).tolist() == [0.0, 0.5, 0.5, 1.0]


def test_language_model(spark, docs, none):
    learn = crc_mod("doc_id", 7) != 2
    data = [(i, t, zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2) for i, t, *_ in rows()]
    one, two, starts = Counter(), Counter(), 0
    split = lambda t: [*(t or "").encode().lower().split(), None]
    for _, t, taught in data:
        if taught:
            w = split(t)
            one.update(w)
            two.update(zip(["start", *w], w))
            starts += 1
    n, v, once = sum(one.values()), len(one), sum(c == 1 for c in one.values())
    unknown = (once + 1) / (n + 2)
    want = []
    for i, t, taught in data:
        w, s = split(t), 0.0
        for h, x in zip(["start", *w], w):
            p = (1 - unknown) * one[x] / n if one[x] else unknown
            c = starts if h == "start" else one[h]
            s += math.log10((two[h, x] + lm.PRIOR * p) / (c + lm.PRIOR))
        want.append((str(i), not taught, len(w), sum(x in one for x in w), n, round(sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w), 6), round(s, 6)))
    for options in ({}, {"block_bytes": 2000, "bucket_keys": 100}):
        found = lm.score(docs, learn, **options).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in found) == sorted(want)
    assert lm.score(none, learn).count() == 0


def test_key_packing():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**64, 1000, np.uint64))
    assert (lm.unpacked_keys(lm.packed_keys(keys)) == keys).all()


def test_pieces_match_the_library(spark, docs, none):
    import sentencepiece

    model, library = pieces.Model.load(), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(11)
    texts = ["".join(rng.choice(" \n\tabcdeéüñ▁ﬁ漢字😀the ingdon;)(}{\r.0019AZ") for _ in range(rng.randint(0, 120))) for _ in range(500)] + [t for _, t, *_ in rows() if t is not None]
    assert pieces.encode_texts(model, texts) == library.encode(texts)
    for r in pieces.encode(docs).collect():
        if r.text is None:
            assert r.piece_ids is None and r.decoded is None
        else:
            assert r.piece_ids == library.encode(r.text) and r.n_pieces == len(r.piece_ids) and r.decoded == library.decode(r.piece_ids) == r.text
    assert pieces.encode(none).count() == 0


def test_pieces_of_a_unigram_model():
    names = ["<unk>", "▁a", "▁ab", "b", "c", "bc", "▁"]
    model = pieces.Model.of(pieces.UNIGRAM, names, [0, -1.0, -2.5, -1.5, -2.0, -1.8, -3.0], [2, 1, 1, 1, 1, 1, 1])
    assert [[names[i] for i in x] for x in pieces.encode_texts(model, ["abc", "ab abc", "axc"])] == [["▁a", "bc"], ["▁ab", "▁a", "bc"], ["▁a", "<unk>", "c"]]


def test_near_copies_meet_in_round_one(spark):
    """Near copies are in one group of the first round whatever the number of entries: only large groups are salted."""
    rng = np.random.default_rng(11)
    words = lambda: [f"w{k}" for k in rng.integers(0, 1 << 30, 30)]
    lines = [words() for _ in range(200)]
    copies = [[*a[:7], "other", *a[8:]] for a in lines[:20]]
    texts = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(lines + copies)], "id long, text string").selectExpr("id", "xxhash64(text) th", "text")
    classes = linededup.cut(linededup.rarity(texts), "rarity")
    entries = linededup.cut(linededup.entries_of(linededup._lines(texts), classes), "entries")
    near = linededup._neighbours(entries, 4)
    ids = entries.select("pk", "id")
    found = near.join(ids.toDF("a", "i"), "a").join(ids.toDF("b", "j"), "b").select("i", "j").collect()
    assert sum((r.i + 200 == r.j) for r in found) >= 15


def test_large_groups_of_near_copies_are_not_paired_out(spark, monkeypatch):
    """Near copies of one line, each with words of its own: the join's pairs stay few, and the lines that go are brute force's."""
    rng = np.random.default_rng(5)
    base = [f"b{k}" for k in range(60)]
    lines = []
    for k in range(500):
        line = list(base)
        for at in rng.choice(60, 5, replace=False):
            line[at] = f"own{k}x{at}"
        lines.append(line)
    made, cut_ = {}, linededup.Tables.cut

    def cut(self, df, name):
        found = cut_(self, df, name)
        made[name] = found.count() if name == "joined" else None
        return found

    monkeypatch.setattr(linededup.Tables, "cut", cut)
    docs = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(lines)], "doc_id long, text string")
    gone = {r.doc_id for r in linededup.dedup(docs).collect() if r.n_removed}
    sets = [set(x) for x in lines]
    assert gone == {j for j in range(500) if any(5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for i in range(j))}
    assert made["joined"] <= 20 * len(lines)


def test_the_table_of_ranks_is_in_no_row(spark):
    """The table of word classes is part of one expression; as a column of its own it is copied into every row."""
    texts = spark.createDataFrame([(1, "a b"), (2, "c")], "id long, text string").selectExpr("id", "xxhash64(text) th", "text")
    classes = linededup.cut(linededup.rarity(texts), "rarity")
    entries = linededup.entries_of(linededup._lines(texts), classes)
    plan = entries._jdf.queryExecution().optimizedPlan().toString()
    assert "scalar-subquery" in plan and " AS classes" not in plan


def test_near_copies_meet_at_words_that_can_be_the_first_shared(spark):
    """Far fewer rows than at all shared prefix words, and every similar pair among them."""
    rng = np.random.default_rng(3)
    lines = []
    for k in range(60):
        line = [f"b{j}" for j in range(rng.integers(40, 46))]
        for at in rng.choice(40, rng.integers(0, 5), replace=False):
            line[at] = f"own{k}x{at}"
        lines.append(line)
    texts = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(lines)], "id long, text string").selectExpr("id", "xxhash64(text) th", "text")
    classes = linededup.cut(linededup.rarity(texts), "rarity")
    entries = linededup.cut(linededup.entries_of(linededup._lines(texts), classes).selectExpr("*", "0 done"), "entries")
    posted, id = linededup._posted(entries), {r.pk: r.id for r in entries.collect()}
    few, all_ = ([(id[r.a], id[r.b]) for r in linededup._paired(posted, posted, "<", first).collect()] for first in (True, False))
    sets = [set(x) for x in lines]
    similar = {(i, j) for j in range(60) for i in range(j) if sets[i] != sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert similar and similar <= set(few) <= set(all_)
    assert 3 * len(few) <= 2 * len(all_)


def test_round_one_takes_entries_of_heavy_words_only(spark, monkeypatch):
    """Small groups of near copies are left to the join: nothing is written for round one. One word more often, and it is."""
    made, cut_ = [], linededup.Tables.cut
    monkeypatch.setattr(linededup.Tables, "cut", lambda self, df, name: made.append(name) or cut_(self, df, name))
    for copies, crowded in ((40, False), (linededup.HEAVY + 1, True)):
        lines = [[*(f"b{j}" for j in range(20)), f"own{k}"] for k in range(copies)]
        docs = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(lines)] + [(-1, "a line of its own")], "doc_id long, text string")
        made.clear()
        gone = {r.doc_id for r in linededup.dedup(docs).collect() if r.n_removed}
        assert gone == set(range(1, copies))
        assert ("near" in made) == ("near-sets" in made) == crowded


def test_words_of_lines_are_told_without_patterns(spark):
    """A pattern (rlike) turns each text into a Java string; blanks are looked for as bytes, and only of blanks are no entries."""
    rows_ = [(1, "A\tb\rC\x0bd\x0ce\n\t \r\x0b\x0c\n\n a  B c D e\n\u00a0"), (2, None), (3, "")]
    texts = linededup._texts(spark.createDataFrame(rows_, "doc_id long, text string"), "doc_id", "text")
    classes = linededup.cut(linededup.rarity(texts), "rarity")
    entries = linededup.entries_of(linededup._lines(texts), classes)
    assert "RLIKE" not in (entries._jdf.queryExecution().optimizedPlan().toString() + linededup.rarity(texts)._jdf.queryExecution().optimizedPlan().toString()).upper()
    found = {r.line_no: r for r in entries.collect()}
    assert sorted(found) == [0, 3, 4] and [found[k].n for k in (0, 3, 4)] == [5, 5, 1] and found[0].h == found[3].h


def test_an_encoder_goes_with_its_model():
    """Without waiting for a collection of garbage, as idle workers collect none."""
    import gc
    import weakref

    gc.disable()
    try:
        model = pieces.Model.of(pieces.BPE, ["\u2581", "a"], [0.0, 0.0], [1, 1])
        assert model.encoder() is model.encoder()
        model.encoder().encode(["a a"])
        held = weakref.ref(model)
        del model
        assert held() is None
    finally:
        gc.enable()


def test_slices_give_memory_back(monkeypatch):
    """After every batch and so at the end, when a worker goes idle."""
    import pyarrow as pa

    from grainfield.llm import shared

    given = []
    monkeypatch.setattr(shared, "give_back", lambda: given.append(1), raising=False)
    batches = [pa.record_batch({"text": pa.array(["a" * 10, None, "b" * 10])})] * 2
    assert [b.num_rows for b in shared.slices(iter(batches), most=8)] == [1, 2, 1, 2] and len(given) == 2
