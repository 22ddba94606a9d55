"""Each stage of the pipeline against a brute-force version, on a table with planted junk, lines, copies and benchmark passages."""

import random
import re

import pytest
import sentencepiece

import corpus_pipeline
from grainfield.llm import pieces
from grainfield.storage import new_path

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau upsilon phi chi psi omega north south east west river stone cloud field harbor winter summer garden window letter silver copper".split()
EXTRA = "score predicted n_words hits n_lines gone fp h"
LICENSE = "this line of a license stands in many of the documents and is theirs alone"


def planted(seed=3):
    rng = random.Random(seed)
    line = lambda n: " ".join(rng.choices(WORDS, k=n)) + "."
    good = ["\n".join(line(rng.randint(8, 40)) for _ in range(rng.randint(2, 6))) for _ in range(120)]
    junk = [" ".join(rng.choice(["###", "$$$ 77", "A1!!", "|", "%%9"]) for _ in range(rng.randint(20, 80))) for _ in range(80)]
    bench = [" ".join(rng.choices(WORDS, k=30)) for _ in range(6)] + ["five words and no more"]
    texts = list(good)
    for k in range(0, 40, 4):  # near copies of one long line, exact copies, contamination
        words = " ".join(rng.choices(WORDS, k=200)).split()
        texts.append(" ".join(words))
        words[rng.randrange(200)] = f"changed{k}"
        texts.append(" ".join(words) + "\n" + LICENSE)
        texts.append(good[k])
        texts.append(good[k + 1] + "\n" + LICENSE + "\n" + bench[k % 6].title())
    rows = [(k, t) for k, t in enumerate(texts)]
    labels = [(k, 1) for k in range(len(rows))]
    rows += [(1000 + k, t) for k, t in enumerate(junk)]
    labels += [(1000 + k, 0) for k in range(len(junk))]
    rows += [(2000, None), (2001, ""), (None, good[7] + "\nno id here at all"), (5, good[5])]  # (5, good[5]) twice: repeated rows
    return rows, labels, bench


def first_lines(rows, order):
    """Lines without those that have an earlier similar line."""
    earlier, out = [], {}
    for r in order:
        kept = []
        for x in r[1].split("\n"):
            s = frozenset(re.sub(r"[\t\r\x0b\x0c]", " ", x.lower()).split(" ")) - {""}
            if not s or not any(5 * len(s & e) >= 4 * len(s | e) for e in earlier):
                kept.append(x)
            if s:
                earlier.append(s)
        out[r] = "\n".join(kept)
    return out


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower(t)) if x]
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def contaminated(t, bench):
    find = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(x))
    w, hit = find(t), set()
    for b in map(find, bench):
        n = min(13, len(b))
        for k in range(len(b) - n + 1 if n else 0):
            hit |= {j for i in range(len(w) - n + 1) if w[i : i + n] == b[k : k + n] for j in range(i, i + n)}
    return bool(hit) and 20 * len(hit) >= len(w)


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels, bench = planted()
    path = new_path(spark, "planted")
    extra = ", ".join(f"{c} double" for c in EXTRA.split())
    spark.createDataFrame([(*r, "en", *[0.25] * len(EXTRA.split())) for r in rows], f"doc_id long, text string, lang string, {extra}").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, bench


def content(df):
    return sorted(((r.doc_id is not None, r.doc_id or 0), r.text or "", r.text is None) for r in df.collect())


def test_stages_against_brute_force(spark, tables):
    path, bench = tables
    stages = dict(corpus_pipeline.STAGES)
    cut = lambda df, name: corpus_pipeline.cut(df, name)
    docs = spark.read.parquet(f"{path}/documents.parquet")

    kept = cut(stages["quality"](spark, docs, path), "t1")
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and all(k in ids for k in range(160)) and not ids & set(range(1000, 1080))
    assert content(kept) == [r for r in content(docs) if (r[0][1] if r[0][0] else None) in ids]

    lined = cut(stages["line_dedup"](spark, kept, path), "t2")
    from pyspark.sql.functions import xxhash64

    hashes = {r.text: r.h for r in kept.select("text", xxhash64("text").alias("h")).collect()}
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    order = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    new = first_lines(rows, order)
    want = [(r[0], new.get(r)) for r in rows]
    want = [(i, n) for (i, t), (_, n) in zip(rows, want, strict=True) if t == n or n.strip(" \t\n\r\x0b\x0c")]
    assert content(lined) == sorted(((i is not None, i or 0), n or "", n is None) for i, n in want)
    assert lined.columns == docs.columns and all(r[c] == 0.25 for r in lined.collect() for c in EXTRA.split())

    single = cut(stages["near_duplicates"](spark, lined, path), "t3")
    rows = sorted({(r.doc_id is None, r.doc_id or 0, r.text) for r in lined.collect()}, key=lambda r: (r[0], r[1], r[2] or ""))
    sets, group = [shingles(r[2]) for r in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = group[a], group[b]
                group = [min(x, y) if g in (x, y) else g for g in group]
    want = [rows[g] for g in sorted(set(group))]
    assert content(single) == sorted(((not n, i), t or "", t is None) for n, i, t in want)

    clean = cut(stages["decontamination"](spark, single, path), "t4")
    assert content(clean) == [r for r in content(single) if not contaminated(r[1], bench)]
    assert 0 < clean.count() < single.count()

    last = stages["tokenization"](spark, clean, path).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert all(r.piece_ids == (library.encode(r.text) if r.text is not None else None) and r.decoded == r.text for r in last)


def test_stages_on_nothing(spark, tables):
    path, _ = tables
    docs = spark.read.parquet(f"{path}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        assert docs.count() == 0
