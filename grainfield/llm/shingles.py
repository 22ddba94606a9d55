"""Near copies by an exact set-similarity join on word shingles: a Jaccard similarity of 0.8 or more of five-word sets.

A text is the set of the hashes of its five-word shingles, words A-Z lower-cased. Shingles are ordered by rarity: they are
counted in a fixed number of hash buckets, and a shingle's rank is its bucket's logarithmic class, then its hash - one order
for the whole corpus, so the filters stay exact, and only the number of candidates depends on the buckets. Texts with equal
sets are one entry, named by a hash of the set.

Two similar sets share at least o = 4/9 of their sizes' sum, so their first shared shingle stands before place n - o + 1 of
each (it is among the first n - ceil(0.8 n) + 1) and their sizes differ by a factor 0.8 at most. What passes is verified on
whole sets. Only components are asked for: first SimHash fingerprints of the shingles are linked as in `simhash` (deletion
variants of two segments, equality join, two bits at most), and each entry is held against the first one with the same two
least shingles, and the first one with the same two rarest ones, which links most copies to one leader of their group; all
these pairs are verified. Fingerprints of similar texts often differ in more bits than deletion variants can find, so the
exact join finds the links that are left: it leaves out pairs within a component, each entry is held against its smallest
candidate, and the pairs are verified that this left in different components.

Whole sets are read and shuffled only for pairs whose parity sketches allow a similarity of 0.8. A sketch has a bit for each
shingle or more (a power of two): the parity of the number of shingles that fall on it, so two sketches cannot differ in more
bits than the sets in shingles, a ninth of their sizes' sum at most, and nearly all pairs that only share a few shingles go.

Defined results: null and word-less texts have the empty set and are one entry; fewer words than a shingle are one shingle;
of a component the row with the smallest id stays, null ids last (of equal ids, the smallest text hash; of equal rows, one).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import components
from .linededup import told_apart
from .shared import Tables, aside, back, cut, slices, texts_of
from .simhash import fingerprint, links, shingle_hashes

SHINGLE = 5
BUCKETS = 1 << 18
PARTS = 64
SLICE = 1 << 20


def shingle_set(text: bytes) -> np.ndarray:
    """Distinct shingle hashes in ascending order."""
    return np.unique(shingle_hashes(text, SHINGLE))


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of the shingles that fall on each of at least 64 and at least len(s) bits, a power of two; the halves of a
    sketch, xor, are the sketch of half as many bits."""
    bits = max(64, 1 << (len(s) - 1).bit_length()) if len(s) else 64
    odd = np.bincount((s & np.uint64(bits - 1)).view(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def _name(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).view(np.int64))


def rarity(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """For each bucket of shingle hashes the class (0 to 127) of its count: one array of fixed size, whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches, "__text", SLICE):
            sets = [shingle_set(t) for t in texts_of(batch.column("__text"))]
            if sets:
                total += np.bincount((np.concatenate(sets) % np.uint64(buckets)).view(np.int64), minlength=buckets)
        parts = np.array_split(total, PARTS)
        yield pa.record_batch({"part": pa.array(range(PARTS), pa.int32()), "counts": pa.array([p.tobytes() for p in parts], pa.binary())})

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c, np.int64) for c in table.column("counts").to_pylist())
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "part int, counts binary"
    found = docs.select(F.col(text).cast("string").alias("__text")).mapInArrow(count, schema).groupBy("part").applyInArrow(add, schema).collect()
    if not found:
        return np.zeros(buckets, np.uint8)
    counts = np.concatenate([np.frombuffer(bytes(r.counts), np.int64) for r in sorted(found, key=lambda r: r.part)])
    return np.minimum(127, 3 * np.log2(np.maximum(counts, 1))).astype(np.uint8)


def entries_of(docs: DataFrame, classes: np.ndarray, text: str, keep: list[Column | str]) -> DataFrame:
    """The kept columns, h (names the set), n (its size), prefix (its rarest shingles), names of its two least and its two
    rarest shingles, fp (the SimHash fingerprint of all its shingles, repeats included), and its sketch."""
    kept = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared.value
        for batch in slices(batches, "__text", SLICE):
            names, sizes, prefixes, least, rarest, fps, sketches = [], [], [], [], [], [], []
            for t in texts_of(batch.column("__text")):
                hashes = shingle_hashes(t, SHINGLE)
                s = np.unique(hashes)
                n = len(s)
                order = np.lexsort((s, rank[(s % np.uint64(len(rank))).astype(np.int64)]))
                names.append(_name(s))
                sizes.append(n)
                prefixes.append(s[order[: n + (-4 * n) // 5 + 1]].view(np.int64) if n else s.view(np.int64))
                least.append(_name(s[:2]))
                rarest.append(_name(s[order[:2]]))
                fps.append(fingerprint(hashes))
                sketches.append(sketch(s))
            found = [pa.array(names, pa.int64()), pa.array(sizes, pa.int32()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(least, pa.int64()), pa.array(rarest, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sketches, pa.list_(pa.int64()))]
            yield pa.record_batch([*batch.columns[:-1], *found], names=[*batch.schema.names[:-1], "h", "n", "prefix", "least", "rarest", "fp", "sketch"])

    added = [T.StructField("h", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("least", T.LongType()), T.StructField("rarest", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("sketch", T.ArrayType(T.LongType()))]
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields[:-1], *added]))


def candidates(entries: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) of entries (h, n, prefix, root) of different roots whose sizes and first shared shingle allow a
    similarity of 0.8."""
    posted = entries.select("h", "n", "root", F.posexplode("prefix").alias("pos", "word"))
    a, b = (posted.select("word", *(F.col(x).alias(f"{s}_{x}") for x in ("h", "n", "pos", "root"))) for s in "ab")
    near = F.expr("a_h < b_h and a_root <> b_root and 5 * a_n >= 4 * b_n and 5 * b_n >= 4 * a_n and 9 * least(a_n - a_pos, b_n - b_pos) >= 4 * (a_n + b_n)")
    return a.join(b, (a.word == b.word) & near).select(F.col("a_h").alias("a"), F.col("b_h").alias("b")).distinct()


def fingerprint_pairs(entries: DataFrame) -> DataFrame:
    """Pairs of entries by SimHash: one entry of each of two fingerprints that deletion variants find within two bits, and
    each entry with that one of its own fingerprint."""
    one = cut(entries.groupBy("fp").agg(F.min("h").alias("a")), "fingerprints")
    same = entries.join(one, "fp").where("h <> a").select("a", F.col("h").alias("b"))
    linked = links(one.select("fp"))
    for s in "ab":
        linked = linked.join(one.select(F.col("fp").alias(s), F.col("a").alias(f"h{s}")), s)
    return linked.select(F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b")).unionByName(same)


def leaders(entries: DataFrame) -> DataFrame:
    """Pairs of an entry and the smallest one with the same two least shingles or the same two rarest ones; groups are
    aggregated map-side, whatever their size."""
    found = None
    for key in ("least", "rarest"):
        keyed = entries.select("h", "n", F.col(key).alias("key"))
        first = keyed.groupBy("key").agg(F.min("h").alias("a"), F.count(F.lit(1)).alias("c")).where("c > 1").select("key", "a")
        some = keyed.join(first, "key").where("h <> a").select("a", F.col("h").alias("b"))
        found = some if found is None else found.unionByName(some)
    return found.distinct()


def alike(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches (h, n, sketch) allow a similarity of 0.8; none that is similar goes."""
    for s in "ab":
        pairs = pairs.join(sketches.select(F.col("h").alias(s), F.col("n").alias(f"{s}_n"), F.col("sketch").alias(f"{s}_sketch")), s)
    sized = pairs.where("5 * a_n >= 4 * b_n and 5 * b_n >= 4 * a_n")  # so one sketch is twice as wide at most
    half = "zip_with(slice({0}, 1, size({0}) div 2), slice({0}, size({0}) div 2 + 1, size({0}) div 2), (x, y) -> x ^ y)"
    a, b = (f"if(size({x}) > size({y}), {half.format(x)}, {x})" for x, y in (("a_sketch", "b_sketch"), ("b_sketch", "a_sketch")))
    apart = f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x ^ y)), 0, (n, x) -> n + x)"
    return sized.where(f"9 * {apart} <= a_n + b_n").select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs that are similar by their whole sets."""
    both = F.size(F.array_intersect("a_set", "b_set"))
    joined = pairs.join(sets.select(F.col("h").alias("a"), F.col("set").alias("a_set")), "a").join(sets.select(F.col("h").alias("b"), F.col("set").alias("b_set")), "b")
    return joined.where(5 * both >= 4 * (F.size("a_set") + F.size("b_set") - both)).select("a", "b")


def _read(pairs: DataFrame, docs: DataFrame, rows: DataFrame, text: str, tables: Tables, name: str) -> DataFrame:
    """Written (h, set) of all entries of the pairs: one text of each is read again."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct()
    one = tables.cut(rows.join(wanted, "h", "left_semi").groupBy("h").agg(F.min("__text_hash").alias("__text_hash")), f"{name}-texts")
    some, _ = told_apart(docs.select("__text_hash", F.col(text).cast("string").alias("__text")), "__text_hash", one, tables, f"{name}-marks")
    texts = some.join(one, "__text_hash").select("h", "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", SLICE):
            sets = [shingle_set(t).view(np.int64) for t in texts_of(batch.column("__text"))]
            yield pa.record_batch({"h": batch.column("h"), "set": pa.array(sets, pa.list_(pa.int64()))})

    sets = tables.cut(texts.mapInArrow(run, "h long, set array<long>").dropDuplicates(["h"]), name)
    tables.drop(f"{name}-texts", f"{name}-marks")
    return sets


def _rooted(found: DataFrame) -> DataFrame:
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())


def similar(docs: DataFrame, rows: DataFrame, entries: DataFrame, text: str, tables: Tables) -> DataFrame:
    """(node, root) of the components of similar entries; docs and rows (h) have __text_hash; the table of entries is dropped."""
    sketches = tables.cut(entries.select("h", "n", "sketch"), "shingle-sketches")
    near = tables.cut(alike(fingerprint_pairs(entries).unionByName(leaders(entries)).distinct(), sketches), "shingle-leaders")
    sets = _read(near, docs, rows, text, tables, "leader-sets")
    first = cut(_verified(near, sets), "leader-pairs")
    tables.drop("shingle-leaders", "leader-sets")
    roots = _rooted(components(first)).withColumnRenamed("node", "h")
    rooted = entries.join(roots, "h", "left").withColumn("root", F.coalesce("root", "h"))
    found = tables.cut(candidates(rooted), "shingle-candidates")
    tables.drop("shingle-entries")
    pairs = tables.cut(alike(found, sketches), "shingle-pairs")
    tables.drop("shingle-candidates", "shingle-sketches")
    sets = _read(pairs, docs, rows, text, tables, "shingle-sets")
    second = cut(_verified(pairs.groupBy("b").agg(F.min("a").alias("a")), sets), "first-pairs")
    linked = _rooted(components(first.unionByName(second)))
    for s in "ab":
        pairs = pairs.join(linked.select(F.col("node").alias(s), F.col("root").alias(f"{s}_root")), s, "left").withColumn(f"{s}_root", F.coalesce(f"{s}_root", s))
    rest = _verified(pairs.where("a_root <> b_root").select("a", "b"), sets)
    every = cut(first.unionByName(second).unionByName(rest), "similar-pairs")
    tables.drop("shingle-pairs", "shingle-sets")
    return components(every)


def representatives(docs: DataFrame, id: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """docs with one row of each component, columns (whatever their names) and whole texts as they were."""
    tables = Tables(docs.sparkSession)
    own, names = aside(docs)
    id, text = names[id], names[text]
    hashed = own.withColumn("__text_hash", F.xxhash64(F.col(text)))
    every = tables.cut(entries_of(hashed, rarity(own, text, buckets), text, [id, "__text_hash"]), "shingled")
    rows = cut(every.select(id, "__text_hash", "h"), "shingle-rows")
    entries = tables.cut(every.groupBy("h").agg(*(F.min(c).alias(c) for c in ("n", "least", "rarest", "fp")), *(F.first(c).alias(c) for c in ("prefix", "sketch"))), "shingle-entries")
    tables.drop("shingled")
    of = rows.join(similar(hashed, rows, entries, text, tables).withColumnRenamed("node", "h"), "h", "left").withColumn("root", F.coalesce("root", "h"))
    first = F.min(F.struct(F.col(id).isNull().alias("n"), F.col(id).alias("i"), F.col("__text_hash").alias("h"))).alias("c")
    chosen = cut(of.groupBy("root").agg(first).select(F.col("c.i").alias("__i"), F.col("c.h").alias("__h")), "representatives")
    # texts that may have a row to leave out are told apart first, so that all others stay without a shuffle
    same = (F.col("__text_hash") == F.col("__h")) & F.col(id).eqNullSafe(F.col("__i"))
    many = rows.groupBy(id, "__text_hash").agg(F.count(F.lit(1)).alias("c")).join(chosen.withColumn("__in", F.lit(True)), same, "left").where("c > 1 or __in is null")
    some, others = told_apart(hashed, "__text_hash", cut(many.select("__text_hash").distinct(), "shingle-doubts"), tables, "doubt-marks")
    kept = some.join(chosen, same, "left_semi").dropDuplicates([id, "__text_hash"])
    return back(others.unionByName(kept), names)
