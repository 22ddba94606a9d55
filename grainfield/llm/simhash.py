"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints of 64 bits come from word shingles. For at most two differing bits they are cut into two segments of 32 bits:
one of the two segments then differs by at most one bit, so two linked fingerprints share a segment in which that one bit
is wild. Each distinct fingerprint is indexed under its 64 one-wildcard segment variants, an equality join finds those that
share a variant, and the whole fingerprints are compared.

A variant that many fingerprints share is not paired out: its fingerprints are joined by whole fingerprints that are one
bit away (two within two bits share one), whose groups hold 65 members at most. Components are found by large-star and small-star rounds on DataFrames.

Defined results: null and word-less texts have the fingerprint zero and are linked by it; fewer words than a shingle are
one shingle; repeated rows are linked to each other; a null id takes part, and a component's id is its smallest id (null
only if it has no other); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import components
from .shared import LOWER, cut, slices, texts_of

SHINGLE = 3
SEED = 42
HOT = 128
#: Fingerprints of one task whose variants are formed.
PART = 10_000


def shingle_hashes(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of every run of `size` words, A-Z lower-cased, joined by one space."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    h = xxhash.xxh64_intdigest
    view = memoryview(line)
    return np.fromiter((h(view[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)), np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit k is set if it is in over half the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        part = hashes[a : a + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, text: str = "text", keep: list[Column | str] = ("doc_id",)) -> DataFrame:
    """The kept columns and fp (the fingerprint as a signed long)."""
    kept = docs.select(*keep, F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            fps = np.array([fingerprint(shingle_hashes(t)) for t in texts_of(batch.column("__text"))], np.uint64).view(np.int64)
            yield pa.record_batch([*batch.columns[:-1], pa.array(fps, pa.int64())], names=[*batch.schema.names[:-1], "fp"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields[:-1], T.StructField("fp", T.LongType())]))


def _variants() -> Column:
    """The 64 keys of a fingerprint: segment, wild bit, and the segment with that bit off, in one long."""
    keys = []
    for seg in range(2):
        part = F.shiftright(F.col("fp"), 32 * seg).bitwiseAND(F.lit(0xFFFFFFFF))
        for bit in range(32):
            keys.append(F.lit((seg << 37) | (bit << 32)).bitwiseOR(part.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << bit)))))
    return F.explode(F.array(*keys))


def _midpoints() -> Column:
    """The fingerprint and all that differ from it by one bit: two fingerprints within two bits share one of these, and at
    most 65 fingerprints share any."""
    own = [F.col("fp")]
    for bit in range(64):
        value = 1 << bit
        own.append(F.col("fp").bitwiseXOR(F.lit(value - (1 << 64) if value >= 1 << 63 else value)))
    return F.explode(F.array(*own))


def _pairs(keyed: DataFrame, most: int) -> DataFrame:
    """Linked pairs (a < b) of rows (key, fp) that share a key."""
    a, b = keyed.select("key", F.col("fp").alias("a")), keyed.select("key", F.col("fp").alias("b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most)
    return a.join(b, (a.key == b.key) & near).select("a", "b")


def links(fps: DataFrame, most: int = 2, hot: int = HOT) -> DataFrame:
    """Distinct pairs (a, b) of distinct fingerprints within `most` (at most 2) bits; column fp."""
    if not 0 <= most <= 2:
        raise ValueError("two segments with one wild bit cover at most 2 differing bits")
    # fingerprints are few bytes and their variants 64 times as many: without this few tasks would sort them all
    fps = fps.repartition(max(1, -(-fps.count() // PART)), "fp")
    keyed = fps.select("fp", _variants().alias("key"))
    # of a variant's fingerprints each task passes on hot + 1 at most, which tells that it is hot, so none fills a task
    rank = F.row_number().over(W.partitionBy("key").orderBy("fp"))
    some = keyed.withColumn("rank", rank).where(F.col("rank") <= hot + 1)
    sized = cut(some.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("key"))).where(F.col("n") > 1).select("key", "fp", "n"), "shared-variants")
    few = _pairs(sized.where(F.col("n") <= hot), most)
    over = sized.where(F.col("n") > hot).select("key").distinct()
    if over.isEmpty():
        return few.distinct()
    dense = cut(keyed.join(over, "key", "left_semi").select("fp").distinct(), "dense")
    return few.unionByName(_pairs(dense.select("fp", _midpoints().alias("key")), most)).distinct()


def cluster(rows: DataFrame, id: str = "doc_id", most: int = 2, hot: int = HOT) -> DataFrame:
    """rows (with fp), root (the component's smallest fingerprint) and component_id: the smallest id that a row reaches."""
    smallest = cut(rows.groupBy("fp").agg(F.min(id).alias("least")), "fingerprints")
    found = components(links(smallest.select("fp"), most, hot))
    roots = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    of = smallest.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    table = cut(of.select("fp", "root").join(least, "root").select("fp", "root", "component_id"), "components")
    return rows.join(table, "fp")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id) of every row."""
    rows = cut(with_fingerprints(docs, text, [id]), "fingerprinted")
    return cluster(rows, id).select(id, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component: the one with the smallest id (of equal ids, the smallest text hash; of equal
    rows, one), columns and whole texts as they were."""
    hashed = docs.withColumn("__text_hash", F.xxhash64(F.col(text)))
    rows = cut(with_fingerprints(hashed, text, [id, "__text_hash"]), "fingerprinted")
    first = F.min(F.struct(F.col(id).isNull().alias("n"), F.col(id).alias("i"), F.col("__text_hash").alias("h"))).alias("c")
    clusters = cluster(rows, id)
    chosen = clusters.groupBy("root").agg(first).select(F.col("c.i").alias("__i"), F.col("c.h").alias("__h"))
    chosen = cut(chosen, "representatives")
    kept = hashed.join(chosen, (F.col("__text_hash") == F.col("__h")) & F.col(id).eqNullSafe(F.col("__i")), "left_semi")
    if not rows.groupBy(id, "__text_hash").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates([id, "__text_hash"])
    return kept.select(*docs.columns)
