"""Language-model scores with a weighted backoff automaton.

Counts of words and word pairs of all training texts become an automaton: a state for each history (the start, or the word
before), an arc for each pair that was seen, and a failure arc from each history to the root, whose arcs are single words.
    p(v)     = (1 - u) c(v) / N, and u = (n1 + 1) / (N + 2) for any unknown word; n1 words occur once
    p(v | h) = (c(hv) + m p(v)) / (c(h) + m), so a failure arc weighs m / (c(h) + m)
Both sum to one. A text is read once from left to right, its state is carried, and log10 probabilities add up.

No task holds the whole model. Texts are grouped into blocks of a few megabytes; a block asks for the counts of the words
and pairs that it has, keys split by hash into buckets of bounded size; each bucket adds up what all blocks counted and
answers with totals in the order asked. A block then builds the part of the automaton that its texts can reach.

Words are identified by 64-bit hashes. Defined results: a null or empty text is one end token; repeated rows count as often
as they occur; with no training text all words are unknown; a null mark of training is no training; a null id is an id like
any other; a text of any length is read whole, in one block; only id and text are read, so other columns, whatever their
names, change nothing; an empty table gives no rows. There are no ties.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import LOWER, slices, texts_of

BLOCK_BYTES = 8 << 20
BUCKET_KEYS = 2_000_000
PRIOR = 200.0
#: Hashes of the end token and of the start history, which are no words.
END, START = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_U = np.uint64


def words(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


@dataclass
class Encoded:
    """Texts of a block: local word numbers one after another, each text led by START and followed by END."""

    hashes: np.ndarray  # of local words; 0 is END, 1 is START
    flat: np.ndarray
    sizes: np.ndarray  # tokens of each text, START apart

    @classmethod
    def of(cls, texts: list[bytes]) -> Encoded:
        index: dict[bytes, int] = {}
        get, flat, sizes = index.setdefault, [], []
        for text in texts:
            w = words(text)
            flat.append(np.fromiter((get(x, len(index) + 2) for x in w), np.int64, len(w)))
            sizes.append(len(w) + 1)
        out = np.empty(sum(sizes) + len(sizes), np.int64)
        at = 0
        for part in flat:
            out[at] = 1
            out[at + 1 : at + 1 + len(part)] = part
            out[at + 1 + len(part)] = 0
            at += len(part) + 2
        hashes = np.array([END, START, *map(xxhash.xxh64_intdigest, index)], np.uint64)
        return cls(hashes, out, np.array(sizes, np.int64))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Local words and their distinct pairs as hashed keys, which pair each token ends, and which tokens there are."""
        token = np.flatnonzero(self.flat != 1)
        pair = self.flat[token - 1] * len(self.hashes) + self.flat[token]
        distinct, which = np.unique(pair, return_inverse=True)
        return distinct, which, token


def pair_keys(hashes: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = hashes[distinct // len(hashes)] * _U(0x9E3779B185EBCA87) + hashes[distinct % len(hashes)]
        x ^= x >> _U(29)
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(32)
        x *= _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _asked(e: Encoded, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a block in order, and where its words and then its pairs stand in it."""
    keys = np.concatenate([pair_keys(e.hashes, np.arange(len(e.hashes))), pair_keys(e.hashes, distinct) ^ _U(0x5555555555555555)])
    order = np.argsort(keys, kind="stable")
    return keys[order], order


def _bucket(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> _U(32)) * _U(n) >> _U(32)).astype(np.int64)


def packed_keys(keys: np.ndarray) -> bytes:
    """Rising keys as their differences, high bytes of all first, so that what is zero stands together and compresses."""
    return np.diff(keys, prepend=_U(0)).astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, np.uint8).reshape(8, -1).T.copy().view(">u8").ravel().astype(np.uint64), dtype=np.uint64)


def packed_counts(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.astype("<u8").tobytes(), 1)


def unpacked_counts(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), "<u8").astype(np.int64)


def _ask(buckets: int):
    """A block's keys with its counts over training texts, by bucket."""

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        e = Encoded.of(texts_of(table.column("text").combine_chunks()))
        learn = np.asarray(table.column("learn"), dtype=bool)
        distinct, which, token = e.pairs()
        taught = np.repeat(learn, e.sizes)
        one = np.bincount(e.flat[token][taught], minlength=len(e.hashes))
        one[1] = learn.sum()
        keys, order = _asked(e, distinct)
        counts = np.concatenate([one, np.bincount(which[taught], minlength=len(distinct))])[order]
        b = _bucket(keys, buckets)
        starts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        ends = [*starts[1:], len(b)]
        return pa.table(
            {
                "bucket": pa.array(b[starts], pa.int32()),
                "block": pa.array([block] * len(starts), pa.int32()),
                "keys": pa.array([packed_keys(keys[x:y]) for x, y in zip(starts, ends, strict=True)], pa.binary()),
                "counts": pa.array([packed_counts(counts[x:y]) for x, y in zip(starts, ends, strict=True)], pa.binary()),
            }
        )

    return run


def _answer(table: pa.Table) -> pa.Table:
    """A bucket's totals for each block, in the order asked."""
    keys = [unpacked_keys(x) for x in table.column("keys").to_pylist()]
    counts = [unpacked_counts(x) for x in table.column("counts").to_pylist()]
    sizes = [len(x) for x in keys]
    _, which = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(which, weights=np.concatenate(counts)).astype(np.int64)[which]
    ends = np.cumsum(sizes)
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "totals": pa.array([packed_counts(total[e - n : e]) for n, e in zip(sizes, ends, strict=True)], pa.binary())})


class Automaton:
    """The part of the backoff automaton that a block's words reach; states are local words as histories."""

    def __init__(self, n_words: int, distinct: np.ndarray, one: np.ndarray, two: np.ndarray, totals: tuple[int, int, int], prior: float):
        tokens, _, once = totals
        unknown = (once + 1) / (tokens + 2)
        self.root = np.log10(np.where(one > 0, (1 - unknown) * one / max(1, tokens), unknown))
        self.fail = np.log10(prior / (one + prior))
        seen = np.flatnonzero(two > 0)
        history, word = distinct[seen] // n_words, distinct[seen] % n_words
        self.arcs = distinct[seen]  # in order of history, then word
        self.weights = np.log10((two[seen] + prior * 10 ** self.root[word]) / (one[history] + prior))
        self.n_words = n_words

    def read(self, flat: np.ndarray) -> np.ndarray:
        """log10 probability of each token, START apart. The state before a token is the word read last, so the arcs of all
        tokens are found at once; where there is none, the failure arc leads to the root's."""
        token = np.flatnonzero(flat != 1)
        state, word = flat[token - 1], flat[token]
        step = state * self.n_words + word
        at = np.minimum(np.searchsorted(self.arcs, step), max(0, len(self.arcs) - 1))
        there = self.arcs[at] == step if len(self.arcs) else np.zeros(len(step), bool)
        out = self.fail[state] + self.root[word]
        out[there] = self.weights[at[there]]
        return out


def _score(totals: tuple[int, int, int], prior: float, kept: list[str]):
    tokens, vocabulary, _ = totals

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        e = Encoded.of(texts_of(docs.column("text").combine_chunks()))
        distinct, _, token = e.pairs()
        _, order = _asked(e, distinct)
        parts = [x for _, x in sorted(zip(answers.column("bucket").to_pylist(), answers.column("totals").to_pylist(), strict=True))]
        counts = np.empty(len(order), np.int64)
        counts[order] = np.concatenate([unpacked_counts(x) for x in parts])
        one, two = counts[: len(e.hashes)], counts[len(e.hashes) :]
        logs = Automaton(len(e.hashes), distinct, one, two, totals, prior).read(e.flat)
        c = one[e.flat[token]]
        base = np.log10((c + 1) / (tokens + 1 * (vocabulary + 1)))
        starts = np.cumsum(e.sizes) - e.sizes
        add = lambda x: np.add.reduceat(x, starts)  # noqa: E731  no text is without a token
        added = {"n_tokens": pa.array(e.sizes), "n_known": pa.array(add((c > 0).astype(np.int64))), "base_score": pa.array(add(base)), "score": pa.array(add(logs))}
        return pa.table([*(docs.column(k) for k in kept), *added.values()], names=[*kept, *added])

    return run


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per part of a task: hashes of distinct tokens and their counts."""
    for batch in slices(batches, "text", 32 << 20):
        e = Encoded.of(texts_of(batch.column("text")))
        counts = np.bincount(e.flat, minlength=len(e.hashes))
        counts[1] = 0
        there = np.flatnonzero(counts)
        yield pa.record_batch({"h": pa.array(e.hashes[there].view(np.int64), pa.int64()), "n": pa.array(counts[there], pa.int64())})


def totals_of(docs: DataFrame, learn: Column, text: str = "text") -> tuple[int, int, int]:
    """Training tokens, distinct ones, and those that occur once."""
    taught = docs.where(learn).select(F.col(text).cast("string").alias("text"))
    counts = taught.mapInArrow(_count_words, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    r = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.count(F.when(F.col("n") == 1, 1))).first()
    return int(r[0]), int(r[1]), int(r[2])


def score(docs: DataFrame, learn: Column, id: str = "doc_id", text: str = "text", prior: float = PRIOR, block_bytes: int = BLOCK_BYTES, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; `learn` marks training rows."""
    totals = totals_of(docs, learn, text)
    size = docs.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    buckets = max(1, -(-size // (3 * bucket_keys)))  # a word and a pair at most every three bytes or so
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    block = F.pmod(F.xxhash64(F.col(id), F.crc32(body.cast("binary")), F.spark_partition_id()), F.lit(blocks)).cast("int")
    rows = docs.select(F.col(id), F.coalesce(learn, F.lit(False)).alias("learn"), body.alias("text"), block.alias("block"))
    asked = rows.groupBy("block").applyInArrow(_ask(buckets), "bucket int, block int, keys binary, counts binary")
    answers = asked.groupBy("bucket").applyInArrow(_answer, "block int, bucket int, totals binary")
    kept = [id, "learn"]
    out = T.StructType([docs.schema[id], T.StructField("learn", T.BooleanType())])
    for name, kind in (("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())):
        out = out.add(name, kind)
    scored = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(totals, prior, kept), out)
    return scored.select(id, (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", F.lit(totals[0]).cast("long").alias("train_tokens"), "base_score", "score")
