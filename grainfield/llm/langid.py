"""Language identification with language-bitmask n-gram filters.

Training counts the character n-grams of all words of every language. A language contains an n-gram that makes up at least
a fixed part of its n-grams of that length; rarer ones are what stray words and wrong labels leave in every language, and
there are at most 1 / LEAST_RATE others. All languages share one bit-sliced Bloom filter: a slot holds one bit for each
language, an n-gram sets the bits of all languages that contain it in its slots, and the AND of its slots is the set of all
these languages - every one of them, and now and then one more. A text's score for a language is the popcount of its n-grams
with that bit, corrected for the filter's false-positive rate in that language; the highest decides.

Pairs of language and n-gram are turned into bits on the executors; the driver receives one row for each slot that has a
bit, at most MOST_SLOTS of them.

Defined results: null texts, texts without a letter, and a model without any language give `und` and score 0; rows with a
null language are not learned from; ties go to the first language by name; repeated rows count as often as they occur; a
long text is read whole, word by word; an empty table gives an empty model, or no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, slices

ORDERS = (2, 3, 4)
LEAST_RATE = 1e-4
HASHES = 3
SLOTS_PER_GRAM = 16
MOST_SLOTS = 1 << 22
_WORD = re.compile(r"[^\W\d_]+")
_LANE = 40
_MOST = 300_000


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(word: str, orders=ORDERS) -> list[str]:
    word = word if word.isalpha() else "".join(c for c in word if c.isalpha())
    if not word:
        return []
    padded = f" {word} "
    out = list(word) if 1 in orders else []
    return out + [padded[k : k + n] for n in orders if n > 1 for k in range(len(padded) - n + 1)]


def _count(orders):
    """Per task: (lang, gram, n). Words are counted first, so each distinct word is taken apart once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        total: dict[str, Counter] = {}

        def flush(everything: bool) -> Iterator[pa.RecordBatch]:
            for lang, c in seen.items():
                into = total.setdefault(lang, Counter())
                for w, n in c.items():
                    for g in grams(w, orders):
                        into[g] += n
            seen.clear()
            if everything or sum(map(len, total.values())) > _MOST:
                for lang, c in total.items():
                    yield pa.record_batch({"lang": pa.array([lang] * len(c), pa.string()), "gram": pa.array(list(c), pa.string()), "n": pa.array(list(c.values()), pa.int64())})
                total.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(words(text))
                if sum(map(len, seen.values())) > _MOST:
                    yield from flush(False)
        yield from flush(True)

    return run


@dataclass
class Filters:
    """Bit-sliced Bloom filters: slots x words of 64 languages."""

    langs: list[str]
    slots: np.ndarray
    false_rate: np.ndarray  # of each language
    orders: tuple[int, ...]

    @classmethod
    def of(cls, langs: list[str], slots: np.ndarray, orders=ORDERS) -> Filters:
        fill = np.array([np.count_nonzero(slots[:, k // 64] & np.uint64(1 << (k % 64))) / len(slots) for k in range(len(langs))])
        return cls(langs, slots, fill**HASHES, tuple(orders))

    @classmethod
    def build(cls, rows: list[tuple[str, str]], orders=ORDERS) -> Filters:
        """From (lang, gram) pairs at hand."""
        langs = sorted({lang for lang, _ in rows})
        n = _size(len({g for _, g in rows}))
        slots = np.zeros((n, max(1, -(-len(langs) // 64))), np.uint64)
        place = {lang: k for k, lang in enumerate(langs)}
        for lang, gram in rows:
            k = place[lang]
            slots[_hashes(gram, n), k // 64] |= np.uint64(1 << (k % 64))
        return cls.of(langs, slots, orders)

    def mask(self, gram: str) -> int:
        """The languages that contain the n-gram, as bits."""
        a, b, c = (self.slots[k] for k in _hashes(gram, len(self.slots)))
        if len(a) == 1:
            return int(a[0] & b[0] & c[0])
        return sum(int(x) << (64 * k) for k, x in enumerate(a & b & c))

    def voter(self) -> Voter:
        """One for all tasks of a worker, which keep a broadcast value."""
        if "_voter" not in self.__dict__:
            self._voter = Voter(self)
        return self._voter

    def corrected(self, hits: list[int], n: int) -> np.ndarray:
        """Share of n-grams that each language truly has: false positives taken off."""
        return np.clip((np.array(hits) / n - self.false_rate) / np.maximum(1 - self.false_rate, 1e-9), 0, 1)


def _size(grams: int) -> int:
    """Slots for so many n-grams: a power of two."""
    return min(MOST_SLOTS, max(1024, 1 << int(SLOTS_PER_GRAM * max(1, grams) - 1).bit_length()))


def _hashes(gram: str, n: int) -> list[int]:
    h = xxhash.xxh64_intdigest(gram.encode(), 42)
    a, b = h & 0xFFFFFFFF, h >> 32 | 1
    return [a + k * b & n - 1 for k in range(HASHES)]


def _slots_of(gram: Column, n: int) -> Column:
    """The same places as `_hashes`."""
    h = F.xxhash64(gram)
    a, b = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1))
    return F.array(*((a + k * b).bitwiseAND(F.lit(n - 1)).cast("int") for k in range(HASHES)))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", orders=ORDERS, least_rate: float = LEAST_RATE) -> Filters:
    """Filters from all rows with a text and a language. The driver receives the names of languages and a row for each slot."""
    known = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    counts = known.mapInArrow(_count(orders), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = cut(counts, "gram-counts")
    sizes = counts.groupBy("lang", F.length("gram").alias("k")).agg(F.sum("n").alias("total"))  # languages x orders
    often = counts.withColumn("k", F.length("gram")).join(sizes, ["lang", "k"]).where(F.col("n") >= least_rate * F.col("total"))
    pairs = cut(often.select("lang", "gram"), "grams")
    langs = [r.lang for r in pairs.select("lang").distinct().orderBy("lang").collect()]
    n = _size(pairs.select(F.approx_count_distinct("gram")).first()[0])
    slots = np.zeros((n, max(1, -(-len(langs) // 64))), np.uint64)
    if langs:
        place = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")) - 1
        placed = pairs.select("gram", place.cast("int").alias("p"))
        bits = placed.select(F.explode(_slots_of(F.col("gram"), n)).alias("slot"), F.expr("p div 64").cast("int").alias("part"), F.expr("shiftleft(1L, p % 64)").alias("bit"))
        found = bits.groupBy("slot", "part").agg(F.bit_or("bit").alias("bits")).toArrow()
        slots[found.column("slot").to_numpy(), found.column("part").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return Filters.of(langs, slots, orders)


class Voter:
    """Votes of words and n-grams seen before, as lanes of one integer: n-grams, then hits of each language."""

    def __init__(self, filters: Filters):
        self.filters, self.words, self.grams, self.lanes = filters, {}, {}, {}

    def _gram(self, gram: str) -> int:
        bits = self.filters.mask(gram)
        lanes = self.lanes.get(bits)
        if lanes is None:
            lanes = self.lanes[bits] = 1 + sum(1 << (_LANE * (k + 1)) for k in range(len(self.filters.langs)) if bits >> k & 1)
        return lanes

    def _word(self, word: str) -> int:
        known, total = self.grams, 0
        for g in grams(word, self.filters.orders):
            v = known.get(g)
            if v is None:
                if len(known) > _MOST:
                    known.clear()
                v = known[g] = self._gram(g)
            total += v
        return total

    def votes(self, text: str) -> int:
        known, total = self.words, 0
        if len(known) > _MOST:
            known.clear()
        for w in words(text):
            v = known.get(w)
            if v is None:
                v = self._word(w)
                if len(w) <= 64:
                    known[w] = v
            total += v
        return total

    def decide(self, text: str | None) -> tuple[str, float]:
        total = self.votes(text) if text and self.filters.langs else 0
        n = total & ((1 << _LANE) - 1)
        if not n:
            return "und", 0.0
        hits = [total >> (_LANE * (k + 1)) & ((1 << _LANE) - 1) for k in range(len(self.filters.langs))]
        scores = self.filters.corrected(hits, n)
        best = int(np.argmax(scores))
        return self.filters.langs[best], float(scores[best])


def predict(docs: DataFrame, filters: Filters, text: str = "text", keep: list[Column | str] | None = None) -> DataFrame:
    """The kept columns (all but the text, if none are named), lang_pred and score."""
    kept = docs.select(*(keep if keep is not None else [c for c in docs.columns if c not in (text, "lang_pred", "score")]), F.col(text).cast("string").alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voter = shared.value.voter()
        for batch in slices(batches, "__text"):
            found = [voter.decide(t) for t in batch.column("__text").to_pylist()]
            names = batch.schema.names[:-1]
            yield pa.record_batch([*batch.columns[:-1], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[*names, "lang_pred", "score"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
