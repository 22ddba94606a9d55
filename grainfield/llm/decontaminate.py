"""Benchmark decontamination with suffix arrays over the training texts.

Each task turns its documents, a few megabytes at a time, into one suffix array over words (a shard). Every suffix of every
benchmark item is looked up by binary search; the matches of at least `window` words (or of a whole shorter item) are
exactly the suffixes of the shard in one run of its order, whose places and longest common lengths give what is hit.

Words that no item has split the shard and start no suffix. The benchmark is broadcast in parts of bounded size; a larger
benchmark means more passes that each add their hits, never a larger broadcast.

Defined results: a null or word-less text has no words and is clean; null, empty or word-less items take no part; items
that share an id count once; an item with a null id marks words but is not listed; repeated documents are judged alike; an
empty table of documents gives no rows, one of items hits nothing; texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import aside, back, cut, slices, texts_of

WINDOW = 13
PART_BYTES = 8 << 20
PASSES = 8

#: a-z, 0-9 and every byte of a non-ASCII letter stay; A-Z become small; the rest separates words.
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


@dataclass
class Suffixes:
    """The part of the benchmark that one pass looks for: word ids of all items, and the suffixes to search (those that begin alike, once)."""

    ids: dict[bytes, int]
    tokens: np.ndarray  # items one after another, each ended by -2
    starts: np.ndarray  # of the suffixes
    least: np.ndarray  # words that a match needs
    items: list[list[str]]  # that have the suffix's window


def suffixes(items: list[tuple[object, str | None]], window: int = WINDOW) -> Suffixes | None:
    ids: dict[bytes, int] = {}
    tokens: list[int] = []
    of: dict[tuple[int, ...], tuple[int, set[str]]] = {}
    for name, text in items:
        w = [ids.setdefault(x, len(ids)) for x in words((text or "").encode())]
        need = min(window, len(w))
        for k in range(len(w) - need + 1 if w else 0):
            _, names = of.setdefault(tuple(w[k : k + need]), (len(tokens) + k, set()))
            if name is not None:
                names.add(str(name))
        tokens += [*w, -2]
    if not of:
        return None
    return Suffixes(ids, np.array(tokens, np.int64), np.array([x for x, _ in of.values()]), np.array([len(x) for x in of]), [sorted(x) for _, x in of.values()])


def suffix_array(tokens: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """Starts ordered by the `depth` words from there: sorted by doubling, ranks of 1, 2, 4 .. words. Negative words end a suffix."""
    rank = np.where(tokens < 0, 0, tokens + 1)
    length = 1
    while length < depth:
        step = min(length, depth - length)
        after = np.zeros_like(rank)
        after[:-step] = rank[step:]
        after[rank == 0] = 0
        key = rank * (rank.max() + 1) + after
        _, rank = np.unique(key, return_inverse=True)  # the last word is negative, so 0 stays 0
        length += step
    return starts[np.argsort(rank[starts], kind="stable")]


def _compare(tokens: np.ndarray, at: np.ndarray, own: np.ndarray, start: np.ndarray, least: np.ndarray) -> np.ndarray:
    """-1, 0 or 1: the shard's suffixes at `at` against the first `least` words of the searched ones."""
    out = np.zeros(len(at), dtype=np.int8)
    open_ = np.arange(len(at))
    for d in range(int(least.max(initial=0))):
        open_ = open_[least[open_] > d]
        if not len(open_):
            break
        p = at[open_] + d
        a = np.where(p < len(tokens), tokens[np.minimum(p, len(tokens) - 1)], -1)
        b = own[start[open_] + d]
        out[open_] = np.sign(a - b)
        open_ = open_[a == b]
    return out


def search(tokens: np.ndarray, order: np.ndarray, s: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """Runs [from, to) of the shard's order whose suffixes begin with the needed words of each searched suffix."""
    bounds = []
    for upper in (False, True):
        lo, hi = np.zeros(len(s.starts), np.int64), np.full(len(s.starts), len(order), np.int64)
        while True:
            active = np.flatnonzero(lo < hi)
            if not len(active):
                break
            mid = (lo[active] + hi[active]) // 2
            c = _compare(tokens, order[mid], s.tokens, s.starts[active], s.least[active])
            right = c <= 0 if upper else c < 0
            lo[active] = np.where(right, mid + 1, lo[active])
            hi[active] = np.where(right, hi[active], mid)
        bounds.append(lo)
    return bounds[0], bounds[1]


def longest(tokens: np.ndarray, at: np.ndarray, own: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Words that the suffixes at `at` and the searched ones share from their beginnings."""
    n = np.zeros(len(at), np.int64)
    open_ = np.arange(len(at))
    while len(open_):
        p, q = at[open_] + n[open_], start[open_] + n[open_]
        same = (p < len(tokens)) & (q < len(own))
        same &= tokens[np.minimum(p, len(tokens) - 1)] == own[np.minimum(q, len(own) - 1)]
        same &= own[np.minimum(q, len(own) - 1)] >= 0
        open_ = open_[same]
        n[open_] += 1
    return n


def matches(texts: list[bytes], s: Suffixes, window: int = WINDOW) -> tuple[list[int], list[tuple[int, int, int, int]]]:
    """Words of each text, and (text, word, suffix, words) of every longest verbatim match with a searched suffix."""
    get, parts, sizes = s.ids.get, [], []
    for text in texts:
        w = words(text)
        sizes.append(len(w))
        parts.append(np.array([*(get(x, -1) for x in w), -1], np.int64))
    tokens = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    place = _long_enough(tokens, int(s.least.min()))
    if not len(place):
        return sizes, []
    tokens = tokens[place]
    order = suffix_array(tokens, np.flatnonzero(tokens >= 0), window)
    lo, hi = search(tokens, order, s)
    n = hi - lo
    which = np.repeat(np.arange(len(n)), n)
    at = order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
    size = longest(tokens, at, s.tokens, s.starts[which])
    first, at = np.cumsum([0, *[x + 1 for x in sizes]]), place[at]
    doc = np.searchsorted(first, at, side="right") - 1
    return sizes, list(zip(doc.tolist(), (at - first[doc]).tolist(), which.tolist(), size.tolist(), strict=True))


def _long_enough(tokens: np.ndarray, least: int) -> np.ndarray:
    """Places of the words of runs of at least `least` benchmark words, and of the other word that ends each run."""
    ends = np.flatnonzero(tokens < 0)
    run = np.diff(ends, prepend=-1)  # with its end
    return np.flatnonzero(np.repeat(run > least, run))


def _add_hits(shared, window: int, text: str):
    """Adds one pass's hit words (start, end pairs) and items to each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Suffixes | None = shared.value
        for batch in slices(batches, text):
            sizes, found = matches(texts_of(batch.column(text)), s, window) if s else ([len(words(x)) for x in texts_of(batch.column(text))], [])
            hits: dict[int, list[tuple[int, int]]] = {}
            items: dict[int, set[str]] = {}
            for doc, word, k, n in found:
                hits.setdefault(doc, []).append((word, word + n))
                items.setdefault(doc, set()).update(s.items[k])
            old_hits, old_items = batch.column("hits").to_pylist(), batch.column("items").to_pylist()
            new_hits = [merged(h, hits.get(k, ())) for k, h in enumerate(old_hits)]
            new_items = [sorted({*old, *items.get(k, ())}) for k, old in enumerate(old_items)]
            columns = {f.name: batch.column(f.name) for f in batch.schema} | {"n_words": pa.array(sizes, pa.int64()), "hits": pa.array(new_hits, pa.binary()), "items": pa.array(new_items, pa.list_(pa.string()))}
            yield pa.record_batch([columns[f.name] for f in batch.schema], names=batch.schema.names)

    return run


def merged(packed: bytes, more) -> bytes:
    """Unions of [start, end) ranges, packed as int64 pairs in order."""
    if not more:
        return packed
    out: list[list[int]] = []
    for a, b in sorted([*map(tuple, np.frombuffer(packed, np.int64).reshape(-1, 2).tolist()), *more]):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return np.array(out, np.int64).tobytes()


def _judge():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [np.frombuffer(h, np.int64).reshape(-1, 2) for h in batch.column("hits").to_pylist()]
            hit = [int((x[:, 1] - x[:, 0]).sum()) for x in spans]
            items, n = batch.column("items").to_pylist(), batch.column("n_words").to_pylist()
            added = {
                "n_hit": pa.array(hit, pa.int64()),
                "n_items": pa.array([len(x) for x in items], pa.int64()),
                "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
                "contaminated": pa.array([h > 0 and 20 * h >= w for h, w in zip(hit, n, strict=True)], pa.bool_()),
                "spans": pa.array([x.tolist() for x in spans], pa.list_(pa.list_(pa.int64()))),
            }
            keep = [f for f in batch.schema.names if f != "hits"]
            yield pa.record_batch([*(batch.column(f) for f in keep), *added.values()], names=[*keep, *added])

    return run


def _after(steps: list):
    """One step that takes each batch through all of these, in one Python worker: each chained map would hold one of its own,
    which stays, and is given tasks of later stages, when its stage is over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps:
            batches = step(batches)
        return batches

    return run


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item: str = "item_id", item_text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """docs with n_words, items (ids of items with occurring windows), n_hit, n_items, items_sha256, contaminated and spans
    ([start, end) ranges of hit words). Columns of docs with these names are replaced."""
    names = ["n_words", "hits", "items", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]
    out = docs.drop(*names).withColumns({"n_words": F.lit(0).cast("long"), "hits": F.lit(b"").cast("binary"), "items": F.lit([]).cast("array<string>")})
    bench = benchmark.select(F.col(item).cast("string").alias("i"), F.col(item_text).cast("string").alias("t"))
    total = bench.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = -(-total // part_bytes) or 1
    sc, steps = docs.sparkSession.sparkContext, []
    for k in range(parts):
        rows = [(r.i, r.t) for r in bench.where(F.pmod(F.xxhash64("t"), F.lit(parts)) == k).collect()]  # about part_bytes
        shared = sc.broadcast(suffixes(rows, window))
        if k and k % PASSES == 0:
            out, steps = cut(out.mapInArrow(_after(steps), out.schema), "hits"), []
        steps.append(_add_hits(shared, window, text))
    kept = [f for f in out.schema.fields if f.name != "hits"]
    more = [("n_hit", "long"), ("n_items", "long"), ("items_sha256", "string"), ("contaminated", "boolean"), ("spans", "array<array<long>>")]
    judged = T.StructType(kept)
    for name, kind in more:
        judged = judged.add(name, T._parse_datatype_string(kind))
    return out.mapInArrow(_after([*steps, _judge()]), judged)


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs without those that are contaminated; columns (whatever their names) and whole texts as they were."""
    own, names = aside(docs)
    return back(hits(own, benchmark, text=names[text], **options).where(~F.col("contaminated")), names)
