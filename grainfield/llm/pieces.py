"""SentencePiece encoding and decoding by a shared-prefix Viterbi.

A text becomes marked words (spaces are written as a mark that begins the word after them). The distinct words of a batch
are sorted, which makes them a trie walked depth-first: forward states of a prefix that a word shares with the one before
it are reused, only the rest is computed.

The forward state of a prefix is the score of its best path, the sum of piece scores, and that path's last piece. The
model's kind says which steps a path may take. Unigram: any piece after any other. BPE: merging never crosses a boundary
that it ends with, so a piece may follow another only if the merge order lets the two stand beside each other; all other
steps score minus infinity, and exactly one path into a prefix is left, whose score (of merge ranks) is carried on. Both
read the pieces back from the end, and both give what the model's own encoder gives.

Words of earlier batches stay known to a worker, up to a fixed number of them.

Defined results: null texts have null ids and score; an empty text has no ids and score 0; characters without a piece become
bytes where the model has byte pieces, else the unknown piece, and score 10 below the lowest score; repeated rows and words
have equal results, so there are no ties to break but equal sums in a unigram model (the longer last piece wins); texts of
any length are encoded whole; an empty table gives no rows. Models with another normalizer than identity are refused.
"""

from __future__ import annotations

import re
import weakref
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import slices

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNIGRAM, BPE = 1, 2
_MOST_WORDS = 200_000
_MOST_PAIRS = 200_000


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol-buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, raw[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, raw[at : at + n]
            at += n


@dataclass
class Model:
    """A model's vocabulary (of fixed size, so it is broadcast) and its forward step."""

    kind: int
    pieces: list[str]
    scores: list[float]
    types: list[int]
    dummy_prefix: bool = True
    unknown: int = 0
    ids: dict[str, int] = field(default_factory=dict)
    longest: int = 1
    bytes_: dict[int, int] = field(default_factory=dict)
    joints: set[str] = field(default_factory=set)
    border: re.Pattern | None = None
    plain: list[str | None] = field(default_factory=list)
    pairs: dict[int, bool] = field(default_factory=dict)
    lowest: float = 0.0
    sizes: list[int] = field(default_factory=list)

    def encoder(self) -> Encoder:
        """One for all tasks of a worker, which keep a broadcast value. It does not hold the model in turn, so both go as soon
        as the worker drops the broadcast, and not at some later collection of garbage."""
        if "_encoder" not in self.__dict__:
            self._encoder = Encoder(weakref.proxy(self))
        return self._encoder

    @classmethod
    def load(cls, path: str = MODEL) -> Model:
        import struct

        pieces, scores, types, kind, dummy, unknown = [], [], [], UNIGRAM, True, 0
        for n, value in _fields(open(path, "rb").read()):
            if n == 1:
                piece = dict(_fields(value))
                pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                types.append(piece.get(3, 1))
            elif n == 2:
                trainer = dict(_fields(value))
                kind, unknown = trainer.get(3, UNIGRAM), trainer.get(40, 0)
            elif n == 3:
                norm = dict(_fields(value))
                dummy = bool(norm.get(3, 1))
                if norm.get(1, b"") != b"identity" or norm.get(2) or norm.get(4, 1):
                    raise ValueError("only models with the identity normalizer that keep all spaces are supported")
        if kind not in (UNIGRAM, BPE):
            raise ValueError(f"model kind {kind} is not supported")
        return cls.of(kind, pieces, scores, types, dummy, unknown)

    @classmethod
    def of(cls, kind, pieces, scores, types, dummy_prefix=True, unknown=0) -> Model:
        m = cls(kind, pieces, scores, types, dummy_prefix, unknown)
        m.ids = {p: i for i, p in enumerate(pieces) if types[i] in (1, 4)}
        m.longest = max(map(len, m.ids), default=1)
        m.bytes_ = {int(p[3:5], 16): i for i, p in enumerate(pieces) if types[i] == 6}
        m.joints = {p[k : k + 2] for p in m.ids for k in range(len(p) - 1)}
        m.sizes = [len(p) for p in pieces]
        m.lowest = min(scores, default=0.0) - 10.0
        m.plain = [chr(int(p[3:5], 16)) if types[i] == 6 and p < "<0x8" else None if types[i] == 6 else _shown(p, types[i]) for i, p in enumerate(pieces)]
        return m

    def symbols(self, text: str) -> list[str]:
        """The merges themselves, highest score first and leftmost among equals; for texts of a piece or two."""
        out = list(text)
        while True:
            best = None
            for k in range(len(out) - 1):
                i = self.ids.get(out[k] + out[k + 1])
                if i is not None and (best is None or self.scores[i] > best[0]):
                    best = (self.scores[i], k)
            if best is None:
                return out
            k = best[1]
            out[k : k + 2] = [out[k] + out[k + 1]]

    def stand(self, a: int, b: int) -> bool:
        """Whether piece b follows piece a as it is, that is the merges of both end with these two; nothing joins an unknown
        character (-1)."""
        if a < 0:
            return True
        if len(self.pairs) > _MOST_PAIRS:
            self.pairs.clear()
        x, y = self.pieces[a], self.pieces[b]
        known = self.pairs[a << 32 | b] = self.symbols(x + y) == [x, y]
        return known

    def segments(self, word: str) -> list[str]:
        """Parts of a word between which no piece can stand: cut between a letter and a character that no piece has beside one."""
        if self.border is None:
            others = {c for p in self.ids for c in p if not c.isalpha()} - {MARK}
            joined = [{j[k] for j in self.joints if j[1 - k].isalpha()} for k in (0, 1)]
            before, after = ("".join(map(re.escape, sorted(others - x))) for x in joined)
            self.border = re.compile(f"(?<=[^\\W\\d_])(?=[{after}])|(?<=[{before}])(?=[^\\W\\d_])" if before and after else "(?!)")
        return self.border.split(word)

    def walk(self, words: list[str]) -> Iterator[tuple[str, list[int], float]]:
        """Each of the words (sorted, without repeats), its ids and its score: depth-first through their trie."""
        before, last, best, sizes = "", [-1], [0.0], self.sizes
        forward = self._merge_steps if self.kind == BPE else self._score_steps
        for word in words:
            n, most = 0, min(len(word), len(before))
            while n < most and word[n] == before[n]:
                n += 1
            del last[n + 1 :], best[n + 1 :]
            forward(word, n + 1, last, best)
            out, end = [], len(word)
            while end:
                i = last[end]
                if i < 0:
                    end -= 1
                    out += self._spelled(word[end])[::-1]
                else:
                    out.append(i)
                    end -= sizes[i]
            out.reverse()
            yield word, out, best[-1]
            before = word

    def matcher(self) -> ahocorasick.Automaton:
        """Finds, longest first, the pieces of two characters or more that end at a place and that their own merges make."""
        if "_matcher" not in self.__dict__:
            found = ahocorasick.Automaton()
            for p, i in self.ids.items():
                if len(p) > 1 and self.symbols(p) == [p]:
                    found.add_word(p, i)
            found.make_automaton()
            self._matcher = found
        return self._matcher

    def _merge_steps(self, word: str, end: int, last: list[int], best: list[float]) -> None:
        """The score and last piece (-1: an unknown character) of the one path into every prefix from `end` on; no step but
        one scores above minus infinity."""
        pairs, sizes, scores, done = self.pairs, self.sizes, self.scores, end - 1
        for stop, i in self.matcher().iter(word, max(0, end - self.longest)) if len(self.matcher()) else ():
            if stop < done:
                continue
            if done < stop:
                self._single_steps(word, done, stop, last, best)
                done = stop
            start = stop + 1 - sizes[i]
            if start:
                stands = pairs.get(last[start] << 32 | i)
                if stands is None:
                    stands = self.stand(last[start], i)
                if not stands:
                    continue
            last.append(i)
            best.append(best[start] + scores[i])
            done = stop + 1
        if done < len(word):
            self._single_steps(word, done, len(word), last, best)

    def _single_steps(self, word: str, done: int, end: int, last: list[int], best: list[float]) -> None:
        """Prefixes that end with a piece of one character."""
        for c in word[done:end]:
            i = self.ids.get(c, -1)
            last.append(i)
            best.append(best[-1] + (self.lowest if i < 0 else self.scores[i]))

    def _score_steps(self, word: str, end: int, last: list[int], best: list[float]) -> None:
        """The best score and last piece of every prefix from `end` on; an unknown character costs 10 below the lowest score."""
        for end in range(end, len(word) + 1):
            top = None
            for start in range(max(0, end - self.longest), end):
                i = self.ids.get(word[start:end], -1)
                score = self.scores[i] if i >= 0 else self.lowest if end - start == 1 else None
                if score is not None and (top is None or best[start] + score > top[0]):
                    top = (best[start] + score, i)
            best.append(top[0])
            last.append(top[1])

    def _spelled(self, piece: str) -> list[int]:
        """Ids of a character that no piece has."""
        return [self.bytes_[b] for b in piece.encode()] if self.bytes_ else [self.unknown]

    def marked(self, text: str) -> list[str]:
        """Words with the marks before them, in order; joined they are the text."""
        if not text:
            return []
        text = text.replace(" ", MARK)
        if self.dummy_prefix:
            text = MARK + text
        out, at, n = [], 0, len(text)
        while at < n:
            end = at
            while end < n and text[end] == MARK:
                end += 1
            end = text.find(MARK, end)
            end = n if end < 0 else end
            out.append(text[at:end])
            at = end
        return out

    def decode(self, ids: list[int]) -> str:
        try:
            text = "".join(map(self.plain.__getitem__, ids))
        except TypeError:  # bytes of other than ASCII characters
            text = self._decode_bytes(ids)
        if self.dummy_prefix and text.startswith(" "):
            text = text[1:]
        return text

    def _decode_bytes(self, ids: list[int]) -> str:
        out, run = [], bytearray()
        for i in ids:
            if self.types[i] == 6:
                run.append(int(self.pieces[i][3:5], 16))
                continue
            out.append(run.decode(errors="replace"))
            run.clear()
            out.append(self.plain[i])
        out.append(run.decode(errors="replace"))
        return "".join(out)


def _shown(piece: str, kind: int) -> str:
    return " ⁇ " if kind == 2 else "" if kind == 3 else piece.replace(MARK, " ")


class Encoder:
    """Ids and scores of words of earlier batches beside a model; forgotten when there are many."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}  # words
        self.parts: dict[str, int] = {}  # parts of words of several
        self.ids, self.starts, self.scores = array("i"), array("q", [0]), array("d")

    def _split(self, text: str) -> list[str]:
        """Words without their first mark: of plain texts what stands between single spaces."""
        if self.model.dummy_prefix and MARK not in text and "  " not in text and text[:1] != " " and text[-1:] != " ":
            return text.split(" ") if text else []
        return [w[1:] if w[:1] == MARK else "\0" + w for w in self.model.marked(text)]

    def _add(self, ids, score: float) -> int:
        self.ids.extend(ids)
        self.starts.append(len(self.ids))
        self.scores.append(score)
        return len(self.scores) - 1

    def _learn(self, words: list[str]) -> None:
        model, cut, new, names = self.model, {}, [], {}
        for w in words:
            if w.isalpha():  # one part
                names[MARK + w] = w
                new.append(MARK + w)
                continue
            cut[w] = model.segments(w[1:] if w[:1] == "\0" and w[1:2] != MARK and not model.dummy_prefix else MARK + w)
        new += {p for x in cut.values() for p in x} - self.parts.keys() - names.keys()
        for p, ids, score in model.walk(sorted(new)):
            k = self._add(ids, score)
            if p in names:
                self.index[names[p]] = k
            else:
                self.parts[p] = k
        for w, x in cut.items():
            at = [self.parts[p] if p in self.parts else self.index[p[1:]] for p in x]
            if len(at) == 1:
                self.index[w] = at[0]
            else:
                self.index[w] = self._add([i for k in at for i in self.ids[self.starts[k] : self.starts[k + 1]]], sum(self.scores[k] for k in at))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids one after another, how many each text has (-1: null), and the score of each text."""
        split = [() if t is None else self._split(t) for t in texts]
        words = list(chain.from_iterable(split))
        if len(self.index) > _MOST_WORDS:
            self.forget()
        known = self.index
        self._learn([w for w in set(words) if w not in known])
        at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        ends = np.cumsum([0, *map(len, split)])
        null = np.array([t is None for t in texts], bool)
        if not len(at):
            return np.zeros(0, np.int32), np.where(null, -1, 0), np.zeros(len(texts))
        # copies, as arrays that numpy looks into cannot grow
        starts, ids, scores = np.array(self.starts, np.int64), np.array(self.ids, np.int32), np.array(self.scores)
        n = starts[at + 1] - starts[at]
        upto = np.cumsum(n)
        flat = ids[np.repeat(starts[at] - upto + n, n) + np.arange(upto[-1])]
        sizes = np.diff(np.r_[0, upto][ends])
        sums = np.diff(np.r_[0.0, np.cumsum(scores[at])][ends])
        return flat, np.where(null, -1, sizes), sums


def encode_texts(model: Model, texts: list[str | None]) -> list[list[int] | None]:
    flat, sizes, _ = Encoder(model).encode(texts)
    ends = np.cumsum(np.maximum(sizes, 0))
    return [None if n < 0 else flat[e - n : e].tolist() for n, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


def _run(shared, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        encoder = model.encoder()
        for batch in slices(batches, text, 1 << 20):
            flat, sizes, scores = encoder.encode(batch.column(text).to_pylist())
            null, ends = sizes < 0, np.cumsum(np.maximum(sizes, 0))
            decoded = [None if n < 0 else model.decode(flat[e - n : e].tolist()) for n, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
            ids = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32), mask=np.r_[null, False]), pa.array(flat, pa.int32()))
            yield pa.record_batch(
                [*batch.columns, ids, pa.array(sizes, pa.int64(), mask=null), pa.array(scores, pa.float64(), mask=null), pa.array(decoded, pa.string())],
                names=[*batch.schema.names, *ADDED],
            )

    return run


#: Columns that `encode` adds.
ADDED = ["piece_ids", "n_pieces", "piece_score", "decoded"]


def encode(docs: DataFrame, model: Model | None = None, text: str = "text") -> DataFrame:
    """docs with piece_ids, n_pieces, piece_score (the path's score) and decoded (the ids turned back into text). Columns of
    these names are replaced."""
    docs = docs.drop(*(c for c in ADDED if c != text))
    shared = docs.sparkSession.sparkContext.broadcast(model or Model.load())
    kinds = [T.ArrayType(T.IntegerType()), T.LongType(), T.DoubleType(), T.StringType()]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, k) for c, k in zip(ADDED, kinds, strict=True))])
    return docs.mapInArrow(_run(shared, text), schema)
