"""Sequence packing by minimum bin slack.

Documents become token ids. A document longer than a sequence is cut into full sequences
and a rest; rests and short documents stay whole. Each task keeps a window of pieces as
counts by length. To fill a sequence it takes the longest piece and then, by a bitset
subset-sum over the other lengths, the multiset that comes closest to the capacity; the
bitsets are walked back to get the counts. A window is filled up again before it runs
low, so only the last sequences of a task can have padding that matters.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict, deque
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from meridian.llm.text import utf8

CAPACITY = 2048
END = 1
#: Tokens that a window holds before it is packed, in sequences, and those it keeps back for the next.
WINDOW, KEEP = 512, 64
#: Words whose ids a worker remembers; the least recent go first, by halves.
CACHE = 500_000

#: Documents encoded at once.
SLICE = 500

#: How a vocabulary that is taken word by word normalises a text and splits it, as its file says.
STEPS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_IS_LETTER = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8))
_IS_POINT = np.array([33 <= c < 127 and c != 39 and not chr(c).isalpha() for c in range(256)])


class WordEncoder:
    """Token ids of whole texts, as little-endian unsigned 32-bit bytes.

    A vocabulary whose file says SPLIT and STEPS drops white space and never merges across it,
    so the ids of a text are those of its words in order, and each different word goes through
    the tokenizer once. With any other vocabulary whole texts go through it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        said = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (said["normalizer"] or {}).get("normalizers", [])]
        splits = [(x.get("pattern") or {}).get("Regex") for x in (said["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.by_word = steps == STEPS and splits[:1] == [SPLIT] and not said["post_processor"]
        words = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(words.values(), default=0) + 1, bool)
        self.ends_word[[i for w, i in words.items() if w.endswith("</w>")]] = True

    def words(self, text: bytes) -> list[bytes]:
        """The words of a text, with what can't change their ids evened out: ASCII case, and digits or points after a letter set apart.

        An apostrophe may belong to the letters after it, so it stays. "<|" may name a special
        token, where case matters; such a text is only split.
        """
        if b"<|" in text:
            return text.split()
        text = text.translate(_LOW)
        codes = np.frombuffer(text, np.uint8)
        cut = np.flatnonzero(_IS_LETTER[codes[:-1]] & _IS_POINT[codes[1:]]) + 1
        if len(cut):
            spaced = np.full(len(codes) + len(cut), 32, np.uint8)
            kept = np.ones(len(spaced), bool)
            kept[cut + np.arange(len(cut))] = False
            spaced[kept] = codes
            text = spaced.tobytes()
        return text.split()

    def learn(self, new: list[bytes]) -> None:
        """Put the ids of new words into `known`.

        Words of lower-case letters alone are one pre-token each, whose last id is one that
        ends a word. So they can go through the tokenizer in groups and be told apart after;
        a group that does not come out even, and all other words, go one by one.
        """
        single = []
        if self.ends_word.any():
            plain = [(w, t) for w in new if (t := w.decode()).isalpha() and t == t.lower()]
            groups = [plain[i : i + 64] for i in range(0, len(plain), 64)]
            new = list(set(new).difference(w for w, _ in plain))
            for i in range(0, len(groups), 64):  # an encoding is much larger than its ids
                part = groups[i : i + 64]
                for g, e in zip(part, self.tokenizer.encode_batch_fast([" ".join(t for _, t in g) for g in part], add_special_tokens=False)):
                    ids = np.array(e.ids, "<u4")
                    ends = (np.flatnonzero(self.ends_word[ids]) * 4 + 4).tolist()
                    if len(ends) != len(g):
                        single += [w for w, _ in g]
                        continue
                    data = ids.tobytes()
                    for (w, _), start, end in zip(g, [0, *ends], ends):
                        self.known[w] = data[start:end]
        single += new
        for i in range(0, len(single), 4096):
            part = single[i : i + 4096]
            for w, e in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)):
                self.known[w] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_word:
            whole = [t.decode() for t in utf8(texts)]
            return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in whole]
        split = [self.words(t) for t in utf8(texts)]
        if len(self.known) > CACHE // 2:
            self.known, self.old = {}, self.known
        missing = set().union(*split).difference(self.known)
        again = missing.intersection(self.old)
        self.known.update(zip(again, map(self.old.__getitem__, again)))
        new = list(missing - again)
        self.learn(new)
        return [b"".join(map(self.known.__getitem__, words)) for words in split]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def fill(counts: dict[int, int], room: int, lengths: list[int] | None = None) -> list[tuple[int, int]]:
    """(length, how many) of a multiset from `counts` whose sum is the largest up to `room`; `lengths` are its keys in order."""
    lengths = sorted(counts) if lengths is None else lengths
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in reversed(lengths[: bisect_right(lengths, room)]):
        left, part = min(counts[length], room // length), 1
        while left > 0:
            take = min(part, left)
            steps.append((reach, length, take))
            reach = (reach | (reach << (length * take))) & mask
            left, part = left - take, part * 2
        if reach >> room:
            break
    total = reach.bit_length() - 1
    chosen: dict[int, int] = defaultdict(int)
    for before, length, take in reversed(steps):
        if not (before >> total) & 1:
            total -= length * take
            chosen[length] += take
    return list(chosen.items())


class Window:
    """Pieces of one task, by length, first in first out."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.pieces: dict[int, deque] = defaultdict(deque)
        self.counts: dict[int, int] = {}
        self.lengths: list[int] = []
        self.tokens = 0

    def add(self, length: int, piece: object) -> None:
        self.pieces[length].append(piece)
        if length not in self.counts:
            insort(self.lengths, length)
        self.counts[length] = self.counts.get(length, 0) + 1
        self.tokens += length

    def take(self, length: int) -> object:
        self.counts[length] -= 1
        if not self.counts[length]:
            del self.counts[length]
            del self.lengths[bisect_left(self.lengths, length)]
        self.tokens -= length
        return self.pieces[length].popleft()

    def sequence(self) -> list[object]:
        longest = self.lengths[-1]
        out = [self.take(longest)]
        room = self.capacity - longest
        if room and self.counts:
            for length, many in fill(self.counts, room, self.lengths):
                out += [self.take(length) for _ in range(many)]
        return out


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, digest: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (array<int>), doc_tokens, sequence_id, offset.

    With `digest`, ids_crc32 (of the little-endian unsigned 32-bit ids) stands in for ids.
    A document's ids end with `end`; a null or empty text has that id alone. Rows with a
    null doc_id and repeated rows are packed like any other. Extra columns are ignored.
    An empty table gives an empty result. sequence_id is unique, not gapless.
    """
    column, kind = ("ids_crc32", "long") if digest else ("ids", "array<int>")
    ending = np.array([end], "<u4").tobytes()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, window, sequence = encoder(path), Window(capacity), TaskContext.get().partitionId() << 33
        names = ["doc_id", "start", "length", column, "doc_tokens", "sequence_id", "offset"]

        def drain(least: int) -> list[tuple]:
            nonlocal sequence
            rows = []
            while window.tokens > least:
                at = 0
                for doc, start, ids, total in window.sequence():
                    n = len(ids) // 4
                    value = crc32(ids) if digest else np.frombuffer(ids, "<u4").astype(np.int32)
                    rows.append((doc, start, n, value, total, sequence, at))
                    at += n
                sequence += 1
            return rows

        for f in frames:
            for i in range(0, len(f), SLICE):
                part, rows = f.iloc[i : i + SLICE], []
                for doc, ids in zip(part["id"], enc.encode(part["text"].tolist())):
                    doc = None if doc is None else int(doc)
                    ids += ending
                    n = len(ids) // 4
                    for s in range(0, n, capacity):
                        piece = ids[4 * s : 4 * (s + capacity)]
                        window.add(len(piece) // 4, (doc, s, piece, n))
                    if window.tokens > WINDOW * capacity:
                        rows += drain(KEEP * capacity)
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})
        if rows := drain(0):
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    schema = f"doc_id long, start long, length long, {column} {kind}, doc_tokens long, sequence_id long, offset long"
    return docs.selectExpr("cast(doc_id as string) as id", "text").mapInPandas(run, schema)
