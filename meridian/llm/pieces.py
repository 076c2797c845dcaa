"""SentencePiece encoding with seeded merge-dropout, and decoding.

Merges of a byte-pair vocabulary are taken from an agenda ordered by piece score. Each
candidate that comes up is skipped with the dropout rate as its chance: by a hash of the
seed, the document, the place of the word and the number of the candidate, so the same
seed gives the same segmentation on any machine and another seed another one. Whatever is
skipped, the pieces spell the text, and decoding gives it back.

No piece of such a vocabulary goes on past a space, a line end, or from a letter to
certain points, so what lies between is encoded by itself. The agendas of many words are
worked off at once: words with equally many parts are rows of an array, whose best
candidates come up together. Words of which nothing is skipped have their ids kept.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from hashlib import sha256
from heapq import heapify, heappop, heappush
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from xxhash import xxh3_64_intdigest

from meridian.llm.text import append_columns, mix

SPACE = "▁"
#: Stands for the space mark where a text itself has it; no valid text has this character.
MARK = "\ud800"
DROPOUT = 0.1
#: Longest word that is a row of an array; longer ones have an agenda of their own.
LONG = 32
#: Words whose ids a worker keeps; beyond that it starts anew.
CACHE = 400_000
#: Characters of the texts that are encoded at once, unless one alone has more, and words of one array.
BATCH, BLOCK = 1_000_000, 100_000


def _skipped(places: np.ndarray, candidate: np.ndarray | int, dropout: float) -> np.ndarray:
    """Whether the candidate of that number is skipped at the hashed place."""
    h = mix(mix(places + np.uint64(0xD1B54A32D192ED03) * np.asarray(candidate, np.uint64)))
    return (h >> np.uint64(11)).astype(np.float64) < dropout * 2.0**53


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1 ... of each of many runs, in order."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class PieceCodec:
    """Encoder and decoder for the byte-pair vocabulary of a SentencePiece model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        special = {i for i in range(len(self.pieces)) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i)}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special}
        self.score = {p: model.get_score(i) for p, i in self.ids.items()}
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.raw = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        long = [p for p in self.ids if len(p) > 1]
        after_letter = {b for p in long for a, b in zip(p, p[1:]) if a.isalpha()}
        points = "".join(c for c in ".,;:!?" if c not in after_letter)
        line = "" if any("\n" in p for p in long) else "\n"
        word = f"{SPACE}*[^\\W\\d_{SPACE}]+(?=[{points}])|" if points else ""
        apart = f"{line}|" if line else ""
        self.words = re.compile(f"{word}{apart}{SPACE}*[^{SPACE}{line}]+|{SPACE}+")
        self._symbols(long)
        self._forget()

    def _symbols(self, long: list[str]) -> None:
        """Symbols are ids of pieces, or -1 - code for characters without a piece; a hash table has what each pair of them becomes."""
        self.of_char = -1 - np.arange(0x110000, dtype=np.int64)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        symbol = lambda p: self.ids.get(p, int(self.of_char[ord(p)]) if len(p) == 1 else None)
        place = {s: k for k, s in enumerate(sorted(set(self.score.values())))}
        found = [(symbol(p[:i]), symbol(p[i:]), p) for p in long for i in range(1, len(p))]
        found = [(a, b, self.ids[p], place[self.score[p]]) for a, b, p in found if a is not None and b is not None]
        left, right, whole, rank = np.array(found, np.int64).reshape(-1, 4).T
        self.shift = np.uint64(64 - max(4, (4 * len(found)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.pair_key, self.pair_whole, self.pair_rank = np.full(size, -1), np.full(size, -1), np.full(size, -1)
        keys = self._key(left, right)
        for k, at, w, r in zip(keys.tolist(), self._slot(keys).tolist(), whole.tolist(), rank.tolist()):
            while self.pair_key[at] != -1:
                at = (at + 1) % size
            self.pair_key[at], self.pair_whole[at], self.pair_rank[at] = k, w, r

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left << 32) + (right & 0xFFFFFFFF)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each pair becomes, and the rank of its score; -1 for pairs that don't merge."""
        keys = self._key(left, right).ravel()
        at = self._slot(keys)
        go = np.flatnonzero((self.pair_key[at] != keys) & (self.pair_key[at] != -1))
        while len(go):
            at[go] = (at[go] + 1) % len(self.pair_key)
            go = go[(self.pair_key[at[go]] != keys[go]) & (self.pair_key[at[go]] != -1)]
        return self.pair_whole[at].reshape(left.shape), self.pair_rank[at].reshape(left.shape)

    def _forget(self) -> None:
        self.number, self.flat = _Numbers(), np.empty(0, "<u4")
        self.start, self.length, self.came = (np.empty(0, np.int64) for _ in range(3))

    def word(self, word: str, skipped: Callable[[int], bool] = lambda candidate: False) -> tuple[np.ndarray, int]:
        """Ids of one word, and how many candidates came up. The agenda holds (-score, place, left part, right part)."""
        parts: list[str | None] = list(word)
        n = len(parts)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        score, came = self.score, 0
        agenda: list[tuple[float, int, str, str]] = []
        for i in range(n - 1):
            s = score.get(parts[i] + parts[i + 1])
            if s is not None:
                agenda.append((-s, i, parts[i], parts[i + 1]))
        heapify(agenda)
        while agenda:
            _, i, a, b = heappop(agenda)
            j = right[i] if parts[i] == a else -1
            if j < 0 or parts[j] != b:
                continue
            came += 1
            if skipped(came - 1):
                continue
            parts[i], parts[j] = merged, _ = a + b, None
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                s = score.get(merged + parts[k])
                if s is not None:
                    heappush(agenda, (-s, i, merged, parts[k]))
            k = left[i]
            if k >= 0:
                s = score.get(parts[k] + merged)
                if s is not None:
                    heappush(agenda, (-s, k, parts[k], merged))
        out: list[int] = []
        for p in parts:
            if p is not None:
                k = self.ids.get(p)
                out += [k] if k is not None else self._bytes(ord(p))
        return np.array(out, "<u4"), came

    def _bytes(self, code: int) -> list[int]:
        """Ids of the byte pieces that spell a character."""
        return [self.byte_ids[x] for x in (SPACE if chr(code) == MARK else chr(code)).encode("utf-8", "replace")]

    def _rows(self, words: list[str], places: np.ndarray | None, dropout: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all words, how many each has, how many candidates came up) for words of at most LONG characters."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        text = self.of_char[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        begin = np.cumsum(sizes) - sizes
        came, parts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        ready: list[tuple[np.ndarray, np.ndarray]] = []
        down = (np.empty(0, np.int64), *[np.empty((0, w), np.int64) for w in (0, 0, 0)])
        for n in range(int(sizes.max(initial=0)), 0, -1):
            rows = np.flatnonzero(sizes == n)
            symbols = text[begin[rows][:, None] + np.arange(n)]
            whole, rank = self._pairs(symbols[:, :-1], symbols[:, 1:])
            if len(down[0]):
                rows, symbols, whole, rank = (np.concatenate(x) for x in zip((rows, symbols, whole, rank), down))
            merged = []
            while len(rows):
                best = rank.argmax(axis=1) if n > 1 else np.zeros(len(rows), np.int64)
                live = rank[np.arange(len(rows)), best] >= 0 if n > 1 else np.zeros(len(rows), bool)
                ready.append((rows[~live], symbols[~live]))
                rows, symbols, whole, rank, best = (x[live] for x in (rows, symbols, whole, rank, best))
                go = np.ones(len(rows), bool) if places is None else ~_skipped(places[rows], came[rows], dropout)
                came[rows] += 1
                if go.any():
                    merged.append(self._merged(*(x[go] for x in (rows, symbols, whole, rank, best))))
                rows, symbols, whole, rank, best = (x[~go] for x in (rows, symbols, whole, rank, best))
                rank[np.arange(len(rows)), best] = -1
            down = tuple(np.concatenate(x) for x in zip(*merged)) if merged else (rows, *[np.empty((0, max(0, n - k)), np.int64) for k in (1, 2, 2)])
        for rows, symbols in ready:
            parts[rows] = symbols.shape[1]
        flat = np.empty(int(parts.sum()), np.int64)
        begin = np.cumsum(parts) - parts
        for rows, symbols in ready:
            flat[begin[rows][:, None] + np.arange(symbols.shape[1])] = symbols
        if len(flat) and flat.min() < 0:
            flat, parts = self._spelled(flat, parts)
        return flat.astype("<u4"), parts, came

    def _merged(self, rows: np.ndarray, symbols: np.ndarray, whole: np.ndarray, rank: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, ...]:
        """The rows after their candidates `best` are merged, one part shorter."""
        r, n = np.arange(len(rows)), symbols.shape[1]
        symbols[r, best] = whole[r, best]
        stays, pairs = np.ones((len(rows), n), bool), np.ones((len(rows), n - 1), bool)
        stays[r, best + 1], pairs[r, best] = False, False
        symbols = symbols[stays].reshape(len(rows), n - 1)
        whole, rank = (x[pairs].reshape(len(rows), n - 2) for x in (whole, rank))
        for i, at in ((np.flatnonzero(best > 0), -1), (np.flatnonzero(best < n - 2), 0)):
            k = best[i] + at
            whole[i, k], rank[i, k] = self._pairs(symbols[i, k], symbols[i, k + 1])
        return rows, symbols, whole, rank

    def _spelled(self, flat: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same with byte pieces in place of characters that have no piece."""
        odd = {c: self._bytes(-1 - c) for c in np.unique(flat[flat < 0]).tolist()}
        many = np.ones(len(flat), np.int64)
        at = np.flatnonzero(flat < 0)
        many[at] = [len(odd[c]) for c in flat[at].tolist()]
        of_word = np.repeat(np.arange(len(parts)), parts)
        out = np.repeat(flat, many)
        out[out < 0] = [x for c in flat[at].tolist() for x in odd[c]]
        return out, np.bincount(of_word, many, len(parts)).astype(np.int64)

    def _merge(self, words: list[str], places: np.ndarray | None = None, dropout: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """`_rows` for words of any length, block by block."""
        ids: list[np.ndarray] = []
        many, came, start, done = *(np.zeros(len(words), np.int64) for _ in range(3)), 0
        long = np.fromiter(map(len, words), np.int64, len(words)) > LONG
        short = np.flatnonzero(~long)
        for i in range(0, len(short), BLOCK):
            k = short[i : i + BLOCK]
            got, many[k], came[k] = self._rows([words[j] for j in k.tolist()], None if places is None else places[k], dropout)
            start[k] = done + np.cumsum(many[k]) - many[k]
            ids.append(got)
            done += len(got)
        for k in np.flatnonzero(long).tolist():
            got, came[k] = self.word(words[k]) if places is None else self.word(words[k], _asked(places[k], dropout))
            start[k], many[k] = done, len(got)
            ids.append(got)
            done += len(got)
        flat = np.concatenate(ids or [np.empty(0, "<u4")])
        return (flat[_spread(start, many)] if long.any() else flat), many, came

    def encode_all(self, texts: list[str], seed: int = 0, dropout: float = 0.0, docs: list[str] | None = None) -> list[np.ndarray]:
        """Ids of whole texts as little-endian unsigned 32-bit numbers; `docs` tells their places apart."""
        out: list[np.ndarray] = []
        at, size = 0, 0
        for i, t in enumerate(texts, 1):
            size += len(t)
            if size >= BATCH or i == len(texts):
                out += self._encode(texts[at:i], seed, dropout, docs[at:i] if docs else [""] * (i - at))
                at, size = i, 0
        return out

    def _encode(self, texts: list[str], seed: int, dropout: float, docs: list[str]) -> list[np.ndarray]:
        if len(self.number) > CACHE:
            self._forget()
        split = [self.words.findall((" " + t).replace(SPACE, MARK).replace(" ", SPACE)) if t else [] for t in texts]
        sizes = np.array([len(w) for w in split], np.int64)
        words = [w for part in split for w in part]
        had = len(self.number)
        number = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        new = list(self.number)[had:]
        if new:
            ids, many, came = self._merge(new)
            self.start = np.r_[self.start, len(self.flat) + np.cumsum(many) - many]
            self.flat, self.length, self.came = np.r_[self.flat, ids], np.r_[self.length, many], np.r_[self.came, came]
        start, length, flat = self.start[number], self.length[number], self.flat
        if dropout:
            seeds = np.array([xxh3_64_intdigest(f"{seed}\0{d}".encode()) for d in docs], np.uint64)
            nth = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            places = mix((nth + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.repeat(seeds, sizes))
            came, hit = self.came[number], np.zeros(len(words), bool)
            left = np.flatnonzero(came)
            for k in range(int(came.max(initial=0))):
                skip = _skipped(places[left], k, dropout)
                hit[left[skip]] = True
                left = left[~skip & (came[left] > k + 1)]
                if not len(left):
                    break
            hits = np.flatnonzero(hit)
            ids, many, _ = self._merge([words[i] for i in hits.tolist()], places[hits], dropout)
            start[hits], length[hits] = len(flat) + np.cumsum(many) - many, many
            flat = np.r_[flat, ids]
        ids = flat[_spread(start, length)]
        ends = np.cumsum(np.r_[0, length])[np.cumsum(sizes)]
        return np.split(ids, ends[:-1]) if len(texts) else []

    def encode(self, text: str, seed: int = 0, dropout: float = 0.0, doc: str = "") -> np.ndarray:
        """Ids of one whole text."""
        return self.encode_all([text], seed, dropout, [doc])[0]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


def _asked(place: np.uint64, dropout: float) -> Callable[[int], bool]:
    """`_skipped` at one place, for candidates in order, worked out many at a time."""
    known: list[bool] = []

    def skipped(candidate: int) -> bool:
        if candidate >= len(known):
            known.extend(_skipped(np.full(4096, place), np.arange(len(known), len(known) + 4096), dropout).tolist())
        return known[candidate]

    return skipped


@lru_cache(4)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encode_texts(docs: DataFrame, path: str, seed: int = 0, dropout: float = DROPOUT, key: str = "doc_id") -> DataFrame:
    """`docs` with ids (array<int>): its text under merge-dropout seeded by `seed` and the column `key`.

    A null or empty text has no ids. The vocabulary's own space mark (U+2581) in a text is
    spelled in byte pieces, so it decodes as it was; lone surrogates decode as '?'. A null
    key counts as a key. Repeated rows get equal ids. Columns named ids are replaced, others
    pass through. An empty table gives an empty result.
    """

    def run(keys: list, texts: list[str | None]) -> dict[str, list]:
        ids = codec(path).encode_all([t or "" for t in texts], seed, dropout, list(map(str, keys)))
        return {"ids": [x.astype(np.int32) for x in ids]}

    return append_columns(docs, [key, "text"], run, "ids array<int>")


def decode_ids(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """`df` with decoded: the text that a column of ids spells.

    Null ids give null, no ids an empty text. A column named decoded is replaced, others pass
    through. Repeated rows give repeated results, an empty table an empty one.
    """

    def run(rows: list) -> dict[str, list]:
        c = codec(path)
        return {"decoded": [None if r is None else c.decode(np.array(r, np.int64)) for r in rows]}

    return append_columns(df, [ids], run, "decoded string")


def segment_digests(docs: DataFrame, path: str, seed: int = 0, dropout: float = DROPOUT, key: str = "doc_id") -> DataFrame:
    """`docs` with n_ids, ids_crc32 (little-endian unsigned 32-bit) and decoded_sha256 of encode_texts' segmentation.

    The ids are made, digested and decoded in one task, so they need not travel. A null text
    counts as an empty one; columns named like an added one are replaced. An empty table gives
    an empty result.
    """

    def run(keys: list, texts: list[str | None]) -> dict[str, list]:
        c = codec(path)
        ids = c.encode_all([t or "" for t in texts], seed, dropout, list(map(str, keys)))
        return {
            "n_ids": list(map(len, ids)),
            "ids_crc32": [crc32(x.tobytes()) for x in ids],
            "decoded_sha256": [sha256(c.decode(x).encode()).hexdigest() for x in ids],
        }

    return append_columns(docs, [key, "text"], run, "n_ids long, ids_crc32 long, decoded_sha256 string")
