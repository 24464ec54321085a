"""SentencePiece BPE, encoding by vectorised merge rounds and decoding by gathered bytes.

Encoding is exact for BPE models with byte fallback and identity normal form (others are refused). A
text is cut wherever no piece of the vocabulary holds the two characters next to each other: no merge
ever crosses such a place. The distinct words that this gives are merged together in flat arrays: each
round finds the smallest pair rank of every word, merges all its leftmost occurrences at once, and
compacts the arrays, until no pair remains.

The library merges one pair at a time, the best first and of equals the leftmost. Merges of one round
give the same result as long as none of them makes a pair that the library would take before the
rest; where one does, the later merges of that word wait for the next round. Runs of one character
whose powers all share a rank (the spaces' pieces) are cut into the longest power at once, which is
what merging leftmost first comes to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

SPACE = "▁"
_NONE = np.iinfo(np.int64).max
#: Field numbers of the model file's format.
_TRAINER, _NORMALIZER = 2, 3
_MODEL_TYPE, _BPE, _BYTE_FALLBACK, _SUFFIX_SPACE, _UNKNOWN = 3, 2, 35, 24, 44
_CHARSMAP, _DUMMY_PREFIX, _EXTRA_SPACES, _ESCAPE_SPACES = 2, 3, 4, 5


def _fields(raw: bytes) -> dict[int, int | bytes]:
    """The last value of each field of one message."""
    at, found = 0, {}

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(raw):
        tag = number()
        if tag & 7 == 0:
            found[tag >> 3] = number()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or number()
            found[tag >> 3] = raw[at : at + size]
            at += size
    return found


class PieceModel:
    """A model file's pieces as arrays. ``words`` distinct words are kept with their ids; texts are
    handled in stretches of about ``stretch`` characters."""

    def __init__(self, path: str, words: int = 600_000, stretch: int = 1 << 20) -> None:
        import sentencepiece

        with open(path, "rb") as f:
            spec = _fields(f.read())
        trainer, norm = _fields(spec.get(_TRAINER, b"")), _fields(spec.get(_NORMALIZER, b""))
        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = lib.vocab_size()
        ids = range(self.size)
        if trainer.get(_MODEL_TYPE) != _BPE or not trainer.get(_BYTE_FALLBACK) or trainer.get(_SUFFIX_SPACE):
            raise ValueError("only BPE models with byte fallback are supported")
        if norm.get(_CHARSMAP) or norm.get(_EXTRA_SPACES, 1) or not norm.get(_ESCAPE_SPACES, 1) or any(map(lib.is_unused, ids)):
            raise ValueError("only models that keep texts as they are are supported")
        self.prefix = SPACE if norm.get(_DUMMY_PREFIX, 1) else ""
        piece = [lib.id_to_piece(i) for i in ids]
        self.byte_id = np.array([lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        plain = [i for i in ids if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i))]
        self._tables({piece[i]: i for i in plain}, {i: lib.get_score(i) for i in plain})
        self._spelling(lib, piece, trainer.get(_UNKNOWN, " ⁇ ".encode()))
        self.words, self.stretch = words, stretch
        self.kept: dict[str, bytes] = {}

    def _tables(self, known: dict[str, int], score: dict[int, float]) -> None:
        """Symbols are the ids of pieces, then the characters that are none, by code point."""
        alphabet = sorted({c for p in known for c in p})
        self.place = np.zeros(0x110000, np.int32)  # 0: in no piece
        self.place[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.across = len(alphabet) + 1
        joined = np.zeros(self.across**2 // 8 + 1, np.uint8)
        both = {self.place[ord(a)] * self.across + int(self.place[ord(b)]) for p in known for a, b in zip(p, p[1:])}
        for k in both:
            joined[k >> 3] |= 1 << (k & 7)
        self.joined = joined
        self.char = np.arange(0x110000, dtype=np.int64) + self.size
        single = [c for c in alphabet if c in known]
        self.char[[ord(c) for c in single]] = [known[c] for c in single]
        order = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = np.full(self.size, _NONE)
        for i, s in score.items():
            self.rank[i] = order[s]
        self.step = self.size + 0x110000
        symbol = lambda p: known.get(p, self.size + ord(p) if len(p) == 1 else None)
        pairs = {}
        for p, i in known.items():
            for k in range(1, len(p)):
                a, b = symbol(p[:k]), symbol(p[k:])
                if a is not None and b is not None:
                    pairs[a * self.step + b] = i
        self.keys = np.array(sorted(pairs) or [-1], np.int64)
        self.made = np.array([pairs[k] for k in sorted(pairs)] or [0], np.int64)
        self.powers: dict[int, tuple[int, dict[int, int]]] = {}
        for c in {p[0] for p in known if len(p) > 1 and not p.strip(p[0])}:
            power = {len(p): i for p, i in known.items() if not p.strip(c)}
            ranks = {int(self.rank[i]) for n, i in power.items() if n > 1}
            equal = len(ranks) == 1 and sum(self.rank[i] in ranks for i in known.values()) <= len(power)
            if equal and len(power) > 2 and 1 in power and not any(c in p[1:] and p.strip(c) for p in known):
                self.powers[ranks.pop()] = power[1], power

    def _spelling(self, lib, piece: list[str], unknown: bytes) -> None:
        """The bytes that each id stands for in a decoded text."""
        spelled = []
        for i, p in enumerate(piece):
            if lib.is_byte(i):
                spelled.append(bytes([int(p[3:5], 16)]))
            else:
                spelled.append(b"" if lib.is_control(i) else unknown if lib.is_unknown(i) else p.replace(SPACE, " ").encode())
        self.long = np.array([len(s) for s in spelled])
        self.first = np.cumsum(self.long) - self.long
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.is_byte = np.array([lib.is_byte(i) for i in range(self.size)])
        self.is_control = np.array([lib.is_control(i) for i in range(self.size)])
        self.leads = np.array([p.startswith(SPACE) for p in piece])

    def _merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ids that the pairs merge to, -1 for none."""
        key = a * self.step + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], -1)

    def _ranks(self, a: np.ndarray, b: np.ndarray, same: np.ndarray) -> np.ndarray:
        to = self._merged(a, b)
        return np.where(same & (to >= 0), self.rank[to], _NONE)

    def merge(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols left of each word, and the words' numbers: (sym, word) with words in order."""
        ready: list[tuple[np.ndarray, np.ndarray]] = []
        nxt = lambda x: np.append(x[1:], -1)
        rank = self._ranks(sym, nxt(sym), word == nxt(word))
        while len(sym):
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least, size = np.minimum.reduceat(rank, start), np.diff(np.r_[start, len(sym)])
            low = np.repeat(least, size)
            if (least == _NONE).any():
                done = low == _NONE
                ready.append((sym[done], word[done]))
                sym, word, rank, low = sym[~done], word[~done], rank[~done], low[~done]
                if not len(sym):
                    break
            pos, take = self._leftmost(sym, np.flatnonzero(rank == low), rank)
            to = self._merged(sym[pos], sym[pos + 1])
            for k in np.flatnonzero(take > 2).tolist():
                to[k] = self.powers[int(rank[pos[k]])][1][int(take[k])]
            pos, take, to = self._undisturbed(sym, word, low, pos, take, to)
            gone = np.zeros(len(sym), bool)
            more = take - 1
            gone[np.repeat(pos + 1, more) + np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)] = True
            sym[pos] = to
            at = pos - (np.cumsum(gone)[pos])
            sym, word, rank = sym[~gone], word[~gone], rank[~gone]
            changed = np.zeros(len(sym), bool)
            changed[at] = changed[np.maximum(at - 1, 0)] = True
            at = np.flatnonzero(changed)
            after = np.minimum(at + 1, len(sym) - 1)
            rank[at] = self._ranks(sym[at], sym[after], (word[at] == word[after]) & (after > at))
        if not ready:
            return sym, word
        sym, word = (np.concatenate(x) for x in zip(*ready))
        order = np.argsort(word, kind="stable")
        return sym[order], word[order]

    def _leftmost(self, sym: np.ndarray, pos: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that do not overlap, leftmost first, and how many symbols each takes."""
        new = np.r_[True, np.diff(pos) != 1]
        run = np.flatnonzero(new)
        length = np.diff(np.r_[run, len(pos)])
        first, at = pos[run], np.arange(len(pos)) - np.repeat(run, length)
        begins = at % 2 == 0
        pos, take = pos[begins], np.full(begins.sum(), 2)
        for r, (c, power) in self.powers.items():
            own = (rank[first] == r) & (sym[first] == c) & (length > 1)
            for a, n in zip(first[own].tolist(), (length[own] + 1).tolist()):
                sizes = np.array(_powers_of(n, power))
                begin = a + np.cumsum(sizes) - sizes
                other = (pos < a) | (pos >= a + n)
                pos, take = np.r_[pos[other], begin[sizes > 1]], np.r_[take[other], sizes[sizes > 1]]
        order = np.argsort(pos)
        return pos[order], take[order]

    def _undisturbed(self, sym, word, low, pos, take, to):
        """The merges that come before any pair which an earlier one of them makes."""
        prev, after = np.maximum(pos - 1, 0), np.minimum(pos + take, len(sym) - 1)
        left = sym[prev]
        touching = np.r_[False, (pos[:-1] + take[:-1] == pos[1:])]
        left[touching] = to[:-1][touching[1:]]
        mine, limit = word[pos], low[pos]
        found = self._ranks(left, to, (pos > 0) & (word[prev] == mine)) <= limit
        found |= self._ranks(to, sym[after], (pos + take < len(sym)) & (word[after] == mine)) <= limit
        if not found.any():
            return pos, take, to
        before = np.cumsum(found) - found
        first = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
        keep = before == np.repeat(before[first], np.diff(np.r_[first, len(pos)]))
        return pos[keep], take[keep], to[keep]

    def _ids(self, words: list[str]) -> list[bytes]:
        """The ids of each word, little-endian."""
        code = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        sym, word = self.merge(self.char[code], np.repeat(np.arange(len(words)), [len(w) for w in words]))
        ends = np.searchsorted(word, np.arange(1, len(words) + 1)).tolist()
        raw = sym.astype("<i4").tobytes()
        out = [raw[4 * a : 4 * b] for a, b in zip([0, *ends], ends)]
        for k in np.unique(word[sym >= self.size]).tolist():
            own = np.frombuffer(out[k], "<i4").tolist()
            spelled = [[s] if s < self.size else self.byte_id[list(chr(s - self.size).encode())].tolist() for s in own]
            out[k] = np.array([i for s in spelled for i in s], "<i4").tobytes()
        return out

    def _words(self, text: str) -> Iterator[list[str]]:
        """The words of a text, a stretch at a time."""
        text = (self.prefix + text).replace(" ", SPACE) if text else ""
        begin, size = 0, self.stretch
        while begin < len(text):
            part = text[begin : begin + size]
            place = self.place[np.frombuffer(part.encode("utf-32-le"), "<u4")].astype(np.int64)
            key = place[:-1] * self.across + place[1:]
            cut = np.flatnonzero(self.joined[key >> 3] >> (key & 7) & 1 == 0) + 1
            last = begin + size >= len(text)
            if not last and not len(cut):
                size *= 2
                continue
            ends = cut.tolist() + ([len(part)] if last else [])
            yield [part[a:b] for a, b in zip([0, *ends], ends)]
            begin, size = begin + ends[-1], self.stretch

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as the library gives them, as little-endian 32-bit integers. New words
        are merged together, those of many texts at once."""
        parts: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[list[bytes], list[str]]] = []
        size = 0
        for own, text in zip(parts, texts):
            for words in self._words(text):
                waiting.append((own, words))
                size += len(words)
                if size >= self.stretch:
                    self._put(waiting)
                    size = 0
        self._put(waiting)
        return [own[0] if len(own) == 1 else b"".join(own) for own in parts]

    def _put(self, waiting: list[tuple[list[bytes], list[str]]]) -> None:
        kept = self.kept
        new = list(set().union(*(words for _, words in waiting)).difference(kept))
        if new:
            kept.update(zip(new, self._ids(new)))
        for own, words in waiting:
            own.append(b"".join(map(kept.__getitem__, words)))
        waiting.clear()
        for w in new:
            if len(w) > 64:
                del kept[w]
        if len(kept) > self.words:
            kept.clear()

    def decode(self, rows: list[np.ndarray]) -> list[str]:
        """The texts of rows of ids, as the library decodes them."""
        ids = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
        if len(ids) and not 0 <= ids.min() <= ids.max() < self.size:
            raise ValueError("an id lies outside the vocabulary")
        long = self.long[ids]
        end = np.cumsum(long)
        data = self.spelled[np.repeat(self.first[ids] - (end - long), long) + np.arange(end[-1] if len(end) else 0)].tobytes()
        out, at, byte = [], 0, 0
        for row in rows:
            row = np.asarray(row)
            until = int(end[at + len(row) - 1]) if len(row) else byte
            own = data[byte:until]
            seen = np.flatnonzero(~self.is_control[row])
            if self.prefix and len(seen) and self.leads[row[seen[0]]]:
                own = own[1:]
            breaks = np.flatnonzero(self.is_control[row])
            if len(breaks) and self.is_byte[row].any():  # bytes on both sides of one make no character
                cut = (end[at + breaks] - until + len(own)).clip(0).tolist()
                out.append("".join(_text(own[a:b]) for a, b in zip([0, *cut], [*cut, len(own)])))
            else:
                out.append(_text(own))
            at, byte = at + len(row), until
        return out


def _powers_of(n: int, power: dict[int, int]) -> list[int]:
    """The sizes that n equal characters are merged to, leftmost first, where the sizes in ``power`` may be made."""
    ready, own = [], 1
    while True:
        if ready and ready[-1] + own in power:
            own += ready.pop()
        elif n > 1 and own + 1 in power:
            own, n = own + 1, n - 1
        elif n > 1:
            ready.append(own)
            own, n = 1, n - 1
        else:
            return [*ready, own]


def _text(data: bytes) -> str:
    """data as UTF-8; each byte that belongs to no whole character becomes a replacement character."""
    out, at = [], 0
    while True:
        try:
            return "".join([*out, data[at:].decode()])
        except UnicodeDecodeError as e:
            out += [data[at : at + e.start].decode(), "�"]
            at += e.start + 1


_MODELS: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    """One model for each file in a Python worker; later tasks use it and its kept words again."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of every whole text, without begin and end ids.

    A null or empty text has no ids; null and repeated ids of documents are rows of their own, an empty
    table gives an empty result, other columns are not read. Long texts are cut into stretches where no
    piece can join, so memory beyond a text and its ids does not grow with it (but for a stretch that
    has no such place). Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = piece_model(model)
        for part in (p for b in batches for p in slices(b, "text", 1 << 20)):
            made = own.encode([t or "" for t in part.column(1).to_pylist()])
            ends = np.cumsum([0, *(len(m) // 4 for m in made)])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(made), "<i4")))
            yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode_pieces(rows: DataFrame, model: str) -> DataFrame:
    """rows (doc_id, ids) with the decoded ``text``; null ids decode to an empty text, ids outside the
    vocabulary are an error. Bytes that make no character become U+FFFD, one each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = piece_model(model)
        for batch in batches:
            at = 0
            for n in _runs(batch.column(1)):
                part = batch.slice(at, n)
                col = part.column(1)
                flat, ends = col.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *(v or 0 for v in col.value_lengths().to_pylist())])
                texts = own.decode([flat[a:b] for a, b in zip(ends, ends[1:])])
                yield pa.RecordBatch.from_arrays([part.column(0), col, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])
                at += n

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def _runs(lists: pa.ListArray, limit: int = 1 << 19) -> Iterator[int]:
    """Numbers of rows that together hold about ``limit`` values (a longer row stands alone)."""
    n = total = 0
    for size in lists.value_lengths().to_pylist():
        if n and total + (size or 0) > limit:
            yield n
            n = total = 0
        n, total = n + 1, total + (size or 0)
    if n:
        yield n
