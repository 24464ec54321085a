"""Static range asymmetric numeral system for token ids: interleaved lanes, checkpoints, checksums.

All blocks share one frequency table. A block deals its ids over ``lanes`` states of 64 bits: id i
belongs to lane i mod lanes, so one numpy operation codes a step of all lanes, of many blocks at
once. States stay in [2^31, 2^63) and give 32-bit words to the block's stream. Every ``every`` steps a
checkpoint keeps the states and the place in the stream; the stretches between checkpoints decode
independently of each other, here again side by side.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
_MASK = np.uint64(0xFFFFFFFF)


@dataclass(frozen=True)
class Frequencies:
    """``symbols`` in ascending order, their shares of 2^bits, and where these begin."""

    symbols: np.ndarray
    share: np.ndarray
    bits: int

    @staticmethod
    def of(symbols: np.ndarray, counts: np.ndarray) -> Frequencies:
        """Shares in proportion to counts, at least 1 each; what rounding leaves goes to (or comes
        from) the largest ones."""
        order = np.argsort(symbols)
        symbols, counts = np.asarray(symbols, np.int64)[order], np.asarray(counts, np.float64)[order]
        bits = min(24, max(12, int(len(symbols) - 1).bit_length() + 4)) if len(symbols) else 12
        share = np.maximum(1, np.floor(counts * ((1 << bits) / max(1.0, counts.sum())))).astype(np.int64)
        left = (1 << bits) - int(share.sum())
        for i in np.argsort(-share, kind="stable"):
            if not left or not len(share):
                break
            step = left if left > 0 else -min(-left, int(share[i]) - 1)
            share[i] += step
            left -= step
        return Frequencies(symbols, share, bits)

    @property
    def start(self) -> np.ndarray:
        return np.cumsum(self.share) - self.share


@dataclass
class Block:
    """``states`` has a row for each checkpoint (the first is where decoding begins), ``places`` the
    words of the stream that are read before it; ``check`` is the crc32 of the ids."""

    n: int
    lanes: int
    every: int
    states: np.ndarray
    places: np.ndarray
    words: np.ndarray
    check: int


def encode_blocks(blocks: list[np.ndarray], table: Frequencies, lanes: int = 128, every: int = 128) -> list[Block]:
    """Code each array of ids by itself; blocks of like lengths go side by side."""
    share, start = table.share.astype(np.uint64), table.start.astype(np.uint64)
    most = share << np.uint64(63 - table.bits)
    width = np.uint64(table.bits)
    place = np.zeros(int(table.symbols.max(initial=0)) + 1, np.int32)
    place[table.symbols] = np.arange(len(table.symbols))
    order = sorted((i for i in range(len(blocks)) if len(blocks[i])), key=lambda i: -len(blocks[i]))
    steps = np.array([-(-len(blocks[i]) // lanes) for i in order], np.int64)
    out = [Block(0, lanes, every, np.zeros((0, lanes), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint32), 0) for _ in blocks]
    if not order:
        return out
    tall = int(steps[0])
    coded = np.zeros((tall, len(order), lanes), np.int32)
    for k, i in enumerate(order):
        ids = place[blocks[i]]
        flat = np.zeros(int(steps[k]) * lanes, np.int32)  # the last step is filled with symbol 0
        flat[: len(ids)] = ids
        coded[: steps[k], k] = flat.reshape(-1, lanes)
    words = np.zeros((tall, len(order), lanes), np.uint32)
    gave = np.zeros((tall, len(order), lanes), bool)
    marks: list[list[np.ndarray]] = [[] for _ in order]
    x = np.full((len(order), lanes), _LOW, np.uint64)
    for t in range(tall - 1, -1, -1):  # the decoder reads backwards what is written here
        on = int(np.searchsorted(-steps, -t, side="left"))  # blocks with more than t steps
        s, state = coded[t, :on], x[:on]
        f = share[s]
        full = state >= most[s]
        words[t, :on] = (state & _MASK).astype(np.uint32)
        gave[t, :on] = full
        state = np.where(full, state >> _WORD, state)
        high = state // f
        x[:on] = (high << width) + (state - high * f) + start[s]
        if t % every == 0:
            for k in range(on):
                marks[k].append(x[k].copy())
    for k, i in enumerate(order):
        own = gave[: steps[k], k]
        given = own.sum(axis=1)
        # Where the stream stands before step t: words of the steps before it have been read.
        place = np.r_[0, np.cumsum(given)][:-1][::every]
        data = np.asarray(blocks[i]).astype("<u4").tobytes()
        out[i] = Block(len(blocks[i]), lanes, every, np.array(marks[k][::-1]), place, words[: steps[k], k][own], zlib.crc32(data))
    return out


class Decoder:
    """Decodes blocks of one table; the slot table is built once."""

    def __init__(self, table: Frequencies) -> None:
        self.table = table
        self.slot = np.repeat(np.arange(len(table.share), dtype=np.int32), table.share)
        self.share, self.start = table.share.astype(np.uint64), table.start.astype(np.uint64)

    def decode(self, blocks: list[Block]) -> list[np.ndarray]:
        """The ids of each block (unsigned 32-bit). A wrong checksum raises ValueError."""
        pieces = [(b, c) for b, block in enumerate(blocks) for c in range(len(block.places))]
        if not pieces:
            return [np.zeros(0, np.uint32) for _ in blocks]
        lanes, every = blocks[pieces[0][0]].lanes, blocks[pieces[0][0]].every
        steps = np.array([min(every, -(-blocks[b].n // lanes) - c * every) for b, c in pieces])
        order = np.argsort(-steps, kind="stable")
        pieces, steps = [pieces[i] for i in order], steps[order]
        base = np.cumsum([0, *(len(b.words) for b in blocks)])
        stream = np.concatenate([*(b.words for b in blocks), np.zeros(1, np.uint32)])
        at = np.array([base[b] + blocks[b].places[c] for b, c in pieces])
        x = np.array([blocks[b].states[c] for b, c in pieces])
        found = np.zeros((len(pieces), int(steps[0]), lanes), np.int32)
        bits, slots = np.uint64(self.table.bits), np.uint64((1 << self.table.bits) - 1)
        for t in range(int(steps[0])):
            on = int(np.searchsorted(-steps, -t, side="left"))
            state = x[:on]
            low = state & slots
            s = self.slot[low]
            found[:on, t] = s
            state = self.share[s] * (state >> bits) + low - self.start[s]
            need = state < _LOW
            rank = np.cumsum(need, axis=1)
            read = stream[np.minimum(at[:on, None] + rank - 1, len(stream) - 1)].astype(np.uint64)
            x[:on] = np.where(need, (state << _WORD) | read, state)
            at[:on] += rank[:, -1]
        out = [np.zeros(-(-b.n // lanes) * lanes, np.uint32) for b in blocks]
        symbols = self.table.symbols.astype(np.uint32)
        for k, (b, c) in enumerate(pieces):
            first = c * every * lanes
            out[b][first : first + steps[k] * lanes] = symbols[found[k, : steps[k]].ravel()]
        for b, block in enumerate(blocks):
            out[b] = out[b][: block.n]
            if zlib.crc32(out[b].astype("<u4").tobytes()) != block.check:
                raise ValueError("a block of token ids does not match its checksum")
        return out
