"""Exact removal of repeated byte strings by a distributed, prefix-aware merge sort of suffixes.

Sorting the suffixes at all bytes of a corpus would move a hundred times its size. Anchors (see
``anchors``) rule out the windows that cannot repeat, and of the others the suffixes that start at
anchors are sorted, each for its segment of neighbouring windows: a row of fixed width holds what
follows the anchor up to the segment's end, then what stands before it, read backwards. They are
sorted as runs in the map tasks, front-coded (length shared with the suffix before, then the rest),
exchanged by range, and merged by loser trees that hold, for every waiting run, the length it shares
with the last suffix put out, so that no known prefix is read again.

The merged order settles everything, byte by byte. Equal rows are equal segments: all but the first
go. Neighbours that share ``gram`` bytes or more share their anchor's gram, and only they can hold
equal windows; the shared lengths say which of their windows can be equal at all. A group of such
neighbours that a range border cuts is sorted once more, window by window.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import covered, open_segments
from .common import Workspace, free_name, keyed, slices
from .dealing import RUNS, by_key, grouped, numbers, parts_of
from .words import byte_values, windows

#: A block of a sorted run; block -1 lists the places of a run's equal rows.
BLOCKS = "run long, block long, n long, head binary, last binary, shared binary, rest binary, keys binary, starts binary"
_NAMES = [f.split()[0] for f in BLOCKS.split(", ")]
_TYPES = [pa.int64()] * 3 + [pa.binary()] * 6
#: Columns of a block that travel compressed.
_DENSE = ("shared", "rest", "keys", "starts")
#: What a merge puts out: runs of windows that go (``RUNS`` columns), or rows of cut groups.
MERGED = f"{RUNS}, row binary, key long, start long"
#: Fixed width of what follows the two texts in a row: their lengths and an end mark.
_TAIL = 5


def _dense(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _open(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def rows_of(data: np.ndarray, anchor: np.ndarray, before: np.ndarray, after: np.ndarray, width: int, back: int) -> np.ndarray:
    """A matrix of rows: ``after`` bytes from the anchor on (zeros up to ``width``), ``before`` bytes
    ahead of it, the nearest first (zeros up to ``back``), both lengths, and an end mark."""
    out = np.zeros((len(anchor), width + back + _TAIL), np.uint8)
    ahead, behind = np.arange(width), np.arange(back)
    out[:, :width] = data[np.minimum(anchor[:, None] + ahead, len(data) - 1)] * (ahead < after[:, None])
    out[:, width : width + back] = data[np.maximum(anchor[:, None] - 1 - behind, 0)] * (behind < before[:, None])
    out[:, -5], out[:, -4], out[:, -3], out[:, -2], out[:, -1] = before >> 8, before & 255, after >> 8, after & 255, 1
    return out


def sort_run(rows: np.ndarray, keys: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sort a byte matrix; (order of the distinct rows, each the first by key and start; the length
    each shares with the one before; order of the others). Rows end in a byte that is not zero."""
    place = np.lexsort((starts, keys))
    order = place[np.argsort(rows[place].view(f"S{rows.shape[1]}").ravel(), kind="stable")]
    s = rows[order]
    differs = s[1:] != s[:-1]
    shared = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
    fresh = np.r_[True, shared < rows.shape[1]]
    return order[fresh], np.r_[0, shared][fresh], order[~fresh]


def front_code(strings: np.ndarray, shared: np.ndarray) -> bytes:
    """The bytes of each row after those it shares with the row before."""
    return strings[np.arange(strings.shape[1])[None, :] >= shared[:, None]].tobytes()


def decode(head: bytes, shared: np.ndarray, rest: bytes) -> list[bytes]:
    """The strings of a block; its first one is ``head`` and shares nothing in ``rest``."""
    width, out, at, now = len(head), [head], 0, head
    for n in shared[1:].tolist():
        now = now[:n] + rest[at : at + width - n]
        at += width - n
        out.append(now)
    return out


def common(x: bytes, y: bytes, known: int = 0) -> int:
    """The length that x and y of one size share, reading only what follows the known prefix."""
    return len(x) - ((int.from_bytes(x[known:], "big") ^ int.from_bytes(y[known:], "big")).bit_length() + 7) // 8


def loser_merge(runs: list[Iterator[tuple]]) -> Iterator[tuple[int, tuple]]:
    """(length shared with the string put out before, item) in sorted order over all runs. A run gives
    items (string, length shared with its predecessor, ...) one by one, so blocks are opened as the
    merge comes to them; strings have one length, and a run's first one shares nothing."""
    size = 1 << max(0, (len(runs) - 1).bit_length())
    now: list = [next(r, None) for r in runs] + [None] * (size - len(runs))
    known = [-1 if x is None else 0 for x in now]  # -1: used up
    text = [b"" if x is None else x[0] for x in now]

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's known length then refers to the winner."""
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)  # the longer shared prefix is smaller
        k = known[a]
        if k < 0:
            return a, b
        x, y = text[a], text[b]
        if x == y:
            known[b] = len(x)
            return a, b
        n = common(x, y, k)
        if x < y:
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    losers = [0] * size
    level = list(range(size))
    while len(level) > 1:
        half = len(level) // 2
        up = []
        for i in range(half):
            w, losers[half + i] = play(level[2 * i], level[2 * i + 1])
            up.append(w)
        level = up
    w = level[0]
    while known[w] >= 0:
        yield known[w], now[w]
        x = now[w] = next(runs[w], None)
        if x is None:
            known[w] = -1
        else:
            text[w], known[w] = x[0], x[1]
        node = (w + size) >> 1
        while node:
            other = losers[node]
            if known[w] > known[other]:
                pass  # stays the winner, and the loser's length still holds
            elif known[w] < known[other]:
                losers[node], w = w, other
            else:
                w, losers[node] = play(w, other)
            node >>= 1


def run_blocks(rows: np.ndarray, keys: np.ndarray, starts: np.ndarray, run: int, block_rows: int) -> pa.RecordBatch:
    """``BLOCKS`` of one sorted, front-coded run. Rows equal to an earlier one are only listed."""
    order, shared, later = sort_run(rows, keys, starts)
    s, k, p = rows[order], keys[order], starts[order]
    out: list[tuple] = []
    if len(later):
        out.append((run, -1, len(later), None, rows[later[:1]].tobytes(), None, _dense(rows[later, -5:].tobytes()), _dense(keys[later].tobytes()), _dense(starts[later].tobytes())))
    for i in range(0, len(s), block_rows):
        part, lengths = s[i : i + block_rows], shared[i : i + block_rows]
        coded = lengths.copy()
        coded[0] = rows.shape[1]
        out.append((
            run, i // block_rows, len(part), part[0].tobytes(), part[-1].tobytes(), _dense(lengths.astype("<u2").tobytes()),
            _dense(front_code(part, coded)), _dense(k[i : i + block_rows].tobytes()), _dense(p[i : i + block_rows].tobytes()),
        ))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], _NAMES)


def _segment_runs(batches: Iterator[pa.RecordBatch], width: int, gram: int, run_rows: int, block_rows: int) -> Iterator[pa.RecordBatch]:
    """``BLOCKS`` of the segments (p, packed n) of (key, text, p, n) rows."""
    run = TaskContext.get().partitionId() << 32
    held, size = [], 0
    for part in (s for b in batches for s in slices(b, "text", 1 << 20)):
        keys, texts = np.asarray(part.column(0), np.int64), part.column("text").to_pylist()
        first, packed = ([numbers(d) for d in part.column(c).to_pylist()] for c in "pn")
        own = np.repeat(np.arange(len(keys)), [len(r) for r in first])
        base = np.cumsum([0, *map(len, texts)])[own]
        first, packed = np.concatenate(first), np.concatenate(packed)
        n, before = packed >> 16, packed & 0xFFFF
        data = np.frombuffer(b"".join(texts), np.uint8)
        for i in range(0, len(first), run_rows):
            j = slice(i, i + run_rows)
            rows = rows_of(data, (base + first + before)[j], before[j], (n - 1 + width - before)[j], width, width - gram)
            held.append((rows, keys[own[j]], (first + before)[j]))
            size += len(rows)
            if size >= run_rows:
                yield run_blocks(*(np.concatenate(c) for c in zip(*held)), run, block_rows)
                held, size, run = [], 0, run + 1
    if held:
        yield run_blocks(*(np.concatenate(c) for c in zip(*held)), run, block_rows)


def _window_runs(batches: Iterator[pa.RecordBatch], width: int, gram: int, run_rows: int, block_rows: int) -> Iterator[pa.RecordBatch]:
    """``BLOCKS`` of all windows of the segments that the rows of cut groups hold, one by one."""
    run = TaskContext.get().partitionId() << 32
    held, size = [], 0
    for b in batches:
        for row, key, start in zip(b.column("row").to_pylist(), b.column("key").to_pylist(), b.column("start").to_pylist()):
            before, after = int.from_bytes(row[-5:-3], "big"), int.from_bytes(row[-3:-1], "big")
            text = row[width : width + before][::-1] + row[:after]
            p = np.arange(len(text) - width + 1)
            data = np.frombuffer(text, np.uint8)
            rows = rows_of(data, p, np.zeros_like(p), np.full_like(p, width), width, width - gram)
            held.append((rows, np.full(len(p), key), start - before + p))
            size += len(p)
            if size >= run_rows:
                yield run_blocks(*(np.concatenate(c) for c in zip(*held)), run, block_rows)
                held, size, run = [], 0, run + 1
    if held:
        yield run_blocks(*(np.concatenate(c) for c in zip(*held)), run, block_rows)


def cut_blocks(batches: Iterator[pa.RecordBatch], splitters: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Give every block its range; a block across ranges is decoded and cut."""
    for batch in batches:
        out: list[tuple] = []
        for row in batch.to_pylist():
            first, last = bisect_right(splitters, row["head"]), bisect_right(splitters, row["last"])
            if first == last:
                out.append((first, *row.values()))
                continue
            shared = np.frombuffer(_open(row["shared"]), "<u2").astype(np.int64)
            strings = decode(row["head"], shared, _open(row["rest"]))
            keys, starts = np.frombuffer(_open(row["keys"]), np.int64), np.frombuffer(_open(row["starts"]), np.int64)
            matrix = np.frombuffer(b"".join(strings), np.uint8).reshape(len(strings), -1)
            cuts = np.searchsorted([bisect_right(splitters, s) for s in strings], np.arange(first, last + 2))
            for part, a, b in zip(range(first, last + 1), cuts[:-1].tolist(), cuts[1:].tolist()):
                if a < b:
                    coded = shared[a:b].copy()
                    coded[0] = matrix.shape[1]
                    out.append((
                        part, row["run"], row["block"], b - a, strings[a], strings[b - 1], _dense(shared[a:b].astype("<u2").tobytes()),
                        _dense(front_code(matrix[a:b], coded)), _dense(keys[a:b].tobytes()), _dense(starts[a:b].tobytes()),
                    ))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int32(), *_TYPES])], ["part", *_NAMES])


def _items(blocks: list[dict]) -> Iterator[tuple]:
    """(string, shared, key, start) of a run's blocks, each opened when it is reached."""

    def opened(r: dict) -> Iterator[tuple]:
        shared = np.frombuffer(_open(r["shared"]), "<u2").astype(np.int64)
        strings = decode(r["head"], shared, _open(r["rest"]))
        return zip(strings, shared.tolist(), np.frombuffer(_open(r["keys"]), np.int64).tolist(), np.frombuffer(_open(r["starts"]), np.int64).tolist())

    return chain.from_iterable(map(opened, blocks))


def equal_windows(group: list[tuple], shared: list[int], width: int) -> Iterator[tuple[int, int, int]]:
    """Runs (key, p, n) of windows that also start earlier, among rows (string, key, start) that share
    an anchor's gram, in sorted order, ``shared`` being the lengths shared with the row before. A
    window with i bytes before the anchor can only have an equal if a neighbour shares ``width`` - i
    bytes from the anchor on, and some row the i bytes before it."""
    if len(group) == 2:
        (x, *one), (y, *two) = group
        n = int.from_bytes(x[-5:-3], "big"), int.from_bytes(y[-5:-3], "big")
        behind = min(common(x[width : width + min(n)], y[width : width + min(n)]), *n)
        ahead = min(shared[1], int.from_bytes(x[-3:-1], "big"), int.from_bytes(y[-3:-1], "big"))
        if behind >= width - ahead:
            key, start = max(one, two)
            yield key, start - behind, behind - (width - ahead) + 1
        return
    rows = []
    for i, (s, key, start) in enumerate(group):
        before, after = int.from_bytes(s[-5:-3], "big"), int.from_bytes(s[-3:-1], "big")
        near = max(shared[i] if i else 0, shared[i + 1] if i + 1 < len(group) else 0)
        rows.append([width - min(near, after), before, key, start, s[:after], s[width : width + before]])
    by_left = sorted(rows, key=lambda r: r[5])
    reach = [0] * len(rows)
    for i in range(1, len(rows)):
        x, y = by_left[i - 1][5], by_left[i][5]
        n = min(len(x), len(y))
        n = common(x[:n], y[:n])
        reach[i - 1], reach[i] = max(reach[i - 1], n), n
    for r, n in zip(by_left, reach):
        r[1] = min(r[1], n)
    rows = [r for r in rows if r[0] <= r[1]]
    for i in range(min((r[0] for r in rows), default=0), max((r[1] for r in rows), default=-1) + 1):
        first: dict[bytes, tuple[int, int]] = {}
        for low, high, key, start, right, left in rows:
            if low <= i <= high:
                text, place = left[:i] + right[: width - i], (key, start)
                known = first.setdefault(text, place)
                if known is not place:
                    first[text] = min(known, place)
                    key, start = max(known, place)
                    yield key, start - i, 1


def _merge_range(
    batches: Iterator[pa.RecordBatch], width: int, gram: int, splitters: list[bytes], parts: int, group_rows: int
) -> Iterator[pa.RecordBatch]:
    """Merge the runs of one range. Blocks wait compressed, one of each run is open.

    The rows of one gram are compared here if no border of the range falls among them and they are at most
    ``group_rows``. Otherwise they leave as they come, for the pass that takes window by window."""
    runs: dict[int, list[dict]] = {}
    me = 0
    for batch in batches:
        for r in batch.to_pylist():
            me = r["part"]
            runs.setdefault(r["run"], []).append(r)
    for blocks in runs.values():
        blocks.sort(key=lambda r: (r["block"], r["head"]))
    names = [f.split()[0] for f in MERGED.split(", ")]

    def rows(found: list[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
        for b in by_key(*np.array(found, np.int64).reshape(-1, 3).T, parts):
            none = [pa.nulls(b.num_rows, t) for t in (pa.binary(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *none], names)

    def cut(group: list[tuple]) -> pa.RecordBatch:
        none = [pa.nulls(len(group), t) for t in (pa.int32(), *[pa.binary()] * 4)]
        return pa.RecordBatch.from_arrays([*none, *(pa.array(c, t) for c, t in zip(zip(*group), (pa.binary(), pa.int64(), pa.int64())))], names)

    found: list[tuple[int, int, int]] = []
    group: list[tuple] = []
    shared: list[int] = []
    first = (0, 0)
    leaving = False

    def split(text: bytes) -> bool:
        """Whether a border of this range falls among the rows of text's gram."""
        return any(x[:gram] == text[:gram] for x in splitters[max(0, me - 1) : me + 1])

    def close() -> Iterator[pa.RecordBatch]:
        if leaving:
            yield cut(group)
        elif len(group) > 1 and gram < width:
            found.extend(equal_windows(group, shared, width))

    whole = None
    for n, (text, _, key, start) in loser_merge([_items(b) for b in runs.values()]):
        if whole is None:
            whole = len(text)
        if n == whole and group:  # equal to the group's last row
            place = (key, start)
            if place < first:
                place, first = first, place
                group[-1] = (text, *first)
            before = int.from_bytes(text[-5:-3], "big")
            found.append((place[0], place[1] - before, before + int.from_bytes(text[-3:-1], "big") - width + 1))
            continue
        if n < gram:
            yield from close()
            group, shared = [], []
            leaving = gram < width and split(text)
        # The last row stays, as an equal row of an earlier place would take its own.
        if len(group) >= (4096 if leaving else group_rows) and gram < width:
            leaving = True
            for i in range(0, len(group) - 1, 4096):
                yield cut(group[i : min(i + 4096, len(group) - 1)])
            group, shared = group[-1:], []
        group.append((text, key, start))
        shared.append(n)
        first = (key, start)
        if len(found) >= 1 << 18:
            yield from rows(found)
            found.clear()
    if group:
        yield from close()
    yield from rows(found)


def _listed(batches: Iterator[pa.RecordBatch], width: int, parts: int) -> Iterator[pa.RecordBatch]:
    """``RUNS`` of the rows that a run lists as equal to earlier ones."""
    for batch in batches:
        for rest, keys, starts in zip(*(batch.column(c).to_pylist() for c in ("rest", "keys", "starts"))):
            tail = np.frombuffer(_open(rest), np.uint8).reshape(-1, _TAIL).astype(np.int64)
            before, after = tail[:, 0] << 8 | tail[:, 1], tail[:, 2] << 8 | tail[:, 3]
            yield from by_key(np.frombuffer(_open(keys), np.int64), np.frombuffer(_open(starts), np.int64) - before, before + after - width + 1, parts)


def merged_runs(
    runs: DataFrame, work: Workspace, name: str, width: int, gram: int, range_rows: int, group_rows: int = 50_000
) -> DataFrame:
    """``MERGED`` rows of sorted runs (``BLOCKS``, written). Ranges of about ``range_rows`` distinct rows
    are one task each; their number grows with the rows. Borders come from a sample of block heads, a
    few for each range, and may fall anywhere but between equal rows, so the rows of a frequent gram
    are several ranges. Tasks get of each border only what tells it from the sample before it."""
    spark = runs.sparkSession
    parts = parts_of(spark)
    blocks = runs.where("block >= 0")
    rows, count = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ranges = max(1, -(-rows // range_rows), min(parts, count // 4))
    splitters: list[bytes] = []
    if ranges > 1:
        heads = blocks.select("head")
        if count > 8 * ranges:
            heads = heads.sample(8 * ranges / count, seed=7)
        drawn = sorted({bytes(r.head) for r in heads.collect()})
        at = sorted({len(drawn) * i // ranges for i in range(1, ranges)} - {0})
        splitters = [drawn[i][: common(drawn[i - 1], drawn[i]) + 1] for i in at]
    held, ranges = spark.sparkContext.broadcast(splitters), len(splitters) + 1
    dealt = blocks.mapInArrow(lambda b: cut_blocks(b, held.value), f"part int, {BLOCKS}").repartitionById(ranges, "part")
    return work.save(dealt.mapInArrow(lambda b: _merge_range(b, width, gram, held.value, parts, group_rows), MERGED), name)


def later_windows(
    texts: DataFrame,
    work: Workspace,
    width: int,
    gram: int,
    run_rows: int = 60_000,
    block_rows: int = 500,
    range_rows: int = 300_000,
    group_rows: int = 50_000,
) -> DataFrame:
    """``SPANS`` of all ``width``-byte windows of (__key, text) that also start earlier."""
    spark, parts = texts.sparkSession, parts_of(texts.sparkSession)
    found = work.save(open_segments(texts, byte_values, gram, width), "segments")
    rows = texts.join(found.hint("merge"), "__key").select("__key", "text", "p", "n")
    runs = work.save(rows.mapInArrow(lambda b: _segment_runs(b, width, gram, run_rows, block_rows), BLOCKS), "runs", "uncompressed")
    work.drop("segments")
    merged = merged_runs(runs, work, "merged", width, gram, range_rows, group_rows)
    listed = runs.where("block < 0").mapInArrow(lambda b: _listed(b, width, parts), RUNS)
    out = merged.where("row IS NULL").select(*(f.split()[0] for f in RUNS.split(", "))).unionByName(listed)
    cut = merged.where("row IS NOT NULL").select("row", "key", "start")
    again = work.save(cut.mapInArrow(lambda b: _window_runs(b, width, gram, run_rows, block_rows), BLOCKS), "cut-runs", "uncompressed")
    if not again.isEmpty():
        twice = merged_runs(again, work, "cut-merged", width, width, range_rows)
        listed = again.where("block < 0").mapInArrow(lambda b: _listed(b, width, parts), RUNS)
        out = out.unionByName(twice.select(*out.columns)).unionByName(listed)
    spans = work.save(grouped(out, parts, True), "spans")
    work.drop("runs", "merged", "cut-runs", "cut-merged")
    return spans


def drop_repeated_bytes(
    docs: DataFrame, width: int = 100, gram: int = 48, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): every whole text as UTF-8 bytes, without those
    covered by a ``width``-byte string that also starts earlier (smaller id, or the same document
    and an earlier start). Matches never cross documents; strings are judged on the input.

    A null text is empty. Null ids come before all others, and rows of one id are ordered by their
    texts (nulls first), each a document of its own. A text of any length is one row and fits in a
    task. An empty table gives an empty result; other columns, whatever their names, are not read.
    ``kept`` is binary, as a cut may fall inside a character."""
    work = Workspace(docs.sparkSession, "suffix-dedup")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    own = keyed(own, work, "doc_id", "text").select("__key", "doc_id", F.encode("text", "UTF-8").alias("text"))
    spans = later_windows(own.select("__key", "text"), work, width, gram)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (s for b in batches for s in slices(b, "text")):
            rows = []
            for text, first, size in zip(*(part.column(c).to_pylist() for c in ("text", "p", "n"))):
                text, gaps, left = text or b"", [], text or b""
                if first is not None:
                    gaps, kept, last = covered(numbers(first), numbers(size), width), [], 0
                    for a, b in gaps:
                        kept.append(text[last:a])
                        last = b
                    left = b"".join([*kept, text[last:]])
                rows.append((len(text), len(text) - len(left), len(gaps), left))
            types = [pa.int64()] * 3 + [pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows), types))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    joined = own.join(spans.hint("merge"), "__key", "left").select("doc_id", "text", "p", "n")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
