"""Repeats of at least a given length over sequences of symbols, shared by the substring and suffix-array operators.

Only suffixes at content-chosen anchors are handled (a sparse suffix set). A window is ``length`` consecutive symbols; of
the ``width`` grams at its start the smallest by hash is its anchor. Equal windows have equal anchors at equal offsets,
so windows are compared through their anchors and nothing is lost. Consecutive windows of one anchor form a record.

1. Map: each task hashes its documents and turns them into records, by the prefix that all windows of an anchor share
   (``length - width + 1`` symbols from the anchor on). Records that are equal throughout are aggregated before they
   move: one, the earliest, stands for all as a leaf of several occurrences; the others are its copies, whose windows all
   occur earlier. Only hashes and positions are shuffled, dealt by prefix. A long passage in a third of all documents
   thus sends one record per task and record of the passage.
2. Bucket: a prefix of one record that occurs once is a leaf by itself and drops out. Equal records of several tasks
   become one leaf likewise. All other leaves stay open.
3. Open leaves' symbols are fetched (one join by document). A task is a shard: it sorts its leaves and deals them by
   prefix, in order. An operator-specific step brings a bucket's shards into one order and derives common prefix
   lengths; extending the order to the left symbol by symbol, by stable partition, gives each window's neighbours
   without sorting suffixes anew. Windows that two leaves share, or that lie on a leaf of several occurrences, repeat.
4. Spans are united by document and applied to its text (one join by document).

No prefix gathers an unbounded group. A task that meets very many different records of one prefix (one passage in very
many surroundings) doesn't send them to the prefix's bucket: it knows that they stay open, and tells the bucket with one
mark that others of that prefix do too. In step 3 a prefix with more than HOT_GROUP open leaves takes the longest
prefix there is, the whole window: each window goes by its own hash, aggregated in its task first.

The hashes have 64 bits for the prefix and 64 more for a record; both must agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from scrubline.llm import common
from scrubline.sources.tables import spread

BASE = 0x9E3779B97F4A7C15
CHUNK = 1 << 20
POSITION = np.uint64(CHUNK - 1)
FLUSH_RECORDS = 400_000
FLUSH_SYMBOLS = 4 << 20
#: From so many different records of one prefix in a task's flush, they stay out of that prefix's bucket.
HOT_CLASSES = 64
#: Beyond so many open records of one prefix, their windows are dealt one by one.
HOT_GROUP = 4_096
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        out = np.full(CHUNK + 1, base, U64)
        out[0] = 1
        return np.cumprod(out, dtype=U64)

    return run(BASE), run(pow(BASE, -1, 1 << 64))


_BYTE_CODES = mix(np.arange(1, 257, dtype=U64))


def byte_symbols(text: bytes) -> np.ndarray:
    return np.frombuffer(text, np.uint8)


def word_symbols(text: bytes) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))


@dataclass(frozen=True)
class Windows:
    """What repeats: ``length`` symbols; ``first_stays`` exempts a window's first occurrence by (order, start)."""

    length: int
    width: int
    gram: int
    symbols: Callable[[bytes], np.ndarray]
    first_stays: bool

    @property
    def prefix(self) -> int:
        return self.length - self.width + 1

    @property
    def dtype(self):
        return np.uint8 if self.symbols is byte_symbols else U64


# -- packing of columns into cells ------------------------------------------------------------------------------------


def pack_columns(columns: list[np.ndarray]) -> bytes:
    """Columns as byte planes, compressed: high bytes of numbers are mostly equal."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([len(columns[0]).to_bytes(8, "little"), *planes]))


def unpack_columns(blob: bytes, dtypes: list) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for t in map(np.dtype, dtypes):
        plane = np.frombuffer(raw, np.uint8, n * t.itemsize, at).reshape(t.itemsize, n)
        out.append(np.ascontiguousarray(plane.T).view(t).reshape(n))
        at += n * t.itemsize
    return out


RECORD = [U64, U64, np.int64, np.int64, np.int64, np.uint16, np.uint16, np.uint8]  # K, H, key, order, start, left, run, many
SPAN = [np.int64, np.int64, np.int64]  # key, start, stop
HELD_OPEN = [U64, np.int64, np.int64, np.uint16, np.uint16, np.uint8]  # K, key, start, left, run, many
FRAGMENT = [U64, np.int64, np.int64, np.int64, np.uint16, np.uint16, np.uint8, np.int64]  # K, key, order, start, left, run, many, symbols


def _bucket(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> U64(40)) * U64(n) >> U64(24)).astype(np.int64)


def _cells(buckets: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(buckets, kind="stable")
    cuts = np.flatnonzero(np.diff(buckets[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(buckets[part[0]]), [c[part] for c in columns]


_CELL = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
CELL = "bucket int, kind int, blob binary"
_FOUND = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.int32()), ("prefix", pa.int64()), ("left", pa.int32()), ("run", pa.int32()), ("many", pa.int32())])
FOUND = "key long, start long, stop long, kind int, prefix long, left int, run int, many int"
_SPANS = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])
SPANS = "key long, start long, stop long"
REMOVED, OPEN = 0, 1
#: Kinds of cells: records, settled spans, records that stay open, prefixes whose records do; windows and their spans.
RECORDS, SPANNED, OPENED, MARKED, WINDOWED, WINDOW_SPANS = range(6)


# -- 1: records -------------------------------------------------------------------------------------------------------


def chunk_records(symbols: np.ndarray, ends: np.ndarray, w: Windows) -> tuple[np.ndarray, ...]:
    """(first window, anchor, last window, K, H) of the records of a chunk of at most CHUNK symbols; ends: where its
    pieces end. Positions are those in the chunk."""
    n = len(symbols)
    codes = _BYTE_CODES[symbols] if symbols.dtype == np.uint8 else symbols
    up, down = _powers()
    sums = np.zeros(n + 1, U64)
    np.cumsum(codes * up[:n], out=sums[1:])
    of = lambda i, j: (sums[j] - sums[i]) * down[i]
    valid = np.zeros(n + 1, np.int8)
    begins = np.concatenate([[0], ends[:-1]])
    long = ends - begins >= w.length
    np.add.at(valid, begins[long], 1)
    np.add.at(valid, ends[long] - w.length + 1, -1)
    at = np.flatnonzero(np.cumsum(valid[:n]))
    if not len(at):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),) * 2
    grams = mix((sums[w.gram :] - sums[: -w.gram]) * down[: n - w.gram + 1])
    low = (grams & ~POSITION) | np.arange(len(grams), dtype=U64)
    span = 1
    while span < w.width:  # sliding minimum: spans double, the last step overlaps
        step = min(span, w.width - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    anchor = (low[at] & POSITION).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(anchor) != 0)]))
    first, last, anchor = at[new], at[np.concatenate([new[1:], [len(at)]]) - 1], anchor[new]
    shape = (anchor - first).astype(U64) << U64(32) | (last - first).astype(U64)
    return first, anchor, last, mix(of(anchor, anchor + w.prefix)), mix(of(first, last + w.length) ^ mix(shape + U64(1)))


class _Task:
    """The records of one task, aggregated before they leave."""

    def __init__(self, w: Windows, buckets: int, hot_classes: float = HOT_CLASSES):
        self.w, self.buckets, self.hot_classes = w, buckets, hot_classes
        self.records: list[tuple[np.ndarray, ...]] = []
        self.pieces: list[np.ndarray] = []
        self.whose: list[tuple[int, int, int]] = []
        self.size = self.held = 0

    def add(self, key: int, order: int, text: bytes) -> None:
        symbols = self.w.symbols(text)
        for at in range(0, max(1, len(symbols) - self.w.length + 1), CHUNK - self.w.length + 1):
            piece = symbols[at : at + CHUNK]
            if len(piece) < self.w.length:
                continue
            if self.size + len(piece) > CHUNK:
                self._chunk()
            self.pieces.append(piece)
            self.whose.append((key, order, at))
            self.size += len(piece)

    def _chunk(self) -> None:
        if not self.pieces:
            return
        ends = np.cumsum([len(p) for p in self.pieces])
        first, anchor, last, k, h = chunk_records(np.concatenate(self.pieces), ends, self.w)
        piece = np.searchsorted(ends, first, side="right")
        key, order, at = np.array(self.whose, np.int64).reshape(-1, 3).T
        start = first - np.concatenate([[0], ends[:-1]])[piece] + at[piece]
        self.records.append((k, h, key[piece], order[piece], start, (anchor - first).astype(np.uint16), (last - first).astype(np.uint16)))
        self.held += len(first)
        self.pieces, self.whose, self.size = [], [], 0

    def flush(self, force: bool) -> Iterator[tuple[int, int, bytes]]:
        if force:
            self._chunk()
        if not self.held or not force and self.held < FLUSH_RECORDS:
            return
        k, h, key, order, start, left, run = (np.concatenate(c) for c in zip(*self.records))
        self.records, self.held = [], 0
        by = np.lexsort((start, order, h, k))
        k, h, key, order, start, left, run = (c[by] for c in (k, h, key, order, start, left, run))
        lead = np.concatenate([[True], (k[1:] != k[:-1]) | (h[1:] != h[:-1])])
        group = np.cumsum(lead) - 1
        many = (np.bincount(group) > 1).astype(np.uint8)
        rest = ~lead
        if self.w.first_stays:  # rows of one place in the order are one occurrence
            heads = np.flatnonzero(lead)[group]
            rest &= (order != order[heads]) | (start != start[heads])
        stop = start + run + self.w.length
        new_k = np.concatenate([[True], k[1:] != k[:-1]])
        of_k = np.cumsum(new_k) - 1
        hot = (np.bincount(of_k, weights=lead)[of_k] >= self.hot_classes) & lead
        send = lead & ~hot
        for b, cell in _cells(_bucket(k[send], self.buckets), [k[send], h[send], key[send], order[send], start[send], left[send], run[send], many[group[send]]]):
            yield b, RECORDS, pack_columns(cell)
        for b, cell in _cells(_bucket(mix(key[rest].view(U64)), self.buckets), [key[rest], start[rest], stop[rest]]):
            yield b, SPANNED, pack_columns(cell)
        for b, cell in _cells(_bucket(mix(key[hot].view(U64)), self.buckets), [k[hot], key[hot], start[hot], left[hot], run[hot], many[group[hot]]]):
            yield b, OPENED, pack_columns(cell)
        marks = np.unique(k[hot])
        for b, cell in _cells(_bucket(marks, self.buckets), [marks]):
            yield b, MARKED, pack_columns(cell)


def _batch(cells: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([c[i] for c in cells], f.type) for i, f in enumerate(_CELL)], schema=_CELL)


def _recorder(w: Windows, buckets: int, hot_classes: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = _Task(w, buckets, hot_classes)
        for batch in batches:
            for key, order, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                task.add(key.as_py(), order.as_py(), text.as_py() or b"")
            if cells := list(task.flush(False)):
                yield _batch(cells)
        if cells := list(task.flush(True)):
            yield _batch(cells)

    return run


# -- 2: buckets -------------------------------------------------------------------------------------------------------


def settle(columns: list[np.ndarray], w: Windows, marked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(which records are copies of an earlier one, which are open leaves, the sorted columns) of one bucket's records.
    The last column then tells which leaves occur several times."""
    k, h, key, order, start, left, run, many = columns
    by = np.lexsort((start, order, h, k))
    columns = [c[by] for c in columns]
    k, h, key, order, start, left, run, many = columns
    lead = np.concatenate([[True], (k[1:] != k[:-1]) | (h[1:] != h[:-1])])
    group = np.cumsum(lead) - 1
    heads = np.flatnonzero(lead)
    new_k = np.concatenate([[True], k[1:] != k[:-1]])
    of_k = np.cumsum(new_k) - 1
    classes = np.bincount(of_k, weights=lead)[of_k]
    told = np.isin(k, marked) if marked is not None and len(marked) else np.zeros(len(k), bool)
    several = (np.bincount(group) > 1) | (np.maximum.reduceat(many, heads) > 0)
    copies = ~lead
    if w.first_stays:  # rows of one place in the order are one occurrence
        copies &= (order != order[heads][group]) | (start != start[heads][group])
    columns[-1] = several[group].astype(np.uint8)
    return copies, lead & ((classes > 1) | several[group] | told), columns


def _columns(kinds: list[int], blobs: list[bytes], kind: int, dtypes: list) -> list[np.ndarray] | None:
    """The cells of one kind, column by column."""
    parts = [unpack_columns(b, dtypes) for k, b in zip(kinds, blobs, strict=True) if k == kind]
    return [np.concatenate(c) for c in zip(*parts)] if parts else None


def _bucketer(w: Windows):
    def run(table: pa.Table) -> pa.Table:
        kinds, blobs = table.column("kind").to_pylist(), table.column("blob").to_pylist()
        out = []

        def put(kind: int, key, start, stop, k=None, left=None, own_run=None, many=None) -> None:
            zero = np.zeros(len(key), np.int64)
            columns = (key, start, stop, zero + kind, zero if k is None else k.view(np.int64), *(zero if c is None else c for c in (left, own_run, many)))
            out.append([pa.array(c).cast(f.type) for c, f in zip(columns, _FOUND, strict=True)])

        if spans := _columns(kinds, blobs, SPANNED, SPAN):
            put(REMOVED, *spans)
        if held := _columns(kinds, blobs, OPENED, HELD_OPEN):
            k, key, start, left, own, many = held
            put(OPEN, key, start, start + own + w.length, k, left, own, many)
        if records := _columns(kinds, blobs, RECORDS, RECORD):
            marked = _columns(kinds, blobs, MARKED, [U64])
            copies, still, c = settle(records, w, marked and marked[0])
            k, _, key, _, start, left, own, many = c
            for which, kind in ((copies, REMOVED), (still, OPEN)):
                put(kind, key[which], start[which], start[which] + own[which] + w.length, k[which], left[which], own[which], many[which])
        if not out:
            return _FOUND.empty_table()
        return pa.Table.from_batches([pa.RecordBatch.from_arrays(c, schema=_FOUND) for c in out])

    return run


# -- 3: open records --------------------------------------------------------------------------------------------------


def window_hashes(parts: list[np.ndarray], w: Windows) -> np.ndarray:
    """The hash of each window of each part, of which all together have at most CHUNK symbols."""
    symbols = np.concatenate(parts)
    codes = _BYTE_CODES[symbols] if symbols.dtype == np.uint8 else symbols
    up, down = _powers()
    sums = np.zeros(len(codes) + 1, U64)
    np.cumsum(codes * up[: len(codes)], out=sums[1:])
    sizes = np.array([len(p) for p in parts])
    at = np.concatenate([np.arange(o, o + n) for o, n in zip(np.cumsum(sizes) - sizes, sizes - w.length + 1, strict=True)])
    return mix((sums[at + w.length] - sums[at]) * down[at])


def _pack_symbols(symbols: np.ndarray) -> bytes:
    """Word hashes don't compress, and fragments overlap: each different one is kept once."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    if symbols.dtype == np.uint8:
        return squeeze(symbols.tobytes())
    different, codes = np.unique(symbols, return_inverse=True)
    table = different.tobytes()
    return len(table).to_bytes(8, "little") + table + pack_columns([codes.astype(np.uint32)])


def _unpack_symbols(blob: bytes, w: Windows) -> np.ndarray:
    if w.dtype == np.uint8:
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n = 8 + int.from_bytes(blob[:8], "little")
    return np.frombuffer(blob[8:n], U64)[unpack_columns(blob[n:], [np.uint32])[0]]


def _fetcher(w: Windows, buckets: int):
    """(key, order, text, open leaves) -> cells of fragments, sorted, and of windows for hot prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        parts: list[np.ndarray] = []
        hot_rows: list[tuple[int, int, int]] = []
        hot_parts: list[np.ndarray] = []
        size = hot_size = 0
        whole: list[tuple[int, int, int]] = []
        windows = _Task(w, buckets, float("inf"))

        def flush() -> pa.RecordBatch:
            columns = [np.array(c, t) for c, t in zip(zip(*rows), FRAGMENT, strict=True)]
            after = [part[r[4] + w.prefix :].astype(part.dtype.newbyteorder(">")).tobytes() for r, part in zip(rows, parts, strict=True)]
            inner = np.array(sorted(range(len(rows)), key=after.__getitem__))
            ordered = inner[np.argsort(columns[0][inner], kind="stable")]  # the shard's order: by prefix, then by what follows
            cells = []
            for b, at in _cells(_bucket(columns[0][ordered], buckets), [ordered]):
                head, body = pack_columns([c[at[0]] for c in columns]), _pack_symbols(np.concatenate([parts[i] for i in at[0]]))
                cells.append((b, RECORDS, len(head).to_bytes(8, "little") + head + body))
            return _batch(cells)

        def hashed() -> None:
            nonlocal hot_rows, hot_parts, hot_size
            if hot_parts:
                n = np.array([len(p) for p in hot_parts]) - w.length + 1
                key, order, start = (np.repeat(c, n) for c in np.array(hot_rows, np.int64).T)
                start = start + np.arange(len(start)) - np.repeat(np.cumsum(n) - n, n)
                h = window_hashes(hot_parts, w)
                none = np.zeros(len(h), np.uint16)
                windows.records.append((h, h, key, order, start, none, none))
                windows.held += len(h)
            hot_rows, hot_parts, hot_size = [], [], 0

        def several() -> Iterator[tuple[int, int, bytes]]:
            """Spans of hot leaves of several occurrences."""
            if whole:
                columns = list(np.array(whole, np.int64).T)
                whole.clear()
                for b, cell in _cells(_bucket(mix(columns[0].view(U64)), buckets), columns):
                    yield b, WINDOW_SPANS, pack_columns(cell)

        def dealt(force: bool) -> Iterator[pa.RecordBatch]:
            if force:
                hashed()
            kinds = {RECORDS: WINDOWED, SPANNED: WINDOW_SPANS}
            if cells := [*several(), *((b, kinds[kind], blob) for b, kind, blob in windows.flush(force))]:
                yield _batch(cells)

        for batch in batches:
            for key, order, text, found in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                symbols = w.symbols(text or b"")
                for r in found:
                    part = symbols[r["start"] : r["start"] + r["run"] + w.length]
                    if r["hot"]:
                        if hot_size + len(part) > CHUNK:
                            hashed()
                        hot_rows.append((key, order, r["start"]))
                        hot_parts.append(part)
                        hot_size += len(part)
                        if r["many"] and not w.first_stays:
                            whole.append((key, r["start"], r["start"] + r["run"] + w.length))
                    else:
                        rows.append((r["prefix"] & (2**64 - 1), key, order, r["start"], r["left"], r["run"], r["many"], len(part)))
                        parts.append(part)
                        size += len(part) * part.itemsize
                if size > FLUSH_SYMBOLS:
                    yield flush()
                    rows, parts, size = [], [], 0
            yield from dealt(False)
        if rows:
            yield flush()
        yield from dealt(True)

    return run


@dataclass
class Fragments:
    """Open leaves with their symbols: ``symbols[offset : offset + size]`` from a record's first window on."""

    prefix: np.ndarray
    key: np.ndarray
    order: np.ndarray
    start: np.ndarray
    left: np.ndarray
    run: np.ndarray
    many: np.ndarray
    size: np.ndarray
    symbols: np.ndarray

    @staticmethod
    def unpack(blobs: list[bytes], w: Windows) -> list[Fragments]:
        """One of each cell: a shard's leaves, in order."""
        out = []
        for b in blobs:
            n = 8 + int.from_bytes(b[:8], "little")
            k, key, order, start, left, run, many, size = unpack_columns(b[8:n], FRAGMENT)
            out.append(Fragments(k, key, order, start, left.astype(np.int64), run.astype(np.int64), many, size, _unpack_symbols(b[n:], w)))
        return out

    @staticmethod
    def join(parts: list[Fragments]) -> Fragments:
        return Fragments(*(np.concatenate([getattr(p, f) for p in parts]) for f in Fragments.__dataclass_fields__))

    @property
    def offset(self) -> np.ndarray:
        return np.cumsum(self.size) - self.size


def least_between(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of values[low..high], ends included, for each pair with low <= high."""
    if not len(low):
        return np.zeros(0, values.dtype)
    ends = np.stack([low, high + 1], 1).ravel()
    return np.minimum.reduceat(np.concatenate([values, values[-1:]]), ends)[::2]


def extend_left(f: Fragments, rows: np.ndarray, block: np.ndarray, common_right: np.ndarray, w: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(row, offset) of each window that repeats, its start being ``offset`` symbols left of the row's anchor.

    rows: row numbers ordered by what follows their anchors, block: equal for rows that share the prefix, common_right:
    symbols shared, from the anchor on, with the row before. Each step puts the symbol to the left in front: a stable
    partition by it keeps the order of what follows, and the shared length of new neighbours is the least of those
    between them.
    """
    offset = f.offset
    place = np.lexsort((f.start, f.order))
    rank = np.empty(len(place), np.int64)
    same = np.concatenate([[False], (np.diff(f.order[place]) == 0) & (np.diff(f.start[place]) == 0)])
    rank[place] = np.cumsum(~same)
    found_rows, found_at = [], []
    for d in range(w.width):
        joined = np.concatenate([[False], (block[1:] == block[:-1]) & (common_right[1:] >= w.length - d)])
        cluster = np.cumsum(~joined) - 1
        sizes = np.bincount(cluster)
        hit = sizes[cluster] > 1
        if w.first_stays and hit.any():
            heads = np.flatnonzero(~joined)
            hit &= rank[rows] > np.minimum.reduceat(rank[rows], heads)[cluster]
        hit &= (f.left[rows] - f.run[rows] <= d) & (d <= f.left[rows])
        found_rows.append(rows[hit])
        found_at.append(np.full(int(hit.sum()), d))
        live = np.flatnonzero(f.left[rows] > d)
        if not len(live):
            break
        symbol = f.symbols[offset[rows[live]] + f.left[rows[live]] - d - 1]
        by = live[np.lexsort((symbol, block[live]))]
        after = f.symbols[offset[rows[by]] + f.left[rows[by]] - d - 1]
        again = np.concatenate([[False], (block[by][1:] == block[by][:-1]) & (after[1:] == after[:-1])])
        fresh = np.cumsum(~again) - 1
        shared = np.zeros(len(by), common_right.dtype)
        k = np.flatnonzero(again)
        shared[k] = least_between(common_right, by[k - 1] + 1, by[k])
        alone = np.bincount(fresh)[fresh] == 1
        rows, block, common_right = rows[by][~alone], fresh[~alone], shared[~alone]
        if not len(rows):
            break
    return np.concatenate(found_rows), np.concatenate(found_at)


def _spans_of(f: Fragments, rows: np.ndarray, at: np.ndarray, w: Windows) -> tuple[np.ndarray, ...]:
    """Windows as (key, start, stop), neighbouring windows of a row united."""
    by = np.lexsort((-at, rows))
    rows, begin = rows[by], f.start[rows[by]] + f.left[rows[by]] - at[by]
    if not len(rows):
        return (np.zeros(0, np.int64),) * 3
    new = np.flatnonzero(np.concatenate([[True], (np.diff(rows) != 0) | (np.diff(begin) != 1)]))
    last = np.concatenate([new[1:], [len(rows)]]) - 1
    return f.key[rows[new]], begin[new], begin[last] + w.length


def _merger(w: Windows, merge: Callable[[list[Fragments], Windows], tuple]):
    def run(table: pa.Table) -> pa.Table:
        kinds, blobs = table.column("kind").to_pylist(), table.column("blob").to_pylist()
        out = []
        if parts := Fragments.unpack([b for k, b in zip(kinds, blobs, strict=True) if k == RECORDS], w):
            f, rows, block, common_right = merge(parts, w)
            out.append(_spans_of(f, *extend_left(f, rows, block, common_right, w), w))
            if not w.first_stays:  # all windows on a leaf of several occurrences
                several = f.many > 0
                out.append((f.key[several], f.start[several], (f.start + f.run)[several] + w.length))
        if spans := _columns(kinds, blobs, WINDOW_SPANS, SPAN):
            out.append(spans)
        if records := _columns(kinds, blobs, WINDOWED, RECORD):
            which, _, c = settle(records, w)
            if not w.first_stays:
                which = c[-1] > 0
            out.append((c[2][which], c[4][which], c[4][which] + w.length))
        if not out:
            return _SPANS.empty_table()
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], schema=_SPANS)

    return run


# -- the whole --------------------------------------------------------------------------------------------------------


def keyed_texts(docs: DataFrame) -> DataFrame:
    """(key, ord, doc_id, text): key tells rows apart for joins, ord is their order.

    Both are doc_id as long as it is unique and never null; else key is a hash of doc_id and text, and null comes first.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    odd = docs.select(F.col("doc_id").cast("long").alias("doc_id")).groupBy("doc_id").count().where("doc_id is null or count > 1")
    key = F.col("doc_id") if odd.isEmpty() else F.xxhash64("doc_id", "text")
    return d.select(key.alias("key"), F.coalesce("doc_id", F.lit(-(2**63)).cast("long")).alias("ord"), "doc_id", "text")


def repeated_spans(
    texts: DataFrame, w: Windows, merge: Callable[[list[Fragments], Windows], tuple], hot_classes: int = HOT_CLASSES, hot_group: int = HOT_GROUP
) -> DataFrame:
    """SPANS of texts (key, ord, text) that repeated windows cover; spans may overlap."""
    buckets = common.partitions_for(texts, 16 << 20)
    cells = spread(texts.select("key", "ord", "text")).mapInArrow(_recorder(w, buckets, hot_classes), CELL)
    found = common.materialize(cells.groupBy("bucket").applyInArrow(_bucketer(w), FOUND), "found")
    opened = found.where(F.col("kind") == OPEN)
    # few rows, stored: the join below broadcasts them or, if they are many, splits hot keys
    hot = common.numbers(opened.groupBy("prefix").count().where(F.col("count") > hot_group).select("prefix", F.lit(True).alias("hot")), "hot")
    each = opened.join(hot, "prefix", "left").select("key", F.struct("start", "left", "run", "prefix", "many", F.coalesce("hot", F.lit(False)).alias("hot")).alias("r"))
    still = each.groupBy("key").agg(F.collect_set("r").alias("found"))
    fetched = texts.select("key", "ord", "text").join(still, "key").select("key", "ord", "text", "found")
    fragments = fetched.mapInArrow(_fetcher(w, buckets), CELL)
    merged = fragments.groupBy("bucket").applyInArrow(_merger(w, merge), SPANS)
    return found.where(F.col("kind") == REMOVED).select("key", "start", "stop").unionAll(merged)


def with_spans(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, text, spans) of each row of texts."""
    per = spans.groupBy("key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    return texts.join(per, "key", "left").select("doc_id", "text", "spans")


def covered(n: int, spans) -> np.ndarray:
    """Which of n positions lie in a span (a pyarrow list of structs, or None)."""
    steps = np.zeros(n + 1, np.int64)
    if spans is not None:
        np.add.at(steps, spans.field("start").to_numpy(zero_copy_only=False), 1)
        np.add.at(steps, spans.field("stop").to_numpy(zero_copy_only=False), -1)
    return np.cumsum(steps[:n]) > 0
