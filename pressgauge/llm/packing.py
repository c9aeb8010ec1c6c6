"""Packing: documents cut into pieces that fill fixed windows, placed online by the sum-of-squares rule.

A level array counts partially filled windows by fill level. A document of size s goes to the level h, or to a new window,
that makes the sum of squared counts smallest afterwards. Where filling a window up with its first part and opening one for
the rest makes the sum smaller by more than CUT, it is cut there, and the rest is placed by the same rule; so a few hundred
windows are open at any time. Whole windows' worth of a long document are cut off first.

Each task packs its own rows. Windows that are still open at its end go on, whole, to a second and a third stage, where the
open windows of 16 and then of 256 tasks are placed by the same rule into one level array. Only what is open after that is
joined by cutting, and its last rest is cut into windows whose sizes are powers of two, which need no padding. What moves
is a few hundred windows a task, whatever the task's size.

Null text counts as empty and packs its end id alone; repeated rows are packed each; ids may be null; texts of any length
are cut into whole windows as they come; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, parts_of, saved, small_batches

WINDOW = 1024
END = 0
#: What a cut counts beside the change of the sum (a window at a level that has none changes it by 1).
CUT = 2
#: Tasks whose open windows meet in one level array of the next stage.
MEET = 16


class Levels:
    """Open windows by fill level; ``place`` gives (the level a piece joins, 0 for a new window, whether it is cut there)."""

    def __init__(self, size: int):
        self.size, self.count = size, np.zeros(size + 1, np.int64)
        self.least = np.full(size + 1, -(1 << 40))  # counts, and far below any where there is no window to join
        self.open: list[list] = [[] for _ in range(size + 1)]

    def place(self, s: int) -> tuple[int, bool]:
        n, m, c = self.count, self.least, self.size
        # (change of the sum, cut or not, less the level): on ties whole before cut, then the fullest window.
        best = (2 * n[s] + 1 if s < c else 0, 0, 0)
        if s < c and n[c - s]:
            best = min(best, (1 - 2 * n[c - s], 0, s - c))
        if s < c - 1:  # level h to h + s: the change is 2 (n[h + s] - n[h] + 1); from the fullest down
            change = n[c - 1 : s : -1] - m[c - s - 1 : 0 : -1]
            i = int(change.argmin())
            best = min(best, (2 * int(change[i]) + 2, 0, i + 1 + s - c))
        if s > 1:  # level h fills up, and one opens at h + s - c: 2 (n[h + s - c] - n[h] + 1)
            change = n[s - 1 : 0 : -1] - m[c - 1 : c - s : -1]
            i = int(change.argmin())
            best = min(best, (2 * int(change[i]) + 2 + CUT, 1, i + 1 - c))
        return -best[2], best[1] == 1

    def move(self, h: int, s: int) -> None:
        n, m = self.count, self.least
        if h:
            n[h] -= 1
            m[h] = n[h] or -(1 << 40)
        if h + s < self.size:
            n[h + s] += 1
            m[h + s] = n[h + s]


def powers(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Packer:
    """Rows (doc, start, length, crc, tokens, sequence, offset) as windows are completed. Sequence ids start at ``base``."""

    def __init__(self, base: int, size: int = WINDOW):
        self.levels, self.size, self.next = Levels(size), size, base

    def _emit(self, pieces) -> list[tuple]:
        rows, at, seq = [], 0, self.next
        self.next += 1
        for doc, start, ids, total in pieces:
            rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, seq, at))
            at += len(ids)
        return rows

    def put(self, pieces: list[tuple], s: int) -> list[tuple]:
        """Place pieces of ``s`` ids together, under a whole window."""
        lv, out = self.levels, []
        while s:
            h, cut = lv.place(s)
            window = lv.open[h].pop() if h else []
            room = self.size - h if cut else s
            lv.move(h, room)
            s -= room
            while room:
                doc, start, ids, n = pieces.pop(0)
                window.append((doc, start, ids[:room], n))
                if len(ids) > room:
                    pieces.insert(0, (doc, start + room, ids[room:], n))
                room -= min(room, len(ids))
            if sum(len(p[2]) for p in window) == self.size:
                out += self._emit(window)
            else:
                lv.open[sum(len(p[2]) for p in window)].append(window)
        return out

    def add(self, doc, ids: np.ndarray) -> list[tuple]:
        n, out = len(ids), []
        full = n - n % self.size
        for at in range(0, full, self.size):
            out += self._emit([(doc, at, ids[at : at + self.size], n)])
        return out + self.put([(doc, full, ids[full:].copy(), n)], n - full) if n > full else out

    def windows(self) -> list[list[tuple]]:
        """Open windows, the fullest first."""
        return [window for level in reversed(self.levels.open) for window in level]

    def close(self) -> list[tuple]:
        left = [p for window in self.windows() for p in window]
        total, out = sum(len(p[2]) for p in left), []
        sizes = [self.size] * (total // self.size) + powers(total % self.size)
        left.reverse()
        for size in sizes:
            room, pieces = size, []
            while room:
                doc, start, ids, n = left.pop()
                pieces.append((doc, start, ids[:room], n))
                if len(ids) > room:
                    left.append((doc, start + room, ids[room:], n))
                room -= min(room, len(ids))
            out += self._emit(pieces)
        return out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: A row with ``part`` is a piece of an open window of that task; the others are results.
_ALL = SCHEMA + ", part long, open long, ids binary"
_ARROW = pa.schema([(x.split()[0], pa.binary() if x.endswith("binary") else pa.int64()) for x in _ALL.split(", ")])


def _done(rows: list[tuple]) -> pa.RecordBatch:
    cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
    return pa.RecordBatch.from_arrays([*cols, *[pa.nulls(len(rows), f.type) for f in list(_ARROW)[7:]]], schema=_ARROW)


def _open(packer: Packer, part: int) -> Iterator[pa.RecordBatch]:
    for k, window in enumerate(packer.windows()):
        at = np.cumsum([0] + [len(p[2]) for p in window]).tolist()
        rows = [(doc, start, len(ids), None, n, None, o, part, k, ids.tobytes()) for (doc, start, ids, n), o in zip(window, at, strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _met(before: DataFrame, stage: int, window: int) -> DataFrame:
    """The open windows of ``before``, those of MEET parts in one level array; the last stage cuts what stays open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = packer = key = None
        pieces: list[tuple] = []

        def put():
            return packer.put(pieces, sum(len(p[2]) for p in pieces)) if pieces else []

        def end():
            if packer is None:
                return
            if rows := put() + (packer.close() if stage == 2 else []):
                yield _done(rows)
            if stage < 2:
                yield from _open(packer, group)

        for b in batches:
            for doc, start, n, part, k, ids, g in zip(*(b.column(i).to_pylist() for i in (0, 1, 4, 7, 8, 9, 10)), strict=True):
                if g != group:
                    yield from end()
                    group, packer, key, pieces = g, Packer(stage << 61 | g << 36, window), None, []
                if (part, k) != key:
                    if rows := put():
                        yield _done(rows)
                    key, pieces = (part, k), []
                pieces.append((doc, start, np.frombuffer(ids, np.uint32), n))
        yield from end()

    left = before.filter("part is not null").withColumn("group", F.floor(F.col("part") / MEET))
    return left.repartition(parts_of(before.sparkSession), "group").sortWithinPartitions("group", "part", "open", "offset").mapInArrow(lean(run), _ALL)


def pack(docs: DataFrame, encoder: Callable[[], Callable[[list[str]], list[np.ndarray]]], id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per piece. ``encoder()`` is called once a task and gives a function from texts to uint32 ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode, packer = encoder(), Packer(part << 36, window)
        rows: list[tuple] = []
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1)
            for at in range(0, len(ids), 64):
                for doc, toks in zip(ids[at : at + 64], encode([t or "" for t in texts.slice(at, 64).to_pylist()]), strict=True):
                    rows += packer.add(doc, np.append(toks, np.uint32(END)))
                if len(rows) >= 8192:
                    yield _done(rows)
                    rows = []
        if rows:
            yield _done(rows)
        yield from _open(packer, part)

    with small_batches(docs.sparkSession):
        first = saved(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(lean(run), _ALL), "packed")
        second = saved(_met(first, 1, window), "packed")
    columns = [x.split()[0] for x in SCHEMA.split(", ")]
    done = [x.filter("part is null").select(*columns) for x in (first, second, _met(second, 2, window))]
    return done[0].unionByName(done[1]).unionByName(done[2])
