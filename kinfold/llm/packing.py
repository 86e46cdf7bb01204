"""Packing of token sequences into windows by the online sum-of-squares rule.

Every task packs the documents it reads, in their order, without a shuffle: whole windows are cut from a long document
first, and what is left of it goes to the fill level that keeps the sum of squared counts of partly filled windows least. A
level array holds those counts. When a task's documents end, pieces of the least filled windows are cut to fill the others,
so that a task leaves one partly filled window at most. Until then a task holds the ids of its open windows, which are a part of
those of the rows that it reads, so its memory is bounded by the size of an input split.

Nulls: a null text is empty, so its document is the end id alone; a null doc_id is kept. Repeated rows are packed as often
as they come, equal lengths go to the fullest of equally good levels. A very long text is cut into whole windows first. Other
columns are not read, so they may have any names. sequence_id is the task's number times 2^32 plus the window's number there. An
empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import common, segments

WINDOW, END_ID = 1024, 0
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Online placement; a piece is (document, ids before it, ids). Closed windows come from drain() as lists of pieces."""

    def __init__(self, size: int = WINDOW):
        import numpy as np

        self.size = size
        self.levels = np.zeros(size + 1, np.int64)  # windows by fill, 1 to size - 1
        self.open: dict[int, list[list]] = {}  # by fill, their pieces
        self.closed: list[list] = []

    def place(self, piece: tuple) -> None:
        n = len(piece[2])
        fill = self.choose(n)
        if fill:
            self.levels[fill] -= 1
            window = self.open[fill].pop()
        else:
            window = []
        window.append(piece)
        if fill + n == self.size:
            self.closed.append(window)
            return
        self.levels[fill + n] += 1
        self.open.setdefault(fill + n, []).append(window)

    def choose(self, n: int) -> int:
        """The fill, 0 for a new window, after which the sum of squares is least; of equal ones the fullest."""
        size, levels = self.size, self.levels
        after = 2 * levels[n : size + 1] + 1  # by the fill before, 0 to size - n
        after[-1] = 0  # a full window is not counted
        change = after - 2 * levels[: size - n + 1] + 1
        change[0] = after[0]
        change[1:][levels[1 : size - n + 1] == 0] = 1 << 60
        return size - n - int(change[::-1].argmin())

    def finish(self) -> None:
        """Fill the fullest open windows with cut pieces of the least filled ones."""
        windows = [w for fill in sorted(self.open, reverse=True) for w in self.open[fill]]
        self.open, self.levels[:] = {}, 0
        spare: list[tuple] = []
        first = 0
        while first < len(windows):
            window = windows[first]
            first += 1
            room = self.size - sum(len(x[2]) for x in window)
            while room:
                if not spare:
                    if first == len(windows):
                        break
                    spare = windows.pop()
                doc, start, ids = spare.pop()
                window.append((doc, start, ids[:room]))
                if len(ids) > room:
                    spare.append((doc, start + room, ids[room:]))
                room -= min(room, len(ids))
            self.closed.append(window)
        while spare:  # what a last donor has left
            window, room = [], self.size
            while spare and room:
                doc, start, ids = spare.pop()
                window.append((doc, start, ids[:room]))
                if len(ids) > room:
                    spare.append((doc, start + room, ids[room:]))
                room -= min(room, len(ids))
            self.closed.append(window)

    def drain(self) -> Iterator[list]:
        done, self.closed = self.closed, []
        return iter(done)


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, window: int = WINDOW) -> DataFrame:
    """One row per piece of the documents (doc_id, text), each ended by end_id."""
    common.prepare(docs.sparkSession)
    tokenizer = tokenizer or segments.default_path()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encoder, packer, last = segments.library_encoder(tokenizer), Packer(window), np.array([end_id], "<u4").tobytes()
        base, made = TaskContext.get().partitionId() << 32, 0
        names = [x.split()[0] for x in PIECES.split(", ")]

        def rows() -> Iterator[pa.RecordBatch]:
            nonlocal made
            out = []
            for w in packer.drain():
                at = 0
                for (doc, tokens), start, ids in w:
                    out.append((doc, start, len(ids), zlib.crc32(ids), tokens, base + made, at))
                    at += len(ids)
                made += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)

        for b in batches:
            for doc, got in zip(b.column(0).to_pylist(), encoder.render(b.column(1).to_pylist()), strict=True):
                ids = np.frombuffer(got + last, "<u4")
                whole = len(ids) // window * window
                for start in range(0, whole, window):
                    packer.closed.append([((doc, len(ids)), start, ids[start : start + window])])
                if whole < len(ids):
                    packer.place(((doc, len(ids)), whole, ids[whole:].copy()))
                if len(packer.closed) >= 2_000:
                    yield from rows()
            yield from rows()
        packer.finish()
        yield from rows()
        common.trim()

    return docs.select("doc_id", common.text_of().alias("text")).mapInArrow(task, PIECES)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
