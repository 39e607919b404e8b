"""Sum-of-squares online packing of token sequences (operator 6).

Each task packs the documents of its own partition, in one pass and without a shuffle. A document
is cut into full windows; its remainder goes to the fill level that minimises the sum over levels of
the squared count of partially filled windows, tracked in an array of counts. Of the windows still open at
the end of a partition the emptiest are taken apart and cut to fill up the others, and the last is cut to
powers of two, at which a sequence needs no padding, so a partition pads nothing.

Defined cases: a null text is the empty text (one piece with the end id only); repeated rows and
null ids are packed as they come; an empty table gives no rows; extra columns are ignored; an added token's
string in a text is that token, as the library has it.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.chunks import library_ids
from kindred.llm.common import bounded_batches, documents, text_of

SEQUENCE = 2048
OUT = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


class LevelPacker:
    """Windows by fill level. A piece is (tag, start, ids as bytes); ``done`` gets (pieces) of closed windows."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, list[list]] = {}

    def level_for(self, size: int) -> int:
        """The level whose window takes the piece: 0 opens a new one."""
        n, top = self.counts, self.capacity - size
        best, level = 2 * int(n[size]) + 1, 0
        if top < 1:
            return 0
        if n[top] and 1 - 2 * int(n[top]) <= best:
            best, level = 1 - 2 * int(n[top]), top
        # moving a window from h to h + size changes the sum of squares by 2 (n[h + size] - n[h] + 1)
        delta = n[size + 1 : self.capacity] - n[1:top]
        if len(delta):
            delta = np.where(n[1:top] > 0, 2 * (delta + 1), np.iinfo(np.int64).max)
            at = len(delta) - 1 - int(delta[::-1].argmin())
            if delta[at] < best or delta[at] == best and not level:
                level = at + 1
        return level

    def place(self, piece: tuple) -> list | None:
        """Returns the window if it is now full."""
        size = len(piece[2]) // 4
        if size == self.capacity:
            return [piece]
        level = self.level_for(size)
        window = self.open[level].pop() if level else []
        self.counts[level] -= bool(level)
        window.append(piece)
        if level + size == self.capacity:
            return window
        self.open.setdefault(level + size, []).append(window)
        self.counts[level + size] += 1
        return None

    @staticmethod
    def _take(loose: list[tuple], room: int) -> list[tuple]:
        """Up to ``room`` ids from the end of ``loose``, of which the last piece may be cut."""
        taken = []
        while room and loose:
            tag, start, ids = loose.pop()
            size = min(room, len(ids) // 4)
            taken.append((tag, start, ids[: 4 * size]))
            if len(ids) > 4 * size:
                loose.append((tag, start + size, ids[4 * size :]))
            room -= size
        return taken

    @staticmethod
    def _size(pieces: list[tuple]) -> int:
        return sum(len(p[2]) // 4 for p in pieces)

    def rest(self) -> Iterator[list]:
        """Close what is open: the fullest windows stay as they are and are filled up with pieces of the
        emptiest, which are taken apart and cut; what is left of the last one goes to powers of two."""
        windows = deque(w for level in sorted(self.open) for w in self.open[level])
        loose: list[tuple] = []
        while windows:
            window = windows.pop()
            while room := self.capacity - self._size(window):
                if not loose:
                    if not windows:
                        break
                    loose = windows.popleft()
                window += self._take(loose, room)
            if room:
                loose = window
            else:
                yield window
        while left := self._size(loose):
            yield self._take(loose, 1 << (left.bit_length() - 1))


def pack_sequences(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = SEQUENCE, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their place: sequence_id is the partition's number and a count in it."""
    bounded_batches(docs.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 36, 0
        packer, rows = LevelPacker(capacity), []
        end = np.array([end_id], "<u4").tobytes()

        def put(window: list) -> None:
            nonlocal made
            offset = 0
            for (doc, total), start, ids in window:
                rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, base + made, offset))
                offset += len(ids) // 4
            made += 1

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(OUT))], schema=OUT)
            rows.clear()
            return got

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), library_ids(tokenizer, batch.column(1).to_pylist(), added=True)):
                ids = ids.tobytes() + end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    piece = ((doc, total), start, ids[4 * start : 4 * (start + capacity)])
                    if full := packer.place(piece):
                        put(full)
            yield out()
        for window in packer.rest():
            put(window)
        yield out()

    keyed = docs.select(F.col(doc_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return keyed.mapInArrow(pack, ", ".join(f"{n} long" for n in OUT.names))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_sequences(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
