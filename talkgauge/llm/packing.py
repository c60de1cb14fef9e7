"""Packing: sum-of-squares online packing of token ids into windows of a fixed size.

Each task packs the documents that it reads, in their order, so nothing is shuffled and a lost
task is done again alone. A document's whole windows are full at once; its rest is placed by the
sum-of-squares rule: into the open window (or a new one) for which the squared counts of windows at
each fill level add up to least. The counts are kept in an array by level. Windows that are full
are written; open ones stay in memory, of which there are at most a stated number. With so many open the rule chooses
among them alone; a rest that none of them has room for is cut, so that its first part closes the fullest one, and what is left of it is placed by
the rule. So the rule places all but one rest for each window closed, also where no sum of lengths ever fills a window.

At a task's end what the open windows hold is laid end to end and cut into full
windows. A task's last tokens, fewer than a window, become sequences whose lengths are powers of two, which need no padding.

A null text is the empty text. A document's ids end with ``end_id``, so an empty document has one
piece of one token. Ids of documents are passed on as they are, null and repeated ones included:
each row is a document of its own. An empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkgauge.llm.common import each_text
from talkgauge.llm.tokens import encoder

WINDOW = 2_048
#: Open windows that a task may hold: 8 KB each with 2,048 tokens.
MAX_OPEN = 1_024
#: Sequences of a task are numbered upwards from its partition's number times this.
SEQUENCES_PER_TASK = 1 << 40
ROWS = 5_000
_NEVER = np.iinfo(np.int64).max // 2


class Packer:
    """Places documents; ``rows`` gets (document, start, length, crc32, tokens, sequence, offset), and the piece's ids as bytes if they are to be kept."""

    def __init__(self, window: int = WINDOW, max_open: int = MAX_OPEN, first_sequence: int = 0, keep_ids: bool = False):
        self.window, self.max_open, self.keep_ids, self.rows = window, max(1, max_open), keep_ids, []
        self._next = first_sequence
        # The cost of one more window at a level: 2 n + 1 with n windows there, nothing for a full one.
        self._cost = np.ones(window + 1, dtype=np.int64)
        self._cost[window] = 0
        self._open: list[list[list]] = [[] for _ in range(window)]
        self._n_open = 0
        #: Rests that were cut to close a window.
        self.cuts = 0

    def _write(self, pieces: list[tuple]) -> None:
        offset = 0
        for document, start, data, tokens in pieces:
            length = len(data) // 4
            self.rows.append((document, start, length, zlib.crc32(data), tokens, self._next, offset, *([data] if self.keep_ids else [])))
            offset += length
        self._next += 1

    def add(self, document, data: bytes) -> None:
        tokens, window = len(data) // 4, self.window
        rest = tokens % window
        for start in range(0, tokens - rest, window):
            self._write([(document, start, data[4 * start : 4 * (start + window)], tokens)])
        if rest:
            self._place(rest, (document, tokens - rest, data[4 * (tokens - rest) :], tokens))

    def _place(self, length: int, piece: tuple) -> None:
        cost, window = self._cost, self.window
        now = cost[1 : window - length + 1]
        change = np.where(now > 1, cost[1 + length :] - now + 2, _NEVER)
        # Among equal changes the fullest window; a new one only where it is strictly better.
        level = len(change) - int(np.argmin(change[::-1])) if len(change) else 0
        fits = level and change[level - 1] < _NEVER
        if self._n_open >= self.max_open and not fits:
            self._cut(length, piece)
            return
        if fits and (change[level - 1] <= cost[length] or self._n_open >= self.max_open):
            pieces = self._taken(level)
        else:
            level, pieces = 0, []
        pieces.append(piece)
        self._put(level + length, pieces)

    def _taken(self, level: int) -> list[tuple]:
        self._cost[level] -= 2
        self._n_open -= 1
        return self._open[level].pop()

    def _put(self, level: int, pieces: list[tuple]) -> None:
        if level == self.window:
            self._write(pieces)
            return
        self._open[level].append(pieces)
        self._cost[level] += 2
        self._n_open += 1

    def _cut(self, length: int, piece: tuple) -> None:
        """Closes the fullest window with the first part of a rest that no open window has room for, and places what is left of it."""
        level = int(np.flatnonzero(self._cost[1 : self.window] > 1)[-1]) + 1
        document, start, data, tokens = piece
        n = self.window - level
        self._write([*self._taken(level), (document, start, data[: 4 * n], tokens)])
        self.cuts += 1
        self._place(length - n, (document, start + n, data[4 * n :], tokens))

    def _close(self) -> list[tuple]:
        """Cuts what the open windows hold into full ones, and returns what is left."""
        pieces, length = [], 0
        for level in range(self.window - 1, 0, -1):
            for held in self._open[level]:
                for document, start, data, tokens in held:
                    while length + len(data) // 4 >= self.window:
                        n = self.window - length
                        self._write([*pieces, (document, start, data[: 4 * n], tokens)])
                        start, data, pieces, length = start + n, data[4 * n :], [], 0
                    if data:
                        pieces.append((document, start, data, tokens))
                        length += len(data) // 4
            self._open[level] = []
        self._cost[1 : self.window] = 1
        self._n_open = 0
        return pieces

    def finish(self) -> None:
        pieces = self._close()
        left = sum(len(piece[2]) // 4 for piece in pieces)
        while left:
            size = 1 << (left.bit_length() - 1)
            part, need = [], size
            while need:
                document, start, data, tokens = pieces.pop(0)
                n = min(need, len(data) // 4)
                part.append((document, start, data[: 4 * n], tokens))
                if data[4 * n :]:
                    pieces.insert(0, (document, start + n, data[4 * n :], tokens))
                need -= n
            self._write(part)
            left -= size


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = 1, max_open: int = MAX_OPEN, keep_ids: bool = False) -> DataFrame:
    """One row for each piece of a document: where it lies in the document and in its sequence.

    ``sequence_id`` is unique over all tasks. Every id of a document is in exactly one piece. With ``keep_ids`` a last column ``ids`` has the piece's token
    ids, so a sequence is its pieces' ids in order of ``offset``.
    """
    end = np.array([end_id], dtype=np.uint32).tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField(names[0], kind), *(T.StructField(name, T.LongType()) for name in names[1:])])
    if keep_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def packed(batches):
        packer, arrow = Packer(window, max_open, TaskContext.get().partitionId() * SEQUENCES_PER_TASK, keep_ids), None

        def out():
            columns = list(zip(*packer.rows))
            packer.rows = []
            arrays = [pa.array(column, kind) for column, kind in zip(columns, [arrow, *[pa.int64()] * 6])]
            if keep_ids:
                ends = np.cumsum([0, *(len(x) // 4 for x in columns[7])], dtype=np.int32)
                arrays.append(pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(columns[7]), dtype=np.int32)))
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        for batch in batches:
            arrow = batch.column(0).type
            for document, ids in zip(batch.column(0).to_pylist(), encoder(tokenizer).id_bytes(each_text(batch.column(1)))):
                packer.add(document, ids + end)
                if len(packer.rows) >= ROWS:
                    yield out()
        packer.finish()
        if packer.rows:
            yield out()

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(packed, schema)
