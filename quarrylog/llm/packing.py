"""Sum-of-squares online packing of tokenised documents into fixed windows.

Each task packs its own documents in the order it reads them. A document longer
than the window fills whole windows first; its remainder goes to the open window
whose fill level makes the sum of squares of the numbers of windows per level
smallest. A level array holds those numbers. Windows leave the task when they
are full. At the end, the windows that the rule has filled most are completed as
they are, with ids of the emptiest ones, which alone are taken apart; what is left
of the last one goes to windows whose lengths are powers of two. So no window
needs padding. When open windows hold more than ``max_open_tokens``, the fullest
are completed in the same way until half of that is left, so that a task's memory
is bounded.

Null or empty texts hold the end id alone. Repeated rows are packed as often as
they occur; a null doc_id is carried through. An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quarrylog.llm.vocab import vocabulary_path

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_ARROW = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())])
#: Sequence ids of a task begin at its partition number times this.
TASK_SPAN = 1 << 40


@lru_cache(maxsize=2)
def byte_encoder(ranks_file: str, special: str, special_id: int):
    """The byte-level tokenizer, from its ranks file."""
    import public_tokenizers
    import tiktoken

    with open(vocabulary_path(ranks_file), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={special: special_id})


class LevelPacker:
    """Open windows by fill level, and the number of windows at each level."""

    def __init__(self, window: int, first_id: int, max_open_tokens: int):
        self.window, self.next_id, self.max_open = window, first_id, max_open_tokens
        self.level = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list]] = {}
        self.open_tokens = 0

    def choose(self, size: int) -> int:
        """The level to place ``size`` ids at; 0 opens a window.

        A move from level h to h + size changes the sum of squares by
        2 * (N[h + size] - N[h]) + 2; a full window counts nowhere.
        """
        top = self.window - size
        now = self.level[1 : top + 1]
        change = 2 * (self.level[size + 1 : self.window + 1] - now) + 2
        if top >= 1:
            change[-1] = 1 - 2 * now[-1]
            change[now == 0] = np.iinfo(np.int64).max
            at = len(change) - 1 - int(np.argmin(change[::-1]))
            if change[at] <= 2 * self.level[size] + 1:
                return at + 1
        return 0

    def add(self, piece: tuple) -> list[tuple[int, list]]:
        """Place a piece (doc_id, start, doc_tokens, ids); return windows that are done."""
        size = len(piece[3])
        if size == self.window:
            return [self._number([piece])]
        h = self.choose(size)
        if h:
            pieces = self.open[h].pop()
            self.level[h] -= 1
        else:
            pieces = []
        pieces.append(piece)
        if h + size == self.window:
            self.open_tokens -= h
            return [self._number(pieces)]
        self.open.setdefault(h + size, []).append(pieces)
        self.level[h + size] += 1
        self.open_tokens += size
        return self.close(False) if self.open_tokens > self.max_open else []

    def close(self, last: bool) -> list[tuple[int, list]]:
        """Complete the fullest open windows with the ids of the emptiest, until none (at the end) or half of max_open_tokens are open."""
        goal = 0 if last else self.max_open // 2
        queue = deque((h, w) for h in sorted(self.open) for w in self.open[h])
        pool: list = []  # of windows taken apart, last piece first
        done, rest = [], []
        while queue and self.open_tokens > goal and not rest:
            h, pieces = queue.pop()
            room = self.window - h
            while room and (pool or queue):
                if not pool:
                    pool = queue.popleft()[1][::-1]
                part, left = self._cut(pool.pop(), room)
                pieces.append(part)
                room -= len(part[3])
                if left:
                    pool.append(left)
            if room:
                rest = pieces
            else:
                done.append(self._number(pieces))
                self.open_tokens -= self.window
        rest += pool[::-1]
        if last:
            done += self._powers(rest)
            rest = []
        self.open, self.level[:] = {}, 0
        for pieces in [*(w for _, w in queue), *([rest] if rest else [])]:
            h = sum(len(p[3]) for p in pieces)
            self.open.setdefault(h, []).append(pieces)
            self.level[h] += 1
        self.open_tokens = sum(h * int(n) for h, n in enumerate(self.level))
        return done

    @staticmethod
    def _cut(piece: tuple, room: int) -> tuple[tuple, tuple | None]:
        """The first ``room`` ids of a piece, and what follows."""
        doc, start, doc_tokens, ids = piece
        return (doc, start, doc_tokens, ids[:room]), (doc, start + room, doc_tokens, ids[room:]) if len(ids) > room else None

    def _powers(self, pieces: list) -> list[tuple[int, list]]:
        """Windows whose lengths are powers of two, from less than one window."""
        done, left = [], pieces[::-1]
        total = sum(len(p[3]) for p in pieces)
        while total:
            room = 1 << (total.bit_length() - 1)
            total, held = total - room, []
            while room:
                part, more = self._cut(left.pop(), room)
                held.append(part)
                room -= len(part[3])
                if more:
                    left.append(more)
            done.append(self._number(held))
        return done

    def _number(self, pieces: list) -> tuple[int, list]:
        self.next_id += 1
        return self.next_id - 1, pieces


def pack(docs: DataFrame, window: int = 2048, end_id: int = 1, ranks_file: str = "byte_bpe_50k.tiktoken", special: str = "<|endoftext|>", special_id: int = 50256, max_open_tokens: int = 4 << 20) -> DataFrame:
    """Pack docs(doc_id, text) into windows; one row for each piece of a document.

    Columns: doc_id, start (ids of the document before the piece), length,
    doc_tokens (the document's ids, end id included), sequence_id, offset (of the
    piece in its sequence) and ids (little-endian unsigned 32-bit).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(ranks_file, special, special_id)
        packer = LevelPacker(window, TaskContext.get().partitionId() * TASK_SPAN, max_open_tokens)
        rows, held = [], 0

        def flush():
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(_ARROW)
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW, strict=True)], schema=_ARROW)
            rows.clear()
            return out

        def keep(done):
            size = 0
            for number, pieces in done:
                offset = 0
                for doc, start, doc_tokens, ids in pieces:
                    rows.append((doc, start, len(ids), doc_tokens, number, offset, ids.tobytes()))
                    offset += len(ids)
                size += offset
            return size

        for batch in batches:
            for doc, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                body = encoder.encode_to_numpy(text.as_py() or "", allowed_special="all").astype("<u4", copy=False)
                ids = np.append(body, np.uint32(end_id)).astype("<u4", copy=False)
                doc, n = doc.as_py(), len(ids)
                for start in range(0, n, window):
                    held += keep(packer.add((doc, start, n, ids[start : start + window])))
                if held > 1 << 20:
                    yield flush()
                    held = 0
        keep(packer.close(True))
        yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
