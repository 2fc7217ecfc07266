"""Hierarchical packing: documents cut into windows of several context sizes.

Every document is encoded and closed with an end id.  Whole windows of the largest size are cut
from it; the rest goes to the tier of the smallest context size that holds it.  Tiers are packed
from the longest to the shortest: a rest opens a window of its tier, the gap behind it takes
rests of shorter tiers, whole ones where one fits and a cut one to close the gap.  What cannot
fill a window is carried to the next block of documents, and the last such piece of a partition
is cut into windows of powers of two; so no window has padding.  Windows are then dealt to step
groups in the order of their attention cost, forth and back, so that groups cost alike.

Partitions are packed on their own: nothing is shuffled.  Null texts are empty documents (the end
id alone).  Repeated rows are packed as often as they occur.  No rows give no pieces.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import batches_of, file_path, only
from lectern.llm.encoder import encoder

TIERS = (1024, 512, 256, 128)
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long, step_group long"
)
#: A piece: document id, ids before it, its ids, all ids of the document.
Piece = tuple[int | None, int, np.ndarray, int]


def _cut(piece: Piece, n: int) -> tuple[Piece, Piece]:
    doc, start, ids, total = piece
    return (doc, start, ids[:n], total), (doc, start + n, ids[n:], total)


class TierPacker:
    """Packs pieces as they come; ``windows`` returns those that are full, ``close`` the rest."""

    def __init__(self, tiers: Sequence[int] = TIERS):
        self.tiers = sorted(tiers, reverse=True)
        self.queues: dict[int, deque[Piece]] = {t: deque() for t in self.tiers}
        self.full: list[tuple[int, list[Piece]]] = []

    def add(self, piece: Piece) -> None:
        top = self.tiers[0]
        while len(piece[2]) >= top:
            head, piece = _cut(piece, top)
            self.full.append((top, [head]))
        self._route(piece)

    def _route(self, piece: Piece) -> None:
        n = len(piece[2])
        if n:
            self.queues[min(t for t in self.tiers if t >= n)].append(piece)

    def _take(self, gap: int, below: Sequence[int]) -> Piece | None:
        """The next piece for a gap: a whole one of the longest tier whose head fits, else a cut head of the shortest tier that has one."""
        for tier in below:
            if self.queues[tier] and len(self.queues[tier][0][2]) <= gap:
                return self.queues[tier].popleft()
        for tier in reversed(below):
            if self.queues[tier]:
                head, rest = _cut(self.queues[tier].popleft(), gap)
                self._route(rest)
                return head
        return None

    def windows(self) -> list[tuple[int, list[Piece]]]:
        for k, tier in enumerate(self.tiers):
            queue = self.queues[tier]
            while queue:
                window, gap = [queue.popleft()], 0
                gap = tier - len(window[0][2])
                while gap:
                    piece = self._take(gap, self.tiers[k:])
                    if piece is None:
                        break
                    window.append(piece)
                    gap -= len(piece[2])
                if gap:  # nothing of this size or below is left
                    self.queues[tier].extend(window)
                    break
                self.full.append((tier, window))
        done, self.full = self.full, []
        return done

    def close(self) -> list[tuple[int, list[Piece]]]:
        """Windows of powers of two for what is left."""
        done = self.windows()
        left = deque(p for t in self.tiers for p in self.queues[t])
        total = sum(len(p[2]) for p in left)
        while total:
            size = min(self.tiers[0], 1 << (total.bit_length() - 1))
            window, gap = [], size
            while gap:
                head, rest = _cut(left.popleft(), gap)
                window.append(head)
                gap -= len(head[2])
                if len(rest[2]):
                    left.appendleft(rest)
            done.append((size, window))
            total -= size
        for queue in self.queues.values():
            queue.clear()
        return done


def step_groups(windows: list[tuple[int, list[Piece]]], group_tokens: int) -> list[int]:
    """A group for each window: dealt forth and back in the order of attention cost (sum of squared piece lengths)."""
    cost = [sum(len(p[2]) ** 2 for p in pieces) for _, pieces in windows]
    groups = max(1, round(sum(size for size, _ in windows) / group_tokens))
    out = [0] * len(windows)
    for k, w in enumerate(sorted(range(len(windows)), key=lambda i: (-cost[i], i))):
        turn, place = divmod(k, groups)
        out[w] = place if turn % 2 == 0 else groups - 1 - place
    return out


def pack_documents(
    docs: DataFrame, tiers: Sequence[int] = TIERS, tokenizer: str = "byte_bpe_50k.json", end: int = 0, group_tokens: int = 65_536, block: int = 2048
) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) in windows, see ``PIECES``; a task holds ``block`` documents at a time."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        enc, packer = encoder(file_path(tokenizer)), TierPacker(tiers)
        sequence = group = held = 0

        def rows(windows):
            nonlocal sequence, group
            groups = step_groups(windows, group_tokens)
            out = []
            for (size, pieces), g in zip(windows, groups):
                offset = 0
                for doc, start, ids, total in pieces:
                    out.append((doc, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4")), total, part + sequence, offset, size, part + group + g))
                    offset += len(ids)
                sequence += 1
            group += max(groups, default=-1) + 1
            columns = list(zip(*out)) or [()] * 9
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in PIECES.split(", ")])

        for batch in batches_of(batches, 256):
            ids, offsets = enc.encode(batch.column("text").to_pylist(), end)
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), offsets, offsets[1:]):
                packer.add((doc, 0, ids[a:b], int(b - a)))
            held += batch.num_rows
            if held >= block:
                yield rows(packer.windows())
                held = 0
        yield rows(packer.close())

    return only(docs, doc_id=F.col("doc_id").cast("long"), text="text").mapInArrow(pack, PIECES)
