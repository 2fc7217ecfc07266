"""Lists of members instead of pairs, on Arrow batches: dealt by ranges of members, unpacked and reduced in one task.

Only what tasks run; ``skew.least_group_of_lists`` plans it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Pairs that a task unpacks at once.
AT_ONCE = 1 << 21
#: Pairs in one row that goes back.
ROW_PAIRS = 1 << 16

TYPES = {"int": pa.int32(), "bigint": pa.int64(), "long": pa.int64()}


def _runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), starts[1], ..."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of a list column, and where each list starts and how long it is; a null list is empty."""
    offsets = column.offsets.to_numpy()
    counts = np.diff(offsets)
    if column.null_count:
        counts = np.where(column.is_valid().to_numpy(zero_copy_only=False), counts, 0)
    return column.values.to_numpy(zero_copy_only=False), offsets[:-1].astype(np.int64), counts.astype(np.int64)


def _whole(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Bytes of the numbers up to each end, one binary value each."""
    offsets = np.concatenate([[0], ends * values.itemsize]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def deal(batches: Iterator[pa.RecordBatch], *, group: str, label: str | None, least: int, width: int, first: list[int], pieces: list[int]) -> Iterator[pa.RecordBatch]:
    """Rows (group, _l, _r) as packed rows, one for each task that they have pairs for; without _r the pairs are within _l."""
    first_of, pieces_of = np.array(first, np.int64), np.array(pieces, np.int64)
    for batch in batches:
        sizes = [_flat(_whole(batch.column(c)))[2] for c in ("_l", "_r")]
        work = np.cumsum(sizes[0] * np.where(sizes[1] > 0, sizes[1], sizes[0]))
        cuts = np.flatnonzero(np.diff(work // AT_ONCE, prepend=0)).tolist()
        for start, end in zip([0, *cuts], [*cuts, batch.num_rows]):
            if end > start:
                yield from _dealt(batch.slice(start, end - start), group, label, least, width, first_of, pieces_of)


def _dealt(batch: pa.RecordBatch, group: str, label: str | None, least: int, width: int, first_of: np.ndarray, pieces_of: np.ndarray) -> Iterator[pa.RecordBatch]:
    (l, l_at, l_n), (r, r_at, r_n) = (_flat(_whole(batch.column(c))) for c in ("_l", "_r"))
    rows = np.arange(batch.num_rows)
    across = np.flatnonzero(r_n > 0)
    values = np.concatenate([l, r])
    r_at = r_at + len(l)
    # all lists whose members are the first of a pair, with those that can be the second
    row = np.concatenate([rows, across])
    at, n = np.concatenate([l_at, r_at[across]]), np.concatenate([l_n, r_n[across]])
    within = np.concatenate([r_n == 0, np.zeros(len(across), bool)])
    other_at = np.concatenate([np.where(r_n > 0, r_at, l_at), l_at[across]])
    other_n = np.concatenate([np.where(r_n > 0, r_n, l_n), l_n[across]])

    place = _runs(at, n)
    of = np.repeat(np.arange(len(n)), n)
    spot = (values[place].astype(np.int64) - least) // width
    task = first_of[spot]
    new = np.ones(len(place), bool)
    new[1:] = (of[1:] != of[:-1]) | (task[1:] != task[:-1])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(place)))
    of, task, dealt, begin = of[begin], task[begin], pieces_of[spot[begin]], place[begin]
    # within a list only members after the first of the range are the second of a pair
    skipped = np.where(within[of], begin + 1 - other_at[of], 0)
    after_at, after_n = other_at[of] + skipped, other_n[of] - skipped

    copies = np.repeat(np.arange(len(of)), dealt)
    piece = _runs(np.zeros(len(of), np.int64), dealt)
    order = np.argsort(task[copies] + piece, kind="stable")
    copies, piece = copies[order], piece[order]
    after = values[_runs(after_at[copies], after_n[copies])]
    after_n, dealt = after_n[copies], dealt[copies]
    if (dealt > 1).any():
        kept = after % np.repeat(dealt, after_n) == np.repeat(piece, after_n)
        after_n = np.bincount(np.repeat(np.arange(len(after_n)), after_n)[kept], minlength=len(after_n))
        after = after[kept]
    used = after_n > 0
    copies, piece, after_n = copies[used], piece[used], after_n[used]
    if not len(copies):
        return
    count, task = count[copies], task[copies] + piece
    firsts = values[_runs(begin[copies], count)]
    groups = _whole(batch.column(group)).to_numpy(zero_copy_only=False).astype(np.int64)
    last = np.append(np.flatnonzero(task[1:] != task[:-1]), len(task) - 1)
    ends = last + 1
    columns = [
        pa.array(task[last].astype(np.int32)), _packed(groups[row[of[copies]]], ends), _packed(count.astype(np.int32), ends),
        _packed(firsts, np.cumsum(count)[last]), _packed(after_n.astype(np.int32), ends), _packed(after, np.cumsum(after_n)[last]),
    ]
    names = ["_task", "_g", "_nl", "_l", "_nr", "_r"]
    if label:
        texts = _whole(batch.column(label)).take(pa.array(row[of[copies]]))
        columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), texts))
        names.append(label)
    yield pa.RecordBatch.from_arrays(columns, names=names)


class _Least:
    """The least group of each pair seen so far, sorted by pair."""

    def __init__(self, low: int, high: int, least: int, last: int, least_group: int, last_group: int):
        self.low, self.least, self.least_group = low, least, least_group
        self.group_bits = (last_group - least_group).bit_length()
        self.pair_bits = self.group_bits + (last - least).bit_length()
        self.fits = self.pair_bits + (high - low).bit_length() <= 63
        self.keys = np.zeros(0, np.int64)
        self.columns = tuple(np.zeros(0, np.int64) for _ in range(3))

    def add(self, a: np.ndarray, b: np.ndarray, g: np.ndarray) -> None:
        if self.fits:
            keys = ((a - self.low) << self.pair_bits) | ((b - self.least) << self.group_bits) | (g - self.least_group)
            keys = np.concatenate([self.keys, keys])
            keys.sort()
            pairs = keys >> self.group_bits
            self.keys = keys[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if len(keys) else keys
        else:
            a, b, g = (np.concatenate(x) for x in zip(self.columns, (a, b, g)))
            order = np.lexsort((g, b, a))
            a, b, g = a[order], b[order], g[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            self.columns = a[new], b[new], g[new]

    def parts(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for at in range(0, max(len(self.keys), len(self.columns[0])), AT_ONCE):
            if self.fits:
                k = self.keys[at : at + AT_ONCE]
                b = (k >> self.group_bits) & ((1 << (self.pair_bits - self.group_bits)) - 1)
                yield (k >> self.pair_bits) + self.low, b + self.least, (k & ((1 << self.group_bits) - 1)) + self.least_group
            else:
                yield tuple(x[at : at + AT_ONCE] for x in self.columns)

    def __len__(self) -> int:
        return max(len(self.keys), len(self.columns[0]))


def _unpacked(rows: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs (a, b, group) with a < b of packed rows."""
    g, nl, l, nr, r = (np.concatenate(x) for x in zip(*rows))
    nl, nr = nl.astype(np.int64), nr.astype(np.int64)
    counts = np.repeat(nr, nl)
    b = r[_runs(np.repeat(np.cumsum(nr) - nr, nl), counts)].astype(np.int64)
    a, g = np.repeat(l, counts).astype(np.int64), np.repeat(np.repeat(g, nl), counts)
    if nl.max() > 1 or (b <= a).any():
        kept = b > a
        a, b, g = a[kept], b[kept], g[kept]
    return a, b, g


def reduce(batches: Iterator[pa.RecordBatch], *, group: str, label: str | None, member_kind: str, group_kind: str, least: int, last: int, least_group: int, last_group: int, lows: list[int]) -> Iterator[pa.RecordBatch]:
    """(a, _after) from the packed rows of one task: each pair once, with the least group."""
    member = TYPES[member_kind].to_pandas_dtype()
    found, waiting, n, known, texts = None, [], 0, [], []
    for batch in batches:
        packed = [batch.column(c) for c in ("_g", "_nl", "_l", "_nr", "_r")]
        for k in range(batch.num_rows):
            row = [np.frombuffer(c[k].as_buffer(), t) for c, t in zip(packed, (np.int64, np.int32, member, np.int32, member))]
            if found is None:
                task = batch.column("_task")[k].as_py()
                high = next((x for x in lows[task + 1 :] if x > lows[task]), last + 1)
                found = _Least(lows[task], max(high, lows[task] + 1) - 1, least, last, least_group, last_group)
            if label:
                new, at = np.unique(row[0], return_index=True)
                known.append(new)
                texts.append(batch.column(label)[k].values.take(pa.array(at)))
            waiting.append(row)
            n += int((row[1].astype(np.int64) * row[3]).sum())
            # what is kept is sorted again with what is new, so little that is new waits
            if n >= max(AT_ONCE, len(found) // 2):
                found.add(*_unpacked(waiting))
                waiting, n = [], 0
    if found is None:
        return
    if waiting:
        found.add(*_unpacked(waiting))
    if label:
        names, at = np.unique(np.concatenate(known), return_index=True)
        texts = pa.concat_arrays(texts).take(pa.array(at))
    for a, b, g in found.parts():
        columns = [pa.array(b.astype(member)), pa.array(g, TYPES[group_kind])]
        if label:
            columns.append(texts.take(pa.array(np.searchsorted(names, g))))
        # a row for each a, or several
        cut = np.concatenate([[True], a[1:] != a[:-1]])
        cut[::ROW_PAIRS] = True
        begin = np.flatnonzero(cut)
        pairs = pa.StructArray.from_arrays(columns, names=["b", group, *([label] if label else [])])
        lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(a)).astype(np.int32)), pairs)
        yield pa.RecordBatch.from_arrays([pa.array(a[begin].astype(member)), lists], names=["a", "_after"])
