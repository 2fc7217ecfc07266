"""Encoding texts with a tokenizers file, one word at a time and each word once."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence
from itertools import chain, islice

import numpy as np

#: Characters with Unicode's White_Space property, which the pre-tokenizer's \s matches.
SPACE = "\t-\r \x85\xa0  -     　"
#: A run of Latin letters ends a piece where certain punctuation or space follows, as it does for the pre-tokenizer.
LATIN = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
CHUNK = re.compile(f"[{SPACE}]*(?:[{LATIN}]+(?=[{SPACE}.,|]|$)|[^{SPACE}]+)|[{SPACE}]+")
AFTER_SPACE = re.compile(f"[{SPACE}][^<]*[^{SPACE}<]$")


class Encoder:
    """Ids of texts, equal to encoding each whole text with the library.

    Byte-level pre-tokenization never joins a character with white space after it, nor a letter
    with punctuation after it, and looks ahead but never back; so a text may be cut before each
    run of white space and behind a word.  A distinct piece is encoded once and kept.  At most ``most_pieces`` pieces of up to 64 characters are
    kept; others are encoded again for each batch that has them, so memory is bounded.
    """

    def __init__(self, path: str, most_pieces: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most_pieces = most_pieces
        self.kept: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():  # a character of a byte-level token is a byte
            self.width[number] = len(token)

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number per piece; ``pieces`` begin with space and end without it, so they can follow one another."""
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(pieces)], add_special_tokens=False)[0].ids, np.uint32)
        size = np.fromiter((len(p) if p.isascii() else len(p.encode()) for p in pieces), np.int64, len(pieces))
        ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(size)) + 1
        return ids, np.diff(ends, prepend=0)

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of pieces as little-endian 32-bit numbers."""
        follow: list[str] = []
        alone: list[str] = []
        for p in pieces:
            (follow if AFTER_SPACE.match(p) else alone).append(p)
        out: dict[str, bytes] = {}
        for at in range(0, len(follow), 4096):
            some = follow[at : at + 4096]
            ids, counts = self._ids(some)
            data, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
            out.update(zip(some, map(data.__getitem__, map(slice, [0, *ends], ends))))
        for at in range(0, len(alone), 4096):
            some = alone[at : at + 4096]
            out.update((p, np.array(e.ids, "<u4").tobytes()) for p, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)))
        return out

    def encode(self, texts: Sequence[str | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the offsets of the texts in them; ``end`` follows each text."""
        last = b"" if end is None else np.array(end, "<u4").tobytes()
        cut = [CHUNK.findall(t) if t else [] for t in texts]
        found = list(map(self.kept.get, chain.from_iterable(cut)))
        if None in found:
            flat = list(chain.from_iterable(cut))
            new = [i for i, ids in enumerate(found) if ids is None]
            learned = self._learn(list({flat[i] for i in new}))
            for i in new:
                found[i] = learned[flat[i]]
            room = max(0, self.most_pieces - len(self.kept))
            self.kept.update(islice(((p, ids) for p, ids in learned.items() if len(p) <= 64), room))
        ends = np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut))).tolist()
        each = [b"".join(found[a:z]) + last for a, z in zip([0, *ends], ends)]
        offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, each), np.int64, len(each)))]) // 4
        return np.frombuffer(b"".join(each), "<u4"), offsets


_kept: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file; Spark reuses workers, so it outlives a task."""
    if path not in _kept:
        _kept[path] = Encoder(path)
    return _kept[path]
