"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives one Viterbi pass.

A text is normalised as the model says (dummy prefix, white space written as U+2581) and cut
before each run of U+2581; no piece has that sign behind another one, so the parts are
independent.  Over a part the automaton reports, at each position, all pieces that end there (its
output links); each relaxes the best score of the position by the best score where the piece
begins.  Positions that no piece reaches take the character's UTF-8 bytes as byte pieces.  Of equal
scores the segmentation with fewer, then longer last pieces wins, so results don't depend on the
order of pieces.  Parts are segmented once in a worker and kept, up to a bound.

The result is the segmentation with the highest sum of piece scores, which for a unigram model is
what its library gives.  The installed model was trained by merges, and its scores are ranks of
merges; there the library replays the merges, and both can differ.  Decoding is the same for both.

Null and empty texts have no pieces and decode to an empty text.  Repeated rows are encoded one by
one, rows without an id like any other; nothing is shuffled.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lectern.llm.common import batches_of, file_path, only

MARK = "▁"
PART = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: A byte piece counts this much less than the worst piece.
BYTE_PENALTY = 10.0


class Pieces:
    """Segments texts with the pieces of a model file."""

    def __init__(self, path: str, most: int = 500_000):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.automaton = ahocorasick.Automaton()
        self.texts: list[str | None] = []
        self.bytes: dict[int, int] = {}
        lowest = 0.0
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            self.texts.append(None)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.texts[i] = piece
                self.automaton.add_word(piece, (i, len(piece), model.get_score(i)))
                lowest = min(lowest, model.get_score(i)) if model.get_score(i) > -1e8 else lowest
        self.automaton.make_automaton()
        self.byte_score, self.unknown = lowest - BYTE_PENALTY, model.unk_id()
        self.of_byte = {i: b for b, i in self.bytes.items()}
        self.whole = not any(t and MARK in t.lstrip(MARK) for t in self.texts)
        self.most, self.kept = most, {}

    def segment(self, part: str) -> tuple[tuple[int, ...], float]:
        """Ids and score of one part."""
        n = len(part)
        best: list[tuple[float, int]] = [(0.0, 0)] + [(float("-inf"), 0)] * n  # score, minus the number of pieces
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        done = 0

        def fill(upto: int) -> None:
            """Positions that no piece has reached by now get the bytes of their character."""
            nonlocal done
            while done < upto:
                done += 1
                if best[done][0] == float("-inf"):
                    size = len(part[done - 1].encode("utf-8", "surrogatepass"))
                    best[done] = (best[done - 1][0] + size * self.byte_score, best[done - 1][1] - size)
                    back[done] = (done - 1, -1)

        for end, (number, length, score) in self.automaton.iter(part):
            at = end + 1
            fill(at - 1)
            begin = at - length
            reached = (best[begin][0] + score, best[begin][1] - 1)
            if reached > best[at] or (reached == best[at] and begin < back[at][0]):
                best[at], back[at] = reached, (begin, number)
        fill(n)
        out: list[int] = []
        at = n
        while at:
            begin, number = back[at]
            if number >= 0:
                out.append(number)
            else:
                out.extend(self.bytes.get(b, self.unknown) for b in reversed(part[begin:at].encode("utf-8", "surrogatepass")))
            at = begin
        return tuple(reversed(out)), best[n][0]

    def encode(self, text: str | None) -> tuple[list[int], float]:
        """Ids of a text and the sum of their scores."""
        if not text:
            return [], 0.0
        marked = MARK + text.replace(" ", MARK)
        parts = PART.findall(marked) if self.whole else [marked]
        kept = self.kept
        if len(kept) > self.most:
            kept.clear()
        for p in set(parts).difference(kept):
            kept[p] = self.segment(p)
        found = list(map(kept.__getitem__, parts))
        return list(chain.from_iterable(ids for ids, _ in found)), sum(s for _, s in found)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: byte pieces as UTF-8, U+2581 as space, without the dummy prefix."""
        out = bytearray()
        for i in ids:
            if i in self.of_byte:
                out.append(self.of_byte[i])
            elif self.texts[i] is not None:
                out += self.texts[i].encode()
        text = out.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


_models: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The worker's model for a file."""
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def encode_texts(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, ids and score of every row of ``docs`` (doc_id, text)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(file_path(model))
        for batch in batches_of(batches, 256):
            found = [known.encode(t) for t in batch.column("text").to_pylist()]
            columns = [batch.column("doc_id"), pa.array([i for i, _ in found], pa.list_(pa.int32())), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return only(docs, doc_id="doc_id", text="text").mapInArrow(encode, f"doc_id {kind}, ids array<int>, score double")


def decode_ids(rows: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id and text of every row of ``rows`` (doc_id, ids)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(file_path(model))
        for batch in batches_of(batches, 256):
            texts = [known.decode(i or []) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return only(rows, doc_id="doc_id", ids="ids").mapInArrow(decode, f"doc_id {kind}, text string")


def piece_rows(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """The registered query: number, checksum and score of each text's pieces, and whether they decode to the text."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(file_path(model))
        for batch in batches_of(batches, 256):
            texts = batch.column("text").to_pylist()
            found = [known.encode(t) for t in texts]
            sums = [zlib.crc32(np.array(i, "<u4")) for i, _ in found]
            back = [known.decode(i) == (t or "").replace(MARK, " ") for (i, _), t in zip(found, texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(i) for i, _ in found], pa.int64()), pa.array(sums, pa.int64()), pa.array([s for _, s in found], pa.float64()), pa.array(back)],
                names=["doc_id", "n_pieces", "ids_crc32", "score", "round_trip"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return only(docs, doc_id="doc_id", text="text").mapInArrow(digest, f"doc_id {kind}, n_pieces long, ids_crc32 long, score double, round_trip boolean")
