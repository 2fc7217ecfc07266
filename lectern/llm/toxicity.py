"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over inverted indexes.

**Words.**  Labelled rows become TF-IDF vectors over all their words (runs of letters, lower case),
with document frequencies over all rows.  A text's neighbours are the ``k`` nearest of all examples whose
cosine is at least ``NEAR``; farther ones would have less than a fortieth of a copy's vote and have none.
Examples lie in blocks, and each word lists the blocks that hold it with its largest weight there.  The
heaviest words of a text, down to where the others together have a length below ``REST``, give every block a bound:
what these words can add there, plus ``REST``.  Blocks whose bound reaches ``NEAR`` and the k-th cosine so far are
scored whole.  That bound holds for every example, so the neighbours are those of a full scan.
**Picked terms.**  A second vector has telling terms only: words, their beginnings of three to
eight letters and their ends of three to six, so that unseen forms of a word share terms with seen
ones.  Those are picked that occur in toxic texts of the labelled sample far more often than chance
allows, in either half of it.  Equal vectors are one entry with two counts, so ties cost nothing.
Entries lie in blocks; each term knows its largest weight in every block.  Blocks are scored in the
order of their bound and the search ends when no bound beats the k-th score: the result is that of
the full scan.
**Vote.**  Neighbours by picked terms vote by nearness; a logistic curve fitted to the votes that
examples get from the others turns votes into probabilities.  Texts without any picked term take
the rate of such examples.  That probability is what the neighbours by all words start from: they
count as examples by nearness, against a tenth of an example for the start.

Only the sample is bounded (``sample_rows`` labelled rows with the smallest hash of the id, one of
each class of the 0.8 shingle join and label); document frequencies and scores cover all rows and
whole texts.  Words that no example has are no terms.  Null and empty texts have no terms.  Without any labelled row all scores are 0.  A row that is
labelled twice counts as toxic if one label says so.  Rows without an id are scored, not learned.  Of rows that repeat an id the smallest
text is learned.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import similar_texts
from lectern.llm.common import batches_of, cut_lineage, only, residue

LETTERS = re.compile(r"[^\W\d_]+")
#: For texts of ASCII alone: letters in lower case, all else a space.
PLAIN = bytes(c | 32 if chr(c).isalpha() and c < 128 else 32 for c in range(256))


def terms_of(word: str) -> list[str]:
    """The word, its beginnings and its ends; a mark keeps the three apart."""
    n = len(word)
    return [f"={word}"] + [f"<{word[:k]}" for k in range(3, min(8, n) + 1)] + [f">{word[-k:]}" for k in range(3, min(6, n) + 1)]


def letter_runs(text: str | None) -> list[str]:
    """The words of a text, runs of letters in lower case."""
    if not text:
        return []
    if text.isascii():
        return text.encode().translate(PLAIN).decode().split()
    text = text.lower()
    others = [c for c in set(text) if not (c.isalpha() or LETTERS.match(c))]
    if len(others) > 64:
        return LETTERS.findall(text)
    for c in others:
        text = text.replace(c, " ")
    return text.split()


def word_counts(text: str | None) -> dict[str, int]:
    """How often each word occurs in a text."""
    return Counter(letter_runs(text))


class Terms:
    """Looks words up among the picked terms.

    A word is looked at closely only if its first or last three letters, or all of it, begin, end
    or are a picked term; what was found for such a word is kept, up to a bound.
    """

    def __init__(self, number: dict[str, int], most: int = 300_000):
        self.number, self.most = number, most
        self.begins = frozenset(t[1:4] for t in number if t[0] == "<")
        self.ends = frozenset(t[-3:] for t in number if t[0] == ">")
        self.whole = frozenset(t[1:] for t in number if t[0] == "=")
        self.seen: dict[str, tuple[int, ...]] = {}

    def of(self, word: str) -> tuple[int, ...]:
        found = self.seen.get(word)
        if found is None:
            found = self.seen[word] = tuple(dict.fromkeys(self.number[t] for t in terms_of(word) if t in self.number))
        return found

    def counts(self, text: str | None) -> dict[int, int]:
        """How often each picked term occurs in a text."""
        return self.among(word_counts(text))

    def among(self, words: dict[str, int]) -> dict[int, int]:
        """The same from the counts of a text's words."""
        if len(self.seen) > self.most:
            self.seen.clear()
        begins, ends, whole, of = self.begins, self.ends, self.whole, self.of
        out: dict[int, int] = {}
        for w, n in words.items():
            if w[:3] in begins or w[-3:] in ends or w in whole:
                for t in of(w):
                    out[t] = out.get(t, 0) + n
        return out


def weighted(counts: dict[int, int], idf: np.ndarray) -> tuple[tuple[int, float], ...]:
    """The TF-IDF vector at length one, terms ascending."""
    pairs = [(t, math.log1p(n) * idf[t]) for t, n in sorted(counts.items())]
    norm = math.sqrt(sum(w * w for _, w in pairs))
    return tuple((t, w / norm) for t, w in pairs) if norm else ()


class BlockMaxIndex:
    """Exact nearest vectors by cosine."""

    def __init__(self, vectors: list[tuple[tuple[int, float], ...]], block: int = 64, apart: int = 4):
        self.block, self.n, self.apart = block, len(vectors), apart
        self.blocks = -(-self.n // block)
        postings: dict[int, list[tuple[int, float]]] = {}
        for v, pairs in enumerate(vectors):
            for t, w in pairs:
                postings.setdefault(t, []).append((v, w))
        self.lists: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for t, found in postings.items():
            where, weight = np.array([v for v, _ in found]), np.array([w for _, w in found])
            largest = np.zeros(self.blocks)
            np.maximum.at(largest, where // block, weight)
            self.lists[t] = (where, weight, largest, np.searchsorted(where, np.arange(self.blocks + 1) * block))

    def nearest(self, query: tuple[tuple[int, float], ...], k: int, leave: int = -1) -> list[tuple[float, int]]:
        """The k best (cosine, place), ties to the smaller place; ``leave`` is passed over."""
        lists = [(self.lists[t], q) for t, q in query if t in self.lists]
        if not lists:
            return []
        bound = sum(q * largest for (_, _, largest, _), q in lists)
        best: list[tuple[float, int]] = []
        order = np.argsort(-bound, kind="stable")
        for done, b in enumerate(order):
            if bound[b] <= 0 or (len(best) == k and bound[b] < -best[-1][0] - 1e-12):
                break
            if done == self.apart:
                best = self._all_at_once(lists, order[done:], best, k, leave)
                break
            score = np.zeros(self.block)
            for (where, weight, _, cut), q in lists:
                a, z = cut[b], cut[b + 1]
                score[where[a:z] - b * self.block] += q * weight[a:z]
            here = [(-score[i], int(b) * self.block + int(i)) for i in np.flatnonzero(score > 0)]
            best = sorted(best + [x for x in here if x[1] != leave])[:k]
        return [(-s, v) for s, v in best]

    def _all_at_once(self, lists: list, blocks: np.ndarray, best: list[tuple[float, int]], k: int, leave: int) -> list[tuple[float, int]]:
        """When the best few blocks exclude little, the others are scored by one sum over the lists."""
        score = np.bincount(np.concatenate([x[0] for x, _ in lists]), np.concatenate([q * x[1] for x, q in lists]), minlength=self.n)
        open_ = np.zeros(self.blocks, bool)
        open_[blocks] = True
        found = np.flatnonzero(score > (0.0 if len(best) < k else -best[-1][0] - 1e-12))
        found = found[open_[found // self.block] & (found != leave)]
        found = found[np.argsort(-score[found], kind="stable")[:k]]
        return sorted(best + [(-score[i], int(i)) for i in found])[:k]


def numbered(words: str) -> dict[str, int]:
    """Numbers of words that are given as one text, which is far smaller to send."""
    return {w: k for k, w in enumerate(words.split())}


def word_numbers(counts: dict[str, int], number: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers, ascending, and counts of the words that ``number`` has."""
    found = {t: n for w, n in counts.items() if (t := number.get(w)) is not None}
    return ascending(found)


def ascending(counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    term, n = np.fromiter(counts.keys(), np.int32, len(counts)), np.fromiter(counts.values(), np.int32, len(counts))
    order = np.argsort(term)
    return term[order], n[order]


def word_vector(term: np.ndarray, n: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The TF-IDF vector at length one."""
    weight = np.log1p(n) * idf[term]
    return term, weight / np.sqrt(weight @ weight) if len(term) else weight


def packed(term: np.ndarray, n: np.ndarray) -> bytes:
    """Numbers and counts of one text: a byte of widths, steps from number to number, counts."""
    steps = np.diff(term, prepend=np.int32(0))
    wide, many = bool(len(steps) and steps.max() > 0xFFFF), bool(len(n) and n.max() > 0xFF)
    return bytes([wide + 2 * many]) + steps.astype("<i4" if wide else "<u2").tobytes() + n.astype("<i4" if many else "u1").tobytes()


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    wide, many = data[0] & 1, data[0] & 2
    size = (len(data) - 1) // ((4 if wide else 2) + (4 if many else 1))
    steps = np.frombuffer(data, "<i4" if wide else "<u2", size, 1)
    n = np.frombuffer(data, "<i4" if many else "u1", size, 1 + steps.nbytes)
    return np.cumsum(steps, dtype=np.int32), n.astype(np.int32)


#: Cosine from which an example has a vote, and the length below which a text's lighter words are only bounded.
NEAR, REST = 0.7, 0.5
#: The largest weight of a word in a block, 1 at most, is kept as a number up to this.
WIDEST = 65_535


class Reader:
    """Known words and picked terms of texts; the picked terms of a known word are looked up once."""

    def __init__(self, terms: Terms, words: dict[str, int]):
        self.terms, self.words = terms, words
        self.picked: dict[int, tuple[int, ...]] = {}
        self.bare = np.zeros(len(words) + 1, bool)  # known words that are found to have no picked term

    def read(self, text: str | None) -> tuple[bytes, bytes]:
        """Both of one text, packed."""
        counts = word_counts(text)
        number = np.fromiter(map(self.words.get, counts, repeat(-1)), np.int32, len(counts))
        n = np.fromiter(counts.values(), np.int32, len(counts))
        new: dict[str, int] = {}
        terms: dict[int, int] = {}
        names = list(counts)
        for i in np.flatnonzero(~self.bare[number]).tolist():
            k, w = int(number[i]), names[i]
            if k < 0:
                new[w] = counts[w]
                continue
            found = self.picked.get(k)
            if found is None:
                found = tuple(self.terms.among({w: 1}))
                if not found:
                    self.bare[k] = True
                    continue
                self.picked[k] = found
            for t in found:
                terms[t] = terms.get(t, 0) + counts[w]
        for t, m in self.terms.among(new).items():
            terms[t] = terms.get(t, 0) + m
        known = np.flatnonzero(number >= 0)
        known = known[np.argsort(number[known])]
        return packed(number[known], n[known]), packed(*ascending(terms))


class WordIndex:
    """Exact nearest vectors of a cosine of at least ``near``; vectors lie one after another, cut at ``at``."""

    def __init__(self, at: np.ndarray, term: np.ndarray, weight: np.ndarray, terms: int, block: int = 4, near: float = NEAR, rest: float = REST):
        self.n, self.block, self.near, self.rest = len(at) - 1, block, near, rest
        self.at, self.term, self.weight = at, term, weight.astype(np.float32, copy=False)
        self.blocks = -(-self.n // block)
        # by ranges of words, so that what is sorted at a time stays small
        kind = np.uint16 if self.blocks < 1 << 16 else np.int32
        of_block = np.repeat((np.arange(self.n) // block).astype(kind), np.diff(at))
        ends = self._even_ranges(term, terms) if len(term) else np.array([0, terms])
        lengths = np.zeros(terms, np.int64)
        # filled from the front; what stays unused takes no memory
        self.where, self.largest, used = np.empty(len(term), kind), np.empty(len(term), np.uint16), 0
        for low, high in zip(ends[:-1], ends[1:]):
            chosen = np.flatnonzero((term >= low) & (term < high))
            key = (term[chosen] - low).astype(np.int64) * max(1, self.blocks) + of_block[chosen]
            order = np.argsort(key, kind="stable")
            key, weights = key[order], self.weight[chosen[order]]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            if len(first):
                self.where[used : used + len(first)] = key[first] % max(1, self.blocks)
                # rounded up, so that bounds stay bounds
                self.largest[used : used + len(first)] = np.minimum(WIDEST, np.ceil(np.maximum.reduceat(weights, first) * WIDEST))
                used += len(first)
            lengths[low:high] = np.bincount(key[first] // max(1, self.blocks), minlength=high - low)
        self.cut = np.concatenate([[0], np.cumsum(lengths)])
        self.query = np.zeros(terms)

    @staticmethod
    def _even_ranges(term: np.ndarray, terms: int, parts: int = 16) -> np.ndarray:
        """Ends of ranges of words with about as many entries each."""
        total = np.zeros(terms, np.int64)
        for a in range(0, len(term), 1 << 20):
            total += np.bincount(term[a : a + (1 << 20)], minlength=terms)
        total = np.cumsum(total)
        return np.unique(np.concatenate([[0], np.searchsorted(total, total[-1] * np.arange(1, parts) // parts), [terms]])).astype(np.int64)

    def bounds(self, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """For each block what no cosine of its vectors with the query exceeds."""
        heavy = np.argsort(-weight, kind="stable")
        left = np.sqrt(np.maximum(0, 1 - np.cumsum(weight[heavy] ** 2)))
        used = int(np.argmax(left < self.rest)) + 1 if left[-1] < self.rest else len(heavy)
        heavy = heavy[:used]
        begin = self.cut[term[heavy]]
        size = self.cut[term[heavy] + 1] - begin
        lists = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.bincount(self.where[lists], self.largest[lists] * np.repeat(weight[heavy] / WIDEST, size), minlength=self.blocks) + left[used - 1] + 1e-5

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and places of the k best, ties to the smaller place."""
        best, places = np.zeros(0), np.zeros(0, np.int64)
        if not len(term) or not self.n:
            return best, places
        bound = self.bounds(term, weight)
        blocks = np.flatnonzero(bound >= self.near)
        self.query[term] = weight
        for b in blocks[np.argsort(-bound[blocks], kind="stable")].tolist():
            if len(best) == k and bound[b] < best[-1]:
                break
            first, last = b * self.block, min(self.n, (b + 1) * self.block)
            a, z = self.at[first], self.at[last]
            total = np.concatenate([[0.0], np.cumsum(self.query[self.term[a:z]] * self.weight[a:z])])
            cosine = np.round(total[self.at[first + 1 : last + 1] - a] - total[self.at[first:last] - a], 6)
            found = np.flatnonzero(cosine >= self.near)
            best, places = np.concatenate([best, cosine[found]]), np.concatenate([places, found + first])
            order = np.lexsort((places, -best))[:k]
            best, places = best[order], places[order]
        self.query[term] = 0
        return best, places


@dataclass
class Model:
    """Everything a score needs; its size is bounded by the sample."""

    number: dict[str, int]
    idf: np.ndarray
    vectors: list[tuple[tuple[int, float], ...]]
    toxic: np.ndarray
    clean: np.ndarray
    example: list[int]
    none_rate: float
    slope: float = 1.0
    shift: float = 0.0
    k: int = 16
    word_idf: np.ndarray | None = None
    texts: list[bytes] | None = None
    marks: np.ndarray | None = None
    rows: np.ndarray | None = None

    def __post_init__(self) -> None:
        self.index = BlockMaxIndex(self.vectors)
        self.terms = Terms(self.number)
        self.known: dict[bytes, tuple[float, list[int]]] = {}
        self.read: dict[bytes, tuple[float, list[int]]] = {}

    def __getstate__(self) -> dict:
        """What is sent to tasks: the index has what scores need of the vectors."""
        state = self.__dict__ | {"vectors": []}
        if self.texts:  # in one piece, which is given back whole when the index is made
            state["texts"] = (b"".join(self.texts), np.cumsum([0, *map(len, self.texts)]).tolist())
        return state

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        if self.texts:
            whole, cuts = memoryview(self.texts[0]), self.texts[1]
            self.texts = [whole[a:z] for a, z in zip(cuts, cuts[1:])]

    def vote(self, query: tuple[tuple[int, float], ...], leave: int = 0) -> tuple[float, list[int]] | None:
        """Log odds of the neighbours' votes and the examples that voted; ``leave`` is one example taken out of its entry."""
        near = self.index.nearest(query, self.k)
        for_, against = 0.0, 0.0
        for cosine, v in near:
            weight = math.exp(-8 * (1 - cosine))
            toxic, clean = float(self.toxic[v]), float(self.clean[v])
            if v == abs(leave) - 1:
                toxic, clean = toxic - (leave > 0), clean - (leave < 0)
            for_, against = for_ + weight * toxic, against + weight * clean
        if for_ + against <= 0:
            return None
        return math.log((for_ + 0.1) / (against + 0.1)), [self.example[v] for _, v in near[:3]]

    @cached_property
    def word_index(self) -> WordIndex:
        """Made where it is first used, so that only words and counts are sent; they go when it is there."""
        if not self.texts:
            return WordIndex(np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32), 0)
        at = np.concatenate([[0], np.cumsum([len(unpacked(x)[0]) for x in self.texts])])
        term, weight = np.zeros(at[-1], np.int32), np.zeros(at[-1], np.float32)
        for a, z, x in zip(at[:-1].tolist(), at[1:].tolist(), self.texts):
            term[a:z], weight[a:z] = word_vector(*unpacked(x), self.word_idf)
        self.texts = []
        del x  # the last one holds the whole piece
        return WordIndex(at, term, weight, len(self.word_idf))

    def of(self, words: bytes, picked: bytes) -> tuple[float, list[int]]:
        """Probability and evidence from the packed words and picked terms of a text; equal texts are scored once."""
        import xxhash

        key = xxhash.xxh3_128_digest(words + b"|" + picked)
        if key not in self.read:
            if len(self.read) > 50_000:
                self.read.clear()
            found = self.known.get(picked)
            if found is None:
                if len(self.known) > 100_000:
                    self.known.clear()
                found = self.known[picked] = self.start(dict(zip(*(x.tolist() for x in unpacked(picked)))))
            if self.word_index.n:
                found = self.moved(found, *self.word_index.nearest(*word_vector(*unpacked(words), self.word_idf), self.k))
            self.read[key] = found
        return self.read[key]

    def moved(self, start: tuple[float, list[int]], cosines: np.ndarray, places: np.ndarray, mass: float = 0.1) -> tuple[float, list[int]]:
        """The probability after the neighbours by all words have voted."""
        weight = np.exp(-12 * (1 - cosines))
        p = (weight @ self.marks[places] + mass * start[0]) / (weight.sum() + mass)
        return min(1.0, float(p)), start[1] or self.rows[places[:3]].tolist()

    def start(self, picked: dict[int, int]) -> tuple[float, list[int]]:
        """Probability and evidence by picked terms alone."""
        query = weighted(picked, self.idf) if self.number else ()
        if not query:
            return self.none_rate, []
        voted = self.vote(query)
        return (self.none_rate, []) if voted is None else (1 / (1 + math.exp(-(self.slope * voted[0] + self.shift))), voted[1])


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Newton steps for a slope and a shift, with a weak pull to slope 1 and shift 0."""
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-(a * x + b)))
        r, h = weight * (p - y), weight * p * (1 - p)
        g = np.array([(r * x).sum() + (a - 1), r.sum() + b])
        m = np.array([[(h * x * x).sum() + 1, (h * x).sum()], [(h * x).sum(), h.sum() + 1]])
        step = np.linalg.solve(m, g)
        a, b = a - step[0], b - step[1]
    return max(float(a), 0.05), float(b)


def labelled_sample(docs: DataFrame, labels: DataFrame, learnable: Column, sample_rows: int) -> DataFrame:
    """(doc_id, text, toxic, half): at most ``sample_rows`` labelled rows, one of each group of near copies."""
    marks = only(labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()), doc_id="doc_id", toxic="toxic").filter(learnable)
    chosen = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)

    # at most sample_rows rows of two numbers, here and below
    texts = only(docs.filter(F.col("text").isNotNull()), doc_id="doc_id", text="text").join(F.broadcast(chosen), "doc_id")
    rows = cut_lineage(texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")))
    classes = similar_texts.similarity_classes(rows).select(F.col("doc_id").alias("member"), F.col("class_id"))
    named = rows.select("doc_id", "toxic").join(classes, F.col("doc_id").cast("long") == F.col("member"))
    first = cut_lineage(named.groupBy("class_id", "toxic").agg(F.min("doc_id").alias("doc_id")).drop("toxic"))
    return rows.join(F.broadcast(first), "doc_id").withColumn("half", F.pmod(F.xxhash64("class_id"), F.lit(2)))


def term_counts(sample: DataFrame, among: dict[str, int] | None = None) -> DataFrame:
    """In how many texts of each half of ``sample`` a term occurs; ``among`` leaves out all other terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if among is None else Terms(among)
        names = list(among or ())
        for batch in batches_of(batches, 1024):
            total: Counter[tuple[str, int]] = Counter()
            for half, text in zip(batch.column("half").to_pylist(), batch.column("text").to_pylist()):
                if known is None:
                    total.update({(t, half) for w in set(letter_runs(text)) for t in terms_of(w)})
                else:
                    total.update((names[t], half) for t in known.counts(text))
            columns = [pa.array([t for t, _ in total], pa.string()), pa.array([h for _, h in total], pa.int64()), pa.array(list(total.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "half", "n"])

    each = sample.select("half", "text").mapInArrow(count, "term string, half long, n long")
    return each.groupBy("term").agg(*[F.sum(F.when(F.col("half") == h, F.col("n")).otherwise(0)).alias(f"n{h}") for h in (0, 1)])


def surprise(toxic: int, n: int, base: float) -> float:
    """n * KL(share, base) where the share is above the base: minus the log of a bound on its chance."""
    p = toxic / n
    if p <= base or base <= 0:
        return 0.0
    return n * (p * math.log(p / base) + ((1 - p) * math.log((1 - p) / (1 - base)) if p < 1 else 0.0))


def pick_terms(sample: DataFrame, most: int = 4096, least: int = 4, at_least: float = 12.0, share: float = 0.3) -> dict[str, int]:
    """Terms whose share of toxic texts is far above the sample's, and at least ``share`` in either half."""
    seen = sample.groupBy().agg(F.count("*").alias("n"), F.sum((F.col("toxic") > 0).cast("int")).alias("t")).first()
    if not seen.n or not seen.t:
        return {}
    base = seen.t / seen.n
    common = term_counts(sample.filter("toxic > 0")).filter((F.col("n0") + F.col("n1") >= least) & (F.col("n0") > 0) & (F.col("n1") > 0))
    top = common.orderBy((F.col("n0") + F.col("n1")).desc(), "term").limit(16 * most).collect()
    candidates = {r.term: k for k, r in enumerate(top)}
    clean = {r.term: (r.n0, r.n1) for r in term_counts(sample.filter("toxic <= 0"), candidates).collect()}
    strong = []
    for r in top:
        c0, c1 = clean.get(r.term, (0, 0))
        if r.n0 >= share * (r.n0 + c0) and r.n1 >= share * (r.n1 + c1):
            strong.append((-surprise(r.n0 + r.n1, r.n0 + r.n1 + c0 + c1, base), r.term))
    return {t: k for k, t in enumerate(t for s, t in sorted(strong)[:most] if -s >= at_least)}


def sample_words(sample: DataFrame) -> str:
    """Every word of the sample, in order."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(letter_runs(text))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string())], names=["word"])

    found = sample.select("text").mapInArrow(distinct, "word string").distinct().toArrow().column("word").to_pylist()
    return " ".join(sorted(found))


def read_rows(docs: DataFrame, text: str, number: dict[str, int], words: str) -> DataFrame:
    """The rows of ``docs`` with words and picked, every text's known words and picked terms, packed; written, so each text is read once."""
    shared = docs.sparkSession.sparkContext.broadcast((number, words))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, words = shared.value
        reader = Reader(Terms(number, 100_000), numbered(words))
        for batch in batches_of(batches, 1024):
            found = [reader.read(t) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)]], names=[*batch.schema.names, "words", "picked"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    rows = docs.mapInArrow(read, f"{kinds}, words binary, picked binary")
    rows = cut_lineage(rows if text != "text" else rows.drop("text"), batch_rows=1024)
    shared.unpersist()
    return rows


def document_frequencies(rows: DataFrame, picked: int, words: int) -> tuple[np.ndarray, np.ndarray, int]:
    """In how many rows each picked term and each word occurs, and the number of rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(picked + words + 1, np.int64)
        for batch in batches:
            total[-1] += batch.num_rows
            for name, first in (("picked", 0), ("words", picked)):
                for data in batch.column(name).to_pylist():
                    total[unpacked(data)[0] + first] += 1
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["term", "n"])

    found = rows.select("words", "picked").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row a term
    out = np.zeros(picked + words + 1)
    out[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return out[:picked], out[picked:-1], int(out[-1])


def learn(docs: DataFrame, labels: DataFrame, learnable: Column, sample_rows: int = 30_000, whole: bool = False) -> tuple[Model, DataFrame]:
    """A model from ``labels`` (doc_id, toxic) of the learnable rows of ``docs`` (doc_id, text), and all rows as it reads them.

    These have doc_id, or with ``whole`` every column of ``docs``, named c0, c1 and so on, so that no name can clash.
    """
    sample = labelled_sample(docs, labels, learnable, sample_rows)
    number = pick_terms(sample)
    words = sample_words(sample)
    if whole:
        read = read_rows(docs.toDF(*[f"c{k}" for k in range(len(docs.columns))]), f"c{docs.columns.index('text')}", number, words)
    else:
        read = read_rows(only(docs, doc_id="doc_id", text="text"), "text", number, words)
    frequency, word_frequency, rows = document_frequencies(read, len(number), words.count(" ") + 1 if words else 0)
    idf, word_idf = (np.log((1 + rows) / (1 + f)) + 0.1 for f in (frequency, word_frequency))
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, all_words = Terms(number), numbered(shared.value)
        for batch in batches_of(batches, 1024):
            counts = [word_counts(t) for t in batch.column("text").to_pylist()]
            found = [weighted(terms.among(c), idf) for c in counts]
            whole = [packed(*word_numbers(c, all_words)) for c in counts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("toxic").cast(pa.int64()), pa.array([[t for t, _ in v] for v in found], pa.list_(pa.int32())),
                 pa.array([[w for _, w in v] for v in found], pa.list_(pa.float64())), pa.array(whole, pa.binary())],
                names=["doc_id", "toxic", "t", "w", "words"],
            )

    kind = "doc_id long, toxic long, t array<int>, w array<double>, words binary"
    kept = sorted(sample.select("doc_id", "toxic", "text").mapInArrow(vectors, kind).collect(), key=lambda r: r.doc_id)
    shared.unpersist()
    entries: dict[tuple, list[int]] = {}
    none = [0, 0]
    for r in kept:
        v = tuple(zip(r.t, r.w))
        if v:
            e = entries.setdefault(v, [0, 0, r.doc_id])
            e[0] += r.toxic > 0
            e[1] += r.toxic == 0
        else:
            none[r.toxic == 0] += 1
    if not kept:
        return Model(number, idf, [], np.zeros(0), np.zeros(0), [], 0.0), read
    order = sorted(entries)  # vectors that share terms lie in the same blocks
    toxic, clean = (np.array([entries[v][k] for v in order], float) for k in (0, 1))
    model = Model(
        number, idf, order, toxic, clean, [entries[v][2] for v in order], (none[0] + 0.1) / (sum(none) + 1), word_idf=word_idf,
        texts=[bytes(r.words) for r in kept], marks=np.array([float(r.toxic > 0) for r in kept]), rows=np.array([r.doc_id for r in kept]),
    )
    votes = [(voted[0], y, n) for v, vector in enumerate(order) for y, n in ((1, toxic[v]), (0, clean[v])) if n and (voted := model.vote(vector, (v + 1) * (1 if y else -1)))]
    if votes:
        x, y, n = (np.array(c, float) for c in zip(*votes))
        model.slope, model.shift = fit_logistic(x, y, n)
    return model, read


def score_rows(read: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and evidence (ids of the nearest examples) of every row that ``learn`` has read."""
    shared = read.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 1024):
            found = [shared.value.of(w, p) for w, p in zip(batch.column("words").to_pylist(), batch.column("picked").to_pylist())]
            columns = [batch.column("doc_id"), pa.array([s for s, _ in found], pa.float64()), pa.array([e for _, e in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "evidence"])

    kind = read.schema["doc_id"].dataType.simpleString()
    return read.mapInArrow(score, f"doc_id {kind}, score double, evidence array<long>")


def rows_below(read: DataFrame, model: Model, limit: float) -> DataFrame:
    """The rows, as ``learn`` has read them whole, whose text scores below ``limit``; nothing is shuffled."""
    shared = read.sparkSession.sparkContext.broadcast(model)
    kept = read.columns[:-2]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 1024):
            below = [shared.value.of(w, p)[0] < limit for w, p in zip(batch.column("words").to_pylist(), batch.column("picked").to_pylist())]
            yield batch.select(kept).filter(pa.array(below, pa.bool_()))

    return read.mapInArrow(keep, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in read.schema.fields[:-2]))


def toxicity_rows(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The registered query: learn from three folds of four, score every row."""
    fold = residue("doc_id", 4)
    model, read = learn(docs, labels, (fold != 2) & (fold != -1))
    return score_rows(read, model).select(
        "doc_id", (residue("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence"
    )
