"""Language-model scores by a nested hierarchical Pitman-Yor model, seated by Gibbs sampling.

**Model.**  A word is drawn in the restaurant of its context, the word before it; before the first word of
a text stands the end of a text.  All context restaurants share one parent, the word restaurant, whose new
tables get words that are spelled by a second hierarchy over bytes: the next byte (or the word's end) is
drawn in the restaurant of the five bytes before it, whose parent is that of the four bytes before, and so
on down to none, then the uniform distribution.  Bytes of a context fall into 257, 32, 32, 16 and 8 classes,
the latest first.  The end of a text is a word of no bytes.

**Training.**  Words, then pairs of words of the learnable rows are counted by Spark; none is left out.  In
tables and joins a word goes by a number of 64 bits (xxh3); pairs travel to their counts packed, with the
places of frequent words.  A sweep seats the customers of every pair
(a pair that occurs once has one table whatever the sweep), adds up the tables by context and by word,
seats those of every word in the word restaurant, adds up the bytes of the words on tables, and seats these
in the restaurants of the spelling model, children before parents, in one group for each latest byte of the
contexts; only the restaurant of no bytes is the driver's.  Numbers of tables of the whole restaurant are
those of the sweep before.  Customers are seated one by one up to twenty of a kind, then in blocks of a
twentieth of those already seated, with the chance of a new table held constant within a block.

**Scores.**  The probability of a word after another is the mean of its predictive probabilities over the
samples kept after burn-in, each of one seating.  Frequent words and pairs (at most ``frequent`` and
``frequent_pairs`` of them) are looked up in each task; the others meet their counts in joins.  A pair that
occurs in one learned text alone needs no join there: a learned token whose pair no other text has is its
only customer.  The base score is add-one smoothing over the counts of words.

Null texts are empty: just the end.  Without learnable rows N and V are 0 and both scores are 0.
Rows without an id are scored, not learned; repeated rows are learned and scored one by one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import batches_of, cut_lineage, forget, only, residue

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
END = 256
SYMBOLS = 257
#: Into how many classes the bytes of a context fall, the latest first.
CLASSES = (257, 32, 32, 16, 8)
DISCOUNT, STRENGTH = (0.3, 0.4, 0.5, 0.6, 0.7, 0.75), 1.0


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case; other letters stay."""
    return WORDS.findall((text or "").encode("utf-8", "surrogatepass").lower())


class Numbers(dict):
    """Numbers of 64 bits of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        n = xxhash.xxh3_64_intdigest(word)
        self[word] = n = n - ((n >> 63) << 64)
        return n

    def of(self, words: list[bytes], most: int = 300_000) -> np.ndarray:
        if len(self) > most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def tokens_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Different tokens of texts, which of them stand one after another, and how many each text has.

    Every text ends with the end, so what stands before a token is the one before it in this order, in a circle.
    """
    texts = pc.ascii_lower(pc.fill_null(texts, ""))
    split = pc.ascii_split_whitespace(pc.binary_join_element_wise(texts, "", " "))  # a space at its end gives every text an empty last piece
    flat, offsets = split.flatten(), split.offsets.to_numpy() - split.offsets[0].as_py()
    kept = pc.binary_length(flat).to_numpy() > 0
    kept[offsets[1:] - 1] = True
    lengths = np.add.reduceat(kept, offsets[:-1], dtype=np.int64) if len(kept) else np.zeros(0, np.int64)
    flat = (flat if kept.all() else flat.filter(pa.array(kept))).dictionary_encode()
    return flat.dictionary.cast(pa.binary()), flat.indices.to_numpy().astype(np.int64), lengths


def pack(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers, first bytes first, as one piece of bytes."""
    return pa.compress(b"".join(np.ascontiguousarray(c.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns), "zstd", asbytes=True)


def unpack(pieces: pa.Table, columns: int) -> list[np.ndarray]:
    """What ``pack`` made of so many columns, for each of ``pieces`` (rows, data)."""
    out = []
    for rows, data in zip(pieces.column("rows").to_pylist(), pieces.column("data")):
        raw = np.frombuffer(pa.decompress(data.as_buffer(), rows * 8 * columns, "zstd"), np.uint8)
        out.append(np.ascontiguousarray(raw.reshape(columns, 8, rows).transpose(0, 2, 1)).view("<i8")[:, :, 0])
    return out


def pair_key(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """One number of 64 bits for a word and the one before it."""
    return before * np.int64(-7046029254386353131) + word


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """Where pairs meet; ``in_bucket`` is the same for a column."""
    return ((key.view(np.uint64) >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)


def in_bucket(key: Column, buckets: int) -> Column:
    return (F.shiftrightunsigned(key, 16) % buckets).cast("int")


def seat(customers: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Numbers of tables after ``customers`` of a kind came; ``weight`` is (strength + discount * tables) * parent's probability."""
    tables, seated = np.minimum(customers, 1).astype(np.int64), np.minimum(customers, 1).astype(np.int64)
    going = np.flatnonzero(customers > 1)
    while len(going):
        n, t, w = seated[going], tables[going], weight[going]
        come = np.minimum(customers[going] - n, np.maximum(1, n // 20))
        tables[going] = t + rng.binomial(come, np.clip(w / (n - discount * t + w), 0, 1))
        seated[going] = n + come
        going = going[seated[going] < customers[going]]
    return tables


def spelled(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context and symbol as one number, word) of every byte and end of the words in an Arrow binary array."""
    lengths = np.diff(offsets)
    n, total = len(lengths), int(lengths.sum())
    word = np.repeat(np.arange(n), lengths + 1)
    first = np.cumsum(lengths + 1) - (lengths + 1)
    place = np.arange(total + n) - first[word]
    last = place == lengths[word]
    symbol = np.full(total + n, END, np.int64)
    symbol[~last] = data[offsets[0] : offsets[-1]]
    before = lambda k: np.where(place >= k, np.roll(symbol, k), END)
    context = np.zeros(total + n, np.int64)
    for k, classes in enumerate(CLASSES, 1):
        context = context * classes + before(k) % classes
    return context * SYMBOLS + symbol, word


def shorten(key: np.ndarray, order: int) -> np.ndarray:
    """The key of the parent context: without the oldest byte of a context of ``order`` bytes."""
    context, symbol = np.divmod(key, SYMBOLS)
    return context // CLASSES[order - 1] * SYMBOLS + symbol


@dataclass
class Spelling:
    """Restaurants of the spelling model by order: sorted keys, customers, tables, and what is left to the parent."""

    keys: list[np.ndarray]
    chance: list[np.ndarray]
    contexts: list[np.ndarray]
    left: list[np.ndarray]

    @staticmethod
    def uniform() -> Spelling:
        return Spelling([], [], [], [])

    @staticmethod
    def above(top: np.ndarray) -> Spelling:
        """Just the restaurant of no bytes."""
        return Spelling([np.arange(SYMBOLS)], [top], [np.zeros(1, np.int64)], [np.ones(1)])

    def of(self, key: np.ndarray, order: int = len(CLASSES)) -> np.ndarray:
        """Predictive probability of each key at ``order``."""
        if not self.keys or order < 0:
            return np.full(len(key), 1 / SYMBOLS)
        at = np.minimum(np.searchsorted(self.keys[order], key), len(self.keys[order]) - 1)
        found = self.keys[order][at] == key
        out = np.where(found, self.chance[order][at], 0.0)
        if not found.all():
            some = np.flatnonzero(~found)
            context = key[some] // SYMBOLS
            where = np.minimum(np.searchsorted(self.contexts[order], context), len(self.contexts[order]) - 1)
            weight = np.where(self.contexts[order][where] == context, self.left[order][where], 1.0)
            out[some] = weight * self.of(shorten(key[some], order), order - 1)
        return out

    def words(self, array: pa.BinaryArray) -> np.ndarray:
        """Natural log probabilities of words."""
        _, offsets, data = array.buffers()
        offsets = np.frombuffer(offsets, np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
        key, word = spelled(np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets)
        return np.bincount(word, np.log(self.of(key)), len(array)) if len(array) else np.zeros(0)


def seat_bytes(key: np.ndarray, customers: np.ndarray, top: np.ndarray, sweeps: int, rng: np.random.Generator) -> tuple[Spelling, np.ndarray]:
    """Seat the bytes of words on tables, children first, whose tables are their parents' customers.

    ``top`` is the probability of each symbol in the restaurant of no bytes; what it gets is returned too, by symbol.
    """
    levels: list[dict] = [{} for _ in range(len(CLASSES) + 1)]
    model, up = Spelling.above(top), np.zeros(SYMBOLS, np.int64)
    for _ in range(sweeps):
        k, c = key, customers
        for order in range(len(CLASSES), 0, -1):
            context = k // SYMBOLS
            starts = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(k) else np.zeros(0, np.int64)
            owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(k))))
            d, s = DISCOUNT[order], STRENGTH
            tables = np.bincount(owner, levels[order].get("tables", np.ones(len(k))), len(starts))
            parent = model.of(shorten(k, order), order - 1) if order <= len(model.keys) else top[k % SYMBOLS]
            t = seat(c, (s + d * tables[owner]) * parent, d, rng)
            levels[order] = {"keys": k, "customers": c, "tables": t, "owner": owner, "contexts": context[starts]}
            k, where = np.unique(shorten(k, order), return_inverse=True)
            c = np.bincount(where, t, len(k)).astype(np.int64)
        up = np.bincount(k, c, SYMBOLS).astype(np.int64)
        model = Spelling.above(top)
        for order, x in enumerate(levels[1:], 1):
            d, s = DISCOUNT[order], STRENGTH
            total, tables = (np.bincount(x["owner"], v, len(x["contexts"])) for v in (x["customers"], x["tables"]))
            left = (s + d * tables) / (s + total)
            below = model.of(shorten(x["keys"], order), order - 1)
            chance = (x["customers"] - d * x["tables"]) / (s + total)[x["owner"]] + left[x["owner"]] * below
            for name, value in (("keys", x["keys"]), ("chance", chance), ("contexts", x["contexts"]), ("left", left)):
                getattr(model, name).append(value)
    return model, up


def seat_top(customers: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The probability of each symbol in the restaurant of no bytes."""
    tables = np.minimum(customers, 1)
    for _ in range(3):
        tables = seat(customers, np.full(SYMBOLS, (STRENGTH + DISCOUNT[0] * tables.sum()) / SYMBOLS), DISCOUNT[0], rng)
    left = STRENGTH + DISCOUNT[0] * tables.sum()
    return (customers - DISCOUNT[0] * tables + left / SYMBOLS) / (STRENGTH + customers.sum())


def spell(words: DataFrame, top: np.ndarray, seed: int) -> tuple[Spelling, np.ndarray]:
    """The spelling model of ``words`` (word, t), so many tables each, and the restaurant of no bytes for the next sweep."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 65_536):
            word = batch.column("word")
            _, offsets, data = word.buffers()
            offsets = np.frombuffer(offsets, np.int32)[word.offset : word.offset + len(word) + 1].astype(np.int64)
            key, whose = spelled(np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets)
            keys, where = np.unique(key, return_inverse=True)
            n = np.bincount(where, batch.column("t").to_numpy()[whose], len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

    def seat_group(group: pa.Table) -> pa.Table:
        group = group.sort_by("key")
        key, n = group.column("key").to_numpy(), group.column("n").to_numpy()
        model, up = seat_bytes(key, n, top, 3, np.random.default_rng([seed, int(key[0] // below)]))
        parts = [(0, np.arange(SYMBOLS), up.astype(float))]
        for order in range(1, len(CLASSES) + 1):
            parts += [(order, model.keys[order], model.chance[order]), (-order, model.contexts[order], model.left[order])]
        columns = [np.concatenate([np.full(len(k), o, np.int32) for o, k, _ in parts]), *(np.concatenate([p[i] for p in parts]) for i in (1, 2))]
        return pa.table(dict(zip(("part", "key", "value"), columns)))

    below = SYMBOLS * math.prod(CLASSES[1:])
    sums = words.select("word", "t").mapInArrow(add, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    latest = F.floor(F.col("key") / below).alias("latest")
    seated = cut_lineage(sums.groupBy(latest).applyInArrow(seat_group, "part int, key long, value double"))
    got = seated.toArrow().combine_chunks()
    forget(seated)
    part, key, value = (got.column(c).to_numpy() for c in ("part", "key", "value"))
    model = Spelling.above(top)
    for order in range(1, len(CLASSES) + 1):
        for o, names in ((order, ("keys", "chance")), (-order, ("contexts", "left"))):
            here = np.flatnonzero(part == o)
            here = here[np.argsort(key[here], kind="stable")]
            for name, x in zip(names, (key, value)):
                getattr(model, name).append(x[here])
    at = part == 0
    return model, seat_top(np.bincount(key[at], value[at], SYMBOLS).astype(np.int64), np.random.default_rng(seed))


@dataclass
class Totals:
    """Customers of the word restaurant (tables of all contexts) and its tables."""

    customers: int
    words: int


@dataclass
class Model:
    """Samples of the spelling model and of the totals; what belongs to a word or a pair stays in tables."""

    n: int
    v: int
    discounts: tuple[float, float]
    samples: list[tuple[Spelling, Totals]] = field(default_factory=list)
    #: (key, n, own): of a pair's customers and tables what its predictive probability has, the mean of the samples.
    pairs: DataFrame | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"pairs": None}

    def left(self, totals: Totals) -> float:
        """What the word restaurant leaves to the spelling."""
        return (STRENGTH + self.discounts[1] * totals.words) / (STRENGTH + totals.customers)

    def chance(self, come: np.ndarray, tables: np.ndarray, spelt: np.ndarray, totals: Totals) -> np.ndarray:
        """Predictive probabilities in the word restaurant of words with the probabilities ``spelt``."""
        return (come - self.discounts[1] * tables) / (STRENGTH + totals.customers) + self.left(totals) * spelt

    def spelled(self, array: pa.BinaryArray) -> np.ndarray:
        """(word, sample): logs of the probabilities in the word restaurant of words that no learnable row has; 0 without a sample."""
        return np.stack([math.log(self.left(t)) + s.words(array) for s, t in self.samples], axis=1) if self.samples else np.zeros((len(array), 1))


def count_words(texts: DataFrame) -> DataFrame:
    """(h, word, c) of ``texts`` (text): how often each word occurs.  Tasks add up before they send."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, held, tokens = Numbers(), [], 0

        def out() -> pa.RecordBatch:
            sums = pa.concat_tables(held).group_by("word").aggregate([("c", "sum")]).combine_chunks()
            words = sums.column("word").combine_chunks()
            return pa.RecordBatch.from_arrays([pa.array(numbers.of(words.to_pylist())), words, sums.column("c_sum").combine_chunks()], names=["h", "word", "c"])

        for batch in batches_of(batches, 512):
            words, codes, _ = tokens_of(batch.column("text"))
            held.append(pa.table({"word": words, "c": np.bincount(codes, minlength=len(words))}))
            tokens += len(codes)
            if tokens > 1_500_000:
                yield out()
                held, tokens = [], 0
        if tokens:
            yield out()

    return texts.select("text").mapInArrow(count, "h long, word binary, c long").groupBy("h", "word").agg(F.sum("c").alias("c"))


def count_pairs(texts: DataFrame, frequent: pa.Table, buckets: int, all_pairs: bool) -> DataFrame:
    """Pairs of ``texts`` (text, learned) as (key, u, w, n): how often the learned texts have each; and (u, f, p), w null: in how many pairs a word is the first or second.

    Pairs that occur once and in no other text are left out unless ``all_pairs``; f and p have them too.  Pairs are
    sent packed, ``frequent`` words (h, word) by their place in that table, to one of ``buckets`` groups by the pair's number.
    """
    given = texts.sparkSession.sparkContext.broadcast(frequent)
    size = frequent.num_rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {w: k for k, w in enumerate(given.value.column("word").to_pylist())}
        numbers, held = Numbers(), []

        def out() -> pa.RecordBatch:
            w, h, learned, u, before = (np.concatenate(x) for x in zip(*held))
            rare = np.unique(h[w < 0])
            for k, hashes in ((w, h), (u, before)):
                some = np.flatnonzero(k < 0)
                k[some] = size + np.searchsorted(rare, hashes[some])
            # bucket, first and second word and whether the text is learned in one number: at most 21 bits a word, as a piece has few tokens
            bits = (size + len(rare)).bit_length()
            each = ((bucket_of(pair_key(before, h), buckets) << bits | u) << bits | w) << 1 | learned
            each.sort()
            pair = each >> 1
            first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
            n = np.add.reduceat(each & 1, first)
            n = n << 1 | (np.diff(np.append(first, len(each))) > n)
            pair, names, mask = pair[first], np.concatenate([np.arange(size), rare]), (1 << bits) - 1
            u, w, bucket = names[pair >> bits & mask], names[pair & mask], pair >> 2 * bits
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            data = [pack(np.diff(u[a:z], prepend=0), w[a:z], n[a:z]) for a, z in zip(cuts, cuts[1:])]
            return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]], pa.int32()), pa.array(np.diff(cuts), pa.int32()), pa.array(data, pa.binary())], names=["bucket", "rows", "data"])

        for batch in batches_of(batches, 512):
            if not batch.num_rows:
                continue
            words, codes, lengths = tokens_of(batch.column("text"))
            words = words.to_pylist()
            w, h = np.fromiter(map(place.get, words, repeat(-1)), np.int64, len(words))[codes], numbers.of(words)[codes]
            learned = np.repeat(batch.column("learned").to_numpy(zero_copy_only=False).astype(np.int64), lengths)
            held.append((w, h, learned, np.roll(w, 1), np.roll(h, 1)))
            if sum(len(x[0]) for x in held) > 1_500_000:
                yield out()
                held.clear()
        if held:
            yield out()

    def merge(group: pa.Table) -> pa.Table:
        h = given.value.column("h").to_numpy()
        u, w, n = np.concatenate([np.stack([np.cumsum(x[0]), x[1], x[2]]) for x in unpack(group, 3)], axis=1)
        for k in (u, w):
            some = np.flatnonzero((k >= 0) & (k < size))
            k[some] = h[k[some]]
        key = pair_key(u, w)
        order = np.argsort(key)
        first = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
        asked = np.maximum.reduceat((n & 1)[order], first) > 0
        n, first = np.add.reduceat((n >> 1)[order], first), order[first]
        asked, n, first = asked[n > 0], n[n > 0], first[n > 0]
        u, w, key = u[first], w[first], key[first]
        out = np.flatnonzero((n > 1) | asked | all_pairs)
        pairs = pa.table({"key": key[out], "u": u[out], "w": w[out], "n": n[out], "f": pa.nulls(len(out), pa.int64()), "p": pa.nulls(len(out), pa.int64())})
        sides = []
        for name, other, k in (("f", "p", u), ("p", "f", w)):
            k, times = np.unique(k, return_counts=True)
            none = pa.nulls(len(k), pa.int64())
            sides.append(pa.table({"key": none, "u": k, "w": none, "n": none, name: times, other: np.zeros(len(k), np.int64)}).select(pairs.column_names))
        return pa.concat_tables([pairs, *sides])

    packed = texts.select("text", "learned").mapInArrow(count, "bucket int, rows int, data binary")
    return packed.groupBy("bucket").applyInArrow(merge, "key long, u long, w long, n long, f long, p long")


def by_side(rows: DataFrame, of_context: Column, of_word: Column) -> DataFrame:
    """(h, f, p): sums by the word before and by the word of ``rows`` (u, w)."""
    side = lambda h, f, p: F.struct(F.col(h).alias("h"), f.cast("long").alias("f"), p.cast("long").alias("p"))
    both = rows.select(F.explode(F.array(side("u", of_context, F.lit(0)), side("w", F.lit(0), of_word))).alias("x"))
    return both.groupBy(F.col("x.h").alias("h")).agg(F.sum("x.f").alias("f"), F.sum("x.p").alias("p"))


def seat_pairs(pairs: DataFrame, words: DataFrame, model: Model, share: float, seed: int) -> DataFrame:
    """Seat the customers of pairs that occur twice or more; ``share`` is the sample's in the mean."""
    d = model.discounts[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        for batch in batches_of(batches, 65_536):
            n, tables, chance = (batch.column(c).to_numpy() for c in ("n", "tables", "chance"))
            t = seat(n, (STRENGTH + d * tables) * chance, d, rng)
            own = batch.column("own").to_numpy() + share * (n - d * t)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "u", "w", "n")), pa.array(own), pa.array(t)], names=["key", "u", "w", "n", "own", "t"])

    met = pairs.join(words.select(F.col("h").alias("w"), "chance"), "w").join(words.select(F.col("h").alias("u"), "tables"), "u")
    return met.select("key", "u", "w", "n", "own", "tables", "chance").mapInArrow(run, "key long, u long, w long, n long, own double, t long")


def seat_words(words: DataFrame, model: Model, totals: Totals, seed: int) -> DataFrame:
    """Seat the tables of the contexts (``come`` for each word) in the word restaurant."""
    e = model.discounts[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([seed, 1, TaskContext.get().partitionId()])
        for batch in batches_of(batches, 65_536):
            t = seat(batch.column("come").to_numpy(), (STRENGTH + e * totals.words) * batch.column("spelt").to_numpy(), e, rng)
            yield batch.set_column(batch.schema.get_field_index("t"), "t", pa.array(t))

    return words.mapInArrow(run, words.schema)


def with_chances(words: DataFrame, model: Model, spelling: Spelling, totals: Totals, keep: bool, last: bool = False) -> DataFrame:
    """``words`` with their probabilities when spelled and in the word restaurant, written; those of a sample are kept, and just these at ``last``."""
    given, d = words.sparkSession.sparkContext.broadcast(spelling), model.discounts[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 65_536):
            come, t = (batch.column(c).to_numpy() for c in ("come", "t"))
            spelt = np.exp(given.value.words(batch.column("word")))
            for name, x in (("spelt", spelt), ("chance", model.chance(come, t, spelt, totals))):
                batch = batch.set_column(batch.schema.get_field_index(name), name, pa.array(x))
            yield batch

    out = words.mapInArrow(run, words.schema)
    if keep:
        left = (STRENGTH + d * F.col("tables")) / (STRENGTH + F.col("c"))
        out = out.withColumn("lefts", F.concat("lefts", F.array(left))).withColumn("chances", F.concat("chances", F.array("chance")))
    out = cut_lineage(out.select("h", "word", "c", "lefts", "chances") if last else out)
    given.destroy()  # each executor has it in a file
    return out


def learn(texts: DataFrame, burn: int = 1, samples: int = 2, others: DataFrame | None = None, frequent: int = 250_000) -> tuple[DataFrame, Model]:
    """The model and its words (h, word, c, lefts, chances): by sample what a word as a context leaves, and its probability in the word restaurant.

    With ``others``, all texts that will be scored and are not learned, the model's pairs leave out those that occur once and in none of these;
    only learned texts have them.
    """
    counts = cut_lineage(count_words(texts))
    seen = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    marked = texts.select("text", F.lit(True).alias("learned"))
    if others is not None:
        marked = marked.unionByName(others.select("text", F.lit(False).alias("learned")))
    counted = cut_lineage(count_pairs(marked, frequent_words(counts, frequent).select("h", "word").toArrow(), group_count(texts, seen.n or 0), others is None))
    sides = counted.filter("w IS NULL").groupBy(F.col("u").alias("h")).agg(F.sum("f").alias("f"), F.sum("p").alias("p"))
    none = F.array().cast("array<double>")
    words = counts.join(sides, "h").select("h", "word", "c", "f", "p", F.col("f").alias("tables"), F.col("p").alias("come"), F.lit(1).cast("long").alias("t"), F.lit(0.0).alias("spelt"), F.lit(0.0).alias("chance"), none.alias("lefts"), none.alias("chances"))
    words = cut_lineage(words)
    pairs = cut_lineage(counted.filter("w IS NOT NULL").select("key", "u", "w", "n"))
    forget(counts), forget(counted)
    distinct = words.agg(F.sum("p").alias("pairs")).first().pairs or 0
    few = pairs.agg(F.sum((F.col("n") == 2).cast("long")).alias("n2"), F.sum((F.col("n") > 1).cast("long")).alias("many")).first()
    n1 = distinct - (few.many or 0)
    discount = min(0.95, max(0.1, n1 / (n1 + 2 * few.n2))) if n1 else 0.5
    model = Model(seen.n or 0, seen.v, (discount, 0.7))
    once = pairs.filter("n = 1").select("key", "n", F.lit(1 - discount).alias("own"))
    many = pairs.filter("n > 1").select("key", "u", "w", "n", F.lit(0.0).alias("own"))
    if model.n:
        top, spelling, totals = np.full(SYMBOLS, 1 / SYMBOLS), Spelling.uniform(), Totals(distinct, model.v)
        words = with_chances(old := words, model, spelling, totals, False)
        forget(old)
        for k in range(burn + samples):
            seated = cut_lineage(seat_pairs(many, words, model, (k >= burn) / samples, k))
            if k:
                forget(many)
            many = seated
            more = by_side(many.filter("t > 1"), F.col("t") - 1, F.col("t") - 1).withColumnsRenamed({"f": "more_f", "p": "more_p"})
            added = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).cast("long")
            met = words.join(more, "h", "left").withColumns({"tables": added("f", "more_f"), "come": added("p", "more_p")}).select(*words.columns)
            now = cut_lineage(seat_words(met, model, totals, k))
            forget(words)
            spelling, top = spell(now, top, k)
            sums = now.agg(F.sum("come").alias("come"), F.sum("t").alias("t")).first()
            totals = Totals(sums.come, sums.t)
            words = with_chances(now, model, spelling, totals, k >= burn, k == burn + samples - 1)
            forget(now)
            if k >= burn:
                model.samples.append((spelling, totals))
    model.pairs = cut_lineage(once.unionByName(many.select("key", "n", "own")))
    forget(many), forget(pairs)
    return words.select("h", "word", "c", "lefts", "chances"), model


def group_count(df: DataFrame, tokens: int) -> int:
    """Groups for so many tokens: at most about a million in each, whatever the session's partitions."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), tokens // 1_000_000 + 1)


def frequent_words(words: DataFrame, most: int) -> DataFrame:
    """Words above the smallest count that leaves at most ``most`` of them."""
    sizes = words.groupBy("c").agg(F.count("*").alias("words")).orderBy(F.col("c").desc())
    least, held = None, 0
    for row in sizes.limit(most).toLocalIterator():
        if held + row.words > most:
            break
        least, held = row.c, held + row.words
    return words.filter(F.lit(False) if least is None else F.col("c") >= least)


class Lookup:
    """What frequent words and pairs are to scores, by number of the word."""

    def __init__(self, words: pa.Table, pairs: pa.Table, model: Model):
        self.number = {w: k for k, w in enumerate(words.column("word").to_pylist())}
        self.h, c = words.column("h").to_numpy(), words.column("c").to_numpy()
        self.base, self.share = np.log10(c + 1.0) - math.log10(model.n + model.v + 1), 1 / (STRENGTH + c)
        self.left, self.chance = (words.column(x).combine_chunks().flatten().to_numpy().reshape(len(c), max(1, len(model.samples))) for x in ("lefts", "chances"))
        key = pairs.column("key").to_numpy().view(np.uint64)
        order = np.argsort(key)
        self.keys, self.own = key[order], pairs.column("own").to_numpy()[order]
        # keys are spread evenly, so their first bits lead to a place near them
        self.shift = np.uint64(64 - max(1, len(key).bit_length()))
        self.place = np.searchsorted(self.keys, np.arange(1 << (64 - int(self.shift)), dtype=np.uint64) << self.shift)
        self.place = np.append(self.place, len(key))

    def pairs(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs are frequent, and what they have of their own."""
        key = key.view(np.uint64)
        bucket = (key >> self.shift).astype(np.int64)
        at, end = self.place[bucket], self.place[bucket + 1]
        found, own = np.zeros(len(key), bool), np.zeros(len(key))
        left = np.flatnonzero(at < end)
        while len(left):
            here = at[left]
            hit = self.keys[here] == key[left]
            found[left[hit]], own[left[hit]] = True, self.own[here[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return found, own


def below_of(lefts: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """What the parents of a context give a word, the mean of the samples."""
    return np.einsum("ij,ij->i", lefts, chances) / lefts.shape[1]


def score_texts(docs: DataFrame, words: DataFrame, model: Model, frequent: int = 250_000, frequent_pairs: int = 500_000, learned: Column | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every row of ``docs`` (doc_id, text); reading it again gives the same rows in the same parts.

    ``learned`` marks the rows that ``learn`` learned from, if it was given all the others.
    """
    top_words = frequent_words(words, frequent).select("h", "word", "c", "lefts", "chances").toArrow()
    top_pairs = frequent_words(model.pairs.withColumnRenamed("n", "c"), frequent_pairs).select("key", "own").toArrow()
    given = docs.sparkSession.sparkContext.broadcast((top_words, top_pairs, model))
    del top_words, top_pairs
    kept: list[Lookup] = []
    # a pair that only its own text has is that text's first customer
    one, wide = 1 - model.discounts[0], max(1, len(model.samples))

    def known() -> Lookup:
        if not kept:
            kept.append(Lookup(*given.value))
        return kept[0]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Rows, tokens with their numbers, and which pairs of a frequent word and context are frequent."""
        part, at, look, numbers = TaskContext.get().partitionId() << 32, 0, known(), Numbers()
        for batch in batches_of(batches, 512):
            words, codes, lengths = tokens_of(batch.column("text"))
            listed, row = words.to_pylist(), np.repeat(np.arange(len(lengths)), lengths)
            found = np.fromiter(map(look.number.get, listed, repeat(-1)), np.int64, len(listed))
            w = look.h[found] if len(look.h) else np.zeros(len(listed), np.int64)
            seldom = np.flatnonzero(found < 0)
            w[seldom] = numbers.of([listed[i] for i in seldom.tolist()])
            found, w = found[codes], w[codes]
            before, key = np.roll(found, 1), pair_key(np.roll(w, 1), w)
            both = np.flatnonzero((found >= 0) & (before >= 0))
            often, own = look.pairs(key[both])
            learned = np.repeat(batch.column("learned").to_numpy(zero_copy_only=False), lengths)
            yield batch, part + at, row, words, codes, lengths, found, before, w, key, learned, both, often, own
            at += len(lengths)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, start, row, words, codes, lengths, found, before, w, key, learned, both, often, own in read(batches):
            rows, hit = len(lengths), found >= 0
            base = np.bincount(row[hit], known().base[found[hit]], rows).astype(np.float64)
            below = below_of(known().left[before[both]], known().chance[found[both]])
            r = known().share[before[both]] / below
            own = np.where(often, own, np.where(learned[both], one, 0.0))
            chance = np.bincount(row[both], np.log10(below * (1 + own * r)), rows).astype(np.float64)
            cases = []
            for rare in ((found < 0) & (before >= 0), (found >= 0) & (before < 0), (found < 0) & (before < 0)):
                rare = np.flatnonzero(rare)
                k, j, mine = found[rare], before[rare], learned[rare]
                named = (k < 0) & ~mine  # learned texts have no new words
                lists = pa.StructArray.from_arrays([
                    pa.array(mine), pa.array(w[rare], mask=k >= 0), pa.array(np.roll(w, 1)[rare], mask=j >= 0), pa.array(k, pa.int32(), mask=k < 0), pa.array(j, pa.int32(), mask=j < 0),
                    words.take(pa.array(codes[rare], mask=~named)),
                ], names=["learned", "w", "u", "k", "j", "word"])
                cases.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(row[rare], np.arange(rows + 1)), pa.int32()), lists))
            yield pa.RecordBatch.from_arrays(
                [pa.array(start + np.arange(rows)), batch.column("doc_id"), pa.array(lengths), pa.array(np.bincount(row[hit], minlength=rows)), pa.array(base), pa.array(chance), *cases],
                names=["row", "doc_id", "n_tokens", "n_known", "base", "chance", *rares],
            )

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of frequent words that are not frequent, packed and by bucket."""
        held, first = [], 0

        def out() -> pa.RecordBatch:
            row, u, w, key, learned = (np.concatenate(x) for x in zip(*held))
            bucket = bucket_of(key, buckets)
            order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
            row, u, w, learned, bucket = row[order], u[order], w[order], learned[order], bucket[order]
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(row) else np.zeros(1, np.int64)
            data = [pack(np.diff(row[a:z] - first, prepend=0), u[a:z], w[a:z] << 1 | learned[a:z]) for a, z in zip(cuts, cuts[1:])]
            starts = pa.array(np.full(len(data), first, np.int64))
            return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]], pa.int32()), starts, pa.array(np.diff(cuts), pa.int32()), pa.array(data, pa.binary())], names=["bucket", "start", "rows", "data"])

        for _, start, row, _, _, _, found, before, _, key, learned, both, often, _ in read(batches):
            which = both[~often]
            first = first if held else start
            held.append((start + row[which], before[which], found[which], key[which], learned[which].astype(np.int64)))
            if sum(len(x[0]) for x in held) > 1_000_000:
                yield out()
                held.clear()
        if held:
            yield out()

    def answer(asked: pa.Table, pairs: pa.Table) -> pa.Table:
        """By row what the asked pairs add to its score: what they have of their own, instead of one customer or none."""
        look = known()
        if not asked.num_rows:
            return pa.table({"row": pa.array([], pa.int64()), "more_chance": pa.array([], pa.float64())})
        pairs = pairs.sort_by("key")
        keys, own = pairs.column("key").to_numpy(), pairs.column("own").to_numpy()
        rows, sums = [], []
        for start, (row, u, w) in zip(asked.column("start").to_pylist(), unpack(asked, 3)):
            row, w, learned = start + np.cumsum(row), w >> 1, np.where(w & 1, one, 0.0)
            key = pair_key(look.h[u], look.h[w])
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == key) if len(keys) else np.zeros(0, np.int64)
            row, u, w, learned, mine = row[hit], u[hit], w[hit], learned[hit], own[at[hit]]
            size = look.share[u] / below_of(look.left[u], look.chance[w])
            more = np.log10((1 + mine * size) / (1 + learned * size))
            which = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
            rows.append(row[which])
            sums.append(np.add.reduceat(more, which) if len(which) else more)
        return pa.table({"row": np.concatenate(rows), "more_chance": np.concatenate(sums)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text", (F.lit(False) if learned is None else learned).alias("learned"))
    rares = ["rare_word", "rare_context", "rare_both"]
    kinds = ", ".join(f"{name} array<struct<learned: boolean, w: bigint, u: bigint, k: int, j: int, word: binary>>" for name in rares)
    looked = cut_lineage(texts.mapInArrow(look, f"row long, doc_id {kind}, n_tokens long, n_known long, base double, chance double, {kinds}"))
    buckets = group_count(docs, looked.agg(F.sum("n_tokens").alias("n")).first().n or 0)
    asked = texts.mapInArrow(ask, "bucket int, start long, rows int, data binary").groupBy("bucket")
    owned = model.pairs.select("key", "own", in_bucket(F.col("key"), buckets).alias("bucket")).groupBy("bucket")
    answers = asked.cogroup(owned).applyInArrow(answer, "row long, more_chance double")

    # tokens whose word, context or both are not among the frequent words, one case after another: what a join shuffled goes before the next
    samples = lambda name, to: [F.get(name, F.lit(s)).alias(f"{to}_{s}") for s in range(wide)]
    facts = words.select(F.col("h").alias("w"), "c", *samples("chances", "chance"))
    contexts = words.select(F.col("h").alias("u"), (1 / (STRENGTH + F.col("c"))).alias("share"), *samples("lefts", "left"))

    def met(name: str) -> DataFrame:
        out = looked.filter(F.size(name) > 0).select("row", F.explode(name).alias("x"))
        out = out.select("row", *[f"x.{c}" for c in ("learned", *{"rare_word": ("w", "j", "word"), "rare_context": ("u", "k"), "rare_both": ("w", "u", "word")}[name])])
        if name != "rare_context":
            out = out.join(facts, "w", "left")
        if name != "rare_word":
            out = out.join(contexts, "u", "left")
        kinds = {"w": "long", "u": "long", "k": "int", "j": "int", "word": "binary", "c": "long", "share": "double"} | {f"{x}_{s}": "double" for x in ("chance", "left") for s in range(wide)}
        return out.select("row", "learned", *[F.col(c) if c in out.columns else F.lit(None).cast(t).alias(c) for c, t in kinds.items()])

    def score_rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """key: only of pairs that may occur more than once or, in other texts, at all."""
        m, look = given.value[2], known()
        for batch in batches_of(batches, 65_536):
            filled = lambda name, value: pc.fill_null(batch.column(name), value).to_numpy(zero_copy_only=False).copy()
            k, j, w, u, c, share = (filled(name, x) for name, x in (("k", -1), ("j", -1), ("w", 0), ("u", 0), ("c", 0), ("share", 0.0)))
            chances, lefts = (np.stack([filled(f"{x}_{s}", math.nan) for s in range(wide)], axis=1) for x in ("chance", "left"))
            often, after = np.flatnonzero(k >= 0), np.flatnonzero(j >= 0)
            chances[often], w[often] = look.chance[k[often]], look.h[k[often]]
            lefts[after], u[after], share[after] = look.left[j[after]], look.h[j[after]], look.share[j[after]]
            lefts[np.isnan(lefts)] = 1  # a context that no learnable row has leaves everything
            new, scale = np.isnan(chances[:, 0]), np.zeros(batch.num_rows)
            if new.any():  # only words that no learnable row has are spelled; the chance of a long one is below any number
                logs = m.spelled(batch.column("word").filter(pa.array(new)))
                scale[new] = logs.max(axis=1)
                chances[new], share[new] = np.exp(logs - scale[new, None]), 0
            below, learned = below_of(lefts, chances), batch.column("learned").to_numpy(zero_copy_only=False)
            r = share / below
            log = np.log10(below * (1 + np.where(learned, one, 0.0) * r)) + scale / math.log(10)
            # a word that occurs once has one pair before it and one after it
            settled = np.where(learned, (c == 1) | (share >= 1 / (STRENGTH + 1)), share == 0)
            columns = [batch.column("row"), pa.array(pair_key(u, w), mask=settled), pa.array(np.where(learned, -r, r), mask=settled), pa.array(log), pa.array(c, mask=k >= 0)]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "key", "r", "log", "c"])

    rare = [cut_lineage(met(name).mapInArrow(score_rare, "row long, key long, r double, log double, c long")) for name in rares]
    rare = rare[0].unionByName(rare[1]).unionByName(rare[2])
    nothing = math.log10(model.n + model.v + 1)
    size = F.abs("r")
    more = F.log10((1 + F.col("own") * size) / (1 + F.when(F.col("r") < 0, one).otherwise(0.0) * size))
    every = rare.filter("key IS NOT NULL").join(model.pairs.select("key", "own"), "key", "left")
    every = every.unionByName(rare.filter("key IS NULL"), allowMissingColumns=True).select(
        "row", (F.col("c") > 0).cast("long").alias("known"), (F.log10(F.col("c") + 1.0) - nothing).alias("base"), (F.col("log") + F.coalesce(more, F.lit(0.0))).alias("more_chance"))
    added = every.unionByName(answers, allowMissingColumns=True).groupBy("row").agg(
        F.sum("known").alias("more_known"), F.sum("base").alias("more_base"), F.sum("more_chance").alias("more_chance"))
    both = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return looked.select("row", "doc_id", "n_tokens", "n_known", "base", "chance").join(added, "row", "left").select(
        "doc_id", "n_tokens", both("n_known", "more_known").alias("n_known"), both("base", "more_base").alias("base_score"), both("chance", "more_chance").alias("score"),
    )


def perplexity(rows: DataFrame) -> Column:
    """Ten to the mean negative score a token, over rows with ``score`` and ``n_tokens``."""
    return F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens"))


def model_rows(docs: DataFrame) -> DataFrame:
    """The registered query: learn from six folds of seven, score every row."""
    fold = residue("doc_id", 7)
    learned = (fold != 2) & (fold != -1)
    words, model = learn(only(docs.filter(learned), text="text"), others=only(docs.filter(~learned), text="text"))
    scores = score_texts(docs, words, model, learned=learned)
    forget(words)
    return scores.select(
        "doc_id", (residue("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score"
    )
