"""Joins, neighbours, scores and the pipeline against brute force on small tables."""

import math
import os
import pickle
import random
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import neighbours, packing, pitman_yor, quality, queries, similar_texts, toxicity
from lectern.llm.components import components

SF = "/root/testdata/sf0.001"


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((260, 8)).astype(np.float32) * rng.uniform(0.5, 2, (260, 1)).astype(np.float32)
    x[40:80] = x[40]  # ties
    rows = [(k, v.tolist(), 1.0, 2) for k, v in enumerate(x)]
    rows += [(300, None, 0.0, 0), (320, [0.0] * 8, 0.0, 0), (340, [float("nan")] + [1.0] * 7, 0.0, 0), (360, [None] + [1.0] * 7, 0.0, 0), (None, x[3].tolist(), 0.0, 0), (380, [1.0], 0.0, 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double, node int")
    got = {}
    for r in neighbours.nearest(vectors, F.col("vec_id") % 20 == 0, k=12).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 260, 20))
    full = x.astype(np.float64)
    for q, found in got.items():
        scores = full @ full[q]
        order = [int(i) for i in np.lexsort((np.arange(260), -scores)) if i != q][:12]
        assert [v for _, v, _ in sorted(found)] == order
        assert [r for r, *_ in sorted(found)] == list(range(1, 13)) and all(abs(s - scores[v]) < 1e-9 for _, v, s in found)
    assert neighbours.nearest(vectors.limit(0), F.col("vec_id") >= 0).count() == 0
    two = neighbours.nearest(vectors.filter("vec_id < 2"), F.col("vec_id") >= 0).collect()
    assert sorted((r.query_id, r.vec_id) for r in two) == [(0, 1), (1, 0)]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    roots = {r.node: r.root for r in components(edges).collect()}
    assert {roots[k] for k in range(41)} == {0} and roots[101] == 100
    assert components(edges.limit(0)).count() == 0


def near_copies():
    random.seed(4)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(6))
    texts = {}
    passage = " ".join(word() for _ in range(25))
    for g in range(12):
        base = [word() for _ in range(120)]
        for k in range(1 + g % 5):
            copy = list(base)
            for _ in range(k):
                copy[random.randrange(120)] = word()
            texts[len(texts)] = " ".join(copy)
    for _ in range(15):  # many share a passage, which is no near copy
        texts[len(texts)] = passage + " " + " ".join(word() for _ in range(80))
    texts[len(texts)] = texts[3]
    for t in ("few words", "few words", "", None, "   "):
        texts[len(texts)] = t
    return texts


def brute_classes(texts):
    def shingles(t):
        w = (t or "").split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {k: shingles(t) for k, t in texts.items()}
    links = {k: {j for j in sets if j != k and sets[k] and len(sets[k] & sets[j]) >= 0.8 * len(sets[k] | sets[j])} for k in sets}
    out = {}
    for k in sets:
        seen, todo = {k}, [k]
        while todo:
            todo += [j for j in links[todo.pop()] if j not in seen and not seen.add(j)]
        out[k] = (min(seen), len(links[k]))
    return out


@pytest.mark.parametrize("options", [{}, {"fill": 2, "depth": 2, "recall": 0.9999}, {"block": 2}])
def test_similarity_equals_brute_force(spark, options):
    texts = near_copies()
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in texts.items()] + [(None, texts[0], 1, "x")], "doc_id long, text string, n_links int, node string")
    got = similar_texts.similarity_classes(docs, **options).collect()
    assert len(got) == len(texts) + 1
    want = brute_classes(texts)
    for r in got:
        assert (r.class_id, r.n_links) == (want[r.doc_id] if r.doc_id is not None else (None, 0)), r
    if not options:
        assert similar_texts.similarity_classes(docs.limit(0)).count() == 0


def test_overlaps_count_rare_and_frequent_elements():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, 30).astype(np.uint64)) for _ in range(40)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = similar_texts.overlaps(sets)
    np.fill_diagonal(got, 0), np.fill_diagonal(np.array(want), 0)
    assert all(got[i, j] == want[i][j] for i in range(40) for j in range(40) if i != j)


def test_scores_of_the_language_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.lit(1.0).alias("score"), F.lit("x").alias("rare"))
    odd = spark.createDataFrame([(9001, None), (9002, ""), (9003, "É neverseenword THE"), (None, "the of"), (9003, "twice")], "doc_id long, text string")
    docs = docs.unionByName(odd, allowMissingColumns=True)
    texts = [(r.doc_id, pitman_yor.words_of(r.text) + [b""]) for r in docs.select("doc_id", "text").collect()]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    c = Counter(w for d, ws in texts if d is not None and not held(d) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(d), len(ws), sum(c[w] > 0 for w in ws), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for d, ws in texts)
    rows = pitman_yor.model_rows(docs).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rows) == want
    assert {r.train_tokens for r in rows} == {n} and all(r.held_out == held(r.doc_id) for r in rows) and all(r.score < 0 for r in rows)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    words, model = pitman_yor.learn(docs.filter(fold != 2).select("text"))
    few = {(r.doc_id, r.n_tokens): r for r in pitman_yor.score_texts(docs, words, model, frequent=40).collect()}
    for r in pitman_yor.score_texts(docs, words, model).collect():  # the join gives what the look-up gives
        other = few[r.doc_id, r.n_tokens]
        assert (r.n_known, round(r.base_score, 6), round(r.score, 6)) == (other.n_known, round(other.base_score, 6), round(other.score, 6))
    spelling = model.samples[0][0]
    context = int(spelling.contexts[2][0])
    assert spelling.of(context * 257 + np.arange(257), 2).sum() == pytest.approx(1)
    nobody = pitman_yor.model_rows(docs.filter("doc_id IS NULL")).first()
    assert (nobody.base_score, nobody.train_tokens, nobody.n_known) == (0, 0, 0)
    assert pitman_yor.model_rows(docs.limit(0)).count() == 0


def test_words_are_drawn_in_the_restaurant_of_the_word_before(spark):
    """Plain ASCII: the same words score by their order, and what a context has and leaves is one."""
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 7 == 2]
    order, other = "red fox met big dog", "fox red dog met big"
    rows = [(k, {held[0]: order, held[1]: other}.get(k, order if k % 3 else "big dog met red fox")) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pitman_yor.model_rows(docs).collect()}
    assert got[held[0]].score > got[held[1]].score + 3 and got[held[0]].base_score == pytest.approx(got[held[1]].base_score)
    texts = docs.select("text").limit(30).unionByName(spark.createDataFrame([("red dog",), ("dog dog fox rare",)], "text string"))
    words, model = pitman_yor.learn(texts)
    pairs = Counter((u, w) for r in texts.collect() for ws in [pitman_yor.words_of(r.text) + [b""]] for u, w in zip([b"", *ws], ws))
    number = pitman_yor.Numbers()
    own = {r.key: (r.n, r.own) for r in model.pairs.collect()}
    for r in words.collect():
        mine = {w: own[int(pitman_yor.pair_key(number.of([u]), number.of([w]))[0])] for u, w in pairs if u == bytes(r.word)}
        assert {w: n for w, (n, _) in mine.items()} == {w: n for (u, w), n in pairs.items() if u == bytes(r.word)}
        assert sum(o for _, o in mine.values()) / (1 + r.c) + sum(r.lefts) / len(r.lefts) == pytest.approx(1)
    assert len(own) == len(pairs)


@pytest.mark.parametrize("all_pairs", [False, True])
def test_pairs_sent_packed_are_counted_as_plain_ones(spark, all_pairs):
    """Frequent words go by their place, others by their number; a pair's sides count those that are left out too."""
    rng = random.Random(7)
    mine = [" ".join(rng.choices(["The", "fox", "é", "dog\x0b", "\x1crare%d" % k], [9, 5, 3, 2, 2], k=rng.randrange(9))) for k in range(300)] + ["", " \t ", None]
    others = ["the fox fox new", "rare5 the", None]
    rows = [(t, True) for t in mine] + [(t, False) for t in others]
    number = pitman_yor.Numbers()
    tokens = {t: [*number.of([*pitman_yor.words_of(t), b""]).tolist()] for t, _ in rows}
    dictionary, codes, lengths = pitman_yor.tokens_of(pa.array([t for t, _ in rows], pa.string()).slice(1))
    assert [dictionary[k].as_py() for k in codes.tolist()] == [w for t, _ in rows[1:] for w in [*pitman_yor.words_of(t), b""]] and lengths.sum() == len(codes)
    count = lambda texts: Counter((u, w) for t in texts for u, w in zip([tokens[t][-1], *tokens[t]], tokens[t]))
    want, asked = count(mine), count(others)
    words = pitman_yor.count_words(spark.createDataFrame([(t,) for t in mine], "text string"))
    assert {r.h: r.c for r in words.collect()} == Counter(w for t in mine for w in tokens[t])
    top = pitman_yor.frequent_words(words, 3).select("h", "word").toArrow()
    got = pitman_yor.count_pairs(spark.createDataFrame(rows, "text string, learned boolean").repartition(3), top, 5, all_pairs).collect()
    assert {(r.u, r.w): r.n for r in got if r.w is not None} == {p: n for p, n in want.items() if n > 1 or p in asked or all_pairs}
    f, p = Counter(), Counter()
    for r in got:
        if r.w is None:
            f[r.u] += r.f
            p[r.u] += r.p
    assert f == Counter(u for u, _ in want) and p == Counter(w for _, w in want)


def test_packed_pairs_take_a_fifth_of_plain_ones():
    rng = np.random.default_rng(1)
    u, w = np.sort(rng.zipf(1.3, 50_000) % 250_000), rng.zipf(1.3, 50_000) % 250_000
    data = pitman_yor.pack(np.diff(u, prepend=0), w, np.full(50_000, 2))
    back = pitman_yor.unpack(pa.table({"rows": [50_000], "data": [data]}), 3)[0]
    assert (np.cumsum(back[0]) == u).all() and (back[1] == w).all() and len(data) < 50_000 * 24 / 5


@pytest.mark.parametrize("apart", [0, 2, 1000])
def test_block_max_index_equals_full_scan(apart):
    rng = random.Random(3)
    vectors = []
    for _ in range(400):
        pairs = {rng.randrange(30): rng.random() for _ in range(rng.randrange(1, 6))}
        norm = math.sqrt(sum(w * w for w in pairs.values()))
        vectors.append(tuple(sorted((t, w / norm) for t, w in pairs.items())))
    index = toxicity.BlockMaxIndex(vectors, block=16, apart=apart)
    for query in vectors[:60]:
        q = dict(query)
        scores = sorted((-sum(q.get(t, 0) * w for t, w in v), i) for i, v in enumerate(vectors))
        want = [(-s, i) for s, i in scores if s < 0][:7]
        got = index.nearest(query, 7)
        assert [i for _, i in got] == [i for _, i in want] or np.allclose([s for s, _ in got], [s for s, _ in want])
        assert np.allclose([s for s, _ in got], [s for s, _ in want])


def toxic_corpus(spark, n=600):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    docs, labels = [], []
    for k in range(n):
        toxic = k % 6 == 0
        words = [word() for _ in range(60)]
        if toxic:
            words[rng.randrange(60)] = rng.choice(["zidiot", "zidiots!", "Zidiotly", "vqux" + word()])
        docs.append((k, " ".join(words), "x", 0.1))
        labels.append((k, int(toxic), 1))
    return docs, labels


def test_toxicity_finds_unseen_forms(spark):
    docs, labels = toxic_corpus(spark)
    docs += [(9001, "", "x", 0.0), (9002, None, "x", 0.0), (None, "zidiot here", "x", 0.0), (9003, "vquxneverseen in a text", "x", 0.0), (9003, "fine", "x", 0.0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, toxic string, score double")
    marks = spark.createDataFrame([*labels, (None, 1, 1), (9001, None, 1)], "doc_id long, toxic int, quality int")
    rows = toxicity.toxicity_rows(d, marks).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    truth = {k: t for k, t, _ in labels}
    held = [r for r in rows if r.doc_id in truth and r.held_out]
    assert all(r.predicted == truth[r.doc_id] for r in held) and any(truth[r.doc_id] for r in held)
    by = {(r.doc_id, r.predicted) for r in rows}
    assert {(9001, 0), (9002, 0), (None, 1), (9003, 1), (9003, 0)} <= by
    assert {r.score for r in toxicity.toxicity_rows(d, marks.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity_rows(d.limit(0), marks).count() == 0


def test_toxicity_knows_copies_of_rare_examples(spark):
    rng = random.Random(7)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60))
    rows = [(k, text(), int(k in (20, 40, 60))) for k in range(120)]  # too few toxic texts for any telling term
    d = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(900 + k, rows[k][1] + " end") for k in (20, 40, 60, 7, 8)], "doc_id long, text string")
    marks = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    model, read = toxicity.learn(d, marks, F.lit(True))
    assert not model.number
    got = {r.doc_id: r.score for r in toxicity.score_rows(read, model).filter("doc_id >= 900").collect()}
    assert {k for k, s in got.items() if s >= 0.3} == {920, 940, 960}


@pytest.mark.parametrize("near, rest, block", [(0.7, 0.45, 16), (0.3, 0.2, 4), (0.5, 0.5, 1), (0.0, 0.9, 7)])
def test_word_index_equals_full_scan(near, rest, block):
    rng = np.random.default_rng(3)
    full = rng.random((200, 60)) ** 3 * (rng.random((200, 60)) < 0.3)
    full[50:60] = full[5] * (1 + 0.3 * rng.random((10, 60)))  # near copies
    full[70:90] = full[7]  # ties
    full /= np.linalg.norm(full, axis=1, keepdims=True).clip(1e-9)
    full[100] = 0
    place, term = np.nonzero(full)
    index = toxicity.WordIndex(np.searchsorted(place, np.arange(201)), term, full[place, term], 60, block=block, near=near, rest=rest)
    found_any = 0
    for v in full:
        cosines, found = index.nearest(np.flatnonzero(v), v[v > 0], 7)
        want = full @ v
        order = np.lexsort((np.arange(200), -np.round(want, 6)))[:7]
        order = order[want[order] >= near] if v.any() else order[:0]
        assert np.allclose(cosines, want[order], atol=1e-5) and np.allclose(want[found], want[order], atol=1e-5)
        found_any += len(found) > 1
    assert found_any > 20


def test_votes_equal_a_plain_computation(spark):
    """Scores of the query against TF-IDF, cosines and votes written out in full."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [[word() for _ in range(50)] for _ in range(30)]
    rows = []
    for k in range(150):
        words = list(base[k % 30])
        for _ in range(rng.randrange(0, 22)):
            words[rng.randrange(50)] = word()
        rows.append((k, " ".join(words), int(k % 30 < 4)))
    rows.append((150, "ab " * 30000 + " ".join(base[1]), 1))  # a long text
    d = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(3, "other text of an id")], "doc_id long, text string")
    marks = spark.createDataFrame([(k, y) for k, _, y in rows if k % 4], "doc_id long, toxic int")
    model, read = toxicity.learn(d, marks, F.lit(True))
    got = {(r.doc_id, round(r.score, 6)) for r in toxicity.score_rows(read, model).collect()}
    all_texts = [t for _, t, _ in rows] + ["other text of an id"]
    learned = dict(zip(model.rows.tolist(), model.marks.tolist()))
    texts = {k: min(t for k2, t in [*((k, t) for k, t, _ in rows), (3, "other text of an id")] if k2 == k) for k in learned}
    known = set(w for t in texts.values() for w in t.split())
    df = Counter(w for t in all_texts for w in set(t.split()))
    idf = {w: math.log((1 + len(all_texts)) / (1 + df[w])) + 0.1 for w in known}

    def vector(t):
        v = {w: math.log1p(n) * idf[w] for w, n in Counter(t.split()).items() if w in idf}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    examples = [(k, vector(texts[k])) for k in sorted(learned)]
    names = list(model.number)
    for (doc, t) in [*((k, t) for k, t, _ in rows), (3, "other text of an id")]:
        v = vector(t)
        near = sorted(((-round(sum(x * e.get(w, 0) for w, x in v.items()), 6), k) for k, e in examples))[:16]
        near = [(-c, k) for c, k in near if -c >= toxicity.NEAR]
        start = model.start(dict(Counter({i: n for i, n in model.terms.counts(t).items()})))[0]
        weights = [math.exp(-12 * (1 - c)) for c, _ in near]
        p = (sum(w * learned[k] for w, (_, k) in zip(weights, near)) + 0.1 * start) / (sum(weights) + 0.1)
        assert any(x == doc and abs(s - min(1, p)) < 2e-5 for x, s in got), (doc, p, names[:3])


def test_pipeline_stages(spark, tmp_path):
    docs, labels = toxic_corpus(spark)
    clean = [(k, f"the house of {t} and the garden in it", *r) for k, t, *r in docs]
    clean += [(5001, clean[1][1], "x", 0.1), (5002, clean[2][1] + " end", "x", 0.1), (5003, "short", "x", 0.1), (5004, None, "x", 0.1), (None, clean[1][1] + " of its own", "x", 0.1)]
    clean += [(3, f"a house of {docs[301][1]} with the same id", "x", 0.1), (3, f"a house of {docs[301][1]} with the same id", "x", 0.1)]
    clean = [(*r, k, None) for k, r in enumerate(clean)]
    spark.createDataFrame(clean, "doc_id long, text string, _score string, _first_of_id double, row int, c0 string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    toxic = {k for k, t, _ in labels if t}
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, str(tmp_path))
        assert d.columns == ["doc_id", "text", "_score", "_first_of_id", "row", "c0"], name
        left.append(sorted(str(r.doc_id) for r in d.select("doc_id").collect()))
    everyone = {str(r[0]) for r in clean}
    assert set(left[0]) == everyone - {str(k) for k in toxic}
    assert set(left[1]) == set(left[0]) - {"5003", "5004"}
    # copies of 1, 2 and 301 go, with or without an id; the other text of id 3 is a document of its own, once
    assert left[1].count("3") == 3 and left[2] == sorted([*(set(left[1]) - {"5001", "5002", "None", "301"}), "3"])
    pieces_ = corpus_pipeline.run(spark, str(tmp_path))
    assert {str(r.doc_id) for r in pieces_.select("doc_id").distinct().collect()} == set(left[2])
    assert pieces_.columns == [c.split()[0] for c in packing.PIECES.split(", ")]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0), str(tmp_path)).count() == 0


def test_toxicity_model_is_sent_without_its_vectors():
    vectors = [((0, 0.6), (1, 0.8)), ((1, 1.0),)]
    model = toxicity.Model({"=a": 0, "=b": 1}, np.ones(2), vectors, np.array([1.0, 0.0]), np.array([0.0, 1.0]), [7, 8], 0.1)
    sent = pickle.loads(pickle.dumps(model))
    assert sent.vectors == [] and model.vectors == vectors
    assert sent.vote(vectors[0]) == model.vote(vectors[0]) is not None and sent.start({0: 1}) == model.start({0: 1})


def test_texts_are_read_as_by_the_plain_way():
    """Words by the pattern, numbers and picked terms by Terms; the index holds no more than its entries and drops the packed words."""
    texts = [None, "", "Abc abc, x1y2_z Ünder ǅ É²½ ٣a İstanbul", "plain WORDS only\n\x1fend", "".join(map(chr, range(0x2000, 0x2100))) + "straße A" * 3, "stra\u0301ße ab\x85cd"]
    words = {w: k for k, w in enumerate(["abc", "x", "straße", "plain", "ünder", "end"])}
    terms = toxicity.Terms({"<str": 0, ">der": 1, "=abc": 2, "<wor": 3})
    reader = toxicity.Reader(terms, words)
    for text in texts * 2:
        want = Counter(toxicity.LETTERS.findall((text or "").lower()))
        assert toxicity.word_counts(text) == want
        assert reader.read(text) == (toxicity.packed(*toxicity.word_numbers(want, words)), toxicity.packed(*toxicity.ascending(terms.among(want))))
    packed = [toxicity.packed(np.array(t, np.int32), np.ones(len(t), np.int32)) for t in ([0, 1], [1, 2], [3])]
    model = toxicity.Model({}, np.ones(0), [], np.zeros(0), np.zeros(0), [], 0.1, word_idf=np.ones(4), texts=packed, marks=np.array([1.0, 0, 0]), rows=np.array([5, 6, 7]))
    empty = toxicity.packed(np.zeros(0, np.int32), np.zeros(0, np.int32))
    sent = pickle.loads(pickle.dumps(model))
    assert [bytes(t) for t in sent.texts] == packed and sent.of(packed[0], empty) == model.of(packed[0], empty)
    model = pickle.loads(pickle.dumps(sent))  # with its index
    assert model.of(packed[1], empty)[1] == [6]
    assert model.of(packed[0], empty) == (pytest.approx((1 + 0.1 * 0.1) / 1.1), [5]) and model.texts == []
    assert model.word_index.largest.dtype == np.uint16 and model.word_index.where.dtype == np.uint16 and model.of(packed[2], empty)[1] == [7]


def test_disk_is_freed(spark, tmp_path):
    from lectern.llm.common import cut_lineage, run_folder

    shuffled = lambda: {
        f for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f
    }
    before = shuffled()
    counts = cut_lineage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().repartition(3, "k"))
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.2)
    assert not shuffled() - before and counts.count() == 7
    docs, labels = toxic_corpus(spark)
    spark.createDataFrame([(k, t) for k, t, *_ in docs], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    old = set(os.listdir(run_folder(spark)))
    left = corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    tables = [spark.read.parquet(f"{run_folder(spark)}/{f}").columns for f in set(os.listdir(run_folder(spark))) - old]
    assert sum("c1" in t for t in tables) == 1 and not any("picked" in t for t in tables)  # the texts that are kept, once
    assert left.columns == ["doc_id", "text"] and 0 < left.count() < len(docs)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(queries.SQL[name])
    columns = [d[0] for d in cur.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    plain = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert plain(got.select(*columns).collect()) == plain(cur.fetchall())


def test_rules_name_known_measures(spark):
    have = set(quality.measures(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).columns)
    assert {r.measure for r in (*quality.RULES, *quality.BASE_RULES)} <= have
