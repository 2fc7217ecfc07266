"""Rules, files, packing, pieces, languages and pages: brute force, round trips, and odd rows."""

import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import html_text, id_blocks, id_files, language, packing, pieces, quality
from lectern.llm.common import file_path
from lectern.llm.encoder import Encoder

WORDS = re.compile("[^ \t-\r]+")
SCHEMA = "doc_id long, text string, lang string, n_words long, score double, node string, row long"
LINE = "the cat of the house and the dog in a garden with an old tree is here"
TEXTS = {
    1: "", 2: None, 3: " \n\t ", 4: LINE, 5: "\n".join(f"the old{k} garden{k} of my{k} house{k} has new{k} walls{k} and roofs{k}" for k in range(9)), 6: "one two three " * 40, 7: "x" * 30_000,
    8: "a b c\na b c\n\na b c d é # $$ |\x0b\x1cz", 9: " ".join(f"w{k}" for k in range(20_000)), 10: "mañana über été 日本語 \U0001d11e end <|endoftext|> ok",
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", 7, 0.5, "n", 1) for k, t in TEXTS.items()] + [(5, TEXTS[5], None, None, None, None, None), (None, LINE, "de", 0, 0.0, "", 0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_quality_equals_brute_force(spark, docs):
    def base(text):
        words, lines = WORDS.findall(text or ""), [x for x in (text or "").split("\n") if WORDS.search(x)]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        seen = {w: windows.count(w) for w in set(windows)} if len(windows) < 1000 else dict.fromkeys(windows, 1)
        covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed

    rows = quality.quality_rows(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert tuple(r)[1:7] == base(TEXTS[r.doc_id] if r.doc_id else LINE), r
        assert r.kept == (r.doc_id == 5), r
    assert quality.quality_rows(docs.limit(0)).count() == 0
    kept = quality.kept_rows(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [5, 5]
    plan = quality.quality_rows(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    broken = {r.doc_id: r.broken for r in quality.judged(docs.filter("doc_id IN (1, 8)")).collect()}
    assert "enough_words" in broken[1] and "few_symbols" in broken[8]


ids_ = st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=700)


@settings(max_examples=40, deadline=None)
@given(ids_, st.sampled_from([0.5, 0.9, 1.0]), st.integers(0, 700), st.integers(0, 700))
def test_blocks_round_trip(ids, percentile, a, b):
    data = np.array(ids, np.uint32)
    file = id_blocks.IdFile(id_blocks.write_blocks(np.array([4, 9]), np.array([len(ids), 0]), data, percentile, 64))
    assert (file.ids() == data).all() and (file.ids(a, b) == data[a : max(a, b)]).all() and list(file.documents) == [4, 9]


def test_blocks_keep_outliers_apart():
    ids = np.full(256, 1000, np.uint32)
    ids[7] = 4_000_000_000
    few, all_ = (len(id_blocks.write_blocks(np.zeros(1), np.array([256]), ids, p)) for p in (0.9, 1.0))
    assert few < all_ / 5


@pytest.fixture(scope="module")
def library():
    return Encoder(file_path("byte_bpe_50k.json")).tokenizer


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"ab'sté \t\n\x0b\x1c\x85\xa0.,|1!日<\U0001d11e", "<|endoftext|>"]), max_size=20).map("".join), max_size=4))
def test_encoder_equals_library(texts):
    for most in (3, 10**6):
        enc = Encoder(file_path("byte_bpe_50k.json"), most) if most == 3 else _encoder()
        ids, at = enc.encode(texts)
        for k, t in enumerate(texts):
            assert list(ids[at[k] : at[k + 1]]) == enc.tokenizer.encode(t, add_special_tokens=False).ids


def _encoder(kept=[]):  # noqa: B006
    if not kept:
        kept.append(Encoder(file_path("byte_bpe_50k.json")))
    return kept[0]


def test_id_files_equal_library(spark, docs, library, tmp_path):
    rows = id_files.id_file_rows(docs, folder=str(tmp_path / "ids")).collect()
    assert len(rows) == docs.count()
    encode = lambda t: np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
    start = 0
    for r in sorted(rows, key=lambda r: r.start):
        ids = encode(LINE if r.doc_id is None else TEXTS[r.doc_id])
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids)), r
        start += len(ids)
    order = [r.doc_id or 0 for r in sorted(rows, key=lambda r: r.start)]
    assert order == sorted(order)
    assert id_files.id_file_rows(docs.limit(0), folder=str(tmp_path / "none")).count() == 0


def test_packing_covers_every_id_once(spark, docs, library):
    rows = packing.pack_documents(docs).collect()
    encode = lambda t: np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
    by, sequences = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(by) == {*TEXTS, None}
    for doc, got in by.items():
        ids, copies = encode(LINE if doc is None else TEXTS[doc]), 2 if doc == 5 else 1
        assert sum(r.length for r in got) == copies * len(ids)
        for r in got:
            assert r.doc_tokens == len(ids) and zlib.crc32(ids[r.start : r.start + r.length]) == r.ids_crc32
    for got in sequences.values():
        at = 0
        for r in sorted(got, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == got[0].window <= 1024 and at & (at - 1) == 0 and len({r.step_group for r in got}) == 1
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_gaps_of_long_windows_take_short_pieces():
    packer = packing.TierPacker((8, 4, 2))
    for doc, n in enumerate((7, 3, 1, 1, 2, 20)):
        packer.add((doc, 0, np.arange(n, dtype=np.uint32), n))
    windows = packer.windows() + packer.close()
    assert sum(len(p[2]) for _, w in windows for p in w) == 34
    assert all(sum(len(p[2]) for p in w) == size for size, w in windows)
    first = next(w for _, w in windows if w[0][0] == 0)
    assert [p[0] for p in first] == [0, 2]


def best_score(model, part):
    """All segmentations by plain dynamic programming over substrings."""
    known = {t: model.automaton.get(t)[2] for t in model.texts if t}
    best = [0.0] + [float("-inf")] * len(part)
    for end in range(1, len(part) + 1):
        for begin in range(end):
            if part[begin:end] in known:
                best[end] = max(best[end], best[begin] + known[part[begin:end]])
        if best[end] == float("-inf"):
            best[end] = best[end - 1] + model.byte_score * len(part[end - 1].encode())
    return best[-1]


def test_pieces_are_the_best_and_decode_to_the_text(spark, docs):
    model = pieces.pieces(file_path("piece_bpe_32k.model"))
    for text in ("the house", "  two  spaces ", "Donaudampfschiff", "naïve 日本語 \U0001d11e", "tab\tline\n", "aaaaaaaa", "x" * 50, LINE):
        ids, score = model.encode(text)
        assert model.decode(ids) == text
        marked = pieces.MARK + text.replace(" ", pieces.MARK)
        assert score == pytest.approx(sum(best_score(model, p) for p in pieces.PART.findall(marked)))
    rows = {r.doc_id: r for r in pieces.piece_rows(docs).collect()}
    assert len(rows) == len(TEXTS) + 1 and all(r.round_trip for r in rows.values()) and rows[2].n_pieces == rows[1].n_pieces == 0
    back = pieces.decode_ids(pieces.encode_texts(docs.filter("doc_id = 10"))).first()
    assert back.text == TEXTS[10]


def test_language_on_held_out_rows(spark, docs):
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.language_rows(known.withColumn("lang_pred", F.lit("x"))).join(known.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97 and all(0 <= r.score <= 1 for r in rows)
    found = {r.doc_id: r for r in language.language_rows(docs.withColumn("lang", F.when(F.col("doc_id") > 6, "fr").otherwise("en"))).collect()}
    assert len(found) == len(TEXTS) + 1
    assert all(found[k].lang_pred == "und" and found[k].score == 0 for k in (1, 2, 3)) and found[9].lang_pred in ("en", "fr")
    none = language.language_rows(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert language.language_rows(docs.limit(0)).count() == 0


PAGES = [
    ("<html><head><title>T</title><style>p{}</style></head><body><nav><a href=/>Home</a></nav><div class='ad'>Buy now, it is very cheap today</div><article><h1>A &amp; B</h1>"
     "<p>First   text\nhere.<p><b>Second</b> text<br>goes on.</article><footer>(c) nobody</footer></body></html>", "A & B\nFirst text here.\nSecond text goes on."),
    ("<body><header>Site <a href=/>x</a></header><div class=main-wrap><h1>Head</h1><p>Hello world, this is a long line of the text.</p><p>And this is another long line of it.</p></div>"
     "<aside><p>Read more of our other long texts on this page.</p></aside><section id=comments><p>I do not agree with any of this, sorry.</p></section><form><p>Sign up</p></form>",
     "Head\nHello world, this is a long line of the text.\nAnd this is another long line of it."),
    ("<div class=with-sidebar><article><p>One.</p><aside>no</aside><div class='cookie-notice'>We use them.</div><ul><li>a<li>b</ul></article></div>", "One.\na\nb"),
    ("plain &lt;text&gt;", "plain <text>"), ("", ""), (None, ""), ("<p>", ""), ("<script>var t='</p>';", ""), ("<article><p>ok<!-- open", "ok"),
]


def test_pages(spark):
    rows = spark.createDataFrame([(k, "u", h, "x", 3) for k, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string, n_chars int")
    for r in html_text.extract_pages(rows.union(rows)).collect():
        assert r.text == PAGES[r.page_id][1] and r.n_chars == len(r.text)
    assert html_text.extract_pages(rows.limit(0)).count() == 0


@pytest.mark.parametrize("wrapper", ["class='content with-sidebar'", "class=overflow-hidden", "class='widget Blog'", "id=search-result-text", "role=search"])
def test_names_of_wrappers_drop_no_main_text(wrapper):
    page = f"<body><div class=menu><a href=/>Home</a></div><div {wrapper}><p>Hello world, this is a long line of the text.</p><div class=sidebar><p>Aside.</p></div><p>And this is another long line of it.</p></div>"
    assert html_text.main_text(page) == "Hello world, this is a long line of the text.\nAnd this is another long line of it."


@pytest.mark.parametrize("end", ["<p>", "<div>", ""])
def test_head_ends_without_a_tag(end):
    assert html_text.main_text(f"<!doctype html><head><meta charset=utf-8><title>T</title><style>p{{}}</style>\n{end}All of the text.") == "All of the text."


def test_short_and_linked_parts_of_the_region_stay():
    lengths = (9, 10, 100, 120, 110, 10, 12, 11, 9, 10)
    text = [("word%d " % k * 30)[:n].strip() for k, n in enumerate(lengths)]
    text.insert(4, "<a href=/>a source of this text</a>")
    menu = "".join(f"<li><a href=/{k}>Item {k}</a>" for k in range(5))
    page = f"<body><ul>{menu}</ul><div class=text>{''.join(f'<p>{t}</p>' for t in text)}</div><div><a href=/>One</a> <a href=/>Two</a> <a href=/>Three</a></div>"
    assert html_text.main_text(page).split("\n") == [re.sub("<[^>]*>", "", t) for t in text]


def test_smoothing_keeps_a_constant():
    assert html_text.smoothed([2.0] * 7) == pytest.approx([2.0] * 7)
