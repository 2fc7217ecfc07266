"""Folds against a plain restatement of the splitting rules, on random texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.config import EngineConfig
from lectern.functions import packing
from lectern.operators import passages

CFG = EngineConfig(chunk_tokens=20, overlap_words=5, child_tokens=10, parent_tokens=40, min_chunk_chars=15, graph_section_min_chars=10)
MARKER = re.compile(r"(?i)(pagina?|pàgina?|page|página?)\s+\d+")


def pieces(parts):
    return [p.strip() for p in parts if p.strip()]


def greedy(parts, sep, limit):
    out, cur = [], None
    for p in parts:
        if cur is None:
            cur = p
        elif len(cur) + len(sep) + len(p) > limit:
            out.append(cur)
            cur = p
        else:
            cur += sep + p
    return out + ([cur] if cur is not None else [])


def split(text):
    limit = CFG.chunk_chars
    if len(text) <= limit:
        return [text]
    for parts, sep in ((pieces(text.split("\n\n")), "\n\n"), (pieces(text.split("\n")), "\n"), (pieces(re.split(r"(?<=[.!?])\s+", text)), " ")):
        if len(parts) > 1:
            return greedy(parts, sep, limit)
    return greedy(text.split(), " ", limit)


def headings(md):
    found = [(m.start(), m.group(1).strip()) for m in re.finditer(r"^#{2,4}\s+(.+)$", md, re.M) if not MARKER.match(m.group(1).strip())]
    ends = [s for s, _ in found[1:]] + [len(md)]
    return [(h, md[s:e].strip()) for (s, h), e in zip(found, ends)]


def paragraphs(text):
    out, cur = [], ""
    for p in pieces(text.split("\n\n")):
        if cur and (len(cur) + len(p)) // 4 > CFG.chunk_tokens:
            out.append(cur.strip())
            ws = cur.split()
            cur = " ".join(ws[-CFG.overlap_words:] if len(ws) > CFG.overlap_words else []) + "\n\n" + p
        else:
            cur = cur + "\n\n" + p if cur else p
    return [("General", t) for t in out + ([cur.strip()] if cur.strip() else [])]


def long_section(text):
    if len(text) // 4 <= CFG.chunk_tokens:
        return [text]
    out, run = [], []
    for p in pieces(text.split("\n\n")):
        if len(p) > CFG.chunk_chars:
            out += greedy(run, "\n\n", CFG.chunk_chars) + split(p)
            run = []
        else:
            run.append(p)
    return out + greedy(run, "\n\n", CFG.chunk_chars)


def parents(md):
    out = []
    for section, text in headings(md) or paragraphs(md):
        cut = greedy(split(text), "\n\n", CFG.parent_chars) if len(text) > CFG.parent_chars else [text]
        out += [(section, t) for t in cut]
    return out


def children(ps):
    out = []
    for i, (section, text) in enumerate(ps):
        cut = [text] if len(text) <= CFG.child_chars else [q for p in split(text) for q in (split(p) if len(p) > CFG.child_chars else [p])]
        out += [(i, section, t) for t in cut if len(t) >= CFG.min_chunk_chars]
    return out


def graph_parts(text):
    out, heading = [], "Document"
    for part in re.split(r"\n(#{2,3}\s+.+?)\n", "\n" + text):
        if re.match(r"^#{2,3}\s+", part):
            heading = part.strip("#").strip()
        elif len(part.strip()) > CFG.graph_section_min_chars:
            out.append((heading, part.strip()))
    return out


def random_text(rng):
    out = []
    for _ in range(rng.randint(0, 25)):
        words = [rng.choice(["a", "vi", "terra", "garnatxa", "é", "sòl,", "fi.", "Ah!", "x" * 30]) for _ in range(rng.randint(1, 25))]
        line = " ".join(words)
        if rng.random() < 0.25:
            line = rng.choice(["## ", "### ", "#### ", "##### ", "# ", "## Pagina ", "### Página "]) + rng.choice(["A b", "3", "12 x", "C"])
        out.append(line + rng.choice(["\n", "\n\n", "\n\n\n", " \n", " "]))
    return "".join(out)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    return [random_text(rng) for _ in range(400)]


@pytest.fixture(scope="module")
def split_rows(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(8)
    t = F.col("t")
    out = df.select(
        "i", packing.split_text(t, CFG).alias("split"), packing.heading_sections(t).alias("headings"),
        packing.paragraph_passages(t, CFG).alias("paragraphs"), packing.split_long_section(t, CFG).alias("long"),
        packing.graph_sections(t, CFG).alias("graph"), packing.flat_passages(t, CFG).alias("flat"), packing.parent_passages(t, CFG).alias("parents"),
    ).withColumn("children", packing.child_passages(F.col("parents"), CFG))
    return {r.i: r for r in out.collect()}


def test_splitters(texts, split_rows):
    for i, t in enumerate(texts):
        r = split_rows[i]
        assert r.split == split(t)
        assert [tuple(x) for x in r.headings] == headings(t)
        assert [tuple(x) for x in r.paragraphs] == paragraphs(t)
        assert r.long == long_section(t)
        assert [tuple(x) for x in r.graph] == graph_parts(t)


def test_parents_and_children(texts, split_rows):
    for i, t in enumerate(texts):
        r = split_rows[i]
        assert [tuple(x) for x in r.parents] == parents(t)
        assert [tuple(x) for x in r.children] == children(parents(t))
        flat = [(h, p) for h, x in headings(t) for p in long_section(x)] if headings(t) else paragraphs(t)
        assert [tuple(x) for x in r.flat] == flat


def test_default_sizes(spark):
    md = "## Gran\n" + "paraula " * 400 + "\n## Altra\n" + "frase curta. " * 50
    docs = spark.createDataFrame([("Espanya", "DOP_Rioja", "r", md)], "country string, folder string, source_file string, markdown string")
    split_docs = passages.with_passages(passages.with_document_metadata(docs)).cache()
    ps = passages.parents_table(split_docs).collect()
    records = passages.chunk_records(split_docs).collect()
    assert len(ps) == 2 and {p.parent_id for p in ps} == {f"Espanya__DOP_Rioja__r__parent_{i}" for i in (0, 1)}
    assert len({r.chunk_id for r in records}) == len(records)
    assert {r.parent_id for r in records} == {p.parent_id for p in ps}
    assert all(len(r.markdown) <= 3200 for r in records if r.chunk_id != r.parent_id)
    assert {(r.gi_type, r.gi_name, r.language) for r in records} == {("DOP", "Rioja", "unknown")}
