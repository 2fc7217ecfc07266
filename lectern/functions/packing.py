"""Splitting one document into passages.

Every expression works on the row of one document, so splitting needs no shuffle.  The
greedy packers fold over the *lengths* of the parts and only record where a passage starts;
text is put together once, at the end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern import fixed_values as V
from lectern.config import DEFAULT, EngineConfig
from lectern.functions.text import col, let, strip, strip_chars, stripped_pieces, words

SENTENCE_END = r"(?U)(?<=[.!?])\s+"
_MARK = "\u0001"
_NO_STRINGS = "array<string>"


def _passage(section: Column, markdown: Column) -> Column:
    return F.struct(section.alias("section"), markdown.alias("markdown"))


def _piecewise(parts: Column, starts: Column, separator: Column) -> Column:
    """Join ``parts`` between consecutive (1-based) start positions."""

    def one(start: Column, i: Column) -> Column:
        end = F.coalesce(F.get(starts, i + 1), F.size(parts) + 1)
        return F.call_function("array_join", F.slice(parts, start, end - start), separator)

    return F.transform(starts, one)


def pack(parts: Column, separator: str | Column, limit: int) -> Column:
    """Join neighbouring parts while the joined text stays within ``limit`` characters.

    A part that is longer than the limit by itself is kept whole.
    """
    separator = F.lit(separator) if isinstance(separator, str) else separator
    gap = F.length(separator)

    def step(acc: Column, size: Column) -> Column:
        grown = acc["size"] + gap + size
        opens = (acc["pos"] == 0) | (grown > limit)
        return F.struct(
            (acc["pos"] + 1).alias("pos"),
            F.when(opens, size).otherwise(grown).alias("size"),
            F.when(opens, F.concat(acc["starts"], F.array(acc["pos"] + 1))).otherwise(acc["starts"]).alias("starts"),
        )

    zero = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("size"), F.array().cast("array<int>").alias("starts"))
    return let(
        parts,
        lambda p: let(
            F.aggregate(F.transform(p, F.length), zero, step, lambda acc: acc["starts"]),
            lambda starts: _piecewise(p, starts, separator),
        ),
    )


def split_text(text: Column, cfg: EngineConfig = DEFAULT) -> Column:
    """Paragraphs, else lines, else sentences, else words, packed to the passage size."""
    limit = cfg.chunk_chars

    def cut(separator: str, parts: Column) -> Column:
        return F.struct(F.lit(separator).alias("separator"), parts.alias("parts"))

    def first_that_splits(t: Column, levels: list[tuple[str, str]]) -> Column:
        if not levels:
            return cut(" ", words(t))
        (pattern, separator), deeper = levels[0], levels[1:]
        return let(
            stripped_pieces(t, pattern),
            lambda found: F.when(F.size(found) > 1, cut(separator, found)).otherwise(first_that_splits(t, deeper)),
        )

    levels = [("\n\n", "\n\n"), ("\n", "\n"), (SENTENCE_END, " ")]
    return let(
        text,
        lambda t: F.when(F.length(t) <= limit, F.array(t)).otherwise(
            let(first_that_splits(t, levels), lambda c: pack(c["parts"], c["separator"], limit))
        ),
    )


def heading_sections(markdown: Column | str, keep_preamble: bool = False) -> Column:
    """Sections that start at a level 2-4 heading; page markers do not start one.

    Text before the first heading is dropped unless ``keep_preamble`` is set.
    """
    # possessive \s++ so that the page-marker test looks at the first character of the title
    heading = r"#{2,4}\s++"
    start = rf"(?dmU)^({heading}(?!(?iu:{V.PAGE_MARKER_PATTERN})).+)$"

    def section(piece: Column) -> Column:
        title = strip(F.regexp_extract(piece, rf"(?dU)\A{heading}(.+)", 1))
        return _passage(title, strip(piece))

    def build(pieces: Column) -> Column:
        found = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), section)
        if not keep_preamble:
            return found
        preamble = F.array(_passage(F.lit("General"), strip(F.get(pieces, F.lit(0)))))
        return F.concat(F.filter(preamble, lambda p: p["markdown"] != ""), found)

    return let(F.split(F.regexp_replace(col(markdown), start, _MARK + "$1"), _MARK), build)


def paragraph_passages(text: Column | str, cfg: EngineConfig = DEFAULT) -> Column:
    """Paragraph packing in which a passage starts with the last words of the one before."""
    limit, overlap, cpt = cfg.chunk_tokens, cfg.overlap_words, cfg.chars_per_token

    def step(acc: Column, para: Column) -> Column:
        cur = acc["cur"]
        full = (cur != "") & (F.floor((F.length(cur) + F.length(para)) / cpt) > limit)

        def carried(ws: Column) -> Column:
            tail = F.when(F.size(ws) > overlap, F.array_join(F.slice(ws, F.lit(-overlap), F.lit(overlap)), " "))
            return F.concat(F.coalesce(tail, F.lit("")), F.lit("\n\n"), para)

        grown = F.when(cur == "", para).otherwise(F.concat(cur, F.lit("\n\n"), para))
        return F.struct(
            F.when(full, let(words(cur), carried)).otherwise(grown).alias("cur"),
            F.when(full, F.concat(acc["done"], F.array(strip(cur)))).otherwise(acc["done"]).alias("done"),
        )

    def finish(acc: Column) -> Column:
        tail = F.filter(F.array(strip(acc["cur"])), lambda t: t != "")
        return F.transform(F.concat(acc["done"], tail), lambda t: _passage(F.lit("General"), t))

    zero = F.struct(F.lit("").alias("cur"), F.array().cast(_NO_STRINGS).alias("done"))
    return F.aggregate(stripped_pieces(text, "\n\n"), zero, step, finish)


def split_long_section(text: Column, cfg: EngineConfig = DEFAULT) -> Column:
    """Pack the paragraphs of an oversize section; an oversize paragraph is split by itself."""
    limit = cfg.chunk_chars

    def step(acc: Column, size: Column) -> Column:
        # kind 0 = nothing open, 1 = a packed run is open; an oversize paragraph closes it
        big = size > limit
        opens = big | (acc["open"] == 0) | (acc["size"] + 2 + size > limit)
        return F.struct(
            (acc["pos"] + 1).alias("pos"),
            F.when(big, F.lit(0)).otherwise(F.lit(1)).alias("open"),
            F.when(opens, size).otherwise(acc["size"] + 2 + size).alias("size"),
            F.when(opens, F.concat(acc["starts"], F.array(acc["pos"] + 1))).otherwise(acc["starts"]).alias("starts"),
        )

    zero = F.struct(
        F.lit(0).alias("pos"), F.lit(0).alias("open"), F.lit(0).alias("size"),
        F.array().cast("array<int>").alias("starts"),
    )

    def packed(paras: Column) -> Column:
        starts = F.aggregate(F.transform(paras, F.length), zero, step, lambda acc: acc["starts"])
        runs = let(starts, lambda s: _piecewise(paras, s, F.lit("\n\n")))
        # only a lone oversize paragraph can exceed the limit
        return F.flatten(F.transform(runs, lambda r: split_text(r, cfg)))

    whole = F.floor(F.length(text) / cfg.chars_per_token) <= cfg.chunk_tokens
    return F.when(whole, F.array(text)).otherwise(let(stripped_pieces(text, "\n\n"), packed))


def flat_passages(markdown: Column | str, cfg: EngineConfig = DEFAULT) -> Column:
    """Heading sections (long ones split) or, without headings, overlapping paragraphs."""

    def from_sections(sections: Column) -> Column:
        def cut(s: Column) -> Column:
            return F.transform(split_long_section(s["markdown"], cfg), lambda t: _passage(s["section"], t))

        return F.when(F.size(sections) > 0, F.flatten(F.transform(sections, cut))).otherwise(
            paragraph_passages(markdown, cfg)
        )

    return let(heading_sections(markdown), from_sections)


def parent_passages(markdown: Column | str, cfg: EngineConfig = DEFAULT) -> Column:
    """Large passages (sections, the oversize ones cut to at most the parent size)."""

    def cut(s: Column) -> Column:
        pieces = F.when(
            F.length(s["markdown"]) > cfg.parent_chars,
            pack(split_text(s["markdown"], cfg), "\n\n", cfg.parent_chars),
        ).otherwise(F.array(s["markdown"]))
        return F.transform(pieces, lambda t: _passage(s["section"], t))

    sections = let(
        heading_sections(markdown),
        lambda found: F.when(F.size(found) > 0, found).otherwise(paragraph_passages(markdown, cfg)),
    )
    return F.flatten(F.transform(sections, cut))


def child_passages(parents: Column, cfg: EngineConfig = DEFAULT) -> Column:
    """Small passages of all parents in document order, the too short ones dropped."""

    def pieces(text: Column) -> Column:
        again = F.flatten(
            F.transform(
                split_text(text, cfg),
                lambda p: F.when(F.length(p) > cfg.child_chars, split_text(p, cfg)).otherwise(F.array(p)),
            )
        )
        kept = F.when(F.length(text) <= cfg.child_chars, F.array(text)).otherwise(again)
        return F.filter(kept, lambda p: F.length(p) >= cfg.min_chunk_chars)

    def of_parent(parent: Column, i: Column) -> Column:
        return F.transform(
            pieces(parent["markdown"]),
            lambda p: F.struct(i.alias("parent_index"), parent["section"].alias("section"), p.alias("markdown")),
        )

    return F.flatten(F.transform(parents, of_parent))


def graph_sections(text: Column | str, cfg: EngineConfig = DEFAULT) -> Column:
    """Level 2-3 sections without their heading line; the preamble is called ``Document``."""
    # the two line ends around a heading belong to it, so headings on adjacent lines do not both split
    parts = F.split(
        F.regexp_replace(F.concat(F.lit("\n"), col(text)), r"(?dU)\n(#{2,3}\s+.+?)\n", f"{_MARK}$1{_MARK}"), _MARK
    )

    def is_heading(part: Column) -> Column:
        return F.rlike(part, F.lit(r"(?U)\A#{2,3}\s+"))

    def build(found: Column) -> Column:
        def section(part: Column, i: Column) -> Column:
            # headings and texts take turns, so the title of a text is the part before it
            title = F.coalesce(F.get(found, i - 1), F.lit("Document"))
            body = F.when(is_heading(part), F.lit("")).otherwise(strip(part))
            return _passage(strip(strip_chars(title, "#")), body)

        return F.transform(found, section)

    return F.filter(let(parts, build), lambda s: F.length(s["markdown"]) > cfg.graph_section_min_chars)
