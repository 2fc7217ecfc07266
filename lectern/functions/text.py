"""General text expressions and document cleaning."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern import fixed_values as V


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``.

    Lambdas are not covered by common-subexpression elimination, so an expression that is
    mentioned inside one would be computed again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column | str) -> Column:
    """Remove Unicode whitespace at both ends."""
    # one parameter only: Spark's transform() would pass an element index as a second one
    return F.btrim(col(c), F.lit(V.WHITESPACE))


def strip_chars(c: Column | str, chars: str) -> Column:
    return F.btrim(col(c), F.lit(chars))


def words(c: Column | str) -> Column:
    """Whitespace-separated words; empty array for blank text."""
    pieces = F.split(strip(c), r"(?U)\s+")
    return F.filter(pieces, lambda w: w != "")


def stripped_pieces(c: Column | str, pattern: str) -> Column:
    """Split on a regular expression, strip each piece and drop the blank ones."""
    return F.filter(F.transform(F.split(col(c), pattern), strip), lambda p: p != "")


def contains_any(c: Column, needles: Iterable[str]) -> Column:
    needles = list(needles)
    if len(needles) > 8:
        # one pattern: a long chain of tests would outgrow the limit for generated code
        return F.rlike(c, F.lit("|".join(re.escape(n) for n in needles)))
    found = F.lit(False)
    for needle in needles:
        found = found | F.contains(c, F.lit(needle))
    return found


def count_occurrences(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of a non-empty string."""
    removed = F.length(text) - F.length(F.replace(text, needle, F.lit("")))
    return (removed / F.length(needle)).cast("int")


def title_case(c: Column | str) -> Column:
    """Upper-case the first letter of every run of letters, lower-case all others."""
    runs = F.regexp_extract_all(F.lower(col(c)), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))

    def capitalised(run: Column) -> Column:
        # a letter whose upper-case form has two letters keeps the second one small
        first = F.upper(F.left(run, F.lit(1)))
        return F.concat(F.left(first, F.lit(1)), F.lower(F.substr(first, F.lit(2))), F.substr(run, F.lit(2)))

    return F.array_join(F.transform(runs, capitalised), "")


def entity_name(c: Column | str) -> Column:
    return F.regexp_replace(title_case(strip(c)), r"(?U)\s+", " ")


def fold_accents(c: Column | str) -> Column:
    return F.translate(F.lower(col(c)), V.ACCENTS_FROM, V.ACCENTS_TO)


def truncate(c: Column | str, size: int, marker: str = "") -> Column:
    c = col(c)
    return F.when(F.length(c) > size, F.concat(F.left(c, F.lit(size)), F.lit(marker))).otherwise(c)


def token_estimate(c: Column | str, chars_per_token: int = 4) -> Column:
    return F.floor(F.length(col(c)) / chars_per_token).cast("int")


def drop_repeated_lines(c: Column | str) -> Column:
    """Drop a line whose stripped form equals that of the line right before it (blank lines stay)."""

    def keep(lines: Column) -> Column:
        def is_new(line: Column, i: Column) -> Column:
            return (i == 0) | (strip(line) == "") | (strip(line) != strip(F.get(lines, i - 1)))

        return F.array_join(F.filter(lines, is_new), "\n")

    return let(F.split(col(c), "\n"), keep)


def clean_markdown(c: Column | str, country: str = V.DEFAULT_COUNTRY, strip_page_headings: bool = False) -> Column:
    """Remove page furniture, boilerplate of the country, repeated lines and extra blank lines."""
    out = col(c)
    patterns = [V.PICTURE_PATTERN, V.PAGE_NUMBER_PATTERN]
    patterns.append(V.PAGE_HEADING_PATTERN_FIXED if strip_page_headings else V.PAGE_HEADING_PATTERN)
    patterns.append(V.PAGE_WORD_PATTERN)
    patterns.extend(V.COUNTRY_HEADER_PATTERNS.get(country, ()))
    for pattern in patterns:
        out = F.regexp_replace(out, pattern, "")
    for literal in V.COUNTRY_HEADER_LITERALS.get(country, ()):
        out = F.replace(out, F.lit(literal), F.lit(""))
    return strip(F.regexp_replace(drop_repeated_lines(out), r"\n{3,}", "\n\n"))


def plain_pages(pages: Column | str) -> Column:
    """Join page texts under one page heading each, as the plain extractor does."""
    return F.array_join(
        F.transform(
            col(pages),
            lambda text, i: F.concat(F.lit("\n\n## Pagina "), (i + 1).cast("string"), F.lit("\n\n"), text),
        ),
        "\n",
    )
