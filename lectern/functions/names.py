"""Folder names, identifiers, paths and names mentioned in questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern import fixed_values as V
from lectern.functions.text import col, let, strip


def is_designation(folder: Column | str) -> Column:
    folder = col(folder)
    return F.startswith(folder, F.lit("DOP_")) | F.startswith(folder, F.lit("IGP_"))


def gi_type(folder: Column | str, otherwise: str = "knowledge") -> Column:
    folder = col(folder)
    return F.when(is_designation(folder), F.left(folder, F.lit(3))).otherwise(F.lit(otherwise))


def gi_name(folder: Column | str) -> Column:
    folder = col(folder)
    return F.when(is_designation(folder), F.substr(folder, F.lit(5))).otherwise(folder)


def display_name(folder: Column | str) -> Column:
    name = gi_name(folder)
    slashed = F.replace(name, F.lit("__"), F.lit(" / "))
    return F.replace(
        F.when(is_designation(folder), slashed).otherwise(name), F.lit("_"), F.lit(" ")
    )


def folder_info(folder: Column | str) -> Column:
    return F.struct(
        gi_type(folder).alias("gi_type"),
        gi_name(folder).alias("gi_name"),
        display_name(folder).alias("display_name"),
        is_designation(folder).alias("is_gi"),
    )


def chunk_id(country: Column, folder: Column, pdf: Column, index: Column) -> Column:
    return F.concat_ws("__", country, folder, pdf, index.cast("string"))


def parent_id(country: Column, folder: Column, pdf: Column, index: Column) -> Column:
    return F.concat_ws("__", country, folder, pdf, F.concat(F.lit("parent_"), index.cast("string")))


def parse_parent_id(pid: Column | str) -> Column:
    """Struct (country, folder, pdf), or NULL unless the id has four parts."""
    return let(
        F.split(col(pid), "__", 4),
        lambda p: F.when(
            F.size(p) == 4,
            F.struct(F.get(p, F.lit(0)).alias("country"), F.get(p, F.lit(1)).alias("folder"), F.get(p, F.lit(2)).alias("pdf")),
        ),
    )


def categorize(rel_path: Column | str) -> Column:
    """Category, sub-category and folder of a path below the knowledge root."""

    def build(parents: Column) -> Column:
        category = F.coalesce(F.get(parents, F.lit(0)), F.lit("general"))
        return F.struct(
            category.alias("category"),
            F.coalesce(F.get(parents, F.lit(1)), F.lit("")).alias("subcategory"),
            F.when(F.size(parents) > 0, F.array_join(parents, "/")).otherwise(category).alias("folder"),
        )

    parts = F.filter(F.split(col(rel_path), "/"), lambda p: (p != "") & (p != "."))
    return let(let(parts, lambda p: F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0)))), build)


def file_stem(name: Column | str) -> Column:
    return F.regexp_replace(col(name), r"\.[^.]*$", "")


def explicit_mentions(question: Column | str) -> Column:
    """Names that follow DOP / IGP, cut to their leading capitalised run, joined by ``_``."""
    raw = F.regexp_extract_all(col(question), F.lit(V.MENTION_PATTERN), F.lit(1))

    def leading_run(match: Column) -> Column:
        def step(acc: Column, word: Column) -> Column:
            upper = F.rlike(word, F.lit(r"^\p{Lu}"))
            first = F.size(acc["kept"]) == 0
            fits = upper | (~first & F.lower(word).isin(*V.NAME_CONNECTORS))
            return F.when(
                acc["open"] & fits,
                F.struct(F.concat(acc["kept"], F.array(word)).alias("kept"), F.lit(True).alias("open")),
            ).otherwise(F.struct(acc["kept"].alias("kept"), F.lit(False).alias("open")))

        start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(True).alias("open"))
        parts = F.filter(F.split(strip(match), r"(?U)\s+"), lambda w: w != "")
        return F.aggregate(parts, start, step, lambda acc: F.array_join(acc["kept"], "_"))

    return F.array_distinct(F.filter(F.transform(raw, leading_run), lambda n: n != ""))


def entity_mentions(question: Column | str) -> Column:
    """Capitalised runs (kept with repetitions), then single capitalised words not yet listed."""
    question = col(question)

    def listed(names: Column) -> Column:
        return F.filter(names, lambda n: (F.length(n) > 2) & ~F.lower(n).isin(*V.ENTITY_STOP_WORDS))

    runs = listed(F.regexp_extract_all(question, F.lit(V.ENTITY_RUN_PATTERN), F.lit(1)))
    singles = listed(F.regexp_extract_all(question, F.lit(V.ENTITY_WORD_PATTERN), F.lit(1)))
    return let(runs, lambda r: F.concat(r, F.array_except(singles, r)))


def query_words(question: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(col(question), F.lit(V.KEYWORD_PATTERN), F.lit(0)), F.lower)


def query_keywords(
    question: Column | str,
    names: Column,
    stop_words: tuple[str, ...] = (),
    bilingual: dict[str, str] | None = None,
) -> Column:
    """Distinct search keywords of a question, with the names taken out and translations added."""
    lowered = F.transform(names, lambda n: F.replace(F.lower(n), F.lit("_"), F.lit(" ")))

    def pick(lowered_names: Column) -> Column:
        def wanted(word: Column) -> Column:
            overlaps = F.exists(lowered_names, lambda n: F.contains(n, word) | F.contains(word, n))
            return (~word.isin(*stop_words) if stop_words else F.lit(True)) & ~overlaps

        return F.filter(query_words(question), wanted)

    kept = let(lowered, pick)
    if not bilingual:
        return F.array_distinct(kept)
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in bilingual.items()])

    def expand(words: Column) -> Column:
        def related(word: Column) -> Column:
            hits = F.filter(pairs, lambda p: F.startswith(p["a"], word) | F.startswith(word, p["a"]))
            return F.flatten(F.transform(hits, lambda p: F.array(p["a"], p["b"])))

        return F.array_distinct(F.concat(words, F.flatten(F.transform(words, related))))

    return let(kept, expand)
