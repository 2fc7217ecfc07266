"""Numbers, units, parameters and wine types found in table cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern import fixed_values as V
from lectern.functions.text import col, contains_any, strip, strip_chars, title_case

_UNIT_BY_PARAMETER = {}
for _hint, _key, _unit in V.PARAMETERS:
    _UNIT_BY_PARAMETER.setdefault(_key, _unit)


def _found(raw: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(raw, pattern, 0), F.lit(""))


def quantity_value(raw: Column | str) -> Column:
    """Comma decimals, then dots before three digits as thousands, then dot decimals, then integers."""
    raw = col(raw)
    return F.coalesce(
        F.replace(_found(raw, r"\d+,\d+"), F.lit(","), F.lit(".")).try_cast("double"),
        F.replace(_found(raw, r"\d+\.\d{3}(?!\d)"), F.lit("."), F.lit("")).try_cast("double"),
        _found(raw, r"\d+\.\d+").try_cast("double"),
        _found(raw, r"\d+").try_cast("double"),
    )


def quantity_relation(raw: Column | str) -> Column:
    low = F.lower(col(raw))
    return F.when(contains_any(low, ("mínim", "minim", "mín")), F.lit("min")).when(
        contains_any(low, ("màxim", "maxim", "máximo", "máx")), F.lit("max")
    )


def quantity_unit(raw: Column | str, strict: bool = False) -> Column:
    """``strict`` recognises mg/l before g/l; otherwise the g/l test also catches mg/l."""
    low = F.lower(col(raw))
    per_area = contains_any(low, ("ha", "hect"))
    unit = F.when(contains_any(low, ("%", "vol")), F.lit("% Vol"))
    if strict:
        unit = unit.when(F.contains(low, F.lit("mg/l")), F.lit("mg/l"))
    return (
        unit.when(contains_any(low, ("g/l", "gr/l", "gramos")), F.lit("g/l"))
        .when(F.contains(low, F.lit("kg/ha")), F.lit("kg/ha"))
        .when(F.contains(low, F.lit("hl/ha")), F.lit("hl/ha"))
        .when(F.contains(low, F.lit("kg")), F.when(per_area, F.lit("kg/ha")).otherwise(F.lit("kg")))
        .when(F.contains(low, F.lit("hl")), F.when(per_area, F.lit("hl/ha")).otherwise(F.lit("hl")))
        .when(contains_any(low, ("g/", "gram", "gr.")), F.lit("g/l"))
    )


def quantity(raw: Column | str, strict: bool = False) -> Column:
    return F.struct(
        quantity_value(raw).alias("value"),
        quantity_unit(raw, strict).alias("unit"),
        quantity_relation(raw).alias("relation"),
    )


def parameter_key(text: Column | str) -> Column:
    low = F.lower(col(text))
    return F.coalesce(*[F.when(F.contains(low, F.lit(h)), F.lit(k)) for h, k, _ in V.PARAMETERS])


def default_unit(key: Column) -> Column:
    return F.coalesce(*[F.when(key == k, F.lit(u)) for k, u in _UNIT_BY_PARAMETER.items()])


def wine_type(text: Column | str) -> Column:
    low = F.lower(col(text))
    named = F.array_compact(
        F.array(*[F.when(contains_any(low, words), F.lit(name)) for name, words in V.WINE_TYPES])
    )
    return F.when(F.size(named) > 0, F.array_join(named, "/")).otherwise(F.lit("general"))


def clean_cell(cell: Column | str) -> Column:
    return strip(strip_chars(strip_chars(strip(cell), "*"), "_"))


def clean_variety(name: Column | str) -> Column:
    bare = strip(name)
    for mark in "*_·-":
        bare = strip_chars(bare, mark)
    return title_case(strip(F.regexp_replace(bare, r"(?U)\s*\([^)]*\)", "")))


def is_variety(name: Column | str, whole_word: bool = False) -> Column:
    """``whole_word`` rejects only whole words; otherwise a reject word may be part of a word."""
    name = col(name)
    low = F.lower(name)
    words = "|".join(V.VARIETY_REJECT_WORDS)
    rejected = F.rlike(low, F.lit(rf"(?U)\b(?:{words})\b" if whole_word else f"(?:{words})"))
    return (
        (F.length(name) >= 2)
        & ~F.rlike(low, F.lit(r"(?U)\A[\d\s.,]+\z"))
        & ~rejected
        & ~F.rlike(name, F.lit("[≥≤<>/%]"))
        & (F.length(F.regexp_replace(low, r"[^\p{L}]", "")) >= 3)
    )
