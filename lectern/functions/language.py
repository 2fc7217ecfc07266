"""Offline language tag: the language whose frequent words occur most often in the snippet."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import col, let

# Frequent function words; the order of languages decides ties.
FREQUENT_WORDS = {
    "ca": ("els", "les", "amb", "dels", "és", "aquest", "aquesta", "pel", "seva", "als"),
    "es": ("el", "los", "las", "del", "que", "una", "con", "para", "por", "como"),
    "en": ("the", "of", "and", "to", "is", "that", "with", "for", "was", "by"),
    "fr": ("le", "les", "des", "et", "que", "une", "dans", "pour", "qui", "avec"),
    "de": ("der", "die", "das", "und", "ist", "nicht", "ein", "mit", "den", "auf"),
    "it": ("il", "di", "che", "è", "della", "per", "sono", "gli", "con", "nel"),
    "pt": ("o", "os", "do", "da", "que", "não", "uma", "com", "em", "ao"),
}


def _one_of(words: tuple[str, ...]):
    return lambda token: token.isin(*words)


def detect_language(text: Column | str, limit: int = 500) -> Column:
    """Tag the first ``limit`` characters; ``unknown`` when no frequent word occurs."""
    tokens = F.regexp_extract_all(F.lower(F.left(col(text), F.lit(limit))), F.lit(r"\p{L}+"), F.lit(0))

    def best(found: Column) -> Column:
        scores = F.array(
            *[
                F.struct(
                    F.size(F.filter(found, _one_of(ws))).alias("hits"),
                    F.lit(-i).alias("order"),
                    F.lit(lang).alias("lang"),
                )
                for i, (lang, ws) in enumerate(FREQUENT_WORDS.items())
            ]
        )
        return let(F.array_max(scores), lambda top: F.when(top["hits"] > 0, top["lang"]))

    # never NULL, which saves a test for NULL from tagging the text a second time
    return F.coalesce(let(tokens, best), F.lit("unknown"))
