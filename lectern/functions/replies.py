"""Reading what a language model answered: triples, judge verdicts and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern import fixed_values as V
from lectern.functions.text import col, let, strip

TRIPLES = (
    "array<struct<subject:string,subject_type:string,predicate:string,"
    "object:string,object_type:string,attrs:map<string,string>>>"
)
TRIPLE = TRIPLES[len("array<"):-1]


def _strict(text: Column) -> Column:
    """Triples of a text that is a valid JSON list as a whole, otherwise NULL; items that are no objects are passed over."""
    # from_json wraps a lone object into an array and tolerates trailing text, so the text is
    # checked as JSON first
    valid = F.try_parse_json(text).isNotNull() & F.startswith(F.ltrim(text), F.lit("["))
    items = F.filter(F.from_json(text, "array<string>"), lambda i: F.startswith(F.ltrim(i), F.lit("{")))
    triples = F.transform(items, lambda i: F.from_json(i, TRIPLE, {"allowNonNumericNumbers": "false"}))
    return F.when(valid, F.filter(triples, lambda t: t.isNotNull()))


def parse_triples(raw: Column | str) -> Column:
    """Array of triples: as written, else repaired, else line by line, else empty."""
    body = F.regexp_replace(F.regexp_replace(strip(raw), r"(?U)\A```(?:json)?\s*", ""), r"(?U)\s*```\z", "")
    empty = F.from_json(F.lit("[]"), TRIPLES)

    def mend(text: Column, comma: str = V.REPLY_TRAILING_COMMA) -> Column:
        mended = F.regexp_replace(F.regexp_replace(text, comma, "$1"), V.REPLY_BARE_KEY, '$1"$2":')
        return F.regexp_replace(mended, V.REPLY_NOT_A_VALUE, ': ""')

    def line_objects(text: Column) -> Column:
        lines = F.filter(
            F.transform(F.split(text, "\n"), strip),
            lambda s: F.startswith(s, F.lit("{")) & F.endswith(s, F.lit("}")),
        )
        objects = F.transform(lines, lambda s: let(mend(s, V.REPLY_TRAILING_COMMA_OF_LINE), lambda m: F.when(F.try_parse_json(m).isNotNull(), F.from_json(m, TRIPLE))))
        return F.filter(objects, lambda o: o.isNotNull())

    def parse(text: Column) -> Column:
        found = F.regexp_extract(text, r"(?s)\[.*\]", 0)

        def attempts(array_text: Column) -> Column:
            control = F.regexp_replace(mend(array_text), V.REPLY_CONTROL, "")
            return F.when(array_text == "", empty).otherwise(
                F.coalesce(
                    _strict(array_text),
                    let(control, _strict),
                    line_objects(text),
                    empty,
                )
            )

        return let(found, attempts)

    return F.coalesce(let(body, parse), empty)


def unfenced(raw: Column | str) -> Column:
    """The text between an opening and the last closing code fence, or the text itself."""
    text = strip(raw)
    opened = F.regexp_replace(text, r"(?d)\A```[^\n]*\n", "")
    inner = F.regexp_replace(F.regexp_replace(opened, r"(?s)```(?!.*```).*\z", ""), r"\A```\z", "")
    return F.when(F.startswith(text, F.lit("```")), inner).otherwise(text)


def _json_items(raw: Column | str) -> Column:
    """Items of a JSON list as text, NULL when the reply is no valid JSON list."""
    def items(text: Column) -> Column:
        return F.when(
            F.try_parse_json(text).isNotNull() & F.startswith(strip(text), F.lit("[")),
            F.from_json(text, "array<string>"),
        )

    return let(unfenced(raw), items)


def supported_ratio(raw: Column | str) -> Column:
    """Share of list items whose verdict is SUPPORTED; 0 for anything that is no filled list."""
    def ratio(items: Column) -> Column:
        good = F.filter(items, lambda i: F.get_json_object(i, "$.verdict") == "SUPPORTED")
        return F.when(F.size(items) > 0, F.size(good) / F.size(items))

    return F.coalesce(let(_json_items(raw), ratio), F.lit(0.0))


def passage_score(raw: Column | str) -> Column:
    """Mean of (score - 1) / 2 over the numeric scores of a list; 0 when there is none."""
    def number(item: Column) -> Column:
        # a quoted score is text, not a number
        return F.when(
            F.startswith(strip(item), F.lit("{")) & ~F.rlike(item, F.lit(r'"score"\s*:\s*"')),
            F.get_json_object(item, "$.score").try_cast("double"),
        )

    def mean(scores: Column) -> Column:
        total = F.aggregate(scores, F.lit(0.0), lambda acc, v: acc + (v - 1) / 2)
        return F.when(F.size(scores) > 0, total / F.size(scores))

    values = F.filter(F.transform(_json_items(raw), number), lambda v: v.isNotNull())
    return F.coalesce(let(values, mean), F.lit(0.0))


def scale_score(raw: Column | str, low: int = 1, high: int = 5) -> Column:
    """First stand-alone digit between ``low`` and ``high``, NULL when there is none."""
    return F.regexp_extract(col(raw), rf"(?<!\d)([{low}-{high}])(?!\d)", 1).try_cast("int")


def scale_fraction(raw: Column | str) -> Column:
    return F.coalesce((scale_score(raw) - 1) / F.lit(4.0), F.lit(0.0))
