"""Quality rules: a table of thresholds compiled into one projection, without user functions.

Measures are expressions on the words and lines of a whole text; a rule names a measure and the
range it must lie in; the verdict is the conjunction.  Nothing is shuffled.

Null and empty texts have no words and fail the length rule.  Repeated rows are judged one by
one, rows without a document id like any other.  Input columns whose names clash with those made
here are left out of the result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import only

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

#: Frequent function words of the languages of the corpus (fixed values).
STOP_WORDS = {
    "en": "the of and to in a is that it for on was with be as by this are at an from or not have had but which you his her",
    "de": "der die das und in zu den von mit ist des im für auf nicht ein eine als auch es an dem sich er sie aus bei",
    "fr": "de la le les et des un une en du que qui dans est pour au sur pas par avec il elle ne ce se son sont plus",
    "es": "de la que el en y los del se las por un para con no una su al lo es como más o pero sus le ha",
}


@dataclass(frozen=True)
class Rule:
    """A document passes if ``low <= measure <= high``; a bound that is None doesn't count."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The base rules come with the contract of the query; the others are the method's.
BASE_RULES = (
    Rule("enough_words", "n_words", low=50),
    Rule("few_repeated_words", "repeat_word_percent", high=50),
)
RULES = (
    Rule("few_symbols", "symbols_per_word", high=0.1),
    Rule("usual_word_length", "chars_per_word", low=2, high=12),
    Rule("some_stop_words", "stop_word_share", low=0.005),
    Rule("few_repeated_lines", "dup_line_share", high=0.5),
    Rule("not_one_word_lines", "words_per_line", low=2),
)


def compile_rules(rules: Sequence[Rule]) -> Column:
    """The conjunction of ``rules`` over columns that bear the names of the measures."""
    tests = [F.col(r.measure) >= r.low for r in rules if r.low is not None] + [F.col(r.measure) <= r.high for r in rules if r.high is not None]
    return reduce(Column.__and__, tests, F.lit(True))


def failed_rules(rules: Sequence[Rule]) -> Column:
    """Names of the rules that a row breaks."""
    return F.array_compact(F.array(*[F.when(~compile_rules([r]), F.lit(r.name)) for r in rules]))


def _repeated(words: str) -> dict[str, Column]:
    """Steps that end in the number of words lying in a three-word window that occurs at least twice.

    Windows are sorted with their places; one that equals a neighbour is repeated.  Of each
    repeated window, the words up to the next repeated one count.
    """
    windows = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.struct(F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i")),
    )
    same = lambda x, other: F.coalesce(x["w"] == other["w"], F.lit(False))
    starts = F.sort_array(F.array_compact(F.transform("_sorted", lambda x, k: F.when(same(x, F.get("_sorted", k - 1)) | same(x, F.get("_sorted", k + 1)), x["i"]))))
    covered = F.aggregate(
        F.transform("_starts", lambda s, k: F.least(F.lit(3), F.coalesce(F.get("_starts", k + 1) - s, F.lit(3)))), F.lit(0), lambda a, x: a + x
    )
    return {"_sorted": F.sort_array(windows), "_starts": starts, "n_repeat_words": covered.cast("long")}


def measures(docs: DataFrame, keep: Sequence[str] = ("doc_id",), column: str = "text") -> DataFrame:
    """``keep`` and the measures of each row's text."""
    text, share = F.col("_text"), lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    stop = sorted({w for words in STOP_WORDS.values() for w in words.split()})
    df = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(column, F.lit("")).alias("_text"))
    trimmed = F.btrim(text, F.lit(SPACES))
    df = df.withColumn("_words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")))
    df = df.withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    df = df.select(
        *keep, "_words",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(stop))).cast("long").alias("n_stop_words"),
    )
    for name, step in _repeated("_words").items():
        df = df.withColumn(name, step)
    return df.drop("_words", "_sorted", "_starts").select(
        "*",
        share("n_symbols", "n_words").alias("symbols_per_word"),
        share("word_chars", "n_words").alias("chars_per_word"),
        share("n_stop_words", "n_words").alias("stop_word_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_words", "n_lines").alias("words_per_line"),
        (100 * share("n_repeat_words", "n_words")).alias("repeat_word_percent"),
    )


def judged(docs: DataFrame, rules: Sequence[Rule] = RULES, keep: Sequence[str] = ("doc_id",), column: str = "text") -> DataFrame:
    """The measures with ``base_failed``, ``kept`` and the names of the broken rules."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measures(docs, keep, column).select(
        "*", base.alias("base_failed"), (~base & compile_rules(rules)).alias("kept"), failed_rules([*BASE_RULES, *rules]).alias("broken"),
    )


def kept_rows(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``docs`` (text and any other columns) that pass all rules.

    The optimiser would push the filter below the measures and write each of them out wherever
    the verdict uses it; a row number in the same projection keeps the filter above.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]  # numbered meanwhile, so no name can clash
    rows = judged(docs.toDF(*names), rules, names, names[docs.columns.index("text")])
    numbered = rows.select(*names, "kept", F.monotonically_increasing_id().alias("row"))
    return numbered.filter(F.col("kept") & (F.col("row") >= 0)).select(*names).toDF(*docs.columns)


def quality_rows(docs: DataFrame) -> DataFrame:
    """The registered query: counts, verdicts and broken rules of every document."""
    return judged(only(docs, doc_id="doc_id", text="text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
    )


def quality_sql() -> str:
    """The same by DuckDB, counting windows instead of sorting them."""
    stop = ", ".join("'" + w + "'" for w in sorted({w for words in STOP_WORDS.values() for w in words.split()}))
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents
), win AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS c
  FROM d, unnest(range(1, len(w) - 1)) AS u(i)
), rep AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM win, unnest([0, 1, 2]) AS v(k) WHERE c > 1 GROUP BY rid
), m AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words, len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop
  FROM d LEFT JOIN rep USING (rid)
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_symbols / n_words <= 0.1 AND word_chars / n_words BETWEEN 2 AND 12 AND n_stop / n_words >= 0.005
    AND n_dup_lines / n_lines <= 0.5 AND n_words / n_lines >= 2 AS kept
FROM b"""
