"""Quality rules: a threshold table compiled into one projection.

Each rule is a row of :data:`RULES`: a ratio, its bounds, and the number of words from which it applies.
``quality`` turns the table into a single boolean expression beside the measures themselves, so a plan holds
one scan and one projection, with no shuffle and no user function.

Defined cases: a null or empty text, or one of white space only, has no words; its measures are 0 and it is
rejected (fewer than ten words). Repeated rows and ids are judged row by row. An empty table gives an empty
result. Columns of the input other than id and text are ignored. Very long texts are measured whole.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.llm.common import table

SPACE = " \t\n\x0b\f\r"
#: Frequent function words of the corpus languages.
STOP_WORDS = (
    "the of and to in a is that for it was on are with as be at by this from "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als "
    "le la les un une en que qui dans pour sur pas est avec "
    "el los las del y se por con para es lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """``measure`` must lie in [low, high] in texts of ``min_words`` words or more; a missing bound is open."""

    measure: str
    low: float | None = None
    high: float | None = None
    min_words: int = 1


#: The threshold table.
RULES = (
    Rule("n_words", low=10, min_words=0),
    Rule("mean_word_chars", low=2, high=14),
    Rule("symbol_ratio", high=0.1),
    Rule("stop_ratio", low=0.02, min_words=100),
    Rule("dup_line_ratio", high=0.5),
    Rule("repeat_ratio", high=0.2),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for use in ``body``; a plain reference could be computed again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more in the text.

    Windows are compared by a 64-bit hash. Texts whose windows all differ stop at the first comparison; in
    the others, sorting (hash, place) puts equal windows side by side, and the places of those, sorted, each
    add the words up to the next place, five at most.
    """
    n = F.size(words)
    windows = F.transform(
        F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(5)))
    )

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return _let(pairs, lambda s: _let(_repeated(s), _stretch))

    def _repeated(s: Column) -> Column:
        size = F.size(s)
        none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
        zipped = F.arrays_zip(
            s.alias("s"),
            F.concat(none, F.slice(s, 1, size - 1)).alias("p"),
            F.concat(F.slice(s, 2, size - 1), none).alias("q"),
        )
        kept = F.filter(
            zipped,
            lambda z: z["s"]["h"].eqNullSafe(z["p"]["h"]) | z["s"]["h"].eqNullSafe(z["q"]["h"]),
        )
        return F.sort_array(F.transform(kept, lambda z: z["s"]["i"]))

    def _stretch(places: Column) -> Column:
        following = F.concat(F.slice(places, 2, F.size(places)), F.array(F.lit(None).cast("int")))
        steps = F.zip_with(places, following, lambda a, b: F.least(F.coalesce(b - a, F.lit(5)), F.lit(5)))
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    return F.when(n < 6, F.lit(0)).otherwise(
        _let(
            windows,
            lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)),
        )
    )


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and ratios of each text; all arrays live within a row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\x09-\\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0)
    stops = F.filter(
        F.col("words"),
        lambda w: F.btrim(F.lower(w), F.lit(".,;:!?#*$%&|<>\"'()")).isin(*STOP_WORDS),
    )
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), words.alias("words"), lines.alias("lines"))
    counted = base.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        _covered(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size(stops).cast("long").alias("n_stop_words"),
    )
    some = F.greatest(F.col("n_words"), F.lit(1))
    return counted.select(
        "*",
        (F.col("word_chars") / some).alias("mean_word_chars"),
        (F.col("n_symbols") / some).alias("symbol_ratio"),
        (F.col("n_stop_words") / some).alias("stop_ratio"),
        (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("dup_line_ratio"),
        (F.col("n_repeat_words") / some).alias("repeat_ratio"),
    )


def compile_rules(rules: Sequence[Rule] = RULES) -> Column:
    """One boolean: no rule of the table is broken."""
    kept = F.lit(True)
    for r in rules:
        inside = F.lit(True)
        if r.low is not None:
            inside = inside & (F.col(r.measure) >= F.lit(r.low))
        if r.high is not None:
            inside = inside & (F.col(r.measure) <= F.lit(r.high))
        kept = kept & ((F.col("n_words") < F.lit(r.min_words)) | inside)
    return kept


def quality(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures of each row, ``base_failed`` and the verdict ``kept``."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measures(docs, id_col, text_col).select(
        "*", failed.alias("base_failed"), (~failed & compile_rules(rules)).alias("kept")
    )


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``docs`` whose text passes, columns unchanged.

    A filter on ``kept`` alone would be pushed below the projections, each of its measures written out again
    wherever a rule names it; the row number, which the optimizer does not move, keeps it above them.
    """
    cols = docs.columns
    judged = quality(docs.select(F.struct(*cols).alias("row"), "text"), rules, id_col="row")
    held = judged.select(F.col("doc_id").alias("row"), "kept", F.monotonically_increasing_id().alias("place"))
    return held.filter(F.col("kept") & (F.col("place") >= 0)).select(*(F.col(f"row.{c}").alias(c) for c in cols))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
g AS (
  SELECT rid, i, list_aggregate(words[i:i+4], 'string_agg', ' ') AS gram
  FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM d)),
rep AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g),
st AS (
  SELECT rid, sum(least(5, coalesce(nxt - i, 5))) AS n_repeat_words
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM rep WHERE n > 1) GROUP BY rid),
ln AS (
  SELECT rid, count(*) AS n_lines, count(DISTINCT line) AS n_distinct
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_lines - n_distinct, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines,
    len(list_filter(words, lambda w: list_contains([{_STOPS}],
        regexp_replace(lower(w), '^[.,;:!?#*$%&|<>"''()]+|[.,;:!?#*$%&|<>"''()]+$', '', 'g')))) AS n_stop
  FROM d LEFT JOIN st USING (rid) LEFT JOIN ln USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars >= 2 * n_words AND word_chars <= 14 * n_words AND 10 * n_symbols <= n_words
    AND (n_words < 100 OR 50 * n_stop >= n_words) AND 2 * n_dup_lines <= n_lines AS kept
FROM b
"""
