"""Quality rules: a table of thresholds compiled into one projection, with no user functions.

Measures of a text: words (``common.WORD``), characters in words, symbols, repeated lines, words within
repeated 8-word windows, stop words, lines that begin as list items or end in an ellipsis. A null text has
no words and fails; repeated rows are judged row by row; an empty table gives an empty result; columns
beside the two named ones are ignored. Windows are compared by 64-bit hashes of their words' hashes.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, let

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"
#: Frequent words of four languages, lower case.
STOP_WORDS = (
    "the of and to in is that it for was on with as be by at this from are or an "
    "der die das und ist nicht ein eine zu den von mit dem des im auf für sich es auch "
    "de la que el en los del las por con para una su al lo como más y "
    "le les et des du est un une pour dans qui ce il au sur pas par"
).split()


class Rule(NamedTuple):
    """A document with ``least_words`` words or more fails if ``measure`` is not within ``low`` and ``high``."""

    measure: str
    low: float | None
    high: float | None
    least_words: int = 0


RULES = (
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbols_per_word", None, 0.1),
    Rule("stop_word_share", 0.02, None, 50),
    Rule("dup_line_share", None, 0.5),
    Rule("list_line_share", None, 0.9, 50),
    Rule("ellipsis_line_share", None, 0.3),
)


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK))


def _repeated(words: Column, width: int) -> Column:
    """Words that lie in a window of ``width`` words found twice or more."""

    def covered(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = let(ordered, lambda s: F.filter(F.transform(s, lambda e, j: F.when(F.coalesce(F.get(s, j - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == e["h"], F.lit(False)), e["i"])), lambda x: x.isNotNull()))
        own = let(F.sort_array(again), lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(width), F.coalesce(F.get(p, j + 1) - x, F.lit(width)))), F.lit(0), lambda a, b: a + b))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(own)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(hashes, lambda h: F.transform(F.slice(h, 1, F.size(h) - (width - 1)), lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, width)))))
    return F.when(F.size(words) < 2 * 1 + width - 1, F.lit(0)).otherwise(let(windows, covered))


def _lines(text: Column) -> Column:
    kept = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    return let(
        kept,
        lambda x: F.struct(
            F.size(x).alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(x, lambda y: F.btrim(y, F.lit(BLANKS)).rlike(r"^[-*•]"))).alias("n_list_lines"),
            F.size(F.filter(x, lambda y: F.rtrim(y).endswith("...") | F.rtrim(y).endswith("…"))).alias("n_ellipsis_lines"),
        ),
    )


def quality_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 8, stop_words=tuple(STOP_WORDS)) -> DataFrame:
    """One row per document with its counts and shares."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    by_words = let(
        _words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.size(F.filter(w, lambda x: x.isin(*stop_words))).cast("long").alias("n_stop_words"),
            _repeated(w, width).cast("long").alias("n_repeat_words"),
        ),
    )
    found = docs.select(F.col(id_col), by_words.alias("w"), _lines(text).alias("l"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"))
    words, lines = F.greatest(F.col("w.n_words"), F.lit(1)), F.greatest(F.col("l.n_lines"), F.lit(1))
    return found.select(
        id_col, "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words",
        (F.col("w.word_chars") / words).alias("mean_word_chars"),
        (F.col("n_symbols") / words).alias("symbols_per_word"),
        (F.col("w.n_stop_words") / words).alias("stop_word_share"),
        (F.col("l.n_dup_lines") / lines).alias("dup_line_share"),
        (F.col("l.n_list_lines") / lines).alias("list_line_share"),
        (F.col("l.n_ellipsis_lines") / lines).alias("ellipsis_line_share"),
    )


def quality_rules(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measures, ``base_failed`` (under 20 words, or over 30 % of words in repeated windows) and ``kept``."""
    passed = F.lit(True)
    for r in rules:
        x = F.col(r.measure)
        ok = (x >= r.low if r.low is not None else F.lit(True)) & (x <= r.high if r.high is not None else F.lit(True))
        passed &= ok | (F.col("n_words") < r.least_words)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return quality_measures(docs, id_col, text_col).withColumn("base_failed", failed).withColumn("kept", ~failed & passed)
