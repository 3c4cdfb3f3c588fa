"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import column, unused_prefix

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: Frequent function words of the languages served. Fixed values.
STOP_WORDS = (
    "a and are as at be by for from in is it of on or that the this to was with "
    "das dem den der des die ein eine für ist mit nicht und von zu sich auf "
    "au aux ce dans de des du elle en est et la le les pour que qui un une "
    "al con del el es la las lo los no para por se su una y"
)


@dataclass(frozen=True)
class Rule:
    """Keeps a document when low <= measure <= high (either bound may be open)."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The verdict's thresholds. Measures are the columns of ``measures``.
RULES = (
    Rule("mean_word_chars", "mean_word_chars", 2.0, 20.0),
    Rule("symbol_ratio", "symbol_ratio", None, 0.10),
    Rule("stop_word_ratio", "stop_word_ratio", 0.005, None),
    Rule("dup_line_ratio", "dup_line_ratio", None, 0.50),
    Rule("letter_ratio", "letter_ratio", 0.30, None),
    Rule("bang_ratio", "bang_ratio", None, 0.50),
)


def _count(text: Column, chars: str) -> Column:
    kept = text
    for c in chars:
        kept = F.replace(kept, F.lit(c), F.lit(""))
    return F.octet_length(text) - F.octet_length(kept)


def repeated_window_words(words: Column) -> Column:
    """Positions inside some 3-word window that occurs twice or more.

    Windows are compared by a 64-bit hash of their words: (hash, position) pairs are sorted and equal
    neighbours mark positions. Work is n log n in the words of a text.
    """
    n = F.size(words)
    at = F.sequence(F.lit(0), n - 3)
    key = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    return F.when(n < 4, F.lit(0)).otherwise(
        _covered(F.sort_array(F.transform(at, lambda i: F.struct(key(i).alias("h"), i.alias("i")))))
    )


def _covered(pairs: Column) -> Column:
    def marked(pairs: Column) -> Column:
        twice = F.filter(
            pairs,
            lambda p, k: (F.get(pairs, k - 1)["h"] == p["h"]) | (F.get(pairs, k + 1)["h"] == p["h"]),
        )
        spots = F.flatten(F.transform(twice, lambda p: F.array(p["i"], p["i"] + 1, p["i"] + 2)))
        return F.size(F.array_distinct(spots))

    return F.element_at(F.transform(F.array(pairs), marked), 1)


def measures(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Adds the base counts and ratios as columns, null text counting as empty; no user function, no shuffle."""
    t = F.coalesce(F.col(text), F.lit(""))
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]+", ""))
    stop = list(dict.fromkeys(f(w) for w in STOP_WORDS.split() for f in (str.lower, str.capitalize, str.upper)))
    bare = docs.withColumns({f"{prefix}_words": F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), f"{prefix}_lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))})
    words, lines = F.col(f"{prefix}_words"), F.col(f"{prefix}_lines")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    counted = bare.withColumns(
        {
            f"{prefix}n_words": F.size(words).cast("long"),
            f"{prefix}word_chars": F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("long"),
            f"{prefix}n_symbols": _count(t, SYMBOLS).cast("long"),
            f"{prefix}n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            f"{prefix}n_repeat_words": repeated_window_words(words).cast("long"),
            f"{prefix}n_stop": F.size(F.filter(words, lambda w: w.isin(stop))).cast("long"),
            f"{prefix}n_letters": letters.cast("long"),
            f"{prefix}n_bangs": _count(t, "!").cast("long"),
            f"{prefix}n_lines": F.size(lines).cast("long"),
        }
    )
    col = lambda c: F.col(prefix + c)
    return counted.withColumns(
        {
            f"{prefix}mean_word_chars": ratio(col("word_chars"), col("n_words")),
            f"{prefix}symbol_ratio": ratio(col("n_symbols"), col("word_chars")),
            f"{prefix}stop_word_ratio": ratio(col("n_stop"), col("n_words")),
            f"{prefix}dup_line_ratio": ratio(col("n_dup_lines"), col("n_lines")),
            f"{prefix}letter_ratio": ratio(col("n_letters"), col("word_chars")),
            f"{prefix}bang_ratio": ratio(col("n_bangs"), col("n_words")),
        }
    ).drop(f"{prefix}_words", f"{prefix}_lines")


MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_failed(prefix: str = "") -> Column:
    n, repeat = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n)


def verdict(rules: Sequence[Rule] = RULES, prefix: str = "") -> Column:
    """The table as one boolean column."""
    kept = F.lit(True)
    for rule in rules:
        if rule.low is not None:
            kept = kept & (F.col(prefix + rule.measure) >= F.lit(rule.low))
        if rule.high is not None:
            kept = kept & (F.col(prefix + rule.measure) <= F.lit(rule.high))
    return kept


def failed_rules(rules: Sequence[Rule] = RULES, prefix: str = "") -> Column:
    """Names of the rules a document breaks, in table order."""
    return F.array_compact(F.array(*[F.when(~verdict([r], prefix), F.lit(r.name)) for r in rules]))


def apply_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", prefix: str = "") -> DataFrame:
    """All columns of docs plus the measures, ``base_failed`` and ``kept`` under a prefix.

    A null or empty text has zero counts and fails the base. Extra columns pass through; a prefix keeps added
    names apart from columns that are there already (else the added ones replace them). Rows are independent,
    so ties, copies and an empty table need nothing special.
    """
    out = measures(docs, text, prefix).withColumn(f"{prefix}base_failed", base_failed(prefix))
    return out.withColumn(f"{prefix}kept", ~F.col(f"{prefix}base_failed") & verdict(rules, prefix))


def keep_documents(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """The documents that pass, with their own columns only.

    The verdict feeds a generator that gives one row or none: a filter on it would be pushed below the projection,
    where every reference to a measure is worked out anew. A null or empty text goes; equal rows stay or go together;
    an empty table gives an empty result; columns may have any names.
    """
    prefix = unused_prefix(docs.columns, "_rule_")
    out = apply_rules(docs, rules, text, prefix=prefix)
    once = F.when(F.col(f"{prefix}kept"), F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>"))
    own = [column(c) for c in docs.columns]
    return out.select(*own, F.explode(once).alias(f"{prefix}once")).select(*own)
