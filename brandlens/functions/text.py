"""Text functions as column expressions; no user functions.

Word boundaries are ASCII (``\\w`` is [A-Za-z0-9_]) and white space is Unicode, as in browsers' regular expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words, English then Spanish.
STOPWORDS = (
    "the a an and or but if then so of to in on at for with without is are was were be been being it its this that these "
    "those as by from into your you we our us they their he she his her not no yes can will just more most than all any "
    "have has had do does did up out about how what when where which who why get one new "
    "el la los las un una unos unas y o pero si de del al a en para por con sin es son era eran ser estar esta este estos "
    "estas como que su sus tu tus nuestro nuestra ellos ellas no mas todo toda todos todas hay muy"
).split()

# Promotional adjectives.
PROMOTIONAL = (
    "best amazing revolutionary world-class leading innovative seamless powerful effortless incredible cutting-edge "
    "game-changing unmatched ultimate unique next-generation mejor lider líder increible increíble innovador "
    "revolucionario excepcional impresionante"
).split()

# Sentiment and role lexicons.
POSITIVE = (
    "best great excellent recommend recommended top fast simple powerful favorite ideal loved intuitive recomendado mejor "
    "excelente rapido"
).split()
NEGATIVE = (
    "worst avoid outdated slow clunky expensive complicated discontinued bloated buggy peor evitar lento complicado caro "
    "descontinuado"
).split()
COMPARISON = ["vs", "versus", "compared", "compare", "alternative", "instead of", "alternativa", "comparado", "frente a", "en lugar de"]
DISCARD = ["not recommend", "wouldn't recommend", "steer clear", "no recomendar", "no recomiendo", "no recomendaria"]

# Patterns and limits.
TOKEN = "[a-záéíóúñü]+"
BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
NUMBER = r"(?<!\w)\d+(?:[.,]\d+)?%?" + BOUNDARY
COMPARATIVE = r"(?<!\w)(?:vs\.?|versus|compared to|faster than|better than|more than|less than|frente a|comparado con)" + BOUNDARY
DEFINITION = "(?i)" + BOUNDARY + r"(is|are|es|son)(?U:\s)+(a|an|the|el|la|los|las|un|una)" + BOUNDARY
RADIUS = 60
SNIPPET = 240


#: A token of three letters or more.
LONG_TOKEN = TOKEN[:-1] + "{3,}"


def tokenize(text: Column) -> Column:
    """Lower-case letter runs longer than two that are no stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(LONG_TOKEN), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(sorted({w for w in STOPWORDS if len(w) > 2})))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is read there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def counted(items: Column, pair: Callable[[Column, Column], Column] = lambda term, tf: F.struct(term.alias("term"), tf.alias("tf"))) -> Column:
    """The distinct items of an array, in order, as (term, tf) or as what ``pair`` makes of those: sorted once, then cut
    where an item differs from the one before."""
    later = lambda s: F.filter(F.sequence(F.lit(1), F.size(s) - 1), lambda i: F.get(s, i) != F.get(s, i - 1))
    at = lambda s: F.concat(F.array(F.lit(0)), F.when(F.size(s) > 1, later(s)).otherwise(F.array().cast("array<int>")))
    pairs = lambda s, p: F.transform(p, lambda x, j: pair(F.get(s, x), (F.coalesce(F.get(p, j + 1), F.size(s)) - x).cast("long")))
    return let(F.sort_array(items), lambda s: F.when(F.size(s) > 0, let(at(s), lambda p: pairs(s, p))).otherwise(F.slice(pairs(s, F.array(F.lit(0))), 1, 0)))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+")).cast("long")


def split_sentences(text: Column) -> Column:
    """Pieces between white space that follows a full stop, exclamation or question mark."""
    pieces = F.transform(F.split(text, r"(?U)(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    return F.filter(pieces, lambda s: s != "")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def quote(term: Column) -> Column:
    """A term as a literal regular expression."""
    return F.regexp_replace(term, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def has_word(text: Column, term: Column) -> Column:
    return F.regexp_like(text, F.concat(F.lit("(?i)" + BOUNDARY), quote(term), F.lit(BOUNDARY)))


def shorten(text: Column, limit: int = SNIPPET) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)


def context_window(text: Column, index: Column, length: Column, radius: int = RADIUS) -> Column:
    """Text around a match that begins at a 1-based index."""
    begin = F.greatest(F.lit(1), index - radius)
    return F.substring(text, begin, index + length + radius - begin)


def contains_any(lowered: Column, words: Sequence[str]) -> Column:
    """Whether any of the words occurs, inside other words too."""
    out = F.lit(False)
    for w in dict.fromkeys(words):
        out = out | F.contains(lowered, F.lit(w))
    return out


def contains_excluded(text: Column, terms: Sequence[str]) -> Column:
    return contains_any(F.lower(text), [t.lower() for t in terms if t])


def sentiment(context: Column) -> Column:
    low = F.lower(context)
    good, bad = contains_any(low, POSITIVE), contains_any(low, NEGATIVE)
    return F.when(good & ~bad, "positive").when(bad & ~good, "negative").otherwise("neutral")


def role(context: Column, first: Column) -> Column:
    low = F.lower(context)
    return (
        F.when(contains_any(low, DISCARD), "discarded")
        .when(contains_any(low, COMPARISON), "compared")
        .when(first, "recommended_first")
        .otherwise("mentioned")
    )


def numbers(text: Column) -> Column:
    return F.regexp_count(text, F.lit(NUMBER)).cast("long")


def comparatives(text: Column) -> Column:
    return F.regexp_count(text, F.lit("(?i)" + COMPARATIVE)).cast("long")


def promotional(text: Column) -> Column:
    # No word of the list holds another one between bounds, so that one pass counts what one pass a word would.
    every = "|".join(w.replace("-", r"\-") for w in PROMOTIONAL)
    return F.regexp_count(F.lower(text), F.lit(rf"(?<!\w)(?:{every})(?!\w)")).cast("long")


def factual_density(n_numbers: Column, n_comparatives: Column, n_promotional: Column) -> Column:
    facts = n_numbers + n_comparatives
    return F.when(facts + n_promotional > 0, facts / (facts + n_promotional)).otherwise(F.lit(0.0))


def round_half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("long")


def is_long_form(hook: Column, words: int = 6) -> Column:
    return F.size(F.split(collapse(hook), " ")) > words


def strip_code_fence(text: Column) -> Column:
    body = F.regexp_extract(text, r"```(?:json)?\s*([\s\S]*?)```", 1)
    return F.trim(F.when(text.rlike(r"```(?:json)?\s*[\s\S]*?```"), body).otherwise(text))


def score_label(score: Column) -> Column:
    return F.when(score >= 70, "good").when(score >= 40, "needs_work").otherwise("critical")
