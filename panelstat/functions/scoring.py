"""Scoring expressions (X8-X10, E3-E5). Pure column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelstat.functions import _c
from panelstat.functions.text import number_from_text

# Fixed pattern: the judge's score is the first signed decimal, else the
# first digit run.
SCORE_RE = r"[-+]?\d*\.\d+|\d+"
NUMBER_RE = r"-?\d+(?:\.\d+)?"


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def parse_score(col) -> Column:
    """Judge text -> score in [0, 1]; null when no number is present."""
    m = F.regexp_extract(_c(col), SCORE_RE, 0)
    return F.when(m != "", clamp01(m.try_cast("double")))


def first_number(col) -> Column:
    """First number in free text, thousands commas removed."""
    s = F.regexp_replace(_c(col), r"(\d),(\d)", "$1$2")
    m = F.regexp_extract(s, NUMBER_RE, 0)
    return F.when(m != "", m.try_cast("double"))


def truth_number(col) -> Column:
    """Ground truth written as a number (commas, currency, percent allowed)."""
    return number_from_text(col)


def numeric_score(predicted, truth) -> Column:
    """1 - |p - t| / max(|t|, 1), clamped to [0, 1]."""
    p, t = _c(predicted), _c(truth)
    return clamp01(F.lit(1.0) - F.abs(p - t) / F.greatest(F.abs(t), F.lit(1.0)))


def tokens(col) -> Column:
    """Distinct lower-case word tokens (letters and digits)."""
    s = F.lower(F.regexp_replace(_c(col), r"[^\p{L}\p{N}]+", " "))
    return F.array_distinct(F.filter(F.split(F.trim(s), " "), lambda x: x != ""))


def text_score(response, truth) -> Column:
    """Normalised equality -> 1.0, else token-set Jaccard (E5 stand-in for a
    semantic judge)."""
    a, b = tokens(response), tokens(truth)
    inter = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - inter
    same = F.array_join(F.array_sort(a), " ") == F.array_join(F.array_sort(b), " ")
    return F.when(same, F.lit(1.0)).otherwise(F.try_divide(inter.cast("double"), F.when(union > 0, union)))


# --------------------------------------------------------------------------- equal meaning (E5)

# What unit words multiply a number by. A percentage is its number.
UNITS = {"thousand": 1e3, "k": 1e3, "lakh": 1e5, "lakhs": 1e5, "lac": 1e5, "lacs": 1e5, "million": 1e6, "mn": 1e6,
         "crore": 1e7, "crores": 1e7, "cr": 1e7, "billion": 1e9, "bn": 1e9}
# Abbreviations and other words that stand for the same.
ABBREVIATIONS = {"wpr": "worker population ratio", "lfpr": "labour force participation rate", "ur": "unemployment rate",
                 "up": "uttar pradesh", "ap": "andhra pradesh", "mp": "madhya pradesh", "hp": "himachal pradesh",
                 "tn": "tamil nadu", "wb": "west bengal", "jk": "jammu kashmir", "uts": "union territories",
                 "labor": "labour", "women": "female", "men": "male", "females": "female", "males": "male", "salaried": "regular"}
STOP_WORDS = ["the", "a", "an", "of", "in", "is", "and", "per", "state"]
_NUMBER = r"(-?\d[\d,]*(?:\.\d+)?)"
_UNIT = r"\s*-?(" + "|".join(sorted(UNITS, key=len, reverse=True)) + r")?\b"
# Which number of a text is meant: the first with a currency, with a unit, as a percentage, that is no year, any.
QUANTITY_RES = [r"(?i)(?:₹|\brs\.?|\binr)\s*" + _NUMBER + _UNIT,
                r"(?i)" + _NUMBER + r"\s*-?(" + "|".join(sorted(UNITS, key=len, reverse=True)) + r")\b",
                r"(?i)" + _NUMBER + r"()\s*(?:%|per\s?cent\b)",
                r"(?<![\d.,–-])(?!(?:19|20)\d\d(?![\d.,]\d))" + _NUMBER + r"()",
                _NUMBER + r"()"]


def quantity(col) -> Column:
    """The number that a text states, with currencies, thousands commas and unit
    words ("2.1 lakh") resolved; null without one."""
    c = _c(col)
    out = F.lit(None).cast("double")
    for pattern in reversed(QUANTITY_RES):
        digits, unit = F.regexp_extract(c, pattern, 1), F.lower(F.regexp_extract(c, pattern, 2))
        factor = F.lit(1.0)
        for word, times in UNITS.items():
            factor = F.when(unit == word, F.lit(times)).otherwise(factor)
        value = F.regexp_replace(digits, ",", "").try_cast("double") * factor
        out = F.when(digits != "", value).otherwise(out)
    return out


def meaning_tokens(col) -> Column:
    """Distinct tokens with abbreviations written out and common words left out."""
    named = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    words = F.flatten(F.transform(tokens(col), lambda t: F.split(F.coalesce(F.element_at(named, t), t), " ")))
    return F.array_distinct(F.filter(words, lambda t: ~t.isin(*STOP_WORDS)))


def token_likeness(a: Column, b: Column) -> Column:
    """1 less edits by length, from 0.75 on; else 0: plurals and misspellings count, other words do not."""
    like = F.lit(1.0) - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
    return F.when(like >= 0.75, like).otherwise(F.lit(0.0))


def aligned_score(response_tokens: Column, weighted_truth: Column) -> Column:
    """Share of the truth's token weight (array of structs t, w) that the response's
    most alike tokens cover; null for a truth without tokens."""
    covered = F.aggregate(weighted_truth, F.lit(0.0), lambda acc, x: acc + x["w"] * F.coalesce(
        F.array_max(F.transform(response_tokens, lambda r: token_likeness(r, x["t"]))), F.lit(0.0)))
    total = F.aggregate(weighted_truth, F.lit(0.0), lambda acc, x: acc + x["w"])
    return F.try_divide(covered, F.when(total > 0, total))
