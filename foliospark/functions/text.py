"""Reusable column expressions over text. All native; nothing here runs Python on executors."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters that count as white space beside the ASCII ones.
SPACES = "[\\s\\u00A0\\u1680\\u2000-\\u200B\\u202F\\u205F\\u3000\\uFEFF]+"
PARTICLES = "van den|van der|van de|van het|van|de la|de los|de las|de le|von der|von|del|della|de|der|den|di|da|dos|du|bin|binti"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_of(c: Column | str) -> Column:
    """The text, empty where null."""
    return F.coalesce(col(c), F.lit(""))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def staged(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns that later steps refer to by name.

    They are made by a generator, through which neither projections nor filters are merged; long chains of derived
    columns would otherwise be written out again in every place that uses them.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def squeeze(c: Column | str) -> Column:
    """White space of any kind as single spaces, none at the ends. ASCII texts that have nothing but single spaces, which is soon seen, are left as they are."""
    s = text_of(c)
    clean = (F.octet_length(s) == F.length(s)) & ~s.rlike("[\\t-\\r]|  ")
    return F.trim(F.when(clean, s).otherwise(F.regexp_replace(s, SPACES, " ")))


def word_count(c: Column | str) -> Column:
    return let(squeeze(c), lambda s: F.when(s == "", F.lit(0)).otherwise(F.size(F.split(s, " "))))


def first_match(c: Column | str, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null where there is none or the group is empty."""
    return F.nullif(F.regexp_extract(text_of(c), pattern, group), F.lit(""))


def any_word(words: list[str]) -> str:
    """A pattern for any of some words that shares their beginnings, so that at most places one look is enough."""
    if "" in words:
        return ""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[0], []).append(w[1:])
    each = [re.escape(c) + any_word(rest) for c, rest in sorted(by.items())]
    return f"(?:{'|'.join(each)})" if len(each) > 1 else each[0]


def doublings(n: Column) -> Column:
    """1, 2, 4, ... below n, as an array; empty for n of at most 1."""
    return F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda p: p < n)


def scan(items: Column, combine) -> Column:
    """Inclusive running values of an array under an associative ``combine(before, own)``, null elements kept out.

    Each round combines every element with the running value one, two, four, ... places before it: n log n steps, where a fold that appends to
    an array copies all that it has made at each step.
    """
    step = lambda have, p: F.transform(have, lambda x, k: F.when(k < p, x).otherwise(combine(F.get(have, k - p), x)))
    return let(items, lambda x: F.aggregate(doublings(F.size(x)), x, step))


def find_all(c: Column | str, pattern: str) -> Column:
    """All matches of a pattern, in order, as array<struct<raw, position>>; positions count from 0.

    A split on the pattern gives the gaps between matches; running sums of the lengths of gaps and matches (``scan``) are the places where matches end.
    """
    c = text_of(c)
    parts = F.struct(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)).alias("found"), F.split(c, pattern, -1).alias("gaps"))

    def placed(p: Column) -> Column:
        steps = F.transform(p["found"], lambda m, k: F.length(m) + F.coalesce(F.length(F.get(p["gaps"], k)), F.lit(0)))
        at = lambda m, end: F.struct(m.alias("raw"), (end - F.length(m)).cast("int").alias("position"))
        return F.zip_with(p["found"], scan(steps, lambda a, b: a + b), at)

    return let(parts, placed)


def joined_runs(items: Column, apart: Column, between: str = " ") -> Column:
    """Neighbouring strings as one, with ``between``, but where ``apart`` (a flag for each string) has it start anew; strings hold no line break."""
    pieces = F.zip_with(items, apart, lambda x, a: F.struct(x.alias("x"), a.alias("a")))
    text = F.array_join(F.transform(pieces, lambda p, k: F.concat(F.when(k == 0, F.lit("")).when(p["a"], F.lit("\n")).otherwise(F.lit(between)), p["x"])), "")
    return F.when(F.size(items) > 0, F.split(text, "\n")).otherwise(F.array().cast("array<string>"))


def js_round(c: Column, digits: int = 0) -> Column:
    """Half up towards positive infinity."""
    k = 10**digits
    return F.floor(c * k + 0.5) / k if digits else F.floor(c + 0.5)


def normalize_title(c: Column | str) -> Column:
    """Letters, digits and single spaces, in lower case."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text_of(c)), "[^\\p{L}\\p{N}\\s]", ""), "\\s+", " "))


def _bigrams(s: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, F.lit(2)))


def dice_bigram(a: Column | str, b: Column | str) -> Column:
    """Dice similarity of character bigrams with multiplicity, of normalised titles.

    Equal 1; an empty side, or a side under three characters, 0. Bigrams both sides have count as often as the rarer
    side has them: the size of one list minus what is left of it after the other is taken away.
    """
    times = lambda grams, g: F.size(F.filter(grams, lambda h: h == g))
    shared = lambda x, y: F.aggregate(F.array_intersect(x, y), F.lit(0), lambda n, g: n + F.least(times(x, g), times(y, g)))

    def score(p: Column) -> Column:
        x, y = p["x"], p["y"]
        return (
            F.when((x == "") | (y == ""), F.lit(0.0))
            .when(x == y, F.lit(1.0))
            .when((F.length(x) < 3) | (F.length(y) < 3), F.lit(0.0))
            .otherwise(let(F.struct(_bigrams(x).alias("x"), _bigrams(y).alias("y")), lambda g: 2.0 * shared(g["x"], g["y"])) / (F.length(x) + F.length(y) - 2))
        )

    return let(F.struct(normalize_title(a).alias("x"), normalize_title(b).alias("y")), score)


def normalize_doi(c: Column | str) -> Column:
    s = F.regexp_replace(F.lower(F.trim(col(c))), "^https?://(dx\\.)?doi\\.org/", "")
    return F.nullif(F.regexp_replace(s, "/$", ""), F.lit(""))


def normalize_issn(c: Column | str) -> Column:
    s = F.regexp_replace(F.upper(F.trim(col(c))), "[^0-9X]", "")
    return F.when(F.length(s) == 8, F.concat(F.substring(s, 1, 4), F.lit("-"), F.substring(s, 5, 4)))


def normalize_isbn(c: Column | str) -> Column:
    return F.nullif(F.regexp_replace(col(c), "[^0-9Xx]", ""), F.lit(""))


def surname(c: Column | str) -> Column:
    """What stands before the comma, else the last word without dots, in lower case."""
    s = F.trim(text_of(c))
    last = F.regexp_replace(F.element_at(F.split(s, "\\s+"), -1), "[.,]", "")
    return F.lower(F.when(s.contains(","), F.trim(F.substring_index(s, ",", 1))).otherwise(last))


def leading_int(c: Column | str) -> Column:
    """The integer a string starts with, null for none and for 0."""
    return F.nullif(first_match(c, "^\\s*(\\d{1,9})").cast("int"), F.lit(0))


def compare_author(a: Column | str, b: Column | str) -> Column:
    score = lambda p: F.when((p["x"] == "") | (p["y"] == ""), F.lit(0.0)).when(p["x"] == p["y"], F.lit(1.0)).otherwise(dice_bigram(p["x"], p["y"]))
    return let(F.struct(surname(a).alias("x"), surname(b).alias("y")), score)


def compare_year(a: Column | str, b: Column | str) -> Column:
    """1 for equal years, .5 for neighbours, else 0; 0 where one is unknown."""
    x, y = leading_int(a), leading_int(b)
    return F.coalesce(F.when(x == y, F.lit(1.0)).when(F.abs(x - y) == 1, F.lit(0.5)), F.lit(0.0))


def compare_volume_pages(volume_a, pages_a, volume_b, pages_b) -> Column:
    """The share of equal ones among volume and pages, of those that both sides have."""
    pairs = [(F.nullif(col(x), F.lit("")), F.nullif(col(y), F.lit(""))) for x, y in ((volume_a, volume_b), (pages_a, pages_b))]
    known = sum((x.isNotNull() & y.isNotNull()).cast("int") for x, y in pairs)
    equal = sum(F.coalesce((x == y).cast("int"), F.lit(0)) for x, y in pairs)
    return F.when(known > 0, equal / known).otherwise(0.0)


def coverage_ranges(c: Column | str) -> Column:
    """array<struct<from, to>> of coverage such as ``2016-2026; 2001``; parts of other form are left out."""
    part = lambda s: F.struct(
        F.coalesce(first_match(s, "^(\\d{4})\\s*-\\s*\\d{4}$"), first_match(s, "^(\\d{4})$")).cast("int").alias("from"),
        F.coalesce(first_match(s, "^\\d{4}\\s*-\\s*(\\d{4})$"), first_match(s, "^(\\d{4})$")).cast("int").alias("to"),
    )
    return F.filter(F.transform(F.split(text_of(c), ";"), lambda s: part(F.trim(s))), lambda r: r["from"].isNotNull())


def year_covered(coverage: Column | str, year: Column | str) -> Column:
    """Whether a year lies in a range; null where year or coverage is unknown."""
    ranges, y = coverage_ranges(coverage), leading_int(year)
    return F.when(y.isNotNull() & (F.size(ranges) > 0), F.exists(ranges, lambda r: (y >= r["from"]) & (y <= r["to"])))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets, 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def levenshtein_ratio(a: Column | str, b: Column | str) -> Column:
    """1 minus edit distance over the longer length; two empty strings are equal."""
    x, y = text_of(a), text_of(b)
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(x, y) / longest)


def initials_of(c: Column | str) -> Column:
    """Upper-case first letters of the words, small joining words left out."""
    words = F.filter(F.split(squeeze(c), "[ -]"), lambda w: (w != "") & ~F.lower(w).isin("of", "the", "and", "dan", "for", "in", "on", "to", "a", "an"))
    return F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))


def preview(c: Column | str, n: int) -> Column:
    """The first and last n words with an ellipsis between, or the whole text where it has no more."""
    s = squeeze(c)
    words = F.split(s, " ")
    return F.when(F.size(words) <= 2 * n, s).otherwise(
        F.concat(F.array_join(F.slice(words, 1, n), " "), F.lit(" … "), F.array_join(F.slice(words, F.size(words) - n + 1, n), " "))
    )


def strip_particles(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.trim(text_of(c)), f"(?iu)^({PARTICLES.replace(' ', '\\s+')})\\s+", ""))


def key_letters(c: Column | str) -> Column:
    """Letters and digits only, in lower case."""
    return F.regexp_replace(F.lower(text_of(c)), "[^\\p{L}\\p{N}]", "")
