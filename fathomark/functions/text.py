"""Text normalisation and extraction as JVM expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The similarity from which two titles count as the same work, the
# number pattern, and the markup stripped before numbers are read.
STRONG_MATCH = 0.90
NUMBER = r"(?<![A-Za-z0-9_])[-+]?\d+(?:\.\d+)?(?:e[-+]?\d+)?(?![A-Za-z_])"
CITE = r"\\cite[tp]?\*?(?:\[[^\]]*\])*\{([^}]+)\}"
NOISE = (
    (r"(?m)(?<!\\)%.*$", ""),
    (r"\\cite[tp]?\*?(?:\[[^\]]*\])*\{[^}]*\}", ""),
    (r"(?s)\[CITE:[^\]]*\]", ""),
    (r"([-+]?\d+(?:\.\d+)?)\\times\s*10\^\{([-+]?\d+)\}", r"$1e$2"),
    (r"\^\{[^{}]*\}", ""),
    (r"(?<=\d)--(?=\d)", " "),
    (r"(?<=\d)(?:st|nd|rd|th)\b", ""),
)


@lru_cache(maxsize=1)
def _folds() -> tuple[str, str]:
    """Characters whose compatibility decomposition is one letter or digit, and that character."""
    src, dst = [], []
    for cp in range(0xA0, 0x10000):
        ch = chr(cp)
        base = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if base != ch and len(base) == 1 and base.isascii() and base.isalnum():
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


def fold_accents(c: Column) -> Column:
    src, dst = _folds()
    return F.translate(F.regexp_replace(c, r"\p{M}+", ""), src, dst)


def norm_title(c: Column) -> Column:
    """Case, accent, punctuation and space insensitive form."""
    return F.trim(F.regexp_replace(F.lower(fold_accents(c)), "[^a-z0-9]+", " "))


def norm_token(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def title_sim(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length of the normalised titles."""
    x, y = norm_title(a), norm_title(b)
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(x, y) / longest)


def surnames(c: Column) -> Column:
    """Normalised last names of a written-out author list, initials dropped, order kept."""
    parts = F.split(F.regexp_replace(c, r"\band\b", ","), ",")
    last = F.transform(parts, lambda p: F.regexp_extract(F.rtrim(F.rtrim(F.trim(p), F.lit(".")), F.lit(" ")), r"(\S+)$", 1))
    clean = F.transform(last, lambda s: F.trim(s, F.lit(".")))
    kept = F.transform(F.filter(clean, lambda s: F.length(s) >= 2), norm_token)
    return F.array_distinct(F.filter(kept, lambda s: s != ""))


def bib_surnames(c: Column) -> Column:
    """The same for ``Surname, Given and Surname, Given`` lists."""
    people = F.filter(F.transform(F.split(c, r"(?i)\s+and\s+"), F.trim), lambda p: p != "")
    name = F.transform(people, lambda p: F.when(
        F.instr(p, ",") > 0, F.trim(F.substring_index(p, ",", 1))).otherwise(F.regexp_extract(p, r"(\S+)$", 1)))
    return F.array_distinct(F.filter(F.transform(name, norm_token), lambda s: s != ""))


def pages_agree(a: Column, b: Column) -> Column:
    """Equal or contained after normalisation."""
    x, y = norm_token(a), norm_token(b)
    return x.contains(y) | y.contains(x)


def strip_noise(c: Column, comments: bool = True) -> Column:
    """Text without markup that carries numbers which are not claims."""
    for i, (pattern, repl) in enumerate(NOISE):
        if i == 0 and not comments:
            continue
        c = F.regexp_replace(c, pattern, repl)
    c = F.replace(F.replace(c, F.lit("{,}"), F.lit("")), F.lit(","), F.lit(""))
    return F.replace(c, F.lit("\u2212"), F.lit("-"))


def places_of(token: Column) -> Column:
    """Decimal places of a number token, its exponent taken into account; null without a point."""
    mantissa = F.substring_index(token, "e", 1)
    power = F.when(F.instr(token, "e") > 0, F.substring_index(token, "e", -1).try_cast("long")).otherwise(F.lit(0))
    frac = F.length(F.substring_index(mantissa, ".", -1))
    return F.when(F.instr(mantissa, ".") > 0, frac - power)
