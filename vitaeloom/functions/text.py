"""Text normalisation and line structure as column expressions.

Patterns carry (?U), so that white space and letters mean the same as in Unicode-aware engines. Nulls
stay null everywhere; empty texts stay empty.
"""

from __future__ import annotations

import functools
import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters that open a bullet, besides the hyphen.
BULLETS = "•·▪▫◦○●■□–—*►▶➢➤✓✔◆◇»▸‣⁃"
BULLET = rf"^(?U)\s*(?:[{BULLETS.replace('*', chr(92) + '*')}]|-)\s+"
# Sequences left by a wrong decoding, and what they stood for.
MOJIBAKE = (
    ("â€“", "–"), ("â€”", "—"), ("â€™", "'"), ("â€˜", "'"), ("â€œ", '"'), ("â€\u009d", '"'), ("â€¢", "•"), ("Â·", "·"), ("Â\u00a0", " "), ("\ufeff", ""),
)


def _nfkc(texts: pa.Array) -> pa.Array:
    odd = pc.fill_null(pc.invert(pc.string_is_ascii(texts)), False)
    picked = texts.filter(odd)
    if not len(picked):
        return texts
    return pc.replace_with_mask(texts, odd, pa.array([unicodedata.normalize("NFKC", t) for t in picked.to_pylist()], texts.type))


@functools.cache
def _nfkc_udf():
    return F.arrow_udf(_nfkc, "string")


def nfkc(text: Column) -> Column:
    """Compatibility composition; ASCII texts pass through untouched."""
    return _nfkc_udf()(text)


def clean_text(text: Column) -> Column:
    """Line ends, wrong decodings, compatibility forms, blanks and blank lines brought to one form."""
    c = F.regexp_replace(text, "\r\n?", "\n")
    for bad, good in MOJIBAKE:
        c = F.replace(c, F.lit(bad), F.lit(good))
    c = nfkc(c)
    c = F.translate(c, "\t\u00a0\u200b", "  ")
    c = F.regexp_replace(c, " {2,}", " ")
    c = F.regexp_replace(c, r"(?Um)^[\s&&[^\n]]+|[\s&&[^\n]]+$", "")
    c = F.regexp_replace(c, "\n{3,}", "\n\n")
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def strip(text: Column, chars: str = r"\s") -> Column:
    """Both ends without the characters of a class."""
    return F.regexp_replace(text, rf"(?U)\A[{chars}]+|[{chars}]+\z", "")


def is_bullet(line: Column) -> Column:
    return line.rlike(BULLET)


def strip_bullet(line: Column) -> Column:
    return strip(F.regexp_replace(line, BULLET, ""))


def word_count(text: Column) -> Column:
    """Number of words between white space."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def units(line: Column) -> Column:
    """Array of the statements of a line: a bullet is one, prose has one for each sentence."""
    sentences = F.transform(F.split(line, r"(?<=[.!?])(?U:\s+)(?=[A-Z\"'(])"), lambda s: strip(s))
    return F.filter(F.when(is_bullet(line), F.array(strip_bullet(line))).otherwise(sentences), lambda u: u != "")


def explode_lines(df: DataFrame, text: str, *keys: str, keep_blank: bool = True) -> DataFrame:
    """(keys, line_no, line): the lines of a text, numbered from 0; null texts have none."""
    lines = df.select(*keys, F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line"))
    return lines if keep_blank else lines.where(F.trim("line") != "")


def clip(text: Column, most: int = 160) -> Column:
    """A text of at most `most` characters as it is, a longer one cut, with an ellipsis."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, most), r"(?U)\s+\z", ""), F.lit("…")))


def terms(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


def syllables(word: Column) -> Column:
    """Vowel groups of a word; a silent final e doesn't count; at least one."""
    w = F.lower(word)
    n = F.regexp_count(w, F.lit("[aeiouy]+"))
    silent = w.endswith("e") & ~w.endswith("le") & ~w.endswith("ee") & (n > 1)
    return F.greatest(n - silent.cast("int"), F.lit(1))


def reading_ease(text: Column) -> Column:
    """Flesch reading ease; 100 for a text without words."""
    words = F.regexp_extract_all(text, F.lit("([A-Za-z]+)"), 1)
    n = F.size(words)
    sentences = F.greatest(F.regexp_count(text, F.lit("[.!?]+")), F.lit(1))
    spoken = F.aggregate(words, F.lit(0), lambda a, w: a + syllables(w))
    return F.when(n == 0, F.lit(100.0)).otherwise(206.835 - 1.015 * (n / sentences) - 84.6 * (spoken / F.when(n > 0, n)))


NUMBER = r"(\d+(?:[.,]\d+)*%?)"


def adds_numbers(original: Column, rewrite: Column) -> Column:
    """Does the rewrite hold a figure that the original lacks?"""
    numbers = lambda c: F.regexp_extract_all(c, F.lit(NUMBER), 1)
    return F.size(F.array_except(numbers(rewrite), numbers(original))) > 0
