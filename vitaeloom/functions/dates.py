"""Dates in lines of a resume: tokens, ranges and the text without them, computed on Arrow batches.

A line is cut into pieces (runs of digits, of letters, of blanks, single signs). A date is what a few
neighbouring pieces say: a month word and a year, a month number and a year with a slash or a full stop
between them, a year and a month number with a hyphen, a year by itself, or words for an open end. It is normalised to
YYYY-MM, YYYY or present; its family is text (Jun 2018), numeric (06/2018 or 2018-06) or year;
`present` has none. A range is the first pair of neighbouring dates with nothing but a dash or a word like "to"
between them, which doesn't begin with `present`. Null lines give null.
"""

from __future__ import annotations

import functools
import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Months, words for an open end, and what may stand between two dates of a range.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
OPEN_END = ("present", "current", "currently", "now", "ongoing", "to date", "till date", "today")
BETWEEN = ("–", "—", "-", "‐", "‑", "to", "until", "through", "till")

MONTH_NUMBER = {name: i for i, full in enumerate(MONTHS, 1) for name in (full, full[:3])} | {"sept": 9}
PIECE = re.compile(r"\d+|[^\W\d_]+|\s+|.", re.S)
NO_PIECE = ""


class Date(NamedTuple):
    start: int
    end: int
    value: str
    family: str | None


def _year(piece: str) -> bool:
    return len(piece) == 4 and piece.isdecimal() and piece[:2] in ("19", "20")


def _month(piece: str) -> int | None:
    return int(piece) if len(piece) <= 2 and piece.isdecimal() and 1 <= int(piece) <= 12 else None


def _wordlike(piece: str) -> bool:
    return piece == "_" or piece.isalnum()


def _read(pieces: list[str]) -> tuple[int, str, str | None] | None:
    """(number of pieces, value, family) of the date that begins at the second piece; the first is the one before."""
    before, first = pieces[0], pieces[1].lower()
    if first.isalpha() and not _wordlike(before):
        for words in OPEN_END:
            n = 1 + 2 * words.count(" ")
            if "".join(pieces[1 : n + 1]).lower() == words and not _wordlike(pieces[n + 1]):
                return n, "present", None
        if first in MONTH_NUMBER:
            signs = "".join(p for p in pieces[2:4] if p in (".", ","))
            at = 2 + len(signs) if signs in ("", ".", ",", ".,") else 2
            if pieces[at].isspace() and _year(pieces[at + 1]) and not _wordlike(pieces[at + 2]):
                return at + 1, f"{pieces[at + 1]}-{MONTH_NUMBER[first]:02d}", "text"
    if not first.isdecimal():
        return None
    month, sign, second = _month(first), pieces[2], pieces[3]
    if month and sign in ("/", ".") and (_year(second) or len(second) == 2 and second.isdecimal()):
        return 3, f"{second if len(second) == 4 else '20' + second}-{month:02d}", "numeric"
    if _year(first):
        if sign == "-" and len(second) == 2 and _month(second):
            return 3, f"{first}-{second}", "numeric"
        if before not in ("/", ".", "-") and sign not in ("/", ".", "-"):
            return 1, first, "year"
    return None


def scan(line: str) -> list[Date]:
    """Every date, by position."""
    found = PIECE.findall(line)
    pieces = [NO_PIECE, *found, *[NO_PIECE] * 7]
    out, at, i = [], 0, 0
    while i < len(found):
        read = _read(pieces[i : i + 8]) if found[i].isalnum() else None
        n = read[0] if read else 1
        end = at + sum(map(len, found[i : i + n]))
        if read:
            out.append(Date(at, end, *read[1:]))
        at, i = end, i + n
    return out


def first_range(line: str) -> tuple[str, str, str, int, int] | None:
    """(start date, end date, family, begin, end) of the first range."""
    dates = scan(line)
    joined = ((a, b) for a, b in zip(dates, dates[1:]) if a.family and line[a.end : b.start].strip().lower() in BETWEEN)
    return next(((a.value, b.value, a.family, a.start, b.end) for a, b in joined), None)


def without_dates(line: str) -> str:
    """The line without its first range and without the dates that are left."""
    r = first_range(line)
    kept = line if r is None else line[: r[3]] + line[r[4] :]
    ends = [0, *(d.end for d in scan(kept))]
    starts = [*(d.start for d in scan(kept)), len(kept)]
    return "".join(kept[a:b] for a, b in zip(ends, starts))


KIND = "values array<string>, families array<string>, start_date string, end_date string, family string, example string, rest string"


def _lines(lines: pd.Series) -> pd.DataFrame:
    rows = []
    seen: dict[str, tuple] = {}
    for line in lines:
        if line is None:
            rows.append((None,) * 7)
            continue
        if line not in seen:
            dates, r = scan(line), first_range(line)
            span = (r[0], r[1], r[2], line[r[3] : r[4]]) if r else (None,) * 4
            seen[line] = ([d.value for d in dates], [d.family for d in dates], *span, without_dates(line))
        rows.append(seen[line])
    return pd.DataFrame(rows, columns=["values", "families", "start_date", "end_date", "family", "example", "rest"])


@functools.cache
def _udf():
    return F.pandas_udf(_lines, KIND)


def dates_of(line: Column) -> Column:
    """Struct of the dates of a line: all values and families, the first range, and the rest of the text."""
    return _udf()(line)
