"""One form for texts that look the same, computed on code-point arrays.

A batch of Arrow strings becomes one array of code points plus row offsets. Lookup tables give, for
every code point, its expansion (compatibility forms that only change width or style, canonical
decompositions, spaces, hyphens, nothing for invisible characters); expansion offsets place the
results; letters that imitate Latin ones are replaced word by word; marks are then composed. No step
calls a string function per row.

Defined results: null stays null, an empty text stays empty, a text of invisible characters only
becomes empty. Superscripts, fractions and circled characters look different from their plain
counterparts and are kept. Dashes that are longer than a hyphen are kept. Words of other scripts are
kept: a word is rewritten only if every non-Latin letter in it imitates a Latin one and it also has
Latin letters, or stands in a line with Latin letters and no genuine word of another script.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

SIZE = 0x110000
SPACE, HYPHEN, NEWLINE = 0x20, 0x2D, 0x0A

# Compatibility tags under which a character differs in style or width only.
STYLE_TAGS = ("font", "wide", "narrow", "noBreak", "compat", "small", "initial", "medial", "final", "isolated")
# Hyphens besides U+002D.
HYPHENS = (0x2010, 0x2011, 0xFE63, 0xFF0D)
# Format characters that are visible, and invisible characters that are no format characters.
VISIBLE_FORMAT = (0x0600, 0x0601, 0x0602, 0x0603, 0x0604, 0x0605, 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD)
INVISIBLE = (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0)
# Letters of other scripts and the Latin letters they imitate.
TWINS = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q",
    "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ү": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Ԍ": "G", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O",
    "Р": "P", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "У": "Y", "Ү": "Y", "Ӏ": "I",
    "α": "a", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "ϲ": "c", "ϳ": "j", "υ": "u", "γ": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "օ": "o", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "ո": "n",
}
# Latin letters that imitate plain ones.
LATIN_TWINS = {"ɑ": "a", "ɡ": "g", "ı": "i", "ꜱ": "s", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ᴄ": "c", "ʏ": "y"}

OTHER, LATIN, TWIN, GENUINE, MARK = 0, 1, 2, 3, 4


def _expansion(cp: int, cache: dict[int, tuple[int, ...]]) -> tuple[int, ...]:
    if cp in cache:
        return cache[cp]
    parts = unicodedata.decomposition(chr(cp)).split()
    out: tuple[int, ...] = (cp,)
    if parts:
        tag = parts[0].strip("<>") if parts[0][0] == "<" else ""
        target = [int(x, 16) for x in parts[bool(tag) :]]
        spaced = target[0] == SPACE and len(target) > 1
        if (not tag or tag in STYLE_TAGS) and not spaced:
            out = tuple(y for x in target for y in _expansion(x, cache))
    cache[cp] = out
    return out


class Tables:
    """Lookup tables over all code points; built once in each process."""

    def __init__(self) -> None:
        cache: dict[int, tuple[int, ...]] = {}
        self.length = np.ones(SIZE, np.uint8)
        self.offset = np.arange(SIZE, dtype=np.int32)
        self.rank = np.zeros(SIZE, np.uint8)
        self.kind = np.zeros(SIZE, np.uint8)
        self.twin = np.arange(SIZE, dtype=np.uint32)
        pool = list(range(SIZE))
        keys, values = [], []
        hidden = set(INVISIBLE) | set(range(0xFE00, 0xFE10)) | set(range(0xE0100, 0xE01F0))
        for cp in range(SIZE):
            if 0xD800 <= cp < 0xE000:
                continue
            c = chr(cp)
            category = unicodedata.category(c)
            if category == "Cn" or category == "Co":
                continue
            if category[0] == "L":
                name = unicodedata.name(c, "")
                self.kind[cp] = LATIN if name.startswith(("LATIN", "FULLWIDTH LATIN", "MATHEMATICAL", "FEMININE", "MASCULINE")) else GENUINE
            elif category[0] == "M":
                self.kind[cp] = MARK
            self.rank[cp] = unicodedata.combining(c)
            if category == "Cf" and cp not in VISIBLE_FORMAT or cp in hidden:
                self.length[cp] = 0
                continue
            if category == "Zs":
                pool[cp] = SPACE
                continue
            if cp in HYPHENS:
                pool[cp] = HYPHEN
                continue
            if 0xAC00 <= cp < 0xD7A4:
                continue
            out = _expansion(cp, cache)
            if out != (cp,):
                self.length[cp], self.offset[cp] = len(out), len(pool)
                pool.extend(out)
                raw = unicodedata.decomposition(c)
                if raw[0] != "<" and len(raw.split()) == 2 and unicodedata.normalize("NFC", c) == c:
                    a, b = (int(x, 16) for x in raw.split())
                    keys.append(a << 21 | b)
                    values.append(cp)
        for source, kind in ((TWINS, TWIN), (LATIN_TWINS, LATIN)):
            for a, b in source.items():
                self.kind[ord(a)] = kind
                if kind == TWIN:
                    self.twin[ord(a)] = ord(b)
                else:
                    pool[ord(a)] = ord(b)
        self.pool = np.array(pool, np.uint32)
        order = np.argsort(np.array(keys, np.int64))
        self.pairs = np.array(keys, np.int64)[order]
        self.composed = np.array(values, np.uint32)[order]


@functools.cache
def tables() -> Tables:
    return Tables()


def _runs(change: np.ndarray) -> np.ndarray:
    """Number of the run that each element belongs to; `change` is true where a run begins."""
    return np.cumsum(change) - 1


def _expand(t: Tables, cps: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lengths = t.length[cps].astype(np.int64)
    if (lengths == 1).all():
        return t.pool[t.offset[cps]], rows
    ends = np.cumsum(lengths)
    within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)
    return t.pool[np.repeat(t.offset[cps], lengths) + within], np.repeat(rows, lengths)


def _order_marks(t: Tables, cps: np.ndarray, rows: np.ndarray) -> np.ndarray:
    rank = t.rank[cps]
    if not ((rank[1:] > 0) & (rank[:-1] > rank[1:]) & (rows[1:] == rows[:-1])).any():
        return cps
    starts = rank == 0
    starts[0] = True
    starts[1:] |= rows[1:] != rows[:-1]
    return cps[np.lexsort((rank, _runs(starts)))]


def _replace_twins(t: Tables, cps: np.ndarray, rows: np.ndarray) -> np.ndarray:
    kind = t.kind[cps]
    if not (kind == TWIN).any():
        return cps
    new_row = np.ones(len(cps), bool)
    new_row[1:] = rows[1:] != rows[:-1]
    inside = kind > 0
    starts = new_row.copy()
    starts[1:] |= inside[1:] != inside[:-1]
    word = _runs(starts)
    line_start = new_row.copy()
    line_start[1:] |= cps[:-1] == NEWLINE
    line = _runs(line_start)
    count = lambda what, of: np.bincount(of[kind == what], minlength=of[-1] + 1) > 0
    genuine, latin = count(GENUINE, word), count(LATIN, word)
    plain_line = count(LATIN, line) & ~count(GENUINE, line)
    change = (kind == TWIN) & ~genuine[word] & (latin[word] | plain_line[line])
    return np.where(change, t.twin[cps], cps)


def _compose(t: Tables, cps: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rank = t.rank[cps]
    if not (rank > 0).any():
        return cps, rows
    starts = rank == 0
    starts[0] = True
    starts[1:] |= rows[1:] != rows[:-1]
    first = np.flatnonzero(starts)
    run = _runs(starts)
    place = np.arange(len(cps)) - first[run]
    cps, keep, last = cps.copy(), np.ones(len(cps), bool), np.zeros(len(first), np.uint8)
    open_ = rank[first] == 0
    for k in range(1, int(place.max()) + 1):
        at = np.flatnonzero(place == k)
        at = at[open_[run[at]]]
        if not len(at):
            break
        head = first[run[at]]
        key = cps[head].astype(np.int64) << 21 | cps[at]
        found = np.minimum(np.searchsorted(t.pairs, key), len(t.pairs) - 1)
        good = (t.pairs[found] == key) & (last[run[at]] < rank[at])
        cps[head[good]] = t.composed[found[good]]
        keep[at[good]] = False
        last[run[at[~good]]] = rank[at[~good]]
    return cps[keep], rows[keep]


def to_codepoints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in one array, and the row of each of them."""
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = memoryview(data)[offsets[0] : offsets[-1]] if data is not None else b""
    cps = np.frombuffer(bytes(raw).decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    ends = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    at = ends[offsets - offsets[0]]
    return cps, np.repeat(np.arange(len(texts)), np.diff(at))


def from_codepoints(cps: np.ndarray, rows: np.ndarray, n: int) -> pa.Array:
    data = cps.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    size = 1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000)
    offsets = np.zeros(n + 1, np.int64)
    offsets[1:] = np.cumsum(np.bincount(rows, weights=size, minlength=n)[:n])
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(data)).cast(pa.string())


def fold(texts: pa.Array) -> pa.Array:
    """The texts in the one form described in the module; nulls stay nulls."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if not pa.types.is_string(texts.type):
        texts = texts.cast(pa.string())
    odd = pc.fill_null(pc.invert(pc.string_is_ascii(texts)), False)
    picked = texts.filter(odd)
    if not len(picked):
        return texts
    t = tables()
    cps, rows = to_codepoints(picked)
    cps, rows = _expand(t, cps, rows)
    if len(cps):
        cps = _order_marks(t, cps, rows)
        cps = _replace_twins(t, cps, rows)
        cps, rows = _compose(t, cps, rows)
    return pc.replace_with_mask(texts, odd, from_codepoints(cps, rows, len(picked)))


def fold_texts(values: list[str]) -> list[str]:
    """`fold` for a list, for use inside other batch functions."""
    return fold(pa.array(values, pa.string())).to_pylist()


@functools.cache
def _udf():
    return F.arrow_udf(fold, "string")


def folded(text: Column) -> Column:
    """Column form of `fold`."""
    return _udf()(text)
