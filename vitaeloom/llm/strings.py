"""String comparison on single pairs; called on candidate pairs only, inside Arrow batches."""

from __future__ import annotations

import functools
import unicodedata


def plain(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def jaro_winkler(a: str, b: str, prefix_weight: float = 0.1) -> float:
    """Jaro-Winkler similarity: 1 for equal texts, 0 where no character matches or one text is empty."""
    if a == b:
        return 1.0 if a else 0.0
    reach = max(len(a), len(b)) // 2 - 1
    reach = max(reach, 0)
    used = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, u in zip(b, used) if u]
    swaps = sum(x != y for x, y in zip(left, right)) / 2
    m = len(left)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    same = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return jaro + same * prefix_weight * (1 - jaro)


@functools.lru_cache(maxsize=200_000)
def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, replacements and swaps of neighbours between a and b; most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    before, last = None, list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        row = [i] + [0] * len(b)
        best = i
        for j in range(1, len(b) + 1):
            cost = last[j - 1] + (a[i - 1] != b[j - 1])
            if last[j] + 1 < cost:
                cost = last[j] + 1
            if row[j - 1] + 1 < cost:
                cost = row[j - 1] + 1
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1] and before[j - 2] + 1 < cost:
                cost = before[j - 2] + 1
            row[j] = cost
            if cost < best:
                best = cost
        if best > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)
