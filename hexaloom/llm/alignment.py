"""Banded alignment of word sequences by bit-parallel rows on Python's long integers."""

from __future__ import annotations

from collections import Counter


def edit_distance(a: list, b: list, most: int) -> int:
    """Least insertions, deletions and replacements from a to b; most + 1 if they are more than most."""
    return min(banded(a, b, most, most), most + 1)


def banded(a: list, b: list, band: int, most: int) -> int:
    """Least edits from a to b along the diagonals within band of the main one: never less than the distance, and the distance itself
    if that is at most band. Above most where the distance is, and where the lengths are more than band apart.

    Bit i of a row stands for cell (column + i - band); the band slides down one cell a column, so the row's vertical differences
    shift by one bit each time.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > band:
        return most + 1
    low, high_a, high_b = 0, len(a), len(b)
    while low < high_b and a[low] == b[low]:
        low += 1
    while high_b > low and a[high_a - 1] == b[high_b - 1]:
        high_a, high_b = high_a - 1, high_b - 1
    a, b = a[low:high_a], b[low:high_b]
    if not b:
        return len(a)
    band = min(band, len(a))
    width = 2 * band + 1
    places: dict = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    mask = (1 << width) - 1
    # rows above the first word count from band down to 0: their differences are -1, those below +1
    plus, minus = mask ^ ((1 << band) - 1), (1 << band) - 1
    score = band  # of the band's lowest cell, at column 0 on row `band`
    bottom, n = 1 << (width - 1), len(a)
    for column, w in enumerate(b, 1):
        found = places.get(w, 0)
        shift = column - 1 - band  # row of bit 0, counted in words of a
        equal = (found >> shift if shift >= 0 else found << -shift) & mask
        x = equal | minus
        diagonal = ((((x & plus) + plus) ^ plus) | x) & mask
        across_plus = minus | (mask ^ ((diagonal | plus) & mask))
        across_minus = plus & diagonal
        if not diagonal & bottom:
            score += 1
        diagonal >>= 1
        plus = across_minus | (mask ^ ((diagonal | across_plus) & mask))
        minus = across_plus & diagonal
    # the lowest cell now stands on row len(b) + band; walk up to row len(a)
    row, bit = len(b) + band, width - 2  # the row differences have slid on to the next column already
    while row > n:
        score -= (plus >> bit) & 1
        score += (minus >> bit) & 1
        bit -= 1
        row -= 1
    return score


def _apart(a: list, b: list) -> int:
    """A lower bound: words that one holds and the other doesn't, counted."""
    ca, cb = Counter(a), Counter(b)
    return max((ca - cb).total(), (cb - ca).total())


def similarity(a: list, b: list, least: float) -> float:
    """1 - edit distance / the longer length, or 0 if that is under least. Two empty lists: 1.

    The band begins narrow and doubles until the alignment fits in it, up to what least allows.
    """
    n = max(len(a), len(b))
    if not n:
        return 1.0
    most = int((1 - least) * n + 1e-9)
    if abs(len(a) - len(b)) > most or (n > 32 and _apart(a, b) > most):
        return 0.0
    band = min(most, max(16, abs(len(a) - len(b)) * 2))
    while True:
        d = edit_distance(a, b, band)
        if d <= band:
            return 1 - d / n
        if band == most:
            return 0.0
        band = min(most, 2 * band)


def path_cost(a: list, b: list, most: int, ahead: int = 8) -> int:
    """Edits of one path from a to b, so never less than the distance: word by word, and where two differ, the nearest place at most `ahead` words on
    at which both go on alike. Given up above most."""
    i, j, cost, n, m = 0, 0, 0, len(a), len(b)
    while i < n and j < m:
        if a[i] == b[j]:
            i, j = i + 1, j + 1
            continue
        for s in range(1, ahead):
            if a[i + s : i + s + 2] == b[j + s : j + s + 2]:
                i, j, cost = i + s, j + s, cost + s
                break
            if a[i + s : i + s + 3] == b[j : j + 3]:
                i, cost = i + s, cost + s
                break
            if a[i : i + 3] == b[j + s : j + s + 3]:
                j, cost = j + s, cost + s
                break
        else:
            i, j, cost = i + 1, j + 1, cost + 1
        if cost > most or (cost > 12 and 2 * cost > i):
            return most + 1
    return cost + max(n - i, 0) + max(m - j, 0)


#: Rows of so many cells to either side cost hardly more than narrow ones.
_CHEAP_BAND = 256


def similar(a: list, b: list, least: float, counted: bool = False) -> bool:
    """Whether similarity() is at least `least`. Any path of few enough edits says so at once: one found by looking ahead, or one in a narrow band, which
    is widened until it holds all that least allows. counted: the words that only one of them holds are known to be few enough."""
    n = max(len(a), len(b))
    most, apart = int((1 - least) * n + 1e-9), abs(len(a) - len(b))
    if apart > most:
        return False
    if path_cost(a, b, most) <= most:
        return True
    if not counted and _apart(a, b) > most:
        return False
    band = min(most, _CHEAP_BAND if most <= _CHEAP_BAND else 14 if apart <= 7 else 2 * apart)
    while True:
        if banded(a, b, band, most) <= most:
            return True
        if band == most:
            return False
        band = min(most, 4 * band)
