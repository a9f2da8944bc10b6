"""Words and five-word shingles as 64-bit numbers."""

from __future__ import annotations

import numpy as np
import xxhash

_ODD = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> np.ndarray:
    """Numbers of the words of a text, in lower case and cut at white space, in order.

    Hashed each time: where texts have many different words, that is cheaper than to remember them.
    """
    found = text.lower().split()
    try:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    except UnicodeEncodeError:  # half a surrogate pair
        return np.array([xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) for word in found], np.uint64)


def shingles(text: str, size: int = 5) -> np.ndarray:
    """The distinct rows of `size` words, ascending. A text of fewer words is one row; of none, none."""
    numbers = words(text)
    if not len(numbers):
        return numbers
    size = min(size, len(numbers))
    rows = np.zeros(len(numbers) - size + 1, np.uint64)
    for i in range(size):
        rows = fold(rows, numbers[i : len(numbers) - size + 1 + i])
    rows.sort()
    return rows[np.concatenate([[True], rows[1:] != rows[:-1]])]


def fold(rows: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Numbers of rows that are one value longer."""
    return mix(rows * _ODD + more)


def mix(values: np.ndarray) -> np.ndarray:
    """Spreads every bit over all 64."""
    values = (values ^ values >> np.uint64(32)) * _ODD
    return values ^ values >> np.uint64(29)
