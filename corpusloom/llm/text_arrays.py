"""Words of many texts at once, as NumPy arrays: what the tasks of the classifier and of near-dedup work on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Odd, so that its powers have inverses modulo 2 ** 64.
_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)

#: Bytes of text that are worked on together; a longer text is worked on alone.
CHUNK = 1 << 18


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        n = max(n, CHUNK + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        made = []
        for base in (_BASE, inverse):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            made.append(np.cumprod(x, dtype=np.uint64))
        _powers = tuple(made)
    return _powers[0][:n], _powers[1][:n]


def chunks(texts: list) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first, bytes, starts) of groups of whole texts. Each text is followed by a zero byte; starts has one more entry than texts."""
    group, size, first = [], 0, 0
    for i, t in enumerate([*texts, None]):
        b = (t or "").encode() if i < len(texts) else b""
        if group and (i == len(texts) or size + len(b) > CHUNK):
            lengths = np.array([len(g) + 1 for g in group])
            yield first, np.frombuffer(b"\0".join(group) + b"\0", np.uint8), np.concatenate([[0], np.cumsum(lengths)])
            group, size, first = [], 0, i
        group.append(b)
        size += len(b) + 1


def runs(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of one kind other than 0."""
    edge = np.flatnonzero(kinds[1:] != kinds[:-1]) + 1
    starts = np.concatenate([[0], edge])
    ends = np.concatenate([edge, [len(kinds)]])
    real = kinds[starts] != 0
    return starts[real], ends[real]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]; equal strings have equal hashes wherever they stand."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


#: Of each byte of lower-cased UTF-8 text: is it part of a word (ASCII letters and digits, anything beyond ASCII)?
WORD_BYTES = np.array([48 <= b <= 57 or 97 <= b <= 122 or b > 127 for b in range(256)], np.uint8)
