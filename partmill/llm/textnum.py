"""Numpy helpers that turn one text into arrays: word limits, word hashes, hashes of word runs.

They run inside Arrow batches on the executors; nothing here knows Spark. Words are what stands
between ASCII white space. All hashes are 64-bit and the same in every process.
"""

from __future__ import annotations

import numpy as np

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_WORD_BASE, _RUN_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; kept per process up to a fixed length."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 4096), base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 1 << 20:
            _powers[base] = have
    return have[:n]


def word_limits(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions at which words start and end."""
    space = _IS_SPACE[data]
    change = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(data) and not space[0]:
        change = np.concatenate(([0], change))
    if len(data) and not space[-1]:
        change = np.concatenate((change, [len(data)]))
    return change[::2], change[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    inside = np.arange(total) - np.repeat(first, lengths)
    chars = data[inside + np.repeat(starts, lengths)]
    value = _BYTES[chars] * powers(_WORD_BASE, int(lengths.max()))[inside]
    return mix(np.add.reduceat(value, first) + lengths.astype(np.uint64))


def run_hashes(words: np.ndarray, n: int, base: int = _RUN_BASE) -> np.ndarray:
    """Hash of every n consecutive words, by start."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    up = powers(base, len(words))
    down = powers(pow(base, -1, 1 << 64), len(words))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up, dtype=np.uint64)))
    return mix((total[n:] - total[:-n]) * down[:count] + np.uint64(n))


def span_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _RUN_BASE) -> np.ndarray:
    """Hash of words[start:end] for many spans."""
    up = powers(base, len(words))
    down = powers(pow(base, -1, 1 << 64), len(words))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up, dtype=np.uint64)))
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def text_words(text: str, lower: bool = False, hashes: bool = True) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray | None]:
    """(UTF-8 bytes, word starts, word ends, word hashes if asked for)."""
    raw = text.encode("utf-8", "surrogatepass")
    if lower:
        raw = raw.translate(LOWER)
    data = np.frombuffer(raw, np.uint8)
    starts, ends = word_limits(data)
    return raw, starts, ends, word_hashes(data, starts, ends) if hashes else None


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
