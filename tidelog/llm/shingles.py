"""Words and word shingles of a text as 64-bit hashes, by array operations over its bytes."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_RNG = np.random.default_rng(20240501)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(_U)
_STEP = _U(0x9E3779B97F4A7C15 | 1)
_STEP_INVERSE = _U(pow(int(_STEP), -1, 2**64))
_PLACE = (_RNG.integers(1, 2**63, 256, dtype=np.int64).astype(_U) << _U(1)) | _U(1)
_powers = [np.ones(1, dtype=_U), np.ones(1, dtype=_U)]

#: Bytes that separate words, once A-Z are in lower case: white space alone, or all ASCII but a-z and 0-9.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
NOT_ALPHANUMERIC = np.isin(np.arange(256), [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, step in enumerate((_STEP, _STEP_INVERSE)):
            row = np.full(size, step, dtype=_U)
            row[0] = 1
            _powers[k] = np.multiply.accumulate(row)
    return _powers[0], _powers[1]


def text_words(text: str | None, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The text's bytes, A-Z lower-cased, and first byte, end byte and hash of each word."""
    data = np.frombuffer((text or "").encode("utf-8", "replace").lower(), dtype=np.uint8)
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~separators[data]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return data, starts, ends, sequence_hashes(_BYTE[data], starts, ends) if len(starts) else np.zeros(0, dtype=_U)


def sequence_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each stretch [start, end) of a row of 64-bit values."""
    up, down = _power(len(values))
    total = np.zeros(len(values) + 1, dtype=_U)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U))


def word_hashes(text: str | None, separators: np.ndarray = SPACE) -> np.ndarray:
    """A hash for each word of the text, A-Z lower-cased; none for null."""
    return text_words(text, separators)[3]


def run_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of width consecutive words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    total = np.zeros(n, dtype=_U)
    for k in range(width):
        total += words[k : k + n] * _PLACE[k]
    return mixed(total)


def shingle_runs(text: str | None, width: int = 5, separators: np.ndarray = SPACE) -> np.ndarray:
    """The shingles in the order of the text; of fewer words the whole sequence is one."""
    words = word_hashes(text, separators)
    return run_hashes(words, width) if len(words) >= width else run_hashes(words, max(1, len(words)))


def shingle_set(text: str | None, width: int = 5, separators: np.ndarray = SPACE) -> np.ndarray:
    """The distinct shingles, sorted; empty without words."""
    return np.unique(shingle_runs(text, width, separators))
