"""Vectorised hashing of words and substrings straight from Arrow's text buffers."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

_U = np.uint64
_rng = np.random.default_rng(20240229)
#: A random 64-bit value for each byte, and odd multipliers.
BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
BASE = _U(0x9E3779B97F4A7C15)
BASE_INVERSE = _U(pow(int(BASE), -1, 2**64))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Everything in ASCII but letters and digits.
IS_BREAK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
STEP_BYTES = 512 << 10


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i up to n."""
    size = max(_POWERS, default=0)
    if size < n:
        size = max(n, STEP_BYTES + (128 << 10))
        up, down = np.full(size + 1, BASE, _U), np.full(size + 1, BASE_INVERSE, _U)
        up[0] = down[0] = 1
        _POWERS.clear()
        _POWERS[size] = (np.cumprod(up), np.cumprod(down))
    return _POWERS[size]


def text_chunks(column: pa.Array, step: int = STEP_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts of about ``step`` bytes; nulls are empty."""
    column = column.cast(pa.large_binary())
    if len(column) == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + step, "right")) - 1)
        yield row, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The first r bytes of a lane of eight.
LANES = np.array([(1 << 8 * r) - 1 for r in range(8)] + [2**64 - 1], _U)
LONG_WORD = 256


def word_hashes(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of several texts, A-Z lower-cased, and each text's first word; words are runs of bytes other than ``breaks`` (ASCII white space).

    A word's bytes are folded in eight at a time, each lane through ``mix``, and its length last; nothing in that is linear, so words differ in
    their hashes but for chance (2^-64 a pair).  Words of more than LONG_WORD bytes are hashed by BLAKE2.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    inside = ~breaks[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    sizes = np.flatnonzero(inside & (~after | edge[1:])) + 1 - starts
    low = np.zeros(n + 8, np.uint8)
    low[:n] = LOWER[data]
    lanes = np.ndarray((n + 1,), "<u8", low, strides=(1,))
    hashes = np.full(len(starts), BASE, _U)
    going = np.flatnonzero(sizes <= LONG_WORD)
    at = 0
    while len(going):
        left = sizes[going] - at
        hashes[going] = mix(hashes[going] ^ (lanes[starts[going] + at] & LANES[np.minimum(left, 8)]))
        at += 8
        going = going[left > 8]
    for k in np.flatnonzero(sizes > LONG_WORD).tolist():
        hashes[k] = int.from_bytes(blake2b(low[starts[k] : starts[k] + sizes[k]].tobytes(), digest_size=8).digest(), "little")
    return mix(hashes + sizes.astype(_U)), np.searchsorted(starts, offsets)
