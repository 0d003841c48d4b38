"""64-bit hashes of a text's words, without a step per word."""

from __future__ import annotations

import numpy as np

_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
ODD = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd multiplier and of its inverse, modulo 2**64."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << n.bit_length()
            inverse = np.uint64(pow(int(ODD), -1, 1 << 64))
            self.up = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(size - 1, ODD))))
            self.down = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(size - 1, inverse))))
        return self.up, self.down


_POWERS = _Powers()


def word_hashes(text: str | None, apart: np.ndarray) -> np.ndarray:
    """Hash of each word of the text, A-Z lower-cased; `apart` marks the bytes that separate words."""
    data = np.frombuffer((text or "").encode("utf-8").lower(), dtype=np.uint8)
    edge = np.diff(np.concatenate(([1], apart[data], [1])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _POWERS.get(len(data) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)))
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
