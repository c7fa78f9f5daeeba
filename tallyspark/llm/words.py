"""Hashes of the words of Arrow text columns, computed for many rows at a time."""

from __future__ import annotations

import numpy as np

from tallyspark.llm.arrow import runs

STEP = 0x5851F42D4C957F2D  # odd, 5 modulo 8
SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of the runs of bytes that ``inside`` allows, read through the table ``fold``."""

    def __init__(self, inside: np.ndarray, fold: np.ndarray | None = None):
        self.inside = inside
        self.byte = mix((np.arange(256) if fold is None else fold).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            step, back = np.full(n, STEP, np.uint64), np.full(n, pow(STEP, -1, 1 << 64), np.uint64)
            step[0] = back[0] = 1
            self.up, self.down = np.cumprod(step), np.cumprod(back)

    def words(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each word, and the n+1 word offsets of the rows.

        The sums run over about SLICE bytes of whole words at a time, so a row may be of any length.
        """
        starts, ends = runs(self.inside[raw], offsets)
        out = np.empty(len(starts), np.uint64)
        at = 0
        while at < len(starts):
            lo = starts[at]
            to = max(at + 1, int(np.searchsorted(ends, lo + SLICE, "right")))
            part = raw[lo:ends[to - 1]]
            self.powers(len(part) + 1)
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(self.byte[part] * self.up[:len(part)], out=total[1:])
            a, b = starts[at:to] - lo, ends[at:to] - lo
            out[at:to] = mix((total[b] - total[a]) * self.down[a] + (b - a).astype(np.uint64))
            at = to
        return out, np.searchsorted(starts, offsets)


def grams(words: np.ndarray, n: int, factor: int) -> np.ndarray:
    """Hash of each run of n words, in order; runs may cross rows."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        out = out * np.uint64(factor) + words[k:k + len(out)]
    return mix(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:len(x) - step], x[step:])
        done += step
    return x
