"""64-bit hashes of words and of runs of words, as numpy operations over whole texts."""

from __future__ import annotations

import numpy as np
import xxhash

K = np.uint64(0xD6E8FEB86659FD93)
_SEED = np.uint64(0x9E3779B97F4A7C15)
#: Bytes that part words.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Keeps the first 0 to 8 bytes of a little-endian load.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Longer words are hashed one by one.
_LONG = 128


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lowered(text: str | None) -> bytes:
    """UTF-8 with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of each word between white space; A-Z count as lower case.

    Eight bytes at a time enter a mixing bijection, so words of up to eight
    bytes have different hashes if their lengths are equal, and no algebra
    makes longer ones collide.
    """
    raw = lowered(text)
    if not raw:
        return np.zeros(0, np.uint64)
    a = np.frombuffer(raw, np.uint8)
    blank = np.concatenate([[True], SPACE[a], [True]])
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    loads = np.ndarray(len(raw) + 1, "<u8", raw + bytes(8), strides=(1,))
    out = mix(sizes.astype(np.uint64) * _SEED ^ loads[starts] & _KEEP[np.minimum(sizes, 8)])
    at = np.flatnonzero(sizes > 8)
    for k in range(8, _LONG, 8):
        if not len(at):
            break
        out[at] = mix(out[at] * K ^ loads[starts[at] + k] & _KEEP[np.minimum(sizes[at] - k, 8)])
        at = at[sizes[at] > k + 8]
    for i in at.tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : starts[i] + sizes[i]])
    return out


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of the run of ``size`` words that starts at each place."""
    n = max(len(words) - size + 1, 0)
    h = words[:n] + np.uint64(size)
    for k in range(1, size):
        h = mix(h * K ^ words[k : k + n])
    return h
