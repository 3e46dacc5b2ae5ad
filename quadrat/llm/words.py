"""Words as 64-bit numbers, for hashing runs of words with array arithmetic."""

from __future__ import annotations

import numpy as np
import xxhash

from quadrat.llm.keep import kept

#: Words that one Python worker remembers at most, and the bytes of the longest of them; then it starts anew.
REMEMBER, LONG = 50_000, 100

_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word)
        if len(word) <= LONG:
            self[word] = found
        return found


def split_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Runs of anything but ASCII white space, as UTF-8; ``lower`` changes A-Z alone. NULL has none."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()


def word_numbers(words: list[bytes]) -> np.ndarray:
    numbers = kept("words numbers", _Numbers)
    if len(numbers) > REMEMBER:
        numbers.clear()
    return np.fromiter(map(numbers.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[:1] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done:done + step] = out[:step] * np.uint64(int(out[done - 1]) * int(base) & (1 << 64) - 1)
        done += step
    return out


#: Base of the run hashes, modulo 2^64, and its inverse.
_BASE = _ODD
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))


def run_hashes(numbers: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` numbers, equal for equal runs wherever they start."""
    n = len(numbers)
    if n < width:
        return np.empty(0, np.uint64)
    tables = kept("words powers", dict)
    if tables.get("n", 0) <= n:
        tables.update(n=2 * n + 1024, up=powers(2 * n + 1024, _BASE), down=powers(2 * n + 1024, _INVERSE))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(numbers * tables["up"][:n], out=sums[1:])
    return mixed((sums[width:] - sums[:-width]) * tables["down"][:n - width + 1])
