"""Hashes of words and word shingles for whole batches of texts, as numpy arrays inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
PIECE_BYTES = 4_000_000

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.RandomState(20240501)
_BYTE = _rng.randint(1, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_powers = {"n": 0}


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values: every bit of the result depends on all of x."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64, up to n."""
    if _powers["n"] < n:
        size = max(n, PIECE_BYTES // 4)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        up, down = np.full(size, _BASE), np.full(size, inverse)
        up[0] = down[0] = 1
        _powers.update(n=size, up=np.cumprod(up), down=np.cumprod(down))
    return _powers["up"], _powers["down"]


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each blank-separated word of data: a polynomial over its bytes, from prefix sums."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    ink = ~_BLANK[raw]
    edge = np.diff(np.concatenate(([False], ink, [False])).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _power(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))


def words_of_texts(texts: list[str | None], lower: bool = True) -> Iterator[tuple[int, np.ndarray]]:
    """(index, word hashes) of each text, in order; texts are hashed together up to PIECE_BYTES, longer ones in pieces."""
    held, size = [], 0

    def flush() -> Iterator[tuple[int, np.ndarray]]:
        nonlocal held, size
        sep = b"\n"
        data = sep.join(b for _, b in held)
        hashes = word_hashes(data)
        raw = np.frombuffer(data, np.uint8)
        ink = ~_BLANK[raw] if len(raw) else np.zeros(0, bool)
        starts = np.flatnonzero(ink & ~np.concatenate(([False], ink[:-1]))) if len(raw) else np.zeros(0, int)
        bounds = np.cumsum([0] + [len(b) + 1 for _, b in held])
        cuts = np.searchsorted(starts, bounds)
        for k, (i, _) in enumerate(held):
            yield i, hashes[cuts[k] : cuts[k + 1]]
        held, size = [], 0

    for i, t in enumerate(texts):
        b = ((t or "").lower() if lower else (t or "")).encode("utf-8", "surrogatepass")
        if len(b) > PIECE_BYTES:
            yield from flush()
            parts, at = [], 0
            while at < len(b):
                stop = at + PIECE_BYTES
                while stop < len(b) and not _BLANK[b[stop]]:
                    stop += 1
                parts.append(word_hashes(b[at:stop]))
                at = stop
            yield i, np.concatenate(parts)
            continue
        held.append((i, b))
        size += len(b)
        if size > PIECE_BYTES // 4:
            yield from flush()
    yield from flush()


def shingle_hashes(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Hash of every window of n words; a text of fewer words is one window; no words, none."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out += words[k : len(words) - n + 1 + k] * _STEP[k % 5]
    return mix(out + np.uint64(n))
