"""Vectorised 64-bit hashes of words and word shingles, for use inside tasks.

A word's hash is a polynomial over its bytes (each byte mapped to a random 64-bit value) modulo 2**64, from
differences of one running sum over the whole buffer, then mixed. Equal words always have equal hashes, on any
machine; different words collide with a probability near 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

U64 = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(0, 2**64, 256, dtype=U64)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_STEP = _RNG.integers(0, 2**64, 8, dtype=U64) | U64(1)
#: Bytes hashed at once; buffers are cut between words, so longer texts need no more memory than this.
PIECE = 1 << 18

#: Separators of the near-duplicate operators: space and 0x09 to 0x0D.
BLANKS = np.zeros(256, dtype=bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
#: Separators that leave letters, digits and bytes above 0x7F.
NOT_ALNUM = np.array([not (chr(b).isalnum() or b >= 0x80) for b in range(256)])
LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


_POW, _INV = _powers(_BASE, 1 << 16), _powers(_INVERSE, 1 << 16)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        size = 1 << (n - 1).bit_length()
        _POW, _INV = _powers(_BASE, size), _powers(_INVERSE, size)
    return _POW, _INV


def hash_words(buf: bytes, blanks: np.ndarray = BLANKS, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Hash and start of each word of ``buf`` (A-Z lower-cased), and for each length in ``prefixes`` the hash of its first bytes."""
    data = np.frombuffer(buf, dtype=np.uint8)
    hashes, begins, heads = [], [], [[] for _ in prefixes]
    at, n = 0, len(data)
    while at < n:
        to = min(n, at + PIECE)
        while to < n and not blanks[data[to]]:  # on to the next separator
            step = blanks[data[to : to + 4096]]
            to += int(step.argmax()) if step.any() else len(step)
        part = data[at:to]
        inside = ~blanks[part]
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
        start, end = edge[::2], edge[1::2]
        if len(start):
            pow_, inv = _tables(len(part) + 1)
            total = np.zeros(len(part) + 1, dtype=U64)
            np.cumsum(_BYTE[LOWER_ASCII[part]] * pow_[: len(part)], out=total[1:])
            code = lambda stop: mix((total[stop] - total[start]) * inv[start] + (stop - start).astype(U64) * _STEP[7])  # noqa: E731, B023
            hashes.append(code(end))
            begins.append(start + at)
            for out, k in zip(heads, prefixes, strict=True):
                out.append(mix(code(np.minimum(start + k, end)) + U64(k)))
        at = to
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, dtype=kind)
    return join(hashes, U64), join(begins, np.int64), [join(h, U64) for h in heads]


def combine(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` neighbouring words."""
    if len(words) < k:
        return np.zeros(0, dtype=U64)
    total = np.full(len(words) - k + 1, k, dtype=U64)
    for j in range(k):
        total += words[j : len(words) - k + 1 + j] * _STEP[j % 8] + U64(j)
    return mix(total)


def batches(texts: Iterable[str | None], limit: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, UTF-8 texts) in runs of about ``limit`` bytes (a longer text is a run of its own); null counts as empty."""
    first, size, run = 0, 0, []
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
        if run and size + len(raw) > limit:
            yield first, run
            first, size, run = i, 0, []
        run.append(raw)
        size += len(raw)
    if run:
        yield first, run


def shingle_sets(texts: Iterable[str | None], k: int = 5) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct hashes of its ``k``-word shingles (as unsigned 64-bit integers).

    A text of fewer words gives one value for its whole sequence; a text without words an empty array.
    """
    for _, run in batches(texts):
        ends = np.cumsum([len(raw) + 1 for raw in run])
        hashes, begins, _ = hash_words(b" ".join(run))
        cut = np.searchsorted(begins, ends)
        grams = combine(hashes, k)
        low = 0
        for high in cut.tolist():
            if high - low >= k:
                yield np.unique(grams[low : high - k + 1])
            elif high > low:
                yield combine(hashes[low:high], high - low)
            else:
                yield np.zeros(0, dtype=U64)
            low = high
