"""Hashes of words and of word shingles, for many texts at once, in numpy.

A word is a run of bytes other than 9-13 and 32, with A-Z lower-cased.  Its hash is the
difference of two prefix sums of byte * P^place, divided by P^start: a polynomial in
its own bytes modulo 2^64, mixed.  Buffers are cut at white space, so a buffer holds a bounded part of
whatever text, but for a word longer than that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BUFFER = 1 << 20
U = np.uint64
P, P_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_powers: dict[int, np.ndarray] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads each bit over all others."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        rise = np.full(max(n, BUFFER + 1), base, U)
        rise[0] = 1
        have = _powers[base] = np.cumprod(rise, dtype=U)
    return have[:n]


def _buffers(texts: list[bytes]) -> Iterator[tuple[bytes, list[int], list[int]]]:
    """Bytes, the numbers of the texts in them, and where each ends; a long text comes in several buffers."""
    parts: list[bytes] = []
    numbers: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        at = 0
        if len(text) > BUFFER and parts:  # hashes come text after text
            yield b" ".join(parts), numbers, np.cumsum([len(p) + 1 for p in parts]).tolist()
            parts, numbers, size = [], [], 0
        while len(text) - at > BUFFER:
            cut = max(text.rfind(c, at, at + BUFFER) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if cut <= at:
                found = [x for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (x := text.find(c, at + BUFFER)) >= 0]
                cut = min(found, default=len(text) - 1)
            yield text[at : cut + 1], [i], [cut + 1 - at]
            at = cut + 1
        if size + len(text) - at > BUFFER and parts:
            yield b" ".join(parts), numbers, np.cumsum([len(p) + 1 for p in parts]).tolist()
            parts, numbers, size = [], [], 0
        parts.append(text[at:] if at else text)
        numbers.append(i)
        size += len(text) - at + 1
    if parts:
        yield b" ".join(parts), numbers, np.cumsum([len(p) + 1 for p in parts]).tolist()


def words_of(texts: list[str | None], shapes: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Hashes of all words, text after text; how many each text has; with ``shapes`` a small code of each word's form.  A null text is empty."""
    hashes, forms, counts = [], [], np.zeros(len(texts), np.int64)
    for data, numbers, ends_at in _buffers([(t or "").encode("utf-8", "surrogatepass") for t in texts]):
        b = np.frombuffer(data, np.uint8)
        blank = np.concatenate([[True], (b == 32) | ((b >= 9) & (b <= 13)), [True]])
        turn = np.flatnonzero(blank[1:] != blank[:-1])
        start, stop = turn[::2], turn[1::2]
        low = b + (((b >= 65) & (b <= 90)) * np.uint8(32))
        total = np.zeros(len(b) + 1, U)
        np.cumsum((low.astype(U) + U(1)) * _power(P, len(b)), out=total[1:])
        size = (stop - start).astype(U)
        h = mixed((total[stop] - total[start]) * _power(P_INVERSE, len(b) + 1)[start] + size * U(0xC2B2AE3D27D4EB4F))
        hashes.append(h)
        counts[numbers] += np.bincount(np.searchsorted(ends_at, start, "right"), minlength=len(numbers))
        if shapes:
            has = np.concatenate([[0], np.cumsum(SYMBOLS[b], dtype=np.int32)])
            digits = np.concatenate([[0], np.cumsum((b >= 48) & (b <= 57), dtype=np.int32)])
            first, last = b[start], b[stop - 1]
            upper, other = (first >= 65) & (first <= 90), (last < 128) & ~(((last | 32) >= 97) & ((last | 32) <= 122)) & ~((last >= 48) & (last <= 57))
            again = np.concatenate([[False], h[1:] == h[:-1]])[: len(h)]
            form = np.minimum(size, U(15)).astype(np.int64)
            for x in (has[stop] > has[start], digits[stop] > digits[start], upper, other, again):
                form = form * 2 + x
            forms.append(form)
    return np.concatenate(hashes) if hashes else np.zeros(0, U), counts, (np.concatenate(forms) if forms else np.zeros(0, np.int64)) if shapes else None


def _odd(n: int) -> list[np.uint64]:
    return [U(int(x) | 1) for x in mixed(np.arange(1, n + 1, dtype=U))]


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Each text's set: sorted distinct hashes of ``width`` words in a row; of the whole sequence where a text has fewer; empty without words."""
    h, counts, _ = words_of(texts)
    factors = _odd(width)
    joined = np.zeros(max(0, len(h) - width + 1), U)
    for j, f in enumerate(factors):
        joined += h[j : j + len(joined)] * f
    joined = mixed(joined)
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(joined[at : at + n - width + 1]))
        elif n:
            out.append(mixed(np.array([sum((int(x) * int(f) for x, f in zip(h[at : at + n], factors, strict=False)), 0x51ED270B * n) % (1 << 64)], U)))
        else:
            out.append(np.zeros(0, U))
        at += n
    return out


def minhash(own: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least 32-bit hash of a set under each factor; all ones for an empty set."""
    least = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(own), 4096):
        part = (own[at : at + 4096, None] * factors[None, :]) >> U(32)
        np.minimum(least, part.min(axis=0).astype(np.uint32), out=least)
    return least


def minhash_factors(k: int, seed: int = 1) -> np.ndarray:
    return mixed(np.arange(seed * 1_000_003, seed * 1_000_003 + k, dtype=U)) | U(1)
