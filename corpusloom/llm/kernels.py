"""Vectorised byte kernels over batches of texts: words, polynomial hashes, blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in blocks of about so many bytes; a longer text is a block of its own.
BLOCK = 1 << 21

_RNG = np.random.default_rng(20240607)
#: Hashes are polynomials modulo this prime, one in each of two bases drawn once; no text cancels both for a reason of its own.
PRIME = (1 << 31) - 1
BASES = [int(b) for b in _RNG.integers(1 << 20, PRIME - 1, 2)]
#: A code of each byte value for each base.
CODE = _RNG.integers(1, PRIME, (2, 256), dtype=np.uint64)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for any x."""
    p, bits = np.uint64(PRIME), np.uint64(31)
    x = (x & p) + (x >> bits)
    x = (x & p) + (x >> bits)
    return np.where(x >= p, x - p, x)


def powers(base: int, n: int, _kept: dict = {}) -> np.ndarray:  # noqa: B006
    """base**0 .. base**(n-1) modulo PRIME, kept between calls and grown by doubling."""
    have = _kept.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.ones(1, np.uint32)
        while len(have) < size:
            step = np.uint64(pow(base, len(have), PRIME))
            have = np.concatenate([have, _reduced(have.astype(np.uint64) * step).astype(np.uint32)])
        _kept[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finish of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Elements that the running sums are made of at a time, so that they stay in a core's cache.
_STEP = 1 << 14


def _running(n: int, codes: Callable[[int, slice], np.ndarray]) -> np.ndarray:
    """Per base the running sums of codes times powers, each term below 2**32, which sums of 2**31 terms cannot overflow."""
    out = np.zeros((2, n + 1), np.uint64)
    p, bits = np.uint64(PRIME), np.uint64(31)
    for k, base in enumerate(BASES):
        scale, upto = powers(base, n), np.uint64(0)
        for at in range(0, n, _STEP):
            part = slice(at, min(at + _STEP, n))
            x = codes(k, part) * scale[part]
            high = x >> bits
            x &= p
            x += high
            x[0] += upto
            np.cumsum(x, out=out[k, part.start + 1 : part.stop + 1])
            upto = out[k, part.stop]
    return out


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums of bytes, one longer than data; span_hash() turns them into hashes of spans."""
    return _running(len(data), lambda k, part: CODE[k][data[part]])


def prefix_hash_of(values: np.ndarray) -> np.ndarray:
    """prefix_hash() for whole numbers of any size."""
    x = mix(values.astype(np.uint64) + np.uint64(1))
    both = [_reduced(x), _reduced(mix(x))]
    return _running(len(x), lambda k, part: both[k][part])


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], equal for equal bytes wherever they stand."""
    both = []
    for lane, base in zip(prefix, BASES):
        shift = powers(pow(base, -1, PRIME), len(lane))[start]
        both.append(_reduced(_reduced(lane[end] - lane[start]) * shift))
    return mix((both[0] << np.uint64(31) | both[1]) + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def blocks(texts: list[bytes | None], size: int = BLOCK) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of consecutive texts of about size bytes, each with the index of its first; null counts as empty."""
    first, held, total = 0, [], 0
    for i, t in enumerate(texts):
        t = t or b""
        if held and total + len(t) > size:
            yield first, held
            first, held, total = i, [], 0
        held.append(t)
        total += len(t) + 1
    if held:
        yield first, held


def column_bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    col = batch.column(batch.schema.get_field_index(name))
    return col.cast(pa.large_binary()).to_pylist()


def joined(held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One array of the texts with a newline after each, and the n + 1 offsets."""
    data = np.frombuffer(b"\n".join([*held, b""]), np.uint8)
    at = np.zeros(len(held) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in held], out=at[1:])
    return data, at


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without white space; data ends with white space."""
    space = np.empty(len(data) + 1, bool)
    space[0] = True
    space[1:] = IS_SPACE[data]
    turns = np.flatnonzero(space[1:] != space[:-1])
    return turns[0::2], turns[1::2]
