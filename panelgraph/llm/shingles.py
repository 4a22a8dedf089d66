"""Word shingles of texts as 64-bit hashes, on executors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

WIDTH = 5
#: Bytes of text that are hashed at a time, and of the texts of a part.
BLOCK, PART_BYTES = 1 << 18, 1 << 22
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
#: A word is a polynomial of its bytes' random numbers at BASE, modulo 2**64; BASE is odd, so it has an inverse.
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.append(np.uint64(1), np.full(BLOCK, base, np.uint64)))


_POWERS, _INVERSES = _powers(_BASE), _powers(_INVERSE)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hash) of each word of data, which ends with a space; a block of it at a time."""
    raw = np.frombuffer(data, np.uint8)
    begin, at_begin, at_end = [], [], []
    total, inside = np.uint64(0), False
    for off in range(0, len(raw), BLOCK):
        b = raw[off : off + BLOCK]
        up, down = np.uint64(pow(_BASE, off, 1 << 64)), np.uint64(pow(_INVERSE, off, 1 << 64))
        upto = np.empty(len(b) + 1, np.uint64)  # the sum before each byte
        upto[0] = total
        np.cumsum(_BYTES[b] * _POWERS[: len(b)] * up, out=upto[1:])
        upto[1:] += total
        space = np.concatenate([[not inside], _SPACE[b]])
        first = np.flatnonzero(space[:-1] & ~space[1:])
        end = np.flatnonzero(~space[:-1] & space[1:])
        begin.append(first + off)
        # The sums at a word's ends, made independent of its place in the text.
        at_begin.append(np.stack([upto[first], _INVERSES[first] * down]))
        at_end.append(upto[end])
        total, inside = upto[-1], not space[-1]
    low, shift = np.concatenate(at_begin, axis=1)
    return np.concatenate(begin), mix((np.concatenate(at_end) - low) * shift)


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """Of each text the sorted hashes of its distinct shingles; of a shorter text the whole sequence as one; of no words none.

    Words are what lies between spaces, tabs and line ends, with A-Z in lower case.
    """
    if not len(texts):
        return []
    bounds = np.frombuffer(texts.buffers()[1], np.int32 if texts.type == pa.string() else np.int64)[texts.offset : texts.offset + len(texts) + 1].tolist()
    data = memoryview(texts.buffers()[2]) if texts.buffers()[2] is not None else memoryview(b"")
    pieces = [data[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
    first, h = _words((b"\n".join(pieces) + b"\n").translate(_LOWER))
    start = np.concatenate([[0], np.cumsum([len(p) + 1 for p in pieces])])
    cut = np.searchsorted(first, start).tolist()
    m = max(0, len(h) - width + 1)
    acc = h[:m].copy()
    for k in range(1, width):
        acc *= _MUL
        acc += h[k : k + m]
    acc = mix(acc)
    out = []
    for a, b in zip(cut, cut[1:], strict=False):
        if b - a >= width:
            s = np.sort(acc[a : b - width + 1])
            s = s[np.append(True, s[1:] != s[:-1])]
        else:  # the number of words takes part, so no such sequence equals a part of a longer one
            s = np.array([int.from_bytes(hashlib.blake2b(h[a:b].tobytes(), digest_size=8).digest(), "little")], np.uint64)[: b - a]
        out.append(s)
    return out


def parts(batches: Iterator[pa.RecordBatch], column: int = 1, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Slices of batches of at most `rows` rows whose texts have PART_BYTES at most, or of one row."""
    for batch in batches:
        text = batch.column(column)
        ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(text), 0)).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            upto = min(max(int(np.searchsorted(ends, before + PART_BYTES, "right")), at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, upto - at)
            at = upto


def digest(shingles: np.ndarray, seed: int = 0) -> tuple[int, int]:
    """128 bits of a set as two signed longs."""
    d = hashlib.blake2b(shingles.tobytes(), digest_size=16, salt=seed.to_bytes(16, "little")).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)
