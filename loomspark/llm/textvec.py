"""Vectorised word work on UTF-8 bytes, shared by the operators of this folder.

Documents are handled as byte strings and glued into buffers of about
``CHUNK`` bytes, so that one numpy call covers many short texts while a single
very long text only ever costs memory in proportion to itself.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text per numpy buffer; a longer text gets a buffer of its own.
CHUNK = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _table(extra_separators: Iterable[int], lower: bool, keep: Iterable[int]) -> np.ndarray:
    """256 entries: 0 for a separator, else the byte's value (A-Z folded if ``lower``)."""
    t = np.arange(256, dtype=np.uint8)
    if lower:
        t[65:91] += 32
    wanted = set(keep) - set(extra_separators)
    for b in range(256):
        if b not in wanted:
            t[b] = 0
    return t


#: Words of letters, digits and everything beyond ASCII, A-Z folded to a-z.
FOLDED = _table((), True, [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
#: Words split at ASCII white space only.  NUL counts as a letter there and is handled apart.
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                size = max(n, CHUNK + 65536)
                up, down = np.full(size, _BASE), np.full(size, _BASE_INV)
                up[0] = down[0] = 1
                np.multiply.accumulate(up, out=up)
                np.multiply.accumulate(down, out=down)
            if n > 4 * CHUNK:  # for one very long text: not kept
                return up, down
            self.up, self.down = up, down
        return self.up, self.down


_POWERS = _Powers()


def word_bounds(buf: np.ndarray, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words of a byte buffer (white-space words without a table)."""
    inside = np.zeros(len(buf) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACES[buf] if table is None else table[buf] != 0
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(buf: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of the words and a 64-bit hash of each folded word.

    The hash is polynomial modulo 2**64, read off prefix sums, so its cost is a
    few operations per byte whatever the number of words.
    """
    starts, ends = word_bounds(buf, table)
    up, down = _POWERS.upto(len(buf) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.multiply(table[buf], up[: len(buf)], out=sums[1:], dtype=np.uint64, casting="unsafe")
        np.add.accumulate(sums, out=sums)
        h = (sums[ends] - sums[starts]) * down[starts]
        h = mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return starts, ends, h


def glued(texts: list[bytes], limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Buffers of consecutive texts: first index, index after the last, bytes, start offset of each text.

    One newline stands between texts, so no word reaches across.
    """
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) <= limit):
            size += len(texts[last]) + 1
            last += 1
        part = texts[first:last]
        begin = np.zeros(len(part) + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in part], out=begin[1:])
        yield first, last, np.frombuffer(b"\n".join(part) + b"\n", dtype=np.uint8), begin
        first = last


def bytes_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]
